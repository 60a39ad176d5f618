"""Substring dedup: sparse suffix trees over prefix groups.

Only suffixes that start at *anchors* are kept: in each window of ``length`` words the ``prefix`` consecutive words of least
hash.  Two equal windows have their anchor at the same offset, so every repeat of a whole window meets under its anchor's
words, which are the suffixes' common prefix and their group.  A first pass counts anchors and leaves those that occur once.
Groups are memory-sized: where a prefix is too frequent its suffixes are keyed by longer ones, the whole window at each
offset, of which a batch of documents sends only its first; the rest are known to be repeats.  Such a group is one node, so
its suffixes come sorted by document and position and are walked, never held.  Other groups' suffixes, and their
left contexts read backwards, are sorted; common-prefix lengths of neighbours are the internal nodes of the two trees, and
suffixes below one node pair of joint depth ``length`` are the occurrences of one repeated window.  All but the first by
document and position are marked.

Words are compared by 64-bit hashes, in anchors and windows and one by one beside an anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, mix, span_hashes, string_buffers, text_chunks, window_hashes, word_spans

_U = np.uint64


@dataclass(frozen=True)
class RepeatParams:
    """``hot``: occurrences of an anchor from which its group is split.  ``batch_bytes``: text of a batch of documents."""

    length: int = 20
    prefix: int = 8
    hot: int = 1000
    batch_bytes: int = 4 << 20
    #: Suffixes whose trees are built in one step; a group, of ``hot`` suffixes at most, is never divided.
    step: int = 50_000

    @property
    def side(self) -> int:
        """Words of context on either side of an anchor; also the highest offset of an anchor in a window."""
        return self.length - self.prefix


def anchors(words: np.ndarray, bounds: np.ndarray, params: RepeatParams) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of all documents, whose words are ``words[bounds[i]:bounds[i + 1]]``."""
    k, w = params.prefix, params.side + 1
    grams = window_hashes(words, k)
    n = len(words) - params.length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Least gram of each window, leftmost among equals, by doubling.
    least, span = np.arange(len(grams)), 1
    while span < w:
        step = min(span, w - span)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(grams[b] < grams[a], b, a)
        span += step
    last = np.repeat(bounds[1:], np.diff(bounds))[:n]
    inside = np.arange(n) + params.length <= last
    at = np.unique(least[:n][inside])
    return at, grams[at]


class _Batch:
    """Words of one batch of documents."""

    def __init__(self, table: pa.Table | pa.RecordBatch, text: str):
        column = table.column(text)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        self.data, self.offsets = string_buffers(column)
        # Hashes take many bytes for one of text, so they are made a chunk at a time.
        parts, self.ends, counts, at = [], [], [np.zeros(1, np.int64)], 0
        for chunk in text_chunks([pa.RecordBatch.from_arrays([column], ["text"])], 0):
            data, offsets = string_buffers(chunk.column(0))
            starts, ends, bounds = word_spans(data, offsets)
            parts.append(span_hashes(data, starts, ends))
            self.ends.append(ends + at)
            counts.append(np.diff(bounds))
            at += len(data)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.bounds = np.cumsum(np.concatenate(counts))
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


_LEAF = "key long, doc_id long, rk long, b int, pos int, left int, right int, only int, mask int, words binary"
_MARK = "b int, rk long, pos int, mask int"


def mark_repeats(batched: DataFrame, params: RepeatParams) -> DataFrame:
    """``(b, rk, pos, mask)`` from ``(b, rk, doc_id, text)``: bit i of the mask says that the window ``i`` words before the
    anchor at word ``pos`` starts earlier elsewhere.  ``b`` is a row's batch, ``rk`` names its text."""
    side, k, length = params.side, params.prefix, params.length
    text_at, b_at = batched.columns.index("text"), batched.columns.index("b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, text_at):
            x = _Batch(chunk, "text")
            at, h = anchors(x.words, x.bounds, params)
            b = chunk.column(b_at).to_numpy()[x.doc[at]]
            order = np.lexsort((b, h))
            h, b = h[order], b[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
            place = np.flatnonzero(first)
            n = np.diff(np.append(place, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[place].view(np.int64)), pa.array(b[place].astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "b", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors that occur twice or more, for each batch that has them; rows come sorted by anchor."""
        held: list[np.ndarray] = []
        hot_key = None

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if rows.shape[1]:
                bounds = np.concatenate([[0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1])
                total = np.add.reduceat(rows[2], bounds)
                total = np.repeat(total, np.diff(np.append(bounds, rows.shape[1])))
                keep = (total > 1) | (rows[0] == hot_key if hot_key is not None else False)
                hot = (total > params.hot) | (rows[0] == hot_key if hot_key is not None else False)
                yield pa.RecordBatch.from_arrays([pa.array(rows[1, keep].astype(np.int32)), pa.array(rows[0, keep]), pa.array(hot[keep])], ["b", "h", "hot"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            rows = np.concatenate([*held, rows], 1)
            change = np.flatnonzero(rows[0, 1:] != rows[0, :-1])
            tail = int(change[-1]) + 1 if len(change) else 0
            yield from out(rows[:, :tail])
            rest = rows[:, tail:]
            if rest[2].sum() > params.hot:  # surely hot: no need to hold it
                hot_key = rest[0, 0]
                yield from out(rest)
                rest = rest[:, :0]
            held = [rest]
        if held:
            yield from out(held[0])

    def leaves(docs: pa.Table, known: pa.Table) -> pa.Table:
        out = {c.split()[0]: [] for c in _LEAF.split(", ")}

        def emit(key, row, pos, left, right, only, mask, words):
            out["key"].append(key)
            out["doc_id"].append(ids[row])
            out["rk"].append(rks[row])
            out["pos"].append(pos)
            out["left"].append(left)
            out["right"].append(right)
            out["only"].append(only)
            out["mask"].append(mask)
            out["words"].append(words)

        n_rows = 0
        if docs.num_rows and known.num_rows:
            x = _Batch(docs, "text")
            ids, rks, b = _column(docs, "doc_id"), _column(docs, "rk"), int(docs.column("b")[0].as_py())
            h_known, first = np.unique(_column(known, "h").view(np.uint64), return_index=True)
            hot_known = known.column("hot").to_numpy()[first]
            at, h = anchors(x.words, x.bounds, params)
            place = np.minimum(np.searchsorted(h_known, h), len(h_known) - 1)
            there = h_known[place] == h
            at, h, hot = at[there], h[there], hot_known[place[there]]
            row = x.doc[at]
            pos = at - x.bounds[row]
            left, right = np.minimum(side, pos), np.minimum(side, x.bounds[row + 1] - at - k)
            def context(a: np.ndarray) -> np.ndarray:
                before = np.arange(-1, -side - 1, -1)
                after = np.arange(k, k + side)
                return x.words[np.clip(a[:, None] + np.concatenate([before, after]), 0, len(x.words) - 1)]

            cold = ~hot
            emit(h[cold].view(np.int64), row[cold], pos[cold], left[cold], right[cold], np.full(cold.sum(), -1), np.zeros(cold.sum(), np.int64), context(at[cold]))
            n_rows += int(cold.sum())
            if hot.any():
                a, r, p, lf, rt = at[hot], row[hot], pos[hot], left[hot], right[hot]
                i = np.arange(side + 1)
                ok = (i <= lf[:, None]) & (side - i <= rt[:, None])
                which, off = np.nonzero(ok)
                wins = window_hashes(x.words, length)
                key = mix(wins[a[which] - off] + _U(0x2545F4914F6CDD1D) * off.astype(np.uint64))
                order = np.lexsort((p[which], rks[r[which]], ids[r[which]], key))
                key_s = key[order]
                new = np.ones(len(order), bool)
                new[1:] = key_s[1:] != key_s[:-1]
                head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
                earlier = (ids[r[which[order]]] != ids[r[which[head]]]) | (p[which[order]] - off[order] != p[which[head]] - off[head])
                mask = np.zeros(len(a), np.int64)
                late = order[earlier]
                np.bitwise_or.at(mask, which[late], 1 << off[late])
                done = np.flatnonzero(mask)
                emit(mix(rks[r[done]].view(np.uint64) + p[done].astype(np.uint64)).view(np.int64), r[done], p[done], lf[done], rt[done], np.full(len(done), -2), mask[done], np.zeros((len(done), 0), np.uint64))
                send = order[~earlier]
                w = which[send]
                emit(key[send].view(np.int64), r[w], p[w], lf[w], rt[w], off[send], np.zeros(len(send), np.int64), np.zeros((len(send), 0), np.uint64))
                n_rows += len(done) + len(send)
        arrays = []
        kinds = {"long": (np.int64, pa.int64()), "int": (np.int32, pa.int32())}
        for c in _LEAF.split(", "):
            name, kind = c.split()
            if name == "b":
                arrays.append(pa.array(np.full(n_rows, b if n_rows else 0, np.int32)))
            elif kind == "binary":
                sizes = np.concatenate([np.full(len(wd), 8 * wd.shape[1]) for wd in out[name]]) if n_rows else np.zeros(0, np.int64)
                raw = b"".join(np.ascontiguousarray(wd).tobytes() for wd in out[name])
                offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                arrays.append(pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(raw)]))
            else:
                arrays.append(pa.array(np.concatenate(out[name]).astype(kinds[kind][0]) if n_rows else np.zeros(0, kinds[kind][0]), kinds[kind][1]))
        return pa.table(arrays, [c.split()[0] for c in _LEAF.split(", ")])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, head = 0, None
        for batch in batches:
            only = _column(batch, "only")
            if (only != -1).any():
                settled, head = walk(batch.filter(pa.array(only != -1)), head)
                yield settled
                batch = batch.filter(pa.array(only == -1))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= params.step:
                table = pa.Table.from_batches(held).combine_chunks()
                key = _column(table, "key")
                change = np.flatnonzero(key[1:] != key[:-1])
                if len(change):
                    cut = int(change[-1]) + 1
                    yield from build(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = table.num_rows - cut
        if size:
            yield from build(pa.Table.from_batches(held).combine_chunks())

    def walk(batch: pa.RecordBatch, head: tuple[int, int, int] | None) -> tuple[pa.RecordBatch, tuple[int, int, int] | None]:
        """Marks of suffixes whose windows are keyed whole: all but their group's first, which ``head`` carries on."""
        only, mask = _column(batch, "only"), _column(batch, "mask").astype(np.int64)
        at = np.flatnonzero(only >= 0)
        if len(at):
            key, doc, pos = (_column(batch, c)[at].astype(np.int64) for c in ("key", "doc_id", "pos"))
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            head_doc, head_pos = doc[first], pos[first]
            if head is not None and head[0] == key[0]:
                head_doc[first == 0], head_pos[first == 0] = head[1], head[2]
            mask[at[(doc != head_doc) | (pos != head_pos)]] = 1 << only[at[(doc != head_doc) | (pos != head_pos)]].astype(np.int64)
            head = (int(key[-1]), int(head_doc[-1]), int(head_pos[-1]))
        done = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(done)) for c in ("b", "rk", "pos")), pa.array(mask[done].astype(np.int32))], ["b", "rk", "pos", "mask"]), head

    def build(table: pa.Table) -> Iterator[pa.RecordBatch]:
        words = table.column("words").combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        raw = np.frombuffer(words.buffers()[2], np.uint64, table.num_rows * 2 * side, words.offset * 16 * side).reshape(-1, 2 * side)
        mask = window_marks(_column(table, "key"), _column(table, "doc_id"), _column(table, "pos").astype(np.int64), _column(table, "left"), _column(table, "right"), raw[:, :side], raw[:, side:])
        done = np.flatnonzero(mask)
        if len(done):
            rows = table.select(["b", "rk", "pos"]).take(pa.array(done)).append_column("mask", pa.array(mask[done].astype(np.int32)))
            yield from rows.combine_chunks().to_batches()

    # All columns, so that each pass reads the same exchange of the documents.
    found = batched.mapInArrow(count, "h long, b int, n int")
    known = found.repartition("h").sortWithinPartitions("h").mapInArrow(shared, "b int, h long, hot boolean")
    suffixes = batched.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(leaves, _LEAF)
    return suffixes.repartition("key").sortWithinPartitions("key", "doc_id", "pos").mapInArrow(trees, _MARK)


def _nodes(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Ids of the tree nodes that each suffix passes: column d for depth d, by sorting and common-prefix lengths."""
    n, side = words.shape
    order = np.lexsort((*[words[:, d] for d in range(side - 1, -1, -1)], key))
    k, w = key[order], words[order]
    same = np.ones((n, side + 1), bool)
    same[0] = False
    same[1:, 0] = k[1:] == k[:-1]
    same[1:, 1:] = w[1:] == w[:-1]
    common = np.logical_and.accumulate(same, axis=1)  # up to the common-prefix length of neighbours
    ids = np.empty((n, side + 1), np.int64)
    ids[order] = np.cumsum(~common, axis=0)
    return ids


def window_marks(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each suffix the mask of windows that start earlier in their group.

    ``before`` has the words left of the anchor, nearest first, ``after`` those right of it; ``left`` and ``right`` are how
    many of them the document has.
    """
    n, side = after.shape
    right_nodes, left_nodes = _nodes(key, after), _nodes(key, before)
    marks = np.zeros(n, np.int64)
    for i in range(side + 1):
        use = np.flatnonzero((i <= left) & (side - i <= right))
        if len(use) < 2:
            continue
        node = right_nodes[use, side - i] * (n + 1) + left_nodes[use, i]
        order = np.lexsort((pos[use], doc[use], node))
        node = node[order]
        new = np.ones(len(order), bool)
        new[1:] = node[1:] != node[:-1]
        head = use[order[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        here = use[order]
        late = (doc[here] != doc[head]) | (pos[here] != pos[head])
        marks[here[late]] |= 1 << i
    return marks


def _none(table: pa.Table) -> pa.Array:
    """The text column with nulls again where they were."""
    column = table.column("text").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return pc.if_else(pa.array(~table.column("none").to_numpy()), column, pa.scalar(None, column.type))


_CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _integral(docs: DataFrame, id_col: str) -> bool:
    return docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a column ``number`` that orders rows as their ids do, and ``(own, number)`` of the ids; null stays null."""
    ids = docs.select(F.col(id_col).alias("own")).where("own is not null").distinct().orderBy("own")
    # Sorted partitions are numbered in order once they are materialised.
    ids = cut(cut(ids).withColumn("number", F.monotonically_increasing_id()))
    return docs.join(ids, F.col(id_col) == F.col("own"), "left").drop("own"), ids


def _rows(docs: DataFrame, params: RepeatParams, id_col: str, text_col: str) -> DataFrame:
    """``(b, rk, doc_id, text, missing)`` dealt to batches; a null id sorts last."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc_id"), F.col(id_col).isNull().alias("missing"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rk = F.xxhash64("doc_id", "text")
    return rows.select(F.pmod(rk, F.lit(batches_of(docs, params.batch_bytes, text_col))).cast("int").alias("b"), rk.alias("rk"), "doc_id", "text", "missing").repartition("b")


def _keep_mask(x: _Batch, rks: np.ndarray, marks: pa.Table, params: RepeatParams) -> np.ndarray:
    """Whether each word of the batch stays."""
    delta = np.zeros(len(x.words) + 1, np.int64)
    if marks.num_rows:
        order = np.argsort(rks, kind="stable")
        rk, pos, mask = _column(marks, "rk"), _column(marks, "pos").astype(np.int64), _column(marks, "mask").astype(np.int64)
        lo, hi = np.searchsorted(rks[order], rk, "left"), np.searchsorted(rks[order], rk, "right")
        for copy in range(int((hi - lo).max(initial=0))):  # repeated rows share their marks
            some = np.flatnonzero(lo + copy < hi)
            anchor = x.bounds[order[lo[some] + copy]] + pos[some]
            for i in range(params.side + 1):
                start = anchor[(mask[some] >> i) & 1 == 1] - i
                np.add.at(delta, start, 1)
                np.add.at(delta, start + params.length, -1)
    return np.cumsum(delta[:-1]) == 0


def cut_digests(docs: DataFrame, params: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row.

    A word is removed if a window of ``length`` consecutive words covers it whose words also start earlier: in a smaller
    doc_id, or earlier in the same document.  A null text has no words; null ids come after all others; rows with the same
    id count as one document, whose windows at the same place are not earlier than one another.  Ids that are no integers
    are ordered as Spark orders their type.  A very long text is a batch of its own.  An empty table gives no rows.
    """
    if not _integral(docs, id_col):
        docs, numbers = _numbered(docs.select(F.col(f"`{id_col}`").alias("c0"), F.col(f"`{text_col}`").alias("c1")), "c0")
        found = cut_digests(docs, params, "number", "c1").withColumnRenamed("doc_id", "number")
        return found.join(numbers, "number", "left").select(F.col("own").alias("doc_id"), "n_words", "n_removed", "kept_sha256")

    def finish(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], [c.split()[0] for c in _CUT.split(", ")])
        x = _Batch(table, "text")
        keep = _keep_mask(x, _column(table, "rk"), marks, params)
        raw = x.data.tobytes()
        shas = []
        for d, (a, b) in enumerate(zip(x.offsets[:-1], x.offsets[1:])):
            words = raw[a:b].split()
            flags = keep[x.bounds[d] : x.bounds[d + 1]]
            if not flags.all():
                words = [w for w, stay in zip(words, flags.tolist()) if stay]
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        n = np.diff(x.bounds)
        kept = np.concatenate([[0], np.cumsum(keep)])[x.bounds]
        ids = pa.array(_column(table, "doc_id"), mask=table.column("missing").to_numpy())
        return pa.table([ids, pa.array(n), pa.array(n - np.diff(kept)), pa.array(shas, pa.string())], [c.split()[0] for c in _CUT.split(", ")])

    rows = _rows(docs, params, id_col, text_col)
    return rows.groupBy("b").cogroup(mark_repeats(rows, params).groupBy("b")).applyInArrow(finish, _CUT)


def cut_repeats(docs: DataFrame, params: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the repeats cut out of the text.

    A text that loses nothing stays as it is; of another the remaining words stay, each with the white space before it.
    Rows follow :func:`cut_digests`: null and equal ids, ids that are no integers, long texts.  Null texts stay null.  Columns
    of any name pass through.  An empty table gives no rows.
    """
    from pyspark.sql import types as T

    names = docs.columns
    if not _integral(docs, id_col):
        inner = {c: f"c{i}" for i, c in enumerate(names)}
        renamed, _ = _numbered(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in inner.items()]), inner[id_col])
        return cut_repeats(renamed, params, "number", inner[text_col]).select(*[F.col(a).alias(c) for c, a in inner.items()])
    inner = {c: f"c{i}" for i, c in enumerate(names)}
    keyed = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in inner.items()])
    ident, body = inner[id_col], inner[text_col]
    rk_id, rk_text = F.coalesce(F.col(ident).cast("long"), F.lit(2**63 - 1)), F.coalesce(F.col(body).cast("string"), F.lit(""))
    rk = F.xxhash64(rk_id, rk_text)
    keyed = keyed.select(*[a for a in inner.values() if a != body], F.pmod(rk, F.lit(batches_of(docs, params.batch_bytes, text_col))).cast("int").alias("b"), rk.alias("rk"), rk_id.alias("doc_id"),
                         rk_text.alias("text"), F.col(body).isNull().alias("none")).repartition("b")
    fields = [T.StructField(inner[f.name], f.dataType) for f in docs.schema.fields]

    def finish(table: pa.Table, marks: pa.Table) -> pa.Table:
        whole = pa.table([table.column(f.name) if f.name != body else _none(table) for f in fields], [f.name for f in fields]) if table.num_rows else None
        if whole is None:
            return pa.table({f.name: pa.array([], table.schema.field(f.name if f.name != body else "text").type) for f in fields}) if table.num_columns else table
        kept = whole
        if not marks.num_rows:
            return kept
        x = _Batch(table, "text")
        keep = _keep_mask(x, _column(table, "rk"), marks, params)
        ends = np.concatenate(x.ends)
        lost = np.diff(np.concatenate([[0], np.cumsum(~keep)])[x.bounds]) > 0
        raw = x.data.tobytes()
        texts = kept.column(body).to_pylist()
        for d in np.flatnonzero(lost):
            a, b = x.bounds[d], x.bounds[d + 1]
            prior = np.concatenate([[x.offsets[d]], ends[a : b - 1]])
            flags = keep[a:b]
            left = b"".join(raw[p:e] for p, e in zip(prior[flags].tolist(), ends[a:b][flags].tolist()))
            texts[d] = left.decode("utf-8", "replace").lstrip(" \t\n\x0b\x0c\r")
        at = kept.schema.get_field_index(body)
        return kept.set_column(at, kept.schema.field(at), pa.array(texts, kept.schema.field(at).type))

    marks = mark_repeats(keyed, params)
    out = keyed.groupBy("b").cogroup(marks.groupBy("b")).applyInArrow(finish, T.StructType(fields))
    return out.select(*[F.col(a).alias(c) for c, a in inner.items()])
