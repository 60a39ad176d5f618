"""SimHash near-duplicates through an inverted index of positional bytes with count filtering.

Eight bytes make a group.  Two groups with at most three differing bits share at least five bytes at the same positions.
The index posts every distinct fingerprint under the fourteen blocks of the Steiner system S(3, 4, 8): four byte positions
each, such that any five positions contain a whole block.  So every pair with five shared bytes in a group meets under some
posting, and a posting is 32 bits selective, where single bytes would be 8.  Within a posting the shared positional bytes
of each pair are tallied, pairs below the guaranteed number are dropped, and the rest are verified bit by bit.  Only a
spanning set of the verified links leaves a posting.

:func:`simhash_components` links fingerprints of one group at three bits.  :func:`similar_components` links texts whose
5-word shingles are 0.8 alike: its prints have eight groups over distinct words, which edits change least, for the
index, and 2,048 bits over shingles, from whose angle similarity is verified.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, mix, span_hashes, string_buffers, text_chunks, window_hashes, word_spans
from .components import connected_components

SEED = 42
MAX_BITS = 3
MIN_SHARED_BYTES = 8 - MAX_BITS
#: Postings up to this size are walked at once; larger ones are first divided by groups of their varying bits.
POSTING_BLOCK = 2048
#: Texts of a family that one task holds; larger families are divided, and each two parts meet in a task.
FAMILY_ROWS = 16_384
#: Groups of a wide print's index; its bytes, and those of its shingles' part.
GROUPS, SHINGLE_BYTES = 8, 256
WIDE_BYTES = 8 * GROUPS
#: Bits of a sieve, sent to every executor as 131,072 words at most, whatever the number of its keys.
SIEVE_BITS = 1 << 23


def _blocks() -> list[tuple[int, ...]]:
    """The planes of the affine space AG(3, 2): four points whose exclusive or is zero."""
    out = []
    for a in range(8):
        for b in range(a + 1, 8):
            for c in range(b + 1, 8):
                if (d := a ^ b ^ c) > c:
                    out.append((a, b, c, d))
    return out


BLOCKS = _blocks()


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text; no words give zero."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = (2 * counts > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of each row, the fingerprint as a signed long.  A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            fps = [fingerprint(t.as_py(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _walk(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = 256, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, root) of ``n`` nodes: a found node is compared only with those not found yet.

    ``near(some, others)`` is the matrix of links.  Nodes that are all alike cost ``n`` comparisons, and no link's ends are left apart."""
    nodes, roots, left = [], [], np.arange(n)
    if n <= 2 * step:  # all at once
        found, label = near(left, left), left
        while True:
            new = np.where(found, label, n).min(1)
            if (new == label).all():
                break
            label = new
        nodes = np.flatnonzero(label != left)
        return nodes, label[nodes]
    while len(left):
        root, left = left[0], left[1:]
        waiting = [np.array([root])]
        while waiting and len(left):
            now = waiting.pop()
            for at in range(0, len(now), step):
                hit = np.concatenate([near(now[at : at + step], left[a : a + width]).any(0) for a in range(0, len(left), width)] or [np.zeros(0, bool)])
                if hit.any():
                    waiting.append(left[hit])
                    nodes.append(left[hit])
                    roots.append(np.full(len(nodes[-1]), root))
                    left = left[~hit]
    if not nodes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(nodes), np.concatenate(roots)


def _near_bits(fps: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tally of shared positional bytes, then of differing bits."""
    rows = fps.view(np.uint8).reshape(-1, 8)

    def near(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        shared = np.zeros((len(some), len(others)), np.uint8)
        for p in range(8):
            shared += rows[some, p][:, None] == rows[others, p]
        out = shared >= MIN_SHARED_BYTES
        a, b = np.nonzero(out)
        out[a, b] = np.bitwise_count(fps[some[a]] ^ fps[others[b]]) <= MAX_BITS
        return out

    return near


def _links_within(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links among distinct fingerprints that share one posting.

    Fingerprints of a large posting are dealt by every choice of all but :data:`MAX_BITS` of equal groups of its varying bits:
    a pair differs in at most so many groups and agrees in the rest.  More groups make parts smaller, until they fit."""
    m = len(fps)
    if m < 2:
        return
    spread = int(np.bitwise_or.reduce(fps ^ fps[0]))
    varied = [p for p in range(64) if spread >> p & 1]
    groups = MAX_BITS
    while groups < len(varied) and groups < 8 and m >> (len(varied) * (groups - MAX_BITS) // groups) > POSTING_BLOCK // 4 and m > POSTING_BLOCK:
        groups += 1
    masks = [np.uint64(sum(1 << p for p in bits)) for bits in ([p for g in some for p in varied[len(varied) * g // groups : len(varied) * (g + 1) // groups]]
                                                             for some in combinations(range(groups), groups - MAX_BITS))]
    for mask in masks:
        order = np.argsort(fps & mask, kind="stable")
        bounds = np.flatnonzero(np.diff((fps & mask)[order])) + 1
        for part in np.split(order, bounds):
            if len(part) > 1:
                x = fps[part]
                a, b = _walk(len(x), _near_bits(x))
                yield x[a], x[b]


def near_links(fps: DataFrame) -> DataFrame:
    """Spanning links ``(src, dst)`` among distinct fingerprints ``fp`` at :data:`MAX_BITS` or fewer differing bits."""

    def mask(block: tuple[int, ...]) -> int:
        return int(np.array([sum(255 << (8 * p) for p in block)], np.uint64).view(np.int64)[0])

    postings = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).cast("int").alias("block"), F.col("fp").bitwiseAND(F.lit(mask(b))).alias("key")) for i, b in enumerate(BLOCKS)])).alias("at"))
    postings = postings.select("at.block", "at.key", "fp").repartition("block", "key").sortWithinPartitions("block", "key")

    def links(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fps = np.unique(table.column("fp").to_numpy().view(np.uint64))
        for a, b in _links_within(fps):
            yield a.view(np.int64), b.view(np.int64)

    return postings.mapInArrow(lambda batches: _of_postings(batches, ["block", "key"], links), "src long, dst long")


def _of_postings(batches: Iterator[pa.RecordBatch], keys: list[str], links: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Links of each posting; rows come sorted by ``keys``, and a posting that goes on in the next batch is held in parts."""
    held: list[pa.RecordBatch] = []

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(links(pa.Table.from_batches(parts)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            if sum(p.num_rows for p in held) > 1:
                yield from emit(held)
            held = []
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        bounds = np.concatenate([[0], change, [batch.num_rows]])
        first = 0
        if held and len(bounds) > 2:
            yield from emit([*held, batch.slice(0, bounds[1])])
            held, first = [], 1
        for k in range(first, len(bounds) - 2):
            if bounds[k + 1] - bounds[k] > 1:
                yield from emit([batch.slice(bounds[k], bounds[k + 1] - bounds[k])])
        held.append(batch.slice(bounds[-2]))
    if sum(p.num_rows for p in held) > 1:
        yield from emit(held)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    Lower-cases A-Z only; fewer words than a shingle are one shingle; no words (null, empty or blank text) give
    fingerprint zero, which links like any other.  Rows with equal fingerprints share a class, whatever their number, so
    copies and repeated rows cost no pairs.  ``component_id`` is the smallest id reachable over links of at most three
    bits, null only where all ids of the component are null.  An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(near_links(classes))
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = joined.join(least, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return rows.join(labels, F.col("fp") == F.col("class_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _print(hashes: np.ndarray, size: int) -> bytes:
    """``size`` bytes of majority bits over 64-bit hashes, of which each eight bytes take their own mix."""
    out = []
    for word in range(size // 8):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 15):
            part = mix(hashes[at : at + (1 << 15)] + np.uint64(0x9E3779B97F4A7C15 * (word + 1) & (2**64 - 1)))
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out.append(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def wide_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, also: str | None = None) -> DataFrame:
    """``(doc_id, p)``: :data:`WIDE_BYTES` over a text's distinct words, then :data:`SHINGLE_BYTES` over its distinct shingles; with
    ``also`` that column of longs too, as ``x``.

    Lower-cases A-Z only; fewer words than a shingle are one shingle; no words give zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = bytes(WIDE_BYTES + SHINGLE_BYTES)
        for chunk in text_chunks(batches):
            data, offsets = string_buffers(chunk.column(1))
            data = lower_ascii(data)
            starts, ends, words = word_spans(data, offsets)
            h = span_hashes(data, starts, ends)
            out = []
            for a, b in zip(words[:-1], words[1:]):
                own = h[a:b]
                out.append(_print(np.unique(own), WIDE_BYTES) + _print(np.unique(window_hashes(own, min(shingle, b - a))), SHINGLE_BYTES) if b > a else zero)
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(out, pa.binary()), *chunk.columns[2:]], ["doc_id", "p", "x"][: chunk.num_columns])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    more = [F.col(also).alias("x")] if also else []
    return docs.select(F.col(id_col).alias("doc_id"), text, *more).mapInArrow(run, f"doc_id {kind}, p binary" + (", x long" if also else ""))


def band(similarity: float, spread: float = 6.0, wide: float = 4.0) -> tuple[int, int]:
    """(surely alike, perhaps alike): differing bits of the shingles' part up to which two sets have this Jaccard similarity for
    certain, ``spread`` standard deviations below what the angle says, and from ``wide`` above which they have not."""
    bits = 8 * SHINGLE_BYTES
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    deviation = math.sqrt(bits * p * (1 - p))
    return max(0, int(bits * p - spread * deviation)), int(bits * p + wide * deviation)


def similar_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Spanning links ``(src, dst)`` among ``classes(node, p)`` of distinct prints that are perhaps alike.

    Postings first hold the four bytes of a print's group that are not in their key; only prints that share enough of them with another go
    there again, to the same posting, with their group's and their shingles' bits."""
    perhaps = band(similarity)[1]

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = np.array([[8 * g + i for i in block] for g in range(GROUPS) for block in BLOCKS])
        others = np.array([[8 * g + i for i in range(8) if i not in block] for g in range(GROUPS) for block in BLOCKS])
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                p = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                key = np.ascontiguousarray(p[:, blocks]).view(np.uint32)[:, :, 0].astype(np.int64) | np.arange(len(blocks), dtype=np.int64) << 32
                rest = np.ascontiguousarray(p[:, others]).view(np.int32)[:, :, 0]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(blocks)))), pa.array(rest.ravel())], ["key", "node", "rest"])

    def shared(rows: np.ndarray, some: np.ndarray, others: np.ndarray, least: int) -> np.ndarray:
        """Whether the tally of positional bytes reaches ``least``."""
        count = np.zeros((len(some), len(others)), np.uint8)
        for p in range(rows.shape[1]):
            count += rows[some, p][:, None] == rows[others, p]
        return count >= least

    def met(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rest, node = table.column("rest").to_numpy().view(np.uint8).reshape(-1, 4), table.column("node").to_numpy()
        at = np.unique(np.concatenate(_walk(len(rest), lambda some, others: shared(rest, some, others, MIN_SHARED_BYTES - 4))))
        yield np.full(len(at), table.column("key")[0].as_py()), node[at]

    def links(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        p = np.frombuffer(b"".join(table.column("p").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        g, shingles = p[:, :8], np.ascontiguousarray(p[:, 8:]).view(np.uint64)

        def near(some: np.ndarray, others: np.ndarray) -> np.ndarray:
            out = shared(g, some, others, MIN_SHARED_BYTES)
            a, b = np.nonzero(out)
            for at in range(0, len(a), 1 << 14):
                i, j = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                out[i, j] = np.bitwise_count(shingles[some[i]] ^ shingles[others[j]]).sum(1, dtype=np.int32) <= perhaps
            return out

        a, b = _walk(table.num_rows, near)
        node = table.column("node").to_numpy()
        yield node[a], node[b]

    index = classes.select("node", F.substring("p", 1, WIDE_BYTES).alias("p")).mapInArrow(posted, "key long, node long, rest int")
    there = index.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _of_postings(batches, ["key"], met), "src long, dst long")
    group = F.floor(F.shiftright("key", 32) / len(BLOCKS)).cast("int")
    bits = F.concat(F.substr("p", 8 * group + 1, F.lit(8)), F.substring("p", WIDE_BYTES + 1, SHINGLE_BYTES))
    again = there.select(F.col("src").alias("key"), F.col("dst").alias("node")).join(classes.select("node", "p"), "node").select("key", "node", bits.alias("p"))
    return again.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _of_postings(batches, ["key"], links), "src long, dst long").distinct()


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    sets = []
    for chunk in text_chunks([pa.record_batch([texts], ["text"])], 0):
        data, offsets = string_buffers(chunk.column(0))
        data = lower_ascii(data)
        starts, ends, words = word_spans(data, offsets)
        h = span_hashes(data, starts, ends)
        sets += [np.unique(window_hashes(h[a:b], min(shingle, b - a))) if b > a else np.zeros(0, np.uint64) for a, b in zip(words[:-1], words[1:])]
    return sets


def exact_links(bits: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) links that span the classes of nodes alike: by ``bits`` where they are sure, else by the whole ``sets``.

    A found node is compared only with those not found yet, and those only until one of a class is like them."""
    sure, perhaps = band(similarity)
    size = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    nodes, roots = [], []
    while len(left):
        root, left = left[0], left[1:]
        waiting = [root]
        while waiting and len(left):
            now = waiting.pop()
            apart = np.bitwise_count(bits[left] ^ bits[now]).sum(1, dtype=np.int32)
            few, many = np.minimum(size[left], size[now]), np.maximum(size[left], size[now])
            hit = apart <= sure
            for at in np.flatnonzero(~hit & (apart <= perhaps) & (few >= similarity * many - 1e-9)):
                both = len(np.intersect1d(sets[now], sets[left[at]], assume_unique=True))
                hit[at] = both >= similarity * (few[at] + many[at] - both) - 1e-9
            if hit.any():
                found, left = left[hit], left[~hit]
                nodes.append(found)
                roots.append(np.full(len(found), root))
                waiting += found.tolist()
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def sifted(rows: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``column`` may be among ``keys``, and those whose is surely not, told apart where they are read.

    A key sets one bit of :data:`SIEVE_BITS`; with more keys more other rows pass, which an exact join takes away."""
    def bit(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))

    def place(b: Column) -> Column:
        return b.bitwiseAND(63).cast("int")

    words = keys.select(bit(key).alias("b")).groupBy(F.shiftright("b", 6).alias("sieve_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col("b")))).alias("sieve_bits"))
    own = bit(column)
    met = (F.shiftright(own, 6) == F.col("sieve_word")) & (F.call_function("shiftright", F.col("sieve_bits"), place(own)).bitwiseAND(1) == 1)
    return rows.join(F.broadcast(words), met, "left_semi"), rows.join(F.broadcast(words), met, "left_anti")


def verified_links(families: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Spanning links ``(src, dst)`` of the similarity within ``families(family, node)``; ``nodes(node, x, p)`` and ``texts(x, text)``
    give bits and sets.  Each text travels to its family, where its set is made: compressed
    it is smaller than the hashes; in a family of more than :data:`FAMILY_ROWS` once for each
    part of it, so that each two parts meet and no task holds more than two."""
    parts = F.ceil(F.col("n") / FAMILY_ROWS).cast("int")
    large = families.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > FAMILY_ROWS).select("family", parts.alias("parts"))
    placed = families.join(large, "family", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.select("family", "node", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    held = placed.select("family", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node")
    held = held.join(nodes.select("node", "x", F.substring("p", WIDE_BYTES + 1, SHINGLE_BYTES).alias("bits")), "node")
    wanted = held.select("x").distinct()
    bodies = sifted(texts, "x", wanted, "x")[0].join(wanted, "x", "left_semi").groupBy("x").agg(F.min("text").alias("text"))  # few texts have a family
    rows = held.join(bodies, "x").select("family", "low", "high", "node", "bits", "text")

    def links(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node = table.column("node").to_numpy()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
        a, b = exact_links(bits, [s for part in table.column("text").chunks for s in shingle_sets(part, shingle)], similarity)
        yield node[a], node[b]

    keys = ["family", "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(lambda batches: _of_postings(batches, keys, links), "src long, dst long")


def _class(p: Column) -> Column:
    """Sixteen bytes that stand for a print where only its equality counts."""
    return F.unhex(F.md5(p))


def _labels(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, p, x)`` of every row, and ``(class, component_id)`` of every distinct print."""
    texts = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"))
    rows = cut(wide_prints(texts, id_col, text_col, shingle, "text_hash"))
    classes = cut(rows.groupBy("p").agg(F.min("doc_id").alias("first_id"), F.min("x").alias("x")).withColumn("node", F.monotonically_increasing_id()))
    families = connected_components(similar_links(classes, similarity)).select(F.col("root").alias("family"), "node")
    bodies = texts.select(F.col("text_hash").alias("x"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    roots = connected_components(verified_links(families, classes.select("node", "x", "p"), bodies, shingle, similarity))
    joined = classes.select("node", "first_id", _class(F.col("p")).alias("class")).join(roots, "node", "left").select("class", "first_id", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows, joined.join(least, "root").select("class", "component_id")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, p, component_id)`` of every row, ``p`` its print of :func:`wide_prints`.

    Texts of one component are chained by links of at least ``similarity`` between their sets of ``shingle``-word shingles.  2,048
    bits over the shingles first chain families of texts that are perhaps alike, down to four standard deviations below what they
    say of the similarity (about 0.72 at 0.8).  Within a family pairs are surely alike six deviations above (about 0.9); others are compared by
    their whole sets.  Pairs that differ in at most 31 of 512 bits over
    distinct words have a group with three at most and surely meet in the index; beyond that all but few do (see the README for recall).  Rows with equal prints
    share a class, so copies and repeated rows cost no pairs.  No words (null, empty or blank texts) are all alike.
    ``component_id`` is the smallest id in the component, null only where all its ids are.  An empty table gives no rows.
    """
    rows, labels = _labels(docs, id_col, text_col, shingle, similarity)
    return rows.withColumn("class", _class(F.col("p"))).join(labels, "class").select("doc_id", "p", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of :func:`similar_components`, that of the smallest id; all columns of ``docs``.

    Null, empty and blank texts are alike, so one of them stays.  Where ids repeat, of the rows with a component's smallest id
    (or null, if the component has no other) the one with the smallest text stays.  Columns of any name pass through.  An empty
    table gives no rows.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    ident, text = names[id_col], names[text_col]
    prints, labels = _labels(rows, ident, text, shingle, similarity)
    found = cut(prints.select("doc_id", _class(F.col("p")).alias("p")).join(labels.withColumnRenamed("class", "p"), "p"))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        perhaps, alone = sifted(rows, ident, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), "doc_id")  # most rows stay, and need not travel
        kept = alone.unionByName(perhaps.join(first.select("doc_id"), F.col(ident).eqNullSafe(F.col("doc_id")), "left_semi"))
    else:  # rows are told apart by print too, and rows of one id and component by their text
        ids = first.select(F.col("doc_id").alias("kept_id"), F.col("p").alias("kept_p"), "component_id").distinct()
        of_text = wide_prints(rows.select(F.col(text).alias("doc_id"), text).distinct(), "doc_id", text, shingle).select(F.col("doc_id").alias("of_text"), _class(F.col("p")).alias("p"))
        kept = rows.join(of_text, F.col(text).eqNullSafe(F.col("of_text"))).join(ids, F.col(ident).eqNullSafe(F.col("kept_id")) & (F.col("p") == F.col("kept_p")))
        order = Window.partitionBy("component_id", F.when(F.col("component_id").isNull(), F.col("kept_p"))).orderBy(F.col(text).asc_nulls_last())
        kept = kept.withColumn("place", F.row_number().over(order)).where("place = 1")
    return kept.select(*[F.col(a).alias(c) for c, a in names.items()])
