"""Alignment of two tokenizers over a corpus: which tokens of one overlap which tokens of the other, and how often.

Both tokenizers see the same bytes, a space and the text.  Tokens whose byte ranges overlap are linked; offsets at which
tokens of both end cut a text into groups.  A text is encoded a unit at a time: neither tokenizer has a token across a
single space between two characters that are no white space, so a unit is such a space with what follows it, and distinct
units are encoded and aligned once in a worker.

Corpus-wide counts come by a cogroup of postings.  Each document leaves the multiplicities of its linked id pairs.  They are
shuffled by the second tokenizer's id and sorted by Spark, which spills; ahead of an id's postings come the sums of its
pairs, combined before they are shuffled.  A stream then holds the sums of one id at most, no more than the first
vocabulary, takes their maximum, and walks the postings, leaving contributions of documents, which are summed by document.
Ids with very many postings are dealt by document to several streams, each with that id's sums.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, text_chunks, written

#: Between units: a space with something other than white space on both sides (the piece vocabulary's own mark is white space to it).
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


@dataclass(frozen=True)
class AlignParams:
    """``first``, ``second``: vocabulary files (None: the installed byte-level and piece vocabularies).  ``remembered``: units that a
    worker keeps.  ``posting_rows``: postings of an id in one stream, about."""

    first: str | None = None
    second: str | None = None
    remembered: int = 1 << 18
    posting_rows: int = 2_000_000


def _byte_characters() -> dict[str, int]:
    """The byte of each character that stands for one in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _merge_encoding(path: str):
    """The byte-level vocabulary of a JSON file as ranks of merges; its ids must follow the order of its merges."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    of = _byte_characters()
    raw = {token: bytes(of[c] for c in token) for token in model["vocab"] if all(c in of for c in token)}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    numbers = [model["vocab"][x + y] for x, y in pairs]
    if numbers != sorted(numbers):
        raise ValueError(f"{path}: ids do not follow the merges")
    merged = {x + y for x, y in pairs}
    ranks = {raw[t]: i for t, i in model["vocab"].items() if t in merged or t in of}
    return tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def _bytes_of(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after another, and the bounds of each."""
    return np.frombuffer(b"".join(units), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])


class TwoTokenizers:
    """Both tokenizers, and the units that were seen: their counts, linked pairs and groups."""

    def __init__(self, first: str, second: str, remembered: int):
        import sentencepiece

        self.a, ranks = _merge_encoding(first)
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.width = len(a_bytes)
        self.a_bytes, self.b_bytes = _bytes_of(a_bytes), _bytes_of(b_bytes)
        # Ids as text, with room for what stands after them.
        self.text = _bytes_of([b"%d," % i for i in range(max(len(a_bytes), len(b_bytes)))])
        self.remembered = remembered
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of both, groups, whether the bytes are the unit's
        self.pairs, self.n_pairs, self.hits = (np.zeros(0, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Keeps the half of the units that came most often."""
        keep = np.sort(np.argsort(-self.hits, kind="stable")[: self.remembered // 2])
        units = list(self.number)  # in the order of their numbers
        starts = np.cumsum(self.n_pairs) - self.n_pairs
        self.pairs = self.pairs[ragged(starts[keep], self.n_pairs[keep])]
        self.sizes, self.n_pairs, self.hits = self.sizes[keep], self.n_pairs[keep], self.hits[keep] // 2
        self.groups = [self.groups[i] for i in keep]
        self.number = {units[i]: n for n, i in enumerate(keep)}

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.a.encode_ordinary(" " + u) for u in units], self.b.encode(units, num_threads=1)

    def learn(self, units: list[str]) -> None:
        """Encodes and aligns units that are new."""
        n_links, pairs, groups, sizes = self.align(*self.encode(units), [b" " + u.encode() for u in units])
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
        self.groups += groups
        self.sizes, self.pairs, self.n_pairs = np.concatenate([self.sizes, sizes]), np.concatenate([self.pairs, pairs]), np.concatenate([self.n_pairs, n_links])
        self.hits = np.concatenate([self.hits, np.zeros(len(units), np.int64)])

    def align(self, a: list[list[int]], b: list[list[int]], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(links of each unit, links as ``second * width + first``, groups as text, sizes) of units by their ids and bytes."""
        n = len(raw)
        data, bounds = _bytes_of(raw)

        def side(ids: list[list[int]], table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            count = np.fromiter(map(len, ids), np.int64, n)
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))
            raw, starts = table
            long = np.diff(starts)[flat]
            own = np.repeat(np.arange(n), count)
            size = np.bincount(own, long, n).astype(np.int64)
            good = size == np.diff(bounds)
            # Bytes of units that are as long as they should be, side by side with what they should be.
            use = good[own]
            have, want = raw[ragged(starts[flat[use]], long[use])], data[ragged(bounds[:-1][good], size[good])]
            wrong = np.add.reduceat((have != want).astype(np.int64), (np.cumsum(size[good]) - size[good])) if len(have) else np.zeros(0, np.int64)
            good[np.flatnonzero(good)[wrong > 0]] = False
            return flat, long, own, good

        sides = [side(a, self.a_bytes), side(b, self.b_bytes)]
        good = sides[0][3] & sides[1][3]
        (ia, la, oa), (ib, lb, ob) = (tuple(x[good[own]] for x in (flat, long, own)) for flat, long, own, _ in sides)
        sizes = np.stack([np.bincount(oa, minlength=n), np.bincount(ob, minlength=n), np.zeros(n, np.int64), good], 1).astype(np.int64)
        if not good.any():
            return np.zeros(n, np.int64), np.zeros(0, np.int64), [b""] * n, sizes
        ea, eb = np.cumsum(la), np.cumsum(lb)  # good units follow each other on both sides
        ends = np.union1d(ea, eb)
        at_a, at_b = np.searchsorted(ea, ends), np.searchsorted(eb, ends)
        pairs, n_links = ib[at_b] * self.width + ia[at_a], np.bincount(oa[at_a], minlength=n)
        both = np.intersect1d(ea, eb, assume_unique=True)
        ga, gb = np.searchsorted(both, ea), np.searchsorted(both, eb)  # the group of each token
        sizes[:, 2] = np.bincount(oa[np.searchsorted(ea, both)], minlength=n)
        # Tokens as they are written: by group, first those of one side, then of the other.
        order = np.lexsort((np.append(np.arange(len(ia)), np.arange(len(ib))), np.repeat([0, 1], [len(ia), len(ib)]), np.append(ga, gb)))
        ids, group, second, own = (np.concatenate(x)[order] for x in ((ia, ib), (ga, gb), (np.zeros(len(ia), bool), np.ones(len(ib), bool)), (oa, ob)))
        text, starts = self.text
        long = np.diff(starts)[ids]
        out, last = text[ragged(starts[ids], long)], np.cumsum(long) - 1
        turn = np.append(second[1:] != second[:-1], True) | np.append(group[1:] != group[:-1], True)
        out[last[turn & ~second]], out[last[turn & second]] = 0x7C, 0x3B
        stops = np.concatenate([[0], np.cumsum(np.bincount(own, long, n).astype(np.int64))])
        whole = out.tobytes()
        return n_links, pairs, [whole[x : max(x, y - 1)] for x, y in zip(stops[:-1].tolist(), stops[1:].tolist())], sizes

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, and each text's bounds among them; an empty text has none."""
        split = [_CUT.split(t) if t else [] for t in texts]
        if len(self.number) > self.remembered:
            self.forget()
        number = self.number
        new = list(dict.fromkeys([u for units in split for u in units if u not in number]))
        if new:
            self.learn(new)
        at = np.array([number[u] for units in split for u in units], np.int64)
        self.hits += np.bincount(at, minlength=len(self.hits))
        return at, np.concatenate([[0], np.cumsum([len(units) for units in split])]).astype(np.int64)


@lru_cache(1)
def _tokenizers(first: str | None, second: str | None, remembered: int) -> TwoTokenizers:
    import public_tokenizers

    return TwoTokenizers(first or str(public_tokenizers.path("byte_bpe_50k.json")), second or str(public_tokenizers.path("piece_bpe_32k.model")), remembered)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], *(np.add.reduceat(v[order], at) for v in values)


def aligned(docs: DataFrame, params: AlignParams = AlignParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)`` of every row.

    ``key`` is the row's own; ``pairs`` are its distinct linked ids, ``second << 32 | first``, ``times`` how many links each has.
    Texts that are null, empty, or not given back byte for byte by both tokenizers have no tokens, pairs or groups."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(params.first, params.second, params.remembered)
        for chunk in text_chunks(batches):
            n = chunk.num_rows
            at, bounds = both.look_up(chunk.column(1).to_pylist())
            sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(both.sizes[at], 0)])[bounds]
            total = np.diff(sums, axis=0)
            good = total[:, 3] == np.diff(bounds)
            total[~good] = 0
            groups = [both.groups[u] for u in at.tolist()]
            shas = [hashlib.sha256(b";".join(groups[a:b])).hexdigest() if fine and b > a else "" for a, b, fine in zip(bounds[:-1].tolist(), bounds[1:].tolist(), good.tolist())]
            # Each document's distinct units with their number, then the units' pairs.
            row = np.repeat(np.arange(n), np.diff(bounds))
            use = good[row]
            unit, times = _summed(row[use] << 32 | at[use], np.ones(int(use.sum()), np.int64))
            row, unit = unit >> 32, unit & 0xFFFFFFFF
            count = both.n_pairs[unit]
            space = both.width * len(both.b_bytes[1])
            key, times = _summed(np.repeat(row, count) * space + both.pairs[ragged((np.cumsum(both.n_pairs) - both.n_pairs)[unit], count)], np.repeat(times, count))
            row, pair = key // space, key % space
            pair = pair // both.width << 32 | pair % both.width
            ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            n_links = total[:, 0] + total[:, 1] - total[:, 2]
            yield pa.RecordBatch.from_arrays([chunk.column(0), *(pa.array(total[:, i]) for i in range(3)), pa.array(n_links), pa.array(shas, pa.string()),
                                              pa.ListArray.from_arrays(ends, pa.array(pair)), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    return found.select(F.monotonically_increasing_id().alias("key"), *names)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, n, postings)``: each linked pair's links in the corpus, and in how many documents of :func:`aligned` it stands."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    return each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"), F.count("*").alias("postings"))


def contributions(rows: DataFrame, counts: DataFrame, params: AlignParams) -> DataFrame:
    """``(key, n_best, count_sum)`` of documents with links, from their postings beside the counts of all pairs."""
    second = F.shiftright("pair", 32).cast("int")
    crowded = counts.groupBy(second.alias("b")).agg(F.sum("postings").alias("n")).where(F.col("n") > params.posting_rows)
    parts = crowded.select("b", F.ceil(F.col("n") / params.posting_rows).cast("int").alias("parts"))  # at most a row for each id of the vocabulary
    each = rows.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("key", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("n"))
    part = F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), F.lit(0))
    each = each.withColumn("b", second).join(F.broadcast(parts), "b", "left").select("b", part.alias("part"), "key", "pair", "n")
    sums = counts.withColumn("b", second).join(F.broadcast(parts), "b", "left")
    sums = sums.select("b", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(-1).cast("long").alias("key"), "pair", "n")
    stream = sums.unionAll(each).repartition("b", "part").sortWithinPartitions("b", "part", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = (np.zeros(0, np.int64),) * 3  # stream, pair, count of the last id's sums
        for batch in batches:
            if not batch.num_rows:
                continue
            b, part, key, pair, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            stream = b << 32 | part
            first = key < 0
            own, pairs, counted = (np.concatenate([h, x[first]]) for h, x in zip(head, (stream, pair, n)))
            order = np.lexsort((pairs, own))
            own, pairs, counted = own[order], pairs[order], counted[order]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            most = np.repeat(np.maximum.reduceat(counted, starts), np.diff(np.append(starts, len(own)))) if len(own) else counted
            stay = own == stream[-1]
            head = own[stay], pairs[stay], counted[stay]
            late = np.flatnonzero(~first)
            if len(late):
                # A pair has one id, so within a part the pair alone tells the stream.
                line = np.unique(np.concatenate([own, stream]), return_inverse=True)[1]
                codes, number = np.unique(np.concatenate([pairs, pair]), return_inverse=True)
                have, want = (line[x] * len(codes) + number[x] for x in (slice(0, len(own)), slice(len(own), None)))
                at = np.searchsorted(have, want[late])
                parts = _summed(key[late], np.where(counted[at] == most[at], n[late], 0), n[late] * counted[at])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["key", "n_best", "count_sum"])

    found = stream.mapInArrow(run, "key long, n_best long, count_sum long")
    return found.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def cross_alignment(docs: DataFrame, params: AlignParams = AlignParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row.

    ``n_best`` are the links whose pair is linked as often in the corpus as any pair of the same second id, ties included;
    ``count_sum`` adds up the counts over the row's links.  A text that is null, empty, or that a tokenizer does not give
    back byte for byte has zeros and an empty string, and no part in the counts.  Repeated rows count and are answered each.
    Strings of special tokens are text.  A very long text is a chunk of its own.  An empty table gives no rows.
    """
    rows, _ = written(aligned(docs, params, id_col, text_col))
    counts, _ = written(pair_counts(rows))
    summed = contributions(rows, counts, params).withColumnRenamed("key", "of")
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(summed, F.col("key") == F.col("of"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
