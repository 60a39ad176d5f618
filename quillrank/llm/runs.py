"""Runs of periodic words: maximal stretches that repeat with a smallest period.

A run of period q and ``max(least, 2 q)`` words or more holds, for the largest power of two b with ``2 b - 1 + q`` words in
it, a block of b words at a multiple of b together with the same block q words on.  So for each b the aligned blocks of a
document are the keys of an Aho-Corasick automaton over word numbers, the document is searched once, and
occurrences at the distances of that b seed an exact extension to both sides.  Stretches of the same distance are
extended once; a distance is dropped where a shorter period that divides it is known, or is found after extension.

Blocks that occur nowhere else are no keys: a block of four words or more can come again only if each four
consecutive words in it do, which one sort of a document's word quadruples tells.  Most documents have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, string_buffers, text_chunks

#: Words of the shortest run.
LEAST = 12


def block_of(period: int, least: int = LEAST) -> int:
    """The largest power of two whose block comes again ``period`` words on in every run of that period."""
    room = max(least, 2 * period) - period
    return 1 << ((room + 1) // 2).bit_length() - 1


def _scales(n: int, least: int) -> list[tuple[int, int, int]]:
    """(block, smallest, largest period): consecutive periods with one block, for ``n`` words."""
    out: list[tuple[int, int, int]] = []
    q = 1
    while 2 * q <= n:
        b = block_of(q, least)
        end = q
        if 2 * q > least:
            end = 4 * b - 2  # from here on blocks grow with periods
        else:
            while 2 * (end + 1) <= least and block_of(end + 1, least) == b:
                end += 1
        out.append((b, q, min(end, n // 2)))
        q = end + 1
    return out


def _extend(w: np.ndarray, x: int, period: int, size: int) -> tuple[int, int]:
    """The stretch ``[start, end)`` in which words ``period`` apart are the same, around ``size`` words at ``x`` that are."""
    n, step = len(w), 64
    end = x + size + period
    while end < n:
        stop = min(n, end + step)
        off = w[end:stop] != w[end - period : stop - period]
        if off.any():
            end += int(off.argmax())
            break
        end, step = stop, step * 2
    start, step = x, 64
    while start > 0:
        stop = max(0, start - step)
        off = w[stop:start] != w[stop + period : start + period]
        if off.any():
            start -= int(off[::-1].argmax())
            break
        start, step = stop, step * 2
    return start, end


def _primitive(w: np.ndarray, start: int, period: int) -> bool:
    """Whether no shorter period divides ``period`` in a stretch that is twice as long at least."""
    rest, d = period, 2
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d == 0:
            p = period // d
            if (w[start : start + period] == w[start + p : start + period + p]).all():
                return False
            while rest % d == 0:
                rest //= d
        d += 1
    return True


def _seeds(w: np.ndarray, words: tuple[int, ...], block: int, first: int, last: int, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of blocks that come again ``first`` to ``last`` words on; ``use`` are the blocks that are keys."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number: dict[tuple[int, ...], int] = {}
    key = np.full(len(w) // block + 1, -1)
    for i in use.tolist():
        own = words[i * block : (i + 1) * block]
        if own not in number:
            number[own] = len(number)
            found.add_word(own, number[own])
        key[i] = number[own]
    found.make_automaton()
    hits = np.array(list(found.iter(words)), np.int64).reshape(-1, 2)
    at, own = hits[:, 0] - block + 1, hits[:, 1]
    places, distances = [], []
    for step in range((last - first) // block + 1):
        i = -(-np.maximum(at - last, 0) // block) + step
        ok = i * block <= at - first
        ok[ok] = key[i[ok]] == own[ok]
        places.append(i[ok] * block)
        distances.append(at[ok] - i[ok] * block)
    return np.concatenate(places), np.concatenate(distances)


def find_runs(w: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``(start, length, period)`` rows of all runs of the word numbers ``w``, by start, then period."""
    n = len(w)
    none = np.zeros((0, 3), np.int64)
    if n < least:
        return none
    runs: list[tuple[int, int, int]] = []
    again = np.zeros(n + 1, np.int64)  # how many places before each have four words that come again
    if n >= 4:
        h = w.astype(np.uint64)
        h = mix(mix(h[:-3]) + h[1:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(h[2:-1] + np.uint64(7)) * np.uint64(3) + mix(h[3:] + np.uint64(0x5DEECE66D)) * np.uint64(5))
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(n - 3, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        again[1 : n - 2] = np.cumsum(twice)
        again[n - 2 :] = again[n - 3]
    words: tuple[int, ...] = ()
    for block, first, last in _scales(n, least):
        i = np.arange(n // block)
        if block >= 4:
            use = i[again[i * block + block - 3] - again[i * block] == block - 3]
        else:  # shorter blocks have few distances
            near = np.zeros(n, bool)
            for q in range(first, last + 1):
                same = np.append(w[q:] == w[:-q], np.zeros(q, bool))
                near |= np.logical_and.reduce([np.append(same[k:], np.zeros(k, bool)) for k in range(block)])
            use = i[near[i * block]]
        if not len(use):
            continue
        words = words or tuple(w.tolist())
        place, distance = _seeds(w, words, block, first, last, use)
        if not len(place):
            continue
        # Known runs that reach a distance's words with a shorter period that divides it; the last ones to start can only do so.
        known = np.array(sorted(r for r in runs if r[1] >= 2 * first), np.int64).reshape(-1, 3)
        if len(known):
            live = np.ones(len(place), bool)
            at = np.searchsorted(known[:, 0], place, "right")
            for back in range(1, 5):
                r = known[np.maximum(at - back, 0)]
                live &= ~((at >= back) & (r[:, 0] + r[:, 1] >= place + distance) & (distance % r[:, 2] == 0))
            place, distance = place[live], distance[live]
        order = np.lexsort((place, distance))
        q, end = 0, 0
        for x, d in zip(place[order].tolist(), distance[order].tolist()):
            if d == q and x + block + d <= end:
                continue
            q = d
            start, end = _extend(w, x, d, block)
            if end - start >= max(least, 2 * d) and _primitive(w, start, d):
                runs.append((start, end - start, d))
    return np.array(sorted(set(runs), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3) if runs else none


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words lies in a run after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(x, len(number)) for x in words], np.int64)


def _mapped(rows: DataFrame, schema: str, answer: Callable[[pa.RecordBatch, int, list[bytes]], tuple]) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            data, offsets = string_buffers(chunk.column(1))
            raw = data.tobytes()
            out = [answer(chunk, i, raw[a:b].split()) for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()))]
            columns = zip(*out) if out else [[] for _ in names[1:]]
            fields = [chunk.column(0), *columns]
            yield pa.RecordBatch.from_arrays([fields[0], *(pa.array(list(c), kind) for c, kind in zip(fields[1:], kinds))], names)

    kinds = [{"long": pa.int64(), "string": pa.string(), "array<struct<start:long,length:long,period:long>>": pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))}[part.split(" ", 1)[1]]
             for part in schema.split(", ")[1:]]
    return rows.mapInArrow(run, schema)


def _text(docs: DataFrame, id_col: str, text_col: str):
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, runs, collapsed)`` of every row: its runs of ``least`` words or more, by start, then period, and the text's words,
    joined by one space, without those that lie in a run after its first period.

    Words are runs of bytes other than ``0x20`` and ``0x09-0x0D``, compared byte for byte.  Null, empty and blank texts have no words
    and no runs.  Rows are answered each, whatever their ids; a very long text is a chunk of its own.  An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def answer(_, __, words: list[bytes]) -> tuple:
        runs = find_runs(numbered(words), least)
        gone = dropped(len(words), runs).tolist()
        return [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], b" ".join([x for x, no in zip(words, gone) if not no]).decode("utf-8", "replace")

    return _mapped(_text(docs, id_col, text_col), f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string", answer)


def plant(words: list[bytes], h: int | None) -> list[bytes]:
    """The words with the tail that a tenth of the ids, by their checksum ``h``, have repeated: a test of whole tables."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // len(tail))))[: n - a] if tail else words


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of every row.

    As :func:`periodic_runs`, after :func:`plant` by the id's ``crc32`` as decimal text; a null id plants nothing.  The four numbers
    are of the longest run, ties by start, then period, and null without a run."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _text(docs, id_col, text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))

    def answer(chunk: pa.RecordBatch, i: int, words: list[bytes]) -> tuple:
        words = plant(words, chunk.column(2)[i].as_py())
        runs = find_runs(numbered(words), least)
        best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join([f"{a},{b},{c}\n" for a, b, c in runs.tolist()])
        kept = [x for x, no in zip(words, dropped(len(words), runs).tolist()) if not no] if len(runs) else words
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        return len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _mapped(rows, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", answer)
