"""SentencePiece encoding and decoding in batched numpy.

A text is cut where no piece can reach across: before a space that follows something else, and between characters that
stand side by side in no piece.  Distinct parts of equal length advance together.  Substring hashes of all parts probe the
sorted hashes of the pieces, and for each end the vectorised maximum over the starts is stored with its backpointer.

In a unigram vocabulary a path adds up scores.  In a vocabulary of the merge kind the order of merges decides: two pieces may
follow each other if their characters, merged on their own, end as these two.  A row of pieces is the result of merging
exactly if each piece stands on its own and each two neighbours may follow each other, so a step of the best path is worth one
or nothing, by the piece that the start's backpointer holds, and one start at most is worth one.  Whether two may follow is
told by taking their last merges back, the later first, until a merge across them would have come before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ragged, string_buffers, text_chunks

SPACE = 0x2581
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int64(1) << 40
#: Characters with the most pieces, whose neighbourhoods are looked up in a square table.
_DENSE = 1024
#: Longer parts go one by one.
LONG = 192
#: Distinct parts that a worker remembers before it starts anew.
REMEMBERED = 1 << 18


class Pieces:
    """A vocabulary: pieces with scores and kinds (1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte)."""

    def __init__(self, pieces: list[tuple[str, float, int]], merges: bool, dummy_prefix: bool = True):
        self.merges, self.dummy_prefix = merges, dummy_prefix
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4, 5) and p]
        self.longest = max(len(p) for _, p, _ in normal)
        keys = self._hash_all([p for _, p, _ in normal])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([i for i, _, _ in normal], np.int64)[order]
        self.scores = np.array([s for _, _, s in normal])[order]
        # Merge ranks: the higher score first; equal scores are equal ranks.
        self.ranks = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.unknown_score = float(self.scores.min()) - 10.0
        self.byte_ids = np.full(256, -1, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
        self.byte_fallback = bool((self.byte_ids >= 0).all())
        uses: dict[str, int] = {}
        for _, p, _ in normal:
            for c in p:
                uses[c] = uses.get(c, 0) + 1
        chars = sorted(uses, key=lambda c: (-uses[c], c))
        self.char_id = np.full(0x110000, len(chars), np.int32)
        for i, c in enumerate(chars):
            self.char_id[ord(c)] = i
        number = {c: i for i, c in enumerate(chars)}
        beside = {(number[a], number[b]) for _, p, _ in normal for a, b in zip(p, p[1:])}
        self.dense = np.zeros((_DENSE + 1, _DENSE + 1), bool)
        for a, b in beside:
            if a < _DENSE and b < _DENSE:
                self.dense[a, b] = True
        self.beside = np.array(sorted(a << 24 | b for a, b in beside if a >= _DENSE or b >= _DENSE), np.int64)
        # Decoding: each id's bytes.
        surface = [b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else bytes([int(p[3:5], 16)]) if kind == 6 else p.replace("▁", " ").encode() for p, _, kind in pieces]
        self.surface_lengths = np.array([len(x) for x in surface], np.int64)
        self.surface_starts = np.concatenate([[0], np.cumsum(self.surface_lengths)[:-1]])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.known: dict[int, int] = {}
        self._reset()
        if merges:
            self._merge_table([p for _, p, _ in normal], order)

    def _merge_table(self, texts: list[str], order: np.ndarray) -> None:
        """For each key: when it is merged (single characters before all), from which two pieces, and whether it stands on its own."""
        texts = [texts[i] for i in order]
        size = np.array([len(t) for t in texts])
        self.when = np.where(size > 1, self.ranks, -1)
        self.left, self.right, self.whole = np.full(len(texts), -1), np.full(len(texts), -1), size == 1
        pairs: list[np.ndarray] = []
        for n in range(2, self.longest + 1):
            at = np.flatnonzero(size == n)
            if not len(at):
                continue
            codes = np.array([[ord(c) for c in texts[i]] for i in at], np.uint32)
            sums = self.prefix_sums(codes)
            rows, cuts = np.repeat(np.arange(len(at)), n - 1), np.tile(np.arange(1, n), len(at))
            first, second = self.probe(self.span_hash(sums, rows, np.zeros_like(cuts), cuts)), self.probe(self.span_hash(sums, rows, cuts, np.full_like(cuts, n)))
            ok = (first >= 0) & (second >= 0)
            pairs.append(np.stack([first[ok] << 32 | second[ok], self.ranks[at[rows[ok]]]]))
            row, _, _ = self.merge(codes)
            self.whole[at] = np.bincount(row, minlength=len(at)) == 1
            row, start, end = self.merge(codes, 2)
            two = np.flatnonzero((start == 0) & (np.bincount(row, minlength=len(at))[row] == 2))
            places = self.probe(self.span_hash(sums, row, start, end))
            self.left[at[row[two]]], self.right[at[row[two]]] = places[two], places[two + 1]
        found = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
        found = found[:, np.argsort(found[0], kind="stable")]
        self.pair_keys, self.pair_when = found
        self.followed: dict[int, bool] = {}

    def joined_when(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When the piece of both texts is merged, or never."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_when[at], _NEVER) if len(self.pair_keys) else np.full(len(key), _NEVER)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces at ``b`` may stand after those at ``a`` (places among the keys; -1 is an unknown character)."""
        out = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), _NEVER)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(live):
            bad = self.joined_when(a, b) < limit
            out[live[bad]] = False
            late_a, late_b = np.where(a >= 0, self.when[a], -1), np.where(b >= 0, self.when[b], -1)
            on = ~bad & ((late_a >= 0) | (late_b >= 0))
            live, a, b, late_a, late_b = live[on], a[on], b[on], late_a[on], late_b[on]
            first = late_a > late_b  # of equal merges the left one comes first
            limit = np.where(first, late_a, late_b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def _reset(self) -> None:
        self.known.clear()
        self.flat, self.starts, self.sizes = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.flat_size = 0

    @staticmethod
    def _hash_all(texts: list[str]) -> np.ndarray:
        """The hash of each text, batch by length."""
        out, size = np.zeros(len(texts), np.uint64), np.array([len(t) for t in texts])
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            sums = Pieces.prefix_sums(np.array([[ord(c) for c in texts[i]] for i in at], np.uint32))
            out[at] = Pieces.span_hash(sums, np.arange(len(at)), np.zeros_like(at), np.full(len(at), n))
        return out

    @staticmethod
    def prefix_sums(codes: np.ndarray) -> np.ndarray:
        """Polynomial sums of each row's prefixes; equal-length rows."""
        w, n = codes.shape
        values = mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        out = np.zeros((w, n + 1), np.uint64)
        for k in range(n):
            out[:, k + 1] = out[:, k] * _BASE + values[:, k]
        return out

    @staticmethod
    def span_hash(sums: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(sums[row, end] - sums[row, start] * Pieces._power(end - start) + (end - start).astype(np.uint64))

    @staticmethod
    def _power(n: np.ndarray) -> np.ndarray:
        top = int(n.max(initial=0)) + 1
        steps = np.full(top, _BASE, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)[n]

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the sorted keys, or -1."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    # Segmentation of equal-length rows of code points: (row, start, end) of every piece, in order.

    def merge(self, codes: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges each row's best-ranked pair, leftmost first, until none or ``least`` pieces are left.  Only for the vocabulary's own pieces."""
        w, n = codes.shape
        sums = self.prefix_sums(codes)
        bounds = np.tile(np.arange(n + 1), (w, 1))
        count = np.full(w, n)
        if n > 1:
            row = np.repeat(np.arange(w), n - 1)
            left = np.tile(np.arange(n - 1), w)
            pairs = self._pair_rank(sums, row, left, left + 2).reshape(w, n - 1)
            live = np.flatnonzero((pairs.min(1) < _NEVER) & (count > least))
            p, b = pairs[live], bounds[live]
            columns = np.arange(n + 1)
            while len(live):
                k = p.argmin(1)
                take = np.minimum(columns + (columns >= k[:, None] + 1), n)
                b = np.take_along_axis(b, take, 1)
                count[live] -= 1
                if p.shape[1] > 1:
                    cut = np.arange(p.shape[1])
                    p = np.take_along_axis(p, np.minimum(cut + (cut >= k[:, None]), p.shape[1] - 1), 1)
                p[:, -1] = _NEVER
                for at in (k - 1, k):
                    ok = np.flatnonzero((at >= 0) & (at + 2 <= count[live]))
                    p[ok, at[ok]] = self._pair_rank(sums, live[ok], b[ok, at[ok]], b[ok, at[ok] + 2])
                bounds[live] = b
                on = (p.min(1) < _NEVER) & (count[live] > least)
                live, p, b = live[on], p[on], b[on]
        mask = np.arange(n) < count[:, None]
        row, col = np.nonzero(mask)
        return row, bounds[row, col], bounds[row, col + 1]

    def _pair_rank(self, sums: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = self.probe(self.span_hash(sums, row, start, end))
        return np.where(at >= 0, self.ranks[at], _NEVER)

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best path of each row, by its backpointers."""
        if self.merges:
            back = self._merge_paths(codes) if codes.shape[1] <= LONG else np.concatenate([self._merge_path(row) for row in codes])
        else:
            back = self._score_paths(codes)
        w, n = codes.shape
        rows = np.arange(w)
        ends = np.zeros((w, n + 1), bool)
        at, live = np.full(w, n), rows
        while len(live):
            ends[live, at[live]] = True
            at[live] = back[live, at[live]]
            live = live[at[live] > 0]
        row, end = np.nonzero(ends[:, 1:])
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        start = np.where(np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool), 0, start)
        return row, start, end + 1

    def _found(self, codes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(end, row, start, place) of all substrings that are pieces, and of single characters, with ends from ``first`` to ``last``; by end."""
        w = len(codes)
        low = max(0, first - self.longest)
        codes = codes[:, low:last]
        sums = self.prefix_sums(codes)
        ends, starts = np.meshgrid(np.arange(first, last + 1) - low, np.arange(1, self.longest + 1), indexing="ij")
        starts = ends - starts
        ok = starts >= 0
        ends, starts = ends[ok], starts[ok]
        at = self.probe(self.span_hash(sums, np.tile(np.arange(w), len(ends)), np.repeat(starts, w), np.repeat(ends, w))).reshape(len(ends), w)
        i, row = np.nonzero((at >= 0) | (ends - starts == 1)[:, None])
        return ends[i] + low, row, starts[i] + low, at[i, row]

    def _merge_paths(self, codes: np.ndarray) -> np.ndarray:
        w, n = codes.shape
        end, row, start, place = self._found(codes, 1, n)
        own = (place < 0) | self.whole[place]
        end, row, start, place = end[own], row[own], start[own], place[own]
        bounds = np.searchsorted(end, np.arange(1, n + 2))
        back, held = np.zeros((w, n + 1), np.int64), np.full((w, n + 1), -1)
        for e in range(1, n + 1):
            part = slice(bounds[e - 1], bounds[e])
            r, s, p = row[part], start[part], place[part]
            good = np.flatnonzero((s == 0) | self.may_follow(held[r, s], p))
            # One start of a row is good; the maximum keeps the longest if ever two were.
            good = good[np.argsort(-s[good], kind="stable")]
            back[r[good], e], held[r[good], e] = s[good], p[good]
        return back

    def _merge_path(self, codes: np.ndarray) -> np.ndarray:
        """As :meth:`_merge_paths`, of one long row, with what may follow remembered."""
        n, known = len(codes), self.followed
        back, held = [0] * (n + 1), [-1] * (n + 1)
        for first in range(1, n + 1, 1 << 12):
            end, _, start, place = self._found(codes[None], first, min(n, first + (1 << 12) - 1))
            own = (place < 0) | self.whole[place]
            for e, s, p in sorted(zip(end[own].tolist(), start[own].tolist(), place[own].tolist())):
                if back[e] or held[e] >= 0:
                    continue  # a longer piece was good
                if s:
                    key = held[s] << 32 | (p & 0xFFFFFFFF)
                    good = known.get(key)
                    if good is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        good = known[key] = bool(self.may_follow(np.array([held[s]]), np.array([p]))[0])
                    if not good:
                        continue
                back[e], held[e] = s, p
        return np.array([back])

    def _score_paths(self, codes: np.ndarray) -> np.ndarray:
        """Best total score; a character without a piece scores ten below the worst piece.  Ties go to the longer last piece."""
        w, n = codes.shape
        sums = self.prefix_sums(codes)
        best, back = np.full((w, n + 1), -np.inf), np.zeros((w, n + 1), np.int64)
        best[:, 0] = 0
        rows = np.arange(w)
        for end in range(1, n + 1):
            starts = np.arange(max(0, end - self.longest), end)
            h = self.span_hash(sums, np.repeat(rows, len(starts)), np.tile(starts, w), np.full(w * len(starts), end))
            at = self.probe(h)
            score = np.where(at >= 0, self.scores[at], -np.inf).reshape(w, -1)
            score[:, -1] = np.where(np.isinf(score[:, -1]), self.unknown_score, score[:, -1])
            total = best[:, starts] + score
            pick = total.argmax(1)
            best[:, end], back[:, end] = total[rows, pick], starts[pick]
        return back

    def segment(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of equal-length rows, in order."""
        row, start, end = self.viterbi(codes)
        at = self.probe(self.span_hash(self.prefix_sums(codes), row, start, end))
        ids = np.where(at >= 0, self.ids[at], self.unknown)
        missing = np.flatnonzero(at < 0)
        if len(missing) and self.byte_fallback:
            utf8 = [np.frombuffer(chr(codes[row[m], start[m]]).encode(), np.uint8) for m in missing]
            sizes = np.ones(len(ids), np.int64)
            sizes[missing] = [len(u) for u in utf8]
            row, ids = np.repeat(row, sizes), np.repeat(ids, sizes)
            ids[ragged((np.cumsum(sizes) - sizes)[missing], sizes[missing])] = self.byte_ids[np.concatenate(utf8)]
        return row, ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes with n+1 offsets), and the n+1 offsets of each text's ids."""
        n = len(offsets) - 1
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = lead[offsets]
        if self.dummy_prefix:  # a space before each text that is not empty
            full = np.diff(at) > 0
            codes = np.insert(codes, at[:-1][full], 0x20)
            at = at + np.concatenate([[0], np.cumsum(full)])
        codes = np.where(codes == 0x20, np.uint32(SPACE), codes)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        ids = self.char_id[codes]
        small = np.minimum(ids, _DENSE)
        joined = self.dense[small[:-1], small[1:]]
        rare = np.flatnonzero((small[:-1] == _DENSE) | (small[1:] == _DENSE))
        if len(rare) and len(self.beside):
            key = ids[rare].astype(np.int64) << 24 | ids[rare + 1]
            place = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
            joined[rare] = self.beside[place] == key
        first = np.ones(len(codes), bool)
        first[1:] = ~joined
        first[1:] |= (codes[1:] == SPACE) & (codes[:-1] != SPACE) if self._spaces_lead else False
        first[at[:-1][at[:-1] < len(codes)]] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(codes)))
        sums = np.zeros(len(codes) + 1, np.uint64)
        values = mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        # The same kind of hash over the flat text, by inverse powers.
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), _BASE, np.uint64)]))
        np.cumsum(values * powers[:-1], out=sums[1:])
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64)]))
        keys = mix((sums[starts + sizes] - sums[starts]) * inverse[starts] + sizes.astype(np.uint64))
        unique, example, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._reset()
        number = np.array([self.known.get(k, -1) for k in unique.tolist()], np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn(codes, starts[example[new]], sizes[example[new]], unique[new])
        if len(self.starts) > 1:
            self.starts, self.sizes, self.flat = [np.concatenate(self.starts)], [np.concatenate(self.sizes)], [np.concatenate(self.flat)]
        number = number[which]
        lengths = self.sizes[0][number]
        out = self.flat[0][ragged(self.starts[0][number], lengths)]
        per_part = np.concatenate([[0], np.cumsum(lengths)])
        return out, per_part[np.searchsorted(starts, at)]

    @property
    def _spaces_lead(self) -> bool:
        """Whether a space that follows another character begins a part: true unless some piece has one inside."""
        space = int(self.char_id[SPACE])
        if space >= _DENSE:
            return False
        others = self.dense[:, space].copy()
        others[space] = False
        return not others.any() and not np.isin(self.beside & 0xFFFFFF, [space]).any()

    def _learn(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Segment new parts, batch by length, and remember them; their numbers."""
        numbers = np.zeros(len(keys), np.int64)
        for size in np.unique(sizes):
            of_size = np.flatnonzero(sizes == size)
            step = max(1, (1 << 18) // int(size))
            for a in range(0, len(of_size), step):
                some = of_size[a : a + step]
                row, ids = self.segment(codes[starts[some, None] + np.arange(size)])
                counts = np.bincount(row, minlength=len(some))
                first = len(self.known)
                numbers[some] = np.arange(first, first + len(some))
                self.known.update(zip(keys[some].tolist(), range(first, first + len(some))))
                self.starts.append(self.flat_size + np.cumsum(counts) - counts)
                self.sizes.append(counts)
                self.flat.append(ids)
                self.flat_size += len(ids)
        return numbers

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all id lists, and the n+1 offsets of each text's bytes.  Ids outside the vocabulary are unknown."""
        ids = np.where((ids >= 0) & (ids < len(self.surface_lengths)), ids, self.unknown)
        lengths = self.surface_lengths[ids]
        out = self.surface[ragged(self.surface_starts[ids], lengths)]
        at = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        if self.dummy_prefix:
            first = at[:-1][(np.diff(at) > 0)]
            first = first[out[first] == 0x20]
            out = np.delete(out, first)
            at = at - np.searchsorted(first, at)
        return out, at


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """The vocabulary of a SentencePiece model file with an identity normaliser that keeps white space."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
        raise ValueError("only identity normalisers that keep white space are supported")
    if model.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and merge vocabularies are supported")
    return Pieces([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == 2, spec.add_dummy_prefix)


def public_model() -> str:
    """The installed public 32k vocabulary; every executor has the package."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _mapped(df: DataFrame, id_col: str, text_col: str, model: str | None, schema: str, make: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model or public_model())
        for batch in text_chunks(batches):
            data, offsets = string_buffers(batch.column(1))
            yield make(pieces, batch, data, offsets)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")


def encode_texts(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row; null and empty texts have no ids.

    ``model`` is the path of a model file on every executor.  White space is kept as it is.  Rows are encoded one by one,
    whole, so repeated rows and null ids stay.  An empty table gives no rows.
    """

    def make(pieces: Pieces, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids, at = pieces.encode(data, offsets)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return _mapped(df, id_col, text_col, model, "ids array<int>", make)


def decode_texts(df: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of id lists; null and empty lists give the empty text, null ids and ids outside the vocabulary are unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model or public_model())
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, offsets = pieces.decode(flat, at)
            texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def encoding_digests(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_ids, ids_sha256, round_trip)``: SHA-256 over the ids as little-endian 32-bit numbers, and whether decoding them gives the text back.

    Null and empty texts have no ids and come back empty; rows are encoded whole and one by one, so repeated rows, null ids and
    very long texts stay.  An empty table gives no rows.
    """

    def make(pieces: Pieces, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids, at = pieces.encode(data, offsets)
        back, ends = pieces.decode(ids, at)
        flat = ids.astype("<i4")
        shas = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:])]
        if np.array_equal(ends, offsets):
            bad = np.concatenate([[0], np.cumsum(back != data)])
            same = bad[offsets[1:]] == bad[offsets[:-1]]
        else:
            same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:])])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(shas), pa.array(same)], ["doc_id", "n_ids", "ids_sha256", "round_trip"])

    return _mapped(df, id_col, text_col, model, "n_ids long, ids_sha256 string, round_trip boolean", make)
