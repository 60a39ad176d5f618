"""Language-model scoring with a gated recurrent network in numpy.

Words are known by 64-bit hashes.  The frequent ones of all training documents are outputs of their own, in classes by
frequency; all others share a few shape classes (accents, last character, length).  The network gives the class of the next
token and, for a frequent word, the word in its class; within a shape class words follow their add-one counts over the whole
corpus, with one place for unseen words.  So probabilities over all words sum to one, and the counts, which every document
contributes to, grow with the corpus.

Texts are read once: a batch of documents becomes places in the batch's own sorted vocabulary, and that vocabulary travels in
ranges of hashes to where the ranges of all batches meet, are summed, and go back as counts.  Only binary columns move, a row
for each batch and range, so a word that every batch has costs a count a batch and no rows of its own.

The network is a gated unit with one gate for what is forgotten and what is taken in.  Training is truncated backpropagation
through windows of parallel streams, state carried from window to window and reset between documents.  All training documents
are dealt to shards by a hash of id and text; in each round every shard trains the same network on its next part, and the means
of the weights by tokens start the next round.  Scoring runs documents in step, longest first, state carried through each whole
document.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, lower_ascii, span_hashes, string_buffers, text_chunks, word_spans, written

#: The hash that stands for the end of a document.
END = np.uint64(0x5DEECE66D5DEECE6)
SHAPES = 16


@dataclass(frozen=True)
class LmParams:
    """All training documents train the network once, in shards of about ``shard_tokens * r`` tokens, where r is the third root of
    how many shards of ``shard_tokens`` there would be: with more text there are both more shards and more steps in each.
    ``round_tokens``: a shard's tokens between two means of all shards' weights.  ``updates``: steps that a smaller
    shard makes too, with fewer streams side by side; one of fewer than ``updates * window`` tokens is gone through again.  ``batch_bytes``: text that is numbered together.  ``score_tokens``: tokens that
    are scored in step.  ``range_bytes``: text for each range of hashes."""

    words: int = 2048
    per_class: int = 64
    hidden: int = 24
    embed: int = 24
    window: int = 24
    streams: int = 250
    rate: float = 0.02
    clip: float = 1.0
    shard_tokens: int = 2_000_000
    round_tokens: int = 1_000_000
    updates: int = 1200
    seed: int = 5
    batch_bytes: int = 6 << 20
    score_tokens: int = 4_000_000
    range_bytes: int = 7 << 20

    def shards(self, tokens: int) -> tuple[int, int]:
        """(shards, rounds) for so many training tokens."""
        size = self.shard_tokens * max(1.0, tokens / self.shard_tokens) ** (1 / 3)
        shards = max(1, round(tokens / size))
        return shards, max(1, round(tokens / shards / self.round_tokens)) if shards > 1 else 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, bounds): the tokens of all documents, each document's closed by the end token."""
    data = lower_ascii(data)
    starts, ends, words = word_spans(data, offsets)
    n_docs = len(offsets) - 1
    bounds = words + np.arange(n_docs + 1)
    total = int(bounds[-1])
    h, shape = np.full(total, END, np.uint64), np.full(total, SHAPES, np.int8)
    if len(starts):
        at = np.arange(len(starts)) + np.repeat(np.arange(n_docs), np.diff(words))
        h[at] = span_hashes(data, starts, ends)
        high = np.concatenate([[0], np.cumsum(data >= 128)])
        last = data[ends - 1]
        mark = np.where(last == 0x2C, 1, np.where(last == 0x2E, 2, np.where((last >= 97) & (last <= 122) | (last >= 128), 0, 3)))
        shape[at] = (high[ends] > high[starts]) * 8 + mark * 2 + (ends - starts >= 7)
    return h, shape, bounds


def batch_tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`tokens`, of a whole column, a chunk of text at a time."""
    pieces = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [tokens(*string_buffers(chunk.column(0))) for piece in pieces for chunk in text_chunks([pa.RecordBatch.from_arrays([piece], ["text"])], 0)]
    if not parts:
        return tokens(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    sizes = np.concatenate([[0], *[np.diff(bounds) for _, _, bounds in parts]])
    return np.concatenate([h for h, _, _ in parts]), np.concatenate([x for _, x, _ in parts]), np.cumsum(sizes)


class Network:
    """The weights, the forward pass and the backward pass.

    Inputs are words, then shapes, then the end token, which also stands before a document.  Output classes are the word
    classes, then the shapes, then the end.  Inside, features are rows and tokens columns.
    """

    def __init__(self, vocabulary: np.ndarray, params: LmParams):
        """``vocabulary``: hashes of the frequent words, most frequent first."""
        self.params = params
        self.vocabulary = vocabulary.astype(np.uint64)
        k, n, d, per = len(vocabulary), params.hidden, params.embed, params.per_class
        self.k, self.word_classes = k, -(-k // per)
        self.classes = self.word_classes + SHAPES + 1
        symbols = np.arange(k + SHAPES + 1)
        self.class_of = np.where(symbols < k, symbols // per, self.word_classes + symbols - k)
        self.small = np.uint16 if len(symbols) < 1 << 16 else np.uint32
        rng = np.random.default_rng(params.seed)

        def normal(deviation: float, *shape: int) -> np.ndarray:
            return rng.normal(0, deviation, shape).astype(np.float32)

        self.w = {
            "e": normal(0.5, k + SHAPES + 1, d), "x": normal(d**-0.5, 2 * n, d), "u": normal(n**-0.5, 2 * n, n), "b": np.zeros((2 * n, 1), np.float32),
            "c": normal(n**-0.5, self.classes, n), "cb": np.zeros((self.classes, 1), np.float32),
            "o": normal(n**-0.5, self.word_classes * per, n), "ob": np.zeros((self.word_classes * per, 1), np.float32),
        }
        self.w["ob"][k:] = -1e9
        self._held: dict[str, np.ndarray] = {}
        self.fresh()

    def fresh(self) -> None:
        """No step made yet."""
        self.done, self.moments = 0, {m: {k: np.zeros_like(v) for k, v in self.w.items()} for m in ("m", "v")}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """A scratch array; the next call of the same name overwrites it."""
        size = int(np.prod(shape))
        have = self._held.get(name)
        if have is None or have.size < size:
            have = self._held[name] = np.empty(size, self.w["u"].dtype)
        return have[:size].reshape(shape)

    def symbols(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Input numbers of tokens."""
        if not self.k:
            return self.k + shape.astype(np.int64)
        order = np.argsort(self.vocabulary)
        at = np.minimum(np.searchsorted(self.vocabulary, h, sorter=order), self.k - 1)
        known = (self.vocabulary[order[at]] == h) & (shape < SHAPES)
        return np.where(known, order[at], self.k + shape.astype(np.int64))

    def step(self, gx: np.ndarray, h: np.ndarray, gate: np.ndarray, candidate: np.ndarray, hu: np.ndarray, out: np.ndarray) -> None:
        """One token of each column, into the four last arrays: ``out = h + gate * (candidate - h)``."""
        n, u = self.params.hidden, self.w["u"]
        np.matmul(u[:n], h, out=gate)
        gate += gx[:n]
        np.negative(gate, out=gate)
        np.exp(gate, out=gate)
        gate += np.float32(1)
        np.reciprocal(gate, out=gate)
        np.matmul(u[n:], h, out=hu)
        np.multiply(gate, hu, out=candidate)
        candidate += gx[n:]
        np.tanh(candidate, out=candidate)
        np.subtract(candidate, h, out=out)
        out *= gate
        out += h

    def outputs(self, h: np.ndarray, target: np.ndarray, gradient: bool = False):
        """Natural-log probability of each target symbol from its state, a column of ``h``; with ``gradient`` also that of the summed loss."""
        w, per, m = self.w, self.params.per_class, len(target)
        cls, columns, one = self.class_of[target], np.arange(m), np.float32(1)
        e = np.matmul(w["c"], h, out=self.room("logits", self.classes, m))
        e += w["cb"]
        e -= e.max(0)
        out = e[cls, columns]
        np.exp(e, out=e)
        total = e.sum(0)
        out -= np.log(total)
        if gradient:
            e *= one / total
            e[cls, columns] -= one
            dh = np.matmul(w["c"].T, e, out=self.room("dh", len(h), m))
            grads = {"c": e @ h.T, "cb": e.sum(1, keepdims=True), "o": np.zeros_like(w["o"]), "ob": np.zeros_like(w["ob"])}
        order = np.argsort(target.astype(self.small), kind="stable")
        edges = np.searchsorted(target[order], np.minimum(np.arange(self.word_classes + 1) * per, self.k))
        order = order[: edges[-1]]
        hs = np.take(h, order, axis=1, out=self.room("hs", len(h), len(order)), mode="clip")
        pick, found = target[order] % per, np.empty(len(order), h.dtype)
        back = self.room("back", *hs.shape)
        for i in range(self.word_classes):
            a, b = edges[i], edges[i + 1]
            if a == b:
                continue
            own, at = slice(i * per, (i + 1) * per), (pick[a:b], columns[: b - a])
            e = np.matmul(w["o"][own], hs[:, a:b], out=self.room("words", per, b - a))
            e += w["ob"][own]
            e -= e.max(0)
            logit = e[at]
            np.exp(e, out=e)
            total = e.sum(0)
            found[a:b] = logit - np.log(total)
            if gradient:
                e *= one / total
                e[at] -= one
                np.matmul(w["o"][own].T, e, out=back[:, a:b])
                grads["o"][own] = e @ hs[:, a:b].T
                grads["ob"][own] = e.sum(1, keepdims=True)
        out[order] += found
        if not gradient:
            return out
        dh[:, order] += back
        return out, grads, dh

    def window_gradient(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h0: np.ndarray):
        """Loss, gradients and last state of one window (steps x streams); ``fresh`` marks first tokens of documents, states are (hidden, streams)."""
        (steps, m), n, w, room = inputs.shape, self.params.hidden, self.w, self.room
        flat, d, one = inputs.ravel(), w["e"].shape[1], np.float32(1)
        x = np.take(w["e"], flat, axis=0, out=room("x", steps * m, d), mode="clip").reshape(steps, m, d)
        gx = np.matmul(w["x"], x.transpose(0, 2, 1), out=room("gx", steps, 2 * n, m))
        gx += w["b"]
        keep = (~fresh).astype(h0.dtype)
        before, states, gate, candidate, hu = (room(name, steps, n, m) for name in ("before", "states", "gate", "candidate", "hu"))
        h = h0
        for t in range(steps):
            np.multiply(h, keep[t], out=before[t])
            self.step(gx[t], before[t], gate[t], candidate[t], hu[t], states[t])
            h = states[t]
        last, together = h.copy(), room("together", n, steps * m)
        together.reshape(n, steps, m)[:] = states.transpose(1, 0, 2)
        out, grads, dh = self.outputs(together, targets.ravel(), True)
        states[:] = dh.reshape(n, steps, m).transpose(1, 0, 2)
        du, stay, back = room("du", steps, 2 * n, m), room("stay", n, m), np.zeros_like(h0)
        turned = np.ascontiguousarray(w["u"].T)
        for t in range(steps - 1, -1, -1):
            g, c, of_gate, of_hu, through = gate[t], candidate[t], du[t, :n], du[t, n:], states[t]
            through += back
            of_c = gx[t, n:]  # the gradient of each row of gx replaces it
            np.multiply(c, c, out=of_c)
            np.subtract(one, of_c, out=of_c)
            of_c *= g
            of_c *= through
            np.multiply(of_c, g, out=of_hu)
            hu[t] *= of_c
            c -= before[t]
            c *= through
            c += hu[t]
            np.subtract(one, g, out=stay)
            c *= g
            np.multiply(c, stay, out=of_gate)
            np.matmul(turned, du[t], out=back)
            stay *= through
            back += stay
            back *= keep[t]
            gx[t, :n] = of_gate
        dx = np.matmul(gx.transpose(0, 2, 1), w["x"], out=room("dx", steps, m, d)).reshape(-1, d)
        order = np.argsort(flat.astype(self.small), kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
        de = np.zeros_like(w["e"])
        de[flat[order[at]]] = np.add.reduceat(np.take(dx, order, axis=0, out=room("sorted", *dx.shape), mode="clip"), at, axis=0)
        grads |= {"e": de, "x": np.matmul(gx, x).sum(0), "u": np.matmul(du, before.transpose(0, 2, 1)).sum(0), "b": gx.sum((0, 2))[:, None]}
        return -float(out.sum()), grads, last

    def streams(self, size: int, calls: int = 1) -> int:
        """Streams side by side for ``size`` tokens, one of ``calls`` parts, so that all make ``updates`` steps if they can."""
        p = self.params
        return max(1, min(p.streams, size * calls // (p.window * p.updates), size // (2 * p.window)))

    def train(self, stream: np.ndarray, fresh: np.ndarray, passes: int = 1, part: tuple[int, int] = (0, 1)) -> float:
        """Adam over windows of parallel streams; ``stream`` holds symbols of whole documents, one after another.  The last pass's loss per token.

        ``part`` (i, n): this is the i-th of n calls that share a falling rate; moments go on from call to call."""
        p, f = self.params, np.float32
        streams = self.streams(len(stream), part[1])
        size = -(-len(stream) // streams)
        if size < 2:
            return 0.0
        # The last stream is filled up with the first tokens, so that no token is left out.
        stream, fresh = (np.concatenate([x, x[: size * streams - len(x)]]) for x in (stream, fresh))
        end = self.k + SHAPES
        grid, first = stream.reshape(streams, size).T, fresh.reshape(streams, size).T
        before = np.full((size, streams), end)
        before[1:], before[0, 1:] = grid[:-1], grid[-1, :-1]
        before[first] = end
        done, loss = 0, 0.0
        windows = [(a, min(a + p.window, size)) for a in range(0, size, p.window)]
        total = passes * len(windows)
        for _ in range(passes):
            h, loss = np.zeros((p.hidden, streams), f), 0.0
            for a, b in windows:
                summed, grads, h = self.window_gradient(before[a:b], grid[a:b], first[a:b], h)
                loss += summed
                n = (b - a) * streams
                norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / n
                scale = f(min(1.0, p.clip / max(norm, 1e-9)) / n)
                done += 1
                self.done += 1
                rate = p.rate * min(1.0, self.done / 20) * (1 - 0.9 * (part[0] + done / total) / part[1])
                rate, root = f(rate / (1 - 0.9**self.done)), f((1 - 0.99**self.done) ** -0.5)
                for k, g in grads.items():
                    g *= scale
                    mean, square = self.moments["m"][k], self.moments["v"][k]
                    mean += f(0.1) * (g - mean)
                    g *= g
                    square += f(0.01) * (g - square)
                    np.sqrt(square, out=g)
                    g *= root
                    g += f(1e-6)
                    np.divide(mean, g, out=g)
                    g *= rate
                    self.w[k] -= g
                self.w["ob"][self.k :] = -1e9
        return loss / (size * streams)

    def score(self, symbols: np.ndarray, bounds: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """Natural-log probability of each document's symbols, whole documents in step, longest first."""
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = bounds[:-1][order], lengths[order]
        total, n = np.zeros(len(order)), self.params.hidden
        table = self.w["x"] @ self.w["e"].T + self.w["b"]
        h, before = np.zeros((n, len(order)), table.dtype), np.full(len(order), self.k + SHAPES)
        t, top = 0, int(lengths.max(initial=0))
        while t < top:
            live = int(np.searchsorted(-lengths, -t, "left"))  # documents longer than t
            steps = max(1, min(top - t, block // max(1, live)))
            states, targets, docs = np.empty((n, steps * live), h.dtype), np.empty(steps * live, np.int64), np.empty(steps * live, np.int64)
            at = 0
            for s in range(t, t + steps):
                live = int(np.searchsorted(-lengths, -s, "left"))
                now = symbols[starts[:live] + s]
                out = states[:, at : at + live]
                self.step(np.take(table, before[:live], axis=1), h[:, :live], *(self.room(name, n, live) for name in ("gate", "candidate", "hu")), out)
                h, before = out, now
                targets[at : at + live], docs[at : at + live] = now, np.arange(live)
                at += live
            h = np.ascontiguousarray(h)
            total += np.bincount(docs[:at], self.outputs(states[:, :at], targets[:at]), len(order))
            t += steps
        result = np.zeros(len(order))
        result[order] = total
        return result

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, done=self.done, **{f"{at}_{k}": v for at, of in (("w", self.w), *self.moments.items()) for k, v in of.items()})
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes, params: LmParams) -> Network:
        held = np.load(io.BytesIO(raw))
        net = Network(held["vocabulary"], params)
        parts = {at: {k[2:]: held[k] for k in held.files if k.startswith(f"{at}_")} for at in "wmv"}
        net.w, net.moments, net.done = parts["w"], {"m": parts["m"], "v": parts["v"]}, int(held["done"])
        return net

    def parts(self) -> list[dict[str, np.ndarray]]:
        return [self.w, self.moments["m"], self.moments["v"]]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


_ROWS = "ids array<{kind}>, held array<boolean>, keys array<long>, sizes array<long>, places binary"


def _bytes(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of consecutive parts of ``values``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def numbered(rows: DataFrame, ranges: int, params: LmParams) -> DataFrame:
    """Batches of ``rows(doc_id, text, held_out, key)``, in the order they are read.

    Two kinds of row: for ``r`` -1 a batch's documents and the place of each token in the batch's sorted vocabulary, as byte
    planes; for others the part of that vocabulary in the range ``r`` of hashes: hashes, shapes, and counts in training rows.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"b long, r int, {_ROWS.format(kind=kind)}, h binary, shape binary, c binary"

    def batch(b: int, held: list) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([x.column(0) for x, *_ in held])
        out, keys = (pa.concat_arrays([x.column(i) for x, *_ in held]) for i in (2, 3))
        h, shape = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        sizes = np.concatenate([np.diff(bounds) for *_, bounds in held])
        order = np.argsort(h)
        h = h[order]
        new = np.append(True, h[1:] != h[:-1])
        at = np.flatnonzero(new)
        place = np.empty(len(h), np.uint32)
        place[order] = np.cumsum(new) - 1
        c = np.bincount(place[np.repeat(~out.to_numpy(zero_copy_only=False), sizes)], minlength=len(at)).astype(np.int64)
        h, shape = h[at], shape[order[at]].astype(np.uint8)
        planes = place.view(np.uint8).reshape(-1, 4)[:, : 3 if len(at) <= 1 << 24 else 4].T.tobytes()
        of = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
        n = len(edges) - 1
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        empty = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([-1], pa.int32()), one(ids), one(out), one(keys), one(pa.array(sizes)), pa.array([planes], pa.binary()), empty, empty, empty], names)
        nulls = [pa.nulls(n, t) for t in (pa.list_(ids.type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b)), pa.array(of[edges[:-1]].astype(np.int32)), *nulls, _bytes(h, edges), _bytes(shape, edges), _bytes(c, edges)], names)

    names = ["b", "r", "ids", "held", "keys", "sizes", "places", "h", "shape", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 32, [], 0
        for chunk in text_chunks(batches):
            data, offsets = string_buffers(chunk.column(1))
            held.append((chunk, *tokens(data, offsets)))
            size += len(data) + 16 * chunk.num_rows
            if size >= params.batch_bytes:
                yield from batch(at, held)
                at, held, size = at + 1, [], 0
        if held:
            yield from batch(at, held)

    return rows.select("doc_id", "text", "held_out", "key").mapInArrow(run, schema)


_SUMS = "tokens long, known long, mass array<long>, top_h array<long>, top_c array<long>, top_shape array<int>"


def totals(parts: DataFrame, params: LmParams) -> DataFrame:
    """For each part of a vocabulary (``b``, ``r``) the words' counts over all batches; and a row for each range (``b`` -1) with its sums.

    Words that may be among the ``params.words`` most frequent of all, those of their range, come with their hashes."""

    def total(table: pa.Table) -> pa.Table:
        part = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        h, shape, c = part("h", np.uint64), part("shape", np.uint8), part("c", np.int64)
        order = np.argsort(h)
        new = np.append(True, np.diff(h[order]) != 0)
        at = np.flatnonzero(new)
        of = np.empty(len(h), np.int64)
        of[order] = np.cumsum(new) - 1
        count, kind = np.add.reduceat(c[order], at), shape[order[at]]
        word = (count > 0) & (kind < SHAPES)
        best = np.flatnonzero(word)
        best = best[np.lexsort((h[order[at]][best], -count[best]))[: params.words]]
        frequent = np.zeros(len(at), bool)
        frequent[best] = True
        n = table.num_rows
        bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in table.column("h").to_pylist()])])
        chosen = frequent[of]
        inside = np.concatenate([[0], np.cumsum(chosen)])[bounds]
        place = (np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds)))[chosen].astype(np.uint32)
        mass = np.bincount(kind[word], count[word] + 1, SHAPES).astype(np.int64)
        lists = [pa.array([None] * n + [x.tolist()], t) for x, t in ((mass, pa.list_(pa.int64())), (h[order[at[best]]].view(np.int64), pa.list_(pa.int64())), (count[best], pa.list_(pa.int64())), (kind[best], pa.list_(pa.int32())))]
        binary = [pa.concat_arrays([_bytes(x, y), pa.nulls(1, pa.binary())]) for x, y in ((shape, bounds), (count[of], bounds), (place, inside), (h[chosen], inside))]
        b = table.column("b").to_pylist() + [-1]
        r = table.column("r").to_pylist()
        return pa.table([pa.array(b, pa.int64()), pa.array(r + r[:1], pa.int32()), *binary, pa.array([None] * n + [int(count.sum())], pa.int64()), pa.array([None] * n + [int((count > 0).sum())], pa.int64()), *lists],
                        ["b", "r", "shape", "c", "place", "h", "tokens", "known", "mass", "top_h", "top_c", "top_shape"])

    return parts.groupBy("r").applyInArrow(total, f"b long, r int, shape binary, c binary, place binary, h binary, {_SUMS}")


@dataclass(frozen=True)
class Corpus:
    """Sums over all training tokens, and the most frequent words."""

    tokens: int
    known: int
    log_mass: np.ndarray
    vocabulary: np.ndarray


def corpus(sums: DataFrame, params: LmParams) -> Corpus:
    """The sums of all ranges: one row, and the ``params.words`` most frequent words, ties by hash."""
    row = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0)), *[F.coalesce(F.sum(F.col("mass")[j]), F.lit(0)) for j in range(SHAPES)]).first()
    each = sums.select(F.explode(F.arrays_zip("top_h", "top_c", "top_shape")).alias("w")).select("w.top_h", "w.top_c", "w.top_shape")
    unsigned = F.col("top_h").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    top = each.orderBy(F.desc("top_c"), unsigned).limit(params.words).collect()
    mass = np.array(row[2:], float)
    for r in top:  # frequent words are outputs of their own
        mass[r["top_shape"]] -= r["top_c"] + 1
    # A word within its shape: (c + 1) / (sum of c + 1 over the shape's known words, and one for unseen words).
    return Corpus(row[0], row[1], np.log10(mass + 1), np.array([r["top_h"] for r in top], np.int64).view(np.uint64))


_READY = "doc_id {kind}, held_out boolean, key long, n_tokens long, n_known long, base_score double, within double, s binary"


def ready(batches: DataFrame, counts: DataFrame, found: Corpus, net: Network) -> DataFrame:
    """Each document's counts, base score, probability of words within their shapes, and symbols."""
    kind = batches.schema["ids"].dataType.elementType.simpleString()
    names = ["doc_id", "held_out", "key", "n_tokens", "n_known", "base_score", "within", "s"]
    k, small, vocabulary, log_mass = net.k, net.small, net.vocabulary, np.append(found.log_mass, 0.0)
    order, log_all = np.argsort(vocabulary), np.log10(found.tokens + found.known + 1.0)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("r")
        part = lambda name, kind: np.frombuffer(b"".join(right.column(name).to_pylist()), kind)
        shape, c, h = part("shape", np.uint8).astype(np.int64), part("c", np.int64), part("h", np.uint64)
        sizes = np.array([len(x) for x in right.column("shape").to_pylist()])
        inside = np.array([len(x) // 4 for x in right.column("place").to_pylist()])
        place = part("place", np.uint32) + np.repeat(np.cumsum(sizes) - sizes, inside)
        symbol = k + shape
        if k:
            at = np.minimum(np.searchsorted(vocabulary, h, sorter=order), k - 1)
            same = vocabulary[order[at]] == h
            symbol[place[same]] = order[at[same]]
        rare = (symbol >= k) & (shape < SHAPES)
        log_c = np.log10(c + 1.0)
        within = np.where(rare, log_c - log_mass[shape], 0.0)
        ids, held, keys, sizes = (left.column(name).combine_chunks().flatten() for name in ("ids", "held", "keys", "sizes"))
        n = sizes.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(n)])
        planes = np.frombuffer(left.column("places")[0].as_py(), np.uint8).reshape(-1, bounds[-1])
        of = planes[0].astype(np.int64)
        for i, plane in enumerate(planes[1:]):
            of |= plane.astype(np.int64) << (8 * i + 8)
        add = lambda values: np.add.reduceat(values[of], bounds[:-1])  # noqa: E731  each document has its end token
        return pa.table([ids, held, keys, sizes, pa.array(add((c > 0).astype(np.int64))), pa.array(add(log_c) - n * log_all), pa.array(add(within)), _bytes(symbol.astype(small)[of], bounds)], names)

    return batches.groupBy("b").cogroup(counts.groupBy("b")).applyInArrow(join, _READY.format(kind=kind))


def train_network(net: Network, docs: DataFrame, shards: int, rounds: int) -> Network:
    """The network after all of ``docs(shard, part, s)`` have trained it once: in each round every shard goes on from the means of all
    shards' weights and moments, by tokens, with its next part."""
    params, kind, end = net.params, net.small, net.k + SHAPES
    sc = docs.sparkSession.sparkContext

    def mean(found: Iterator[tuple[int, int, Network]]) -> Iterator[pa.RecordBatch]:
        """One row: the first number, all tokens, and the mean by tokens of the networks."""
        first, total, held, sums = 0, 0, None, []
        for number, n, model in found:
            if held is None:
                first, held, sums = number, model, [{k: np.zeros(v.shape) for k, v in part.items()} for part in model.parts()]
            for into, part in zip(sums, model.parts()):
                for k, v in part.items():
                    into[k] += v.astype(np.float64) * n
            held.done = max(held.done, model.done)
            total += n
        if held is not None and total:
            for part, into in zip(held.parts(), sums):
                part.update({k: v / total for k, v in into.items()})
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total], pa.int64()), pa.array([held.dump()], pa.binary())], ["at", "n", "w"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from mean((b.column(0)[i].as_py(), b.column(1)[i].as_py(), Network.from_bytes(b.column(2)[i].as_py(), params)) for b in batches for i in range(b.num_rows))

    def once(call: int, raw) -> bytes | None:
        """The mean network after all shards have trained on their next part."""

        def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Network]]:
            for shard, pieces in shards_of(batches):
                s = np.frombuffer(b"".join(pieces), kind).astype(np.int64)
                model = Network.from_bytes(raw.value, params)
                again = max(1, -(-params.updates * params.window // (len(s) * rounds)))  # more than one only where one stream alone is too short
                model.train(s, np.append(True, s[:-1] == end), again, (call, rounds))
                yield shard, len(s), model

        rows = docs.where(F.col("part") == call)  # a folder of its own
        rows = rows.select("shard", "s").mapInArrow(lambda batches: mean(trained(batches)), "at int, n long, w binary")
        for groups in (int(shards**0.5), 1) if shards > 1 else ():
            rows = rows.repartition(groups, F.pmod("at", F.lit(groups))).sortWithinPartitions("at").mapInArrow(means, "at int, n long, w binary")
        got = rows.first()
        return bytes(got["w"]) if got else None

    raw = sc.broadcast(net.dump())
    for call in range(rounds):
        if (new := once(call, raw)) is None:
            continue
        net = Network.from_bytes(new, params)
        for part in net.parts():
            part.update({k: v.astype(np.float32) for k, v in part.items()})
        raw = sc.broadcast(net.dump())
    return net


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive rows of one shard."""
    now, held = None, []
    for batch in batches:
        for shard, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append(s)
    if held:
        yield now, held


def learn(docs: DataFrame, params: LmParams, id_col: str, text_col: str) -> tuple[Corpus, Network, DataFrame]:
    """What all training rows teach, and the table that scoring reads, a file for each shard."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"held_out": held_out("doc_id"), "key": F.xxhash64("doc_id", "text", F.lit(params.seed))})
    spark = docs.sparkSession
    batches, at = written(numbered(rows, batches_of(docs, params.range_bytes, text_col), params))
    counts, counts_at = written(totals(batches.where("r >= 0").select("b", "r", "h", "shape", "c"), params))
    found = corpus(counts.where("b = -1"), params)
    net = Network(found.vocabulary, params)
    shards, rounds = params.shards(found.tokens)
    table = ready(batches.where("r = -1").select("b", "ids", "held", "keys", "sizes", "places"), counts.where("b >= 0").select("b", "r", "shape", "c", "place", "h"), found, net)
    table = table.withColumns({"shard": F.pmod("key", F.lit(shards)).cast("int"), "part": F.pmod(F.shiftrightunsigned("key", 32), F.lit(rounds)).cast("int")})
    table, _ = written(table.repartitionById(shards, F.col("shard")).sortWithinPartitions("part", "key", "doc_id"), "part")
    for path in (at, counts_at):
        discard(spark, path)
    return found, train_network(net, table.where(~F.col("held_out")), shards, rounds), table


def lm_scores(docs: DataFrame, params: LmParams = LmParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Learns from the rows whose ``crc32`` of the id as text is not 2 mod 7; a null id is learnt from.  A null text counts as
    empty: the end token alone.  Repeated rows count and are scored each; a very long text is a batch of its own, read whole.
    Without any training row all counts are zero and scores are those of the untrained network.  An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found, net, table = learn(docs, params, id_col, text_col)
    raw = docs.sparkSession.sparkContext.broadcast(net.dump())  # of the size of the vocabulary parameter
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = Network.from_bytes(raw.value, params), [], 0

        def scored() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            bounds = np.concatenate([[0], np.cumsum(t.column("n_tokens").to_numpy())])
            s = np.concatenate([np.frombuffer(string_buffers(chunk)[0], model.small) for chunk in t.column("s").chunks])
            score = model.score(s, bounds) / np.log(10) + t.column("within").to_numpy()
            return pa.RecordBatch.from_arrays([*(t.column(name).combine_chunks() for name in names[:-1]), pa.array(score)], names)

        for batch in batches:
            held.append(batch)
            size += int(np.sum(batch.column("n_tokens").to_numpy()))
            if size >= params.score_tokens:
                yield scored()
                held, size = [], 0
        if size:
            yield scored()

    out = table.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "s").mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(found.tokens).cast("long").alias("train_tokens"), "base_score", "score")
