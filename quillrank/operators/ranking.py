"""Deterministic top-k, BM25 over an inverted index, and exhaustive vector search."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.text import HANGUL_LATIN, Scripts, python_tokenizer, tokens
from quillrank.functions.vectors import similarity

#: Decimals of a score that count for ranks.  Sums in another order differ beyond them; equal scores then tie.
SCORE_DECIMALS = 7


@dataclass(frozen=True)
class Bm25Params:
    """``block_queries``, ``block_terms`` and ``block_pairs`` bound the query set that is sent to every executor: its queries,
    its terms and its (query, term) pairs.  Beyond them scores are joined and summed relationally."""

    k1: float = 1.2
    b: float = 0.75
    mode: str = "char_bigram"
    scripts: Scripts = HANGUL_LATIN
    block_queries: int = 4096
    block_terms: int = 65_536
    block_pairs: int = 500_000


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The ``k`` highest rows of each group with ``rank`` from one; ties by the id as a string."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.col(tie).cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def spread(df: DataFrame) -> DataFrame:
    """A small input that was read in fewer parts than there are cores is dealt out evenly; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Texts that a worker has as tokens at once.
COUNTED_TEXTS = 64


def text_counts(rows: DataFrame, count: Callable[[str], dict], key: str, kind: str, value: str, totals: bool = False) -> DataFrame:
    """The columns of ``rows`` but its last, the text, with ``key`` of this kind and its ``value`` for each entry of ``count(text)``.

    A text is counted whole where it is read, so nothing is shuffled.  With ``totals`` the sum of a text's values is on all its rows,
    and each text has a row without a key."""
    others = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.string() if kind == "string" else pa.int32()
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED_TEXTS):
                batch = whole.slice(at, COUNTED_TEXTS)
                keys, values, sizes, sums = [], [], [], []
                for text in batch.column(len(others)).to_pylist():
                    own = count(text or "")
                    keys += own
                    values += own.values()
                    if totals:
                        keys.append(None)
                        values.append(0)
                        sums.append(sum(own.values()))
                    sizes.append(len(own) + totals)
                row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                columns = [*(batch.column(i).take(row) for i in range(len(others))), pa.array(keys, of), pa.array(values, pa.int64())]
                if totals:
                    columns.append(pa.array(sums, pa.int64()).take(row))
                yield pa.RecordBatch.from_arrays(columns, [*others, key, value, "total"][: len(columns)])

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.mapInArrow(run, f"{schema}{key} {kind}, {value} long" + (", total long" if totals else ""))


def counted_by_id(rows: DataFrame, count: Callable[[str], dict], key: str, kind: str, value: str) -> DataFrame:
    """``(doc_id, key, value)`` from ``rows(doc_id, text)``; rows that share an id are summed, and they alone are shuffled."""
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("shared_id"))
    if shared.isEmpty():
        return text_counts(rows, count, key, kind, value)
    same = F.col("doc_id").eqNullSafe(F.col("shared_id"))
    alone = text_counts(rows.join(shared, same, "left_anti"), count, key, kind, value)
    return alone.unionByName(text_counts(rows.join(shared, same, "left_semi"), count, key, kind, value).groupBy("doc_id", key).agg(F.sum(value).alias(value)))


def term_counter(mode: str, scripts: Scripts = HANGUL_LATIN) -> Callable[[str], dict[str, int]]:
    """A text's terms and how often each is there."""
    cut = python_tokenizer(mode, scripts)
    return lambda text: Counter(cut(text))


def term_frequencies(docs: DataFrame, mode: str, scripts: Scripts = HANGUL_LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, term, tf)``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return counted_by_id(rows, term_counter(mode, scripts), "term", "string", "tf")


def document_terms(docs: DataFrame, mode: str, scripts: Scripts = HANGUL_LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, term)``: the distinct terms of each row; rows that share an id stay apart."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(text_col), mode, scripts))).alias("term"))


def document_lengths(docs: DataFrame, mode: str, scripts: Scripts = HANGUL_LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, dl)`` of every document, those without a token too."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(tokens(F.col(text_col), mode, scripts)).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row ``(n, avg_len)``; an empty corpus has average zero."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avg_len"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def inverse_frequencies(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """``(term, df, idf)`` from a row for each document and term that it has."""
    return inverse_from_counts(frequencies.groupBy("term").agg(F.count("*").alias("df")), stats)


def inverse_from_counts(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """``(term, df, idf)`` from ``(term, df)``."""
    return counts.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))  # one row of stats


def document_weight(params: Bm25Params) -> Column:
    """A posting's BM25 weight from ``idf``, ``tf``, ``dl`` and ``avg_len``."""
    norm = F.when(F.col("avg_len") > 0, F.col("dl") / F.col("avg_len")).otherwise(F.lit(0.0))
    return F.col("idf") * F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * (1 - params.b + params.b * norm))


def query_terms(queries: DataFrame, params: Bm25Params) -> DataFrame:
    """``(query_id, term)``: each query's distinct terms; rows that share an id are one query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text"), params.mode, params.scripts))).alias("term")).distinct()


def numbered_postings(docs: DataFrame, params: Bm25Params) -> tuple[DataFrame, DataFrame]:
    """``(row, doc_id, dl, term, tf)``, and the corpus's statistics.  ``row`` keeps rows that share an id apart; it is the same
    only within one plan."""
    bags = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", tokens(F.col("text"), params.mode, params.scripts).alias("ts")).withColumn("dl", F.size("ts").cast("long"))
    found = bags.select("row", "doc_id", "dl", F.explode("ts").alias("term"))
    return found.groupBy("row", "doc_id", "dl", "term").agg(F.count("*").alias("tf")), corpus_stats(bags)


#: Documents of a group that a task scores against a block of queries, cells of (document, query) and of (posting, query) at once.
GROUP_DOCS, SCORE_CELLS = 4096, 1 << 21


def _named(column: pa.ChunkedArray) -> np.ndarray:
    """The place of each id in their order as strings, null first."""
    names = column.cast(pa.string()).to_pylist()
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i]))] = np.arange(len(names))
    return place


def _visit(asked: pa.Table, posted: pa.Table, k: int | None) -> pa.Table:
    """``(query_id, doc_id, score)`` of the queries in ``asked(query_id, term)`` on the documents in ``posted(row, doc_id, term, w)`` with which
    they share a term; with ``k`` each query's best by rounded scores."""
    queries = pc.dictionary_encode(asked["query_id"].combine_chunks(), null_encoding="encode")
    vocabulary = pc.unique(asked["term"])
    slot, asker = pc.index_in(asked["term"], value_set=vocabulary).to_numpy(), queries.indices.to_numpy().astype(np.int64)
    by_slot = np.argsort(slot, kind="stable")
    asker, starts = asker[by_slot], np.searchsorted(slot[by_slot], np.arange(len(vocabulary) + 1))
    posted = posted.filter(pc.is_in(posted["term"], value_set=vocabulary))  # other terms are another block's
    slot, w = pc.index_in(posted["term"], value_set=vocabulary).to_numpy().astype(np.int64), posted["w"].to_numpy()
    rows, first, doc = np.unique(posted["row"].to_numpy(), return_index=True, return_inverse=True)
    ids = posted["doc_id"].take(pa.array(first))
    place = _named(ids)
    doc = place[doc]
    by_doc = np.lexsort((slot, doc))
    doc, slot, w = doc[by_doc], slot[by_doc], w[by_doc]
    n, wide = len(rows), len(queries.dictionary)
    sizes = starts[slot + 1] - starts[slot]
    laid = np.concatenate([[0], np.cumsum(sizes)])
    step = max(1, SCORE_CELLS // wide)
    qs, ds, ss = [], [], []
    for at in range(0, n, step):
        lo, hi = np.searchsorted(doc, [at, at + step])
        cells = np.zeros(min(step, n - at) * wide)
        while lo < hi:
            to = min(hi, max(lo + 1, int(np.searchsorted(laid, laid[lo] + SCORE_CELLS, "right")) - 1))
            size = sizes[lo:to]
            who = asker[np.repeat(starts[slot[lo:to]] - (laid[lo:to] - laid[lo]), size) + np.arange(laid[to] - laid[lo])]
            cells += np.bincount(np.repeat((doc[lo:to] - at) * wide, size) + who, np.repeat(w[lo:to], size), len(cells))
            lo = to
        cells = cells.reshape(-1, wide)
        if k is None:
            d, q = np.nonzero(cells)
            value = cells[d, q]
        else:
            scores = np.where(cells == 0, -np.inf, np.round(cells, SCORE_DECIMALS))
            floor = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.full(wide, -np.inf)
            d, q = np.nonzero((cells != 0) & (scores >= floor))
            value = scores[d, q]
        qs.append(q)
        ds.append(d + at)
        ss.append(value)
    q, d, value = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((qs, np.int64), (ds, np.int64), (ss, float)))
    if k is not None:
        order = np.lexsort((d, -value, q))
        q, d, value = q[order], d[order], value[order]
        own = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, d, value = q[own], d[own], value[own]
    return pa.table({"query_id": queries.dictionary.take(pa.array(q)), "doc_id": ids.take(pa.array(np.argsort(place)[d])), "score": value})


def _bm25_visits(docs: DataFrame, queries: DataFrame, params: Bm25Params, k: int | None) -> DataFrame:
    """``(query_id, doc_id, score)``: groups of documents, as weights of the terms that are asked for, are visited by blocks of queries.

    A document's postings travel once for each block and its pairs with queries stay in the task; with ``k`` a visit leaves as many rows a
    query.  A task holds one group and one block, whatever the tables' sizes."""
    asked = query_terms(queries, params)
    wanted = asked.select("term").distinct().withColumn("asked", F.lit(True))
    count = term_counter(params.mode, params.scripts)
    text = F.col("text").cast("string").alias("text")
    seen = text_counts(docs.select(text), count, "term", "string", "tf", totals=True).join(wanted, "term", "left").where("term is null or asked")
    counts = seen.groupBy("term").agg(F.count("*").alias("df"), F.sum("total").alias("tokens")).cache()  # a row an asked term, read for both
    stats = counts.where("term is null").select(F.col("df").alias("n"), (F.col("tokens") / F.col("df")).alias("avg_len"))
    weights = inverse_from_counts(counts.where("term is not null").select("term", "df"), stats)
    found = text_counts(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text), count, "term", "string", "tf", totals=True).withColumnRenamed("total", "dl")
    rated = found.join(weights, "term").crossJoin(F.broadcast(stats)).select("row", "doc_id", "term", document_weight(params).alias("w"))  # one row of stats
    n, m = docs.count(), asked.select("query_id").distinct().count()
    groups = max(-(-n // GROUP_DOCS), min(-(-n // 256), docs.sparkSession.sparkContext.defaultParallelism), 1)
    blocks = max(-(-m // max(params.block_queries, 1)), 1)
    parts = min(groups * blocks, 4096)
    left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = rated.withColumn("dg", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left, right = left.repartition(parts, "qb", "qg"), right.repartition(parts, "db", "dg")
    d_type, q_type = docs.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def score(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.table({"query_id": q["query_id"].slice(0, 0), "doc_id": d["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        return _visit(q, d, k)

    return left.groupBy("qb", "qg").cogroup(right.groupBy("db", "dg")).applyInArrow(score, f"query_id {q_type}, doc_id {d_type}, score double")


def bm25_scores(docs: DataFrame, queries: DataFrame, params: Bm25Params = Bm25Params()) -> DataFrame:
    """``(query_id, doc_id, score)`` of all documents that share a term, whatever the number of queries; a repeated document is
    scored as often as it is there."""
    return _bm25_visits(docs, queries, params, None)


def bm25_joined_top_k(docs: DataFrame, queries: DataFrame, k: int, params: Bm25Params = Bm25Params()) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` of each query's best documents by rounded scores, for query sets of any size: nothing of
    them is sent to every executor."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return top_k(_bm25_visits(docs, queries, params, k), k, ["query_id"])


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, params: Bm25Params = Bm25Params()) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: each query's best documents among those that share a term with it.

    Scores are rounded to :data:`SCORE_DECIMALS` before they are ranked; documents that share an id are ranked each.  Query
    sets within the bounds of ``params`` are scored a block of documents at a time against each term's list of queries, which
    never lays out (query, document) pairs but each block's best.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    pairs = query_terms(queries, params).limit(params.block_pairs + 1).collect()  # within the bounds, or the joins take over
    terms = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in pairs))}
    number = {q: i for i, q in enumerate(dict.fromkeys(r["query_id"] for r in pairs))}
    if not pairs or len(pairs) > params.block_pairs or len(number) > params.block_queries or len(terms) > params.block_terms:
        return bm25_joined_top_k(docs, queries, k, params).where("score > 0")
    of_term = np.array([terms[r["term"]] for r in pairs])
    by_term = np.argsort(of_term, kind="stable")
    askers = np.array([number[r["query_id"]] for r in pairs], np.int32)[by_term]
    starts = np.searchsorted(of_term[by_term], np.arange(len(terms) + 1))
    bags = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((terms, starts, askers))  # at most block_terms and block_pairs
    mode, scripts, queries_n = params.mode, params.scripts, len(number)
    block = min(1024, max(64, 8_000_000 // len(terms)))  # rows of weights, a column for each term at most; a worker has no more rows as Python objects

    def counts(batch: pa.RecordBatch, known: dict[str, int], cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term) of all known tokens, and all documents' lengths."""
        rows, found, lengths = [], [], np.zeros(batch.num_rows)
        for i, text in enumerate(batch.column(1).to_pylist()):
            ts = cut(text or "")
            lengths[i] = len(ts)
            own = [known[t] for t in ts if t in known]
            found += own
            rows += [i] * len(own)
        return np.array(rows, np.int64), np.array(found, np.int64), lengths

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value[0]
        cut = python_tokenizer(mode, scripts)
        df, n, total = np.zeros(len(known), np.int64), 0, 0.0
        for batch in (whole.slice(at, block) for whole in batches for at in range(0, whole.num_rows, block)):
            row, term, lengths = counts(batch, known, cut)
            df += np.bincount(np.unique(row * len(known) + term) % len(known), minlength=len(known)).astype(np.int64)
            n, total = n + batch.num_rows, total + lengths.sum()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [n, int(total)]]))], ["i", "c"])

    sums = {r["i"]: r["c"] for r in bags.mapInArrow(frequency, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()}
    n, total = sums.get(-1, 0), sums.get(-2, 0)
    df = np.array([sums.get(i, 0) for i in range(len(terms))], np.float64)
    idfs = np.log(1 + (n - df + 0.5) / (df + 0.5))
    average = total / n if n else 0.0
    k1, b = params.k1, params.b
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, starts, askers = held.value
        cut = python_tokenizer(mode, scripts)
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                row, term, lengths = counts(batch, known, cut)
                if not len(row):
                    continue
                key, tf = np.unique(row * len(known) + term, return_counts=True)
                row, term = key // len(known), key % len(known)
                norm = lengths[row] / average if average else np.zeros(len(row))
                w = idfs[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm))
                names = np.array(batch.column(0).to_pylist(), object)
                order = np.array(sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i])), np.int64)
                used, column = np.unique(term, return_inverse=True)
                dense = np.zeros((batch.num_rows, len(used)))
                dense[row, column] = w
                dense, names = dense[order], names[order]
                sizes = starts[used + 1] - starts[used]
                slot = np.repeat(np.arange(len(used)), sizes)
                asker = askers[np.repeat(starts[used] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                by_query = np.argsort(asker, kind="stable")
                slot, asker = slot[by_query], asker[by_query]
                width = min(256, max(16, 2_000_000 // len(used)))
                out_q, out_d, out_s = [], [], []
                for first in range(0, queries_n, width):
                    lo, hi = np.searchsorted(asker, [first, first + width])
                    if lo == hi:
                        continue
                    part = np.zeros((len(used), width))
                    part[slot[lo:hi], asker[lo:hi] - first] = 1.0
                    scores = np.round(dense @ part, SCORE_DECIMALS)
                    for q in np.flatnonzero((scores > 0).any(0)):
                        best = np.argsort(-scores[:, q], kind="stable")[:k]
                        best = best[scores[best, q] > 0]
                        out_q += [first + q] * len(best)
                        out_d += names[best].tolist()
                        out_s += scores[best, q].tolist()
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int32()), pa.array(out_d, pa.string()), pa.array(out_s, pa.float64())], ["q", "d", "score"])

    found = bags.mapInArrow(score, "q int, d string, score double")
    named = spark.createDataFrame([(i, q) for q, i in number.items()], f"q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    kind = docs.schema["doc_id"].dataType
    best = top_k(found, k, ["q"], tie="d").join(F.broadcast(named), "q")  # at most block_queries rows
    return best.select("query_id", F.col("d").cast(kind).alias("doc_id"), "score", "rank")


#: Queries and documents of one product within a task, and pairs that are scored exactly at once.
PRODUCT_QUERIES, PRODUCT_DOCS, EXACT_PAIRS = 256, 4096, 1 << 16


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors as rows of doubles; null components are not a number."""
    arrays = column.combine_chunks()
    arrays = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    sizes = np.diff(arrays.offsets.to_numpy())
    if arrays.null_count or len(set(sizes.tolist())) > 1:
        raise ValueError("vectors differ in dimension")
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(sizes), -1)


def _best(a: np.ndarray, x: np.ndarray, k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of each query's ``k`` best, ties to the document that comes first.

    A product in single precision tells which pairs may be among the best, its largest error allowed for; these are scored in double precision."""
    size_a, size_x = np.sqrt((a * a).sum(1)), np.sqrt((x * x).sum(1))
    with np.errstate(all="ignore"):
        if cosine:
            near_a, near_x = (np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] != 0).astype(np.float32) for v, n in ((a, size_a), (x, size_x)))
            error = np.full(len(a), (a.shape[1] + 8) * 2.0**-24)
        else:
            near_a, near_x = a.astype(np.float32), x.astype(np.float32)
            error = (a.shape[1] + 8) * 2.0**-24 * size_a * size_x.max() + 1e-30
        sizes = size_a.max(), size_x.max()
        sound = all(1e-12 < s < 1e15 for s in sizes) and (not cosine or bool(((size_a == 0) | (size_a > 1e-12)).all() and ((size_x == 0) | (size_x > 1e-12)).all()))
    found = []
    for at in range(0, len(a), PRODUCT_QUERIES):
        own, off = a[at : at + PRODUCT_QUERIES], error[at : at + PRODUCT_QUERIES] + 10.0**-SCORE_DECIMALS
        q, d, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        worst = np.full(len(own), -np.inf)
        for first in range(0, len(x), PRODUCT_DOCS):
            with np.errstate(all="ignore"):
                near = near_a[at : at + PRODUCT_QUERIES] @ near_x[first : first + PRODUCT_DOCS].T
            floor = worst - off
            if not first and near.shape[1] > 4 * k:
                floor = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - 2 * off
            if sound:
                rows, columns = np.nonzero(near >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None])
            else:  # a number that single precision does not hold: all pairs
                rows, columns = (i.ravel() for i in np.indices(near.shape))
            columns = columns + first
            exact = np.empty(len(rows))
            for i in range(0, len(rows), EXACT_PAIRS):
                r, c = rows[i : i + EXACT_PAIRS], columns[i : i + EXACT_PAIRS]
                value = np.einsum("ij,ij->i", own[r], x[c])
                if cosine:
                    size = size_a[at + r] * size_x[c]
                    value = np.divide(value, size, out=np.zeros_like(value), where=size != 0)
                exact[i : i + EXACT_PAIRS] = np.round(value, SCORE_DECIMALS) + 0.0
            q, d, s = np.concatenate([q, rows]), np.concatenate([d, columns]), np.concatenate([s, exact])
            order = np.lexsort((d, -s, q))
            q, d, s = q[order], d[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, d, s, place = q[place < k], d[place < k], s[place < k], place[place < k]
            last = place == k - 1
            worst[q[last]] = np.where(np.isnan(s[last]), -np.inf, s[last])
        found.append((q + at, d, s))
    return tuple(np.concatenate(c) for c in zip(*found))


def vector_top_k(docs: DataFrame, queries: DataFrame, k: int, name: str = "cosine", group_rows: int = 32_768, query_block: int = 32_768) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` over all pairs of ``queries(query_id, v)`` and ``docs(doc_id, v)``.

    Every document is scored, whatever its sign.  Blocks of queries visit groups of documents; each visit leaves ``k`` rows a
    query.  A task holds one block and one group and works through small products of their parts.  Vectors of another dimension than
    the query's fail the query.
    """
    similarity(name)
    if k < 1:
        raise ValueError("k must be at least 1")
    n, m = docs.count(), queries.count()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-n // group_rows), min(-(-n // 1024), math.isqrt(4 * cores)), 1)  # few visits copy each vector few times
    blocks = max(-(-m // query_block), min(-(-m // 256), -(-4 * cores // groups)), 1)
    parts = max(1, min(groups * blocks, 4096))
    d_type, q_type = docs.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    left = queries.select(F.col("query_id"), F.col("v").cast("array<double>").alias("qv"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb"))
    left = left.withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(parts, "qb", "qg")
    right = docs.select(F.col("doc_id"), F.col("v").cast("array<double>").alias("dv"), F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("dg"))
    right = right.withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, "db", "dg")

    def score(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.table({"query_id": q["query_id"].slice(0, 0), "doc_id": d["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        names = np.array(d["doc_id"].cast(pa.string()).fill_null("").to_pylist(), object)
        order = np.argsort(names, kind="stable")
        a, x = _matrix(q["qv"]), _matrix(d["dv"])[order]
        if a.shape[1] != x.shape[1]:
            raise ValueError("vectors differ in dimension")
        query, doc, found = _best(a, x, k, name == "cosine")
        return pa.table({"query_id": q["query_id"].take(pa.array(query)), "doc_id": d["doc_id"].take(pa.array(order[doc])), "score": found})

    found = left.groupBy("qb", "qg").cogroup(right.groupBy("db", "dg")).applyInArrow(score, f"query_id {q_type}, doc_id {d_type}, score double")
    return top_k(found, k, ["query_id"]).select("query_id", "doc_id", "score", "rank")
