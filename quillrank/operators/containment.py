"""Which documents contain which passages, word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces of an anchor.  A passage of at least two more has one.
ANCHOR = 4


def _window_hashes(pieces: Column, first: Column, last: Column) -> Column:
    """Hashes of ``ANCHOR`` consecutive pieces, starting at 1-based ``first`` to ``last``."""
    return F.transform(F.sequence(first, last), lambda i: F.xxhash64(*[F.element_at(pieces, i + j) for j in range(ANCHOR)]))


#: Passages of one or two pieces that are looked for in one scan of the documents.
SHORT_BLOCK = 4096


def _blocks(passages: DataFrame) -> list[DataFrame]:
    """The passages in parts of at most about :data:`SHORT_BLOCK`."""
    n = passages.count()
    parts = -(-n // SHORT_BLOCK)
    return [passages] if parts == 1 else [passages.where(F.pmod(F.xxhash64("query_id", "passage"), F.lit(parts)) == i) for i in range(parts)]


def containment_pairs(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``(query_id, doc_id)`` of every document ``(doc_id, text)`` that contains the text of a passage ``(query_id, text)``.

    Cut at spaces, all pieces of a passage but its first and last stand side by side in a document that contains it.  So the
    second to fifth pieces are looked up by hash among the windows of the documents, of fewer pieces the longest inner one among
    their pieces, and only what meets there is compared whole.  A passage without an inner piece has no key; such passages are
    a set of queries that documents are scanned for, a bounded block in each scan.
    """
    asked = passages.select("query_id", F.col("text").alias("passage"), F.split("text", " ").alias("ps"))
    pieces = F.size("ps")
    inner = F.slice("ps", F.lit(2), F.greatest(pieces - 2, F.lit(0)))
    longest = F.sort_array(F.transform(inner, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))), asc=False)
    longest = F.get(longest, F.lit(0))["p"]
    many = asked.where(pieces >= ANCHOR + 2).select("query_id", "passage", _window_hashes(F.col("ps"), F.lit(2), F.lit(2))[0].alias("h"))
    few = asked.where((pieces < ANCHOR + 2) & (F.length(longest) > 0)).select("query_id", "passage", F.xxhash64(longest).alias("h"))
    anchored = many.unionByName(few)
    cut = docs.select("doc_id", F.split("text", " ").alias("ps"))
    windows = cut.where(pieces >= ANCHOR).select("doc_id", F.explode(F.array_distinct(_window_hashes(F.col("ps"), F.lit(1), pieces - ANCHOR + 1))).alias("h"))
    met = windows.join(many.select("query_id", "h"), "h").select("doc_id", "query_id")
    if not few.isEmpty():
        each = cut.select("doc_id", F.explode(F.array_distinct(F.transform("ps", lambda p: F.xxhash64(p)))).alias("h"))
        met = met.unionByName(each.join(few.select("query_id", "h"), "h").select("doc_id", "query_id"))
    # Few documents meet a passage; their texts come from a second look at the table, not through the windows.
    texts = docs.select(F.col("doc_id").alias("met_doc"), "text").join(met.withColumnRenamed("doc_id", "met_id"), F.col("met_doc") == F.col("met_id"))
    found = texts.join(anchored.select(F.col("query_id").alias("of"), "passage"), F.col("query_id") == F.col("of")).where(F.contains("text", "passage"))
    out = found.select("query_id", F.col("met_doc").alias("doc_id"))
    keyless = asked.where((pieces < ANCHOR + 2) & ~F.coalesce(F.length(longest) > 0, F.lit(False))).select("query_id", "passage")
    for block in _blocks(keyless):
        out = out.unionByName(docs.join(F.broadcast(block), F.contains("text", "passage")).select("query_id", "doc_id"))
    return out.distinct()
