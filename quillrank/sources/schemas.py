"""Explicit schemas of every file that is read."""

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_TEXT, _INT, _DOUBLE, _TEXTS = T.StringType(), T.IntegerType(), T.DoubleType(), T.ArrayType(T.StringType())
SCRIPT_COUNTS = _s(("hangul_chars", _INT), ("latin_chars", _INT))
METADATA = _s(("domain", _TEXT), ("collection_code", _TEXT), ("source", _TEXT), ("year", _INT))

QUERIES = _s(("query_id", _TEXT), ("split", _TEXT), ("text", _TEXT), ("metadata", METADATA), ("code_switch", SCRIPT_COUNTS))
CORPUS = _s(("doc_id", _TEXT), ("text", _TEXT))
SEARCH_CORPUS = _s(("id", _TEXT), ("text", _TEXT))
PAIRS = _s(("record_id", _TEXT), ("split", _TEXT), ("question", _TEXT), ("answer", _TEXT), ("question_type", _TEXT))
CHOICES = _s(("question_id", _TEXT), ("split", _TEXT), ("query", _TEXT), ("options", _TEXTS), ("answer_index", _INT), ("metadata", METADATA), ("code_switch", SCRIPT_COUNTS))
TRIPLETS = _s(("triplet_id", _TEXT), ("question_id", _TEXT), ("split", _TEXT), ("query", _TEXT), ("positive", _TEXT), ("hard_negatives", _TEXTS), ("option_len_rank", _INT))
PLAN = _s(("batch_id", _TEXT), ("record_id", _TEXT), ("source", _TEXT), ("query", _TEXT), ("positive", _TEXT), ("negative", _TEXT), ("option_len_rank", _INT))
CHOICE_RESULTS = _s(("query_id", _TEXT), ("correct", _TEXT), ("rank", _TEXT), ("reciprocal_rank", _TEXT), ("longest_option_hit", _TEXT), ("random_hit", _TEXT))
PASSAGE_RESULTS = _s(("query_id", _TEXT), ("ndcg", _TEXT), ("mrr", _TEXT), ("recall", _TEXT), ("unjudged_in_top", _TEXT))
