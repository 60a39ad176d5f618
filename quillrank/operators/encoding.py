"""Deterministic token-hashing encoder, and the interface of batched encoders."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillrank.functions.text import HANGUL_LATIN, Scripts, python_tokenizer
from quillrank.operators.ranking import counted_by_id


#: Tokens whose slot a worker remembers.
KNOWN_SLOTS = 1 << 17


def md5_slots(dim: int) -> Callable[[str], int]:
    """MD5 of a token as one big number, modulo ``dim``."""
    if not 0 < dim <= 1 << 30:
        raise ValueError("dim must be between 1 and 2**30")
    return lru_cache(KNOWN_SLOTS)(lambda token: int.from_bytes(hashlib.md5(token.encode(), usedforsecurity=False).digest()) % dim)


def slot_counter(dim: int, mode: str = "char_bigram", scripts: Scripts = HANGUL_LATIN) -> Callable[[str], dict[int, int]]:
    """The slots that a text's tokens fall into and how many do; made anew in each worker."""
    made: list = []

    def count(text: str) -> dict[int, int]:
        if not made:
            made.extend([python_tokenizer(mode, scripts), md5_slots(dim)])
        cut, slot = made
        return Counter(map(slot, cut(text)))

    return count


def hashed_slots(docs: DataFrame, dim: int, max_length: int | None = None, mode: str = "char_bigram", scripts: Scripts = HANGUL_LATIN) -> DataFrame:
    """``(doc_id, slot, c)``: how many tokens of a text, or of its first ``max_length`` characters, fall into each slot.

    A text is counted where it is read; only rows that share an id meet in a shuffle."""
    md5_slots(dim)  # refuses a dimension before anything runs
    text = F.col("text").cast("string") if max_length is None else F.substring("text", 1, max_length)
    return counted_by_id(docs.select("doc_id", text.alias("text")), slot_counter(dim, mode, scripts), "slot", "int", "c")


def hashed_vectors(docs: DataFrame, dim: int, max_length: int | None = None, mode: str = "char_bigram") -> DataFrame:
    """``(doc_id, v)``: the slots as dense vectors; a text without tokens is all zeros."""
    held = hashed_slots(docs, dim, max_length, mode).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "c"))).alias("m"))
    rows = docs.select("doc_id").join(held, "doc_id", "left")
    values = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i].cast("double"), F.lit(0.0)))
    return rows.select("doc_id", values.alias("v"))


class EncoderError(ValueError):
    pass


ENCODERS: dict[str, Callable[..., Callable[[list[str], str], list[list[float]]]]] = {}


def register_encoder(name: str, factory: Callable[..., Callable[[list[str], str], list[list[float]]]]) -> None:
    """``factory(**settings)`` is called once in each worker and gives ``encode(texts, role)``; its ``max_length``, if it has one, is what it applies."""
    ENCODERS[name] = factory


def encode(rows: DataFrame, name: str, role: str, prefix: str = "", batch: int = 32, max_length: int | None = None, id_col: str = "doc_id", **settings) -> DataFrame:
    """``(id, v)`` by a registered encoder in batches; refuses an unknown name, or a length that the encoder does not apply."""
    if name not in ENCODERS:
        raise EncoderError(f"unknown encoder {name!r}; known: {', '.join(sorted(ENCODERS))}")
    factory = ENCODERS[name]
    applied = getattr(factory(**settings), "max_length", max_length)
    if max_length is not None and applied != max_length:
        raise EncoderError(f"asked for length {max_length}, the encoder applies {applied}")

    @F.pandas_udf("array<double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory(**settings)
        for series in texts:
            out: list[list[float]] = []
            for at in range(0, len(series), batch):
                out += model([prefix + (t or "") for t in series.iloc[at : at + batch]], role)
            yield pd.Series(out, dtype=object)

    return rows.select(id_col, run("text").alias("v"))


def counted(rows: DataFrame, role: str, routes: dict[str, Column | bool] | None = None) -> tuple[DataFrame, Observation]:
    """The rows, and what is counted while they pass to an encoder: ``rows``, and how many take each route.

    ``routes`` are the conditions of named routes, such as a model's adapters; without them all rows take the route of their role.
    Counting is part of the pass itself; the observation has its numbers once that has run."""
    seen = Observation(f"encoded {role}")
    named = {role: F.lit(True)} if routes is None else routes
    counts = [F.coalesce(F.count_if(F.lit(c) if isinstance(c, bool) else c), F.lit(0)).alias(name) for name, c in named.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen
