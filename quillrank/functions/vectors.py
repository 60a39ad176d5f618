"""Vector expressions over arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize_strict(v: Column) -> Column:
    """The unit vector; a zero or non-finite length fails the query."""
    n = norm(v)
    ok = (n > 0) & (n < float("inf"))
    return F.when(ok, F.transform(v, lambda x: x / n)).otherwise(F.raise_error(F.lit("vector must have a finite length above zero")))


def normalize_lenient(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in dimension")))


def dot(a: Column, b: Column) -> Column:
    return _same_size(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Zero where either vector is."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine, "dot_product": dot}


def similarity(name: str) -> Callable[[Column, Column], Column]:
    if name not in SIMILARITIES:
        raise ValueError(f"unknown similarity {name!r}; known: {', '.join(sorted(SIMILARITIES))}")
    return SIMILARITIES[name]
