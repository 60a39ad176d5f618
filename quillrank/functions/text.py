"""Text functions as Column builders; Arrow UDFs only where Spark has no built-in (Unicode normalisation)."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@dataclass(frozen=True)
class Scripts:
    """Two scripts as regular-expression character ranges: the one cut into bigrams, and the one kept in whole runs."""

    dense: str = "가-힣"
    plain: str = "A-Za-z0-9"


HANGUL_LATIN = Scripts()
#: For corpora without Hangul: accented Latin letters in the place of Hangul.
ACCENTED_LATIN = Scripts(dense="À-ÿ")

#: All white space of Unicode and the four separators that some regular-expression dialects leave out.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def whitespace_tokens(text: Column, scripts: Scripts = HANGUL_LATIN) -> Column:
    """Lower-cased runs of the two scripts; everything else separates."""
    return F.filter(F.split(F.lower(text), f"[^{scripts.dense}{scripts.plain}]+"), lambda t: t != "")


def bigram_tokens(text: Column, scripts: Scripts = HANGUL_LATIN) -> Column:
    """Lower-cased plain-script runs, then for each run of either script the overlapping bigrams of its dense-script
    characters, or the character itself where there is one."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(f"[{scripts.plain}]+"), F.lit(0)), F.lower)
    runs = F.regexp_extract_all(text, F.lit(f"[{scripts.dense}][{scripts.dense}{scripts.plain}]*"), F.lit(0))  # from a run's first dense character on; most runs have none
    runs = F.transform(runs, lambda r: F.regexp_replace(r, f"[^{scripts.dense}]", ""))

    def bigrams(run: Column) -> Column:
        n = F.length(run)
        return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).when(n == 1, F.array(run)).otherwise(
            F.array().cast("array<string>"))

    return F.concat(plain, F.flatten(F.transform(runs, bigrams)))


def tokens(text: Column, mode: str = "char_bigram", scripts: Scripts = HANGUL_LATIN) -> Column:
    """``whitespace`` tokens, or bigrams for any other mode; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    return whitespace_tokens(text, scripts) if mode == "whitespace" else bigram_tokens(text, scripts)


def python_tokenizer(mode: str, scripts: Scripts = HANGUL_LATIN):
    """The same tokens for use inside Arrow batches."""
    word, plain = re.compile(f"[{scripts.dense}{scripts.plain}]+"), re.compile(f"[{scripts.plain}]+")
    other, dense = re.compile(f"[^{scripts.dense}]+"), re.compile(f"[{scripts.dense}][{scripts.dense}{scripts.plain}]*")

    def whitespace(text: str) -> list[str]:
        return word.findall(text.lower())

    def bigram(text: str) -> list[str]:
        out = list(map(str.lower, plain.findall(text)))
        for run in dense.findall(text):  # a run from its first dense character on; most runs have none
            kept = other.sub("", run) if len(run) > 1 else run
            out += [kept[i : i + 2] for i in range(len(kept) - 1)] if len(kept) > 1 else [kept]
        return out

    return whitespace if mode == "whitespace" else bigram


#: Texts that a worker has as Python strings at once.
TEXT_STEP = 256


def _mapped(texts: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """``f`` of each text, nulls as they are; only :data:`TEXT_STEP` texts at a time leave Arrow."""
    parts = (texts.slice(at, TEXT_STEP).to_pylist() for at in range(0, len(texts), TEXT_STEP))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else f(t) for t in part], pa.string()) for part in parts)])


def _key(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFC", t).casefold() if c.isalnum())


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return _mapped(texts, lambda t: unicodedata.normalize("NFC", t))


@F.arrow_udf(StringType())
def _folded_key(texts: pa.Array) -> pa.Array:
    return _mapped(texts, _key)


@F.arrow_udf(ArrayType(StringType()))
def _folded_keys(lists: pa.Array) -> pa.Array:
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), _mapped(lists.flatten(), _key))


def _ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def _ascii_key(text: Column) -> Column:
    """The key of an ASCII text."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", ""))


def normal_keys(texts: Column) -> Column:
    """The collision key of each text of an array; nulls give empty keys."""
    texts = F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")))
    other = _folded_keys(F.transform(texts, lambda t: F.when(~_ascii(t), t)))  # only these go to Python
    return F.zip_with(texts, other, lambda t, key: F.when(_ascii(t), _ascii_key(t)).otherwise(key))


def collapsed(text: Column) -> Column:
    """White space collapsed to one space and trimmed, null as empty: the part of cleaning that stays in the JVM."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " "))


def clean_text(text: Column) -> Column:
    """Collapsed white space and Unicode NFC; null becomes empty."""
    text = collapsed(text)
    other = text.rlike(r"[^\x{0}-\x{2FF}]")  # below U+0300 every text is in NFC; only the others go to Python
    return F.coalesce(_nfc(F.when(other, text)), text)


def normal_key(text: Column) -> Column:
    """The collision key: cleaned, case-folded, letters and digits only."""
    text = collapsed(text)
    return F.when(_ascii(text), _ascii_key(text)).otherwise(_folded_key(F.when(~_ascii(text), text)))


def answer_key(text: Column) -> Column:
    """Lower case with collapsed white space."""
    return F.lower(collapsed(text))


def nul_joined(*parts: Column) -> Column:
    """The parts as one text, each followed by a NUL; nulls count as empty."""
    return F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\0"))])


def stable_key(seed: str, *parts: Column) -> Column:
    """A seeded sort key that any SQL engine gives alike: the SHA-256 of seed and parts, each followed by a NUL."""
    return F.sha2(nul_joined(F.lit(seed), *parts), 256)


def _blake(person: str):
    name = person.encode()
    if len(name) > hashlib.blake2b.PERSON_SIZE:
        raise ValueError(f"a personalisation has at most {hashlib.blake2b.PERSON_SIZE} bytes")
    return lambda text: hashlib.blake2b(text.encode(), digest_size=16, person=name).hexdigest()


def blake_key(person: str, *parts: Column) -> Column:
    """A sort key of 32 hexadecimal digits, which sorts as its integer does: the personalised BLAKE2b-128 of the parts, each
    followed by a NUL.  Each distinct text of a batch is digested once."""
    digest = _blake(person)

    @F.pandas_udf(StringType())
    def keys(texts: pd.Series) -> pd.Series:
        known = {t: digest(t) for t in set(texts)}
        return texts.map(known)

    return keys(nul_joined(*parts))


def blake_keys(person: str, texts: Column) -> Column:
    """The :func:`blake_key` of each text of an array; the NULs are in the texts."""
    digest = _blake(person)

    @F.pandas_udf(ArrayType(StringType()))
    def keys(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: None if ts is None else [digest(t) for t in ts])

    return keys(texts)


def row_id(source: Column, number: Column, *supplied: Column) -> Column:
    """The first supplied id that is not empty once cleaned, or ``source:000000001`` by the row's number from one."""
    return F.coalesce(*[F.nullif(collapsed(c), F.lit("")) for c in supplied], F.format_string("%s:%09d", source, number))


def script_level(dense: Column, plain: Column, threshold: Column | int, names: tuple[str, str] = ("ko", "en")) -> Column:
    """``mixed`` with both counts at the threshold or more, a script's name with one, else ``other``; nulls count as none."""
    t = F.lit(threshold) if isinstance(threshold, int) else threshold
    d, p = F.coalesce(dense, F.lit(0)) >= t, F.coalesce(plain, F.lit(0)) >= t
    return F.when(d & p, "mixed").when(d, names[0]).when(p, names[1]).otherwise("other")


def script_counts(text: Column, scripts: Scripts = HANGUL_LATIN) -> tuple[Column, Column]:
    """How many dense-script characters and how many letters of the other script a text has."""
    text = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(text, f"[^{scripts.dense}]+", "")), F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))


def checked_bool(text: Column) -> Column:
    """``True`` and ``False`` as booleans; anything else fails the query."""
    return F.when(text == "True", True).when(text == "False", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))))


def printed_bool(value: Column) -> Column:
    return F.initcap(value.cast("string"))


def percent(value: Column) -> Column:
    return F.format_string("%.2f%%", value * 100)


def label(value: Column) -> Column:
    """A stratum's name: null is the string ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def dig(path: str) -> Column:
    """A dotted path into nested columns; null on the way gives null."""
    return F.col(path)


def config_digest(config: dict, length: int | None = None) -> str:
    """SHA-256 of a configuration in canonical JSON."""
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:length]
