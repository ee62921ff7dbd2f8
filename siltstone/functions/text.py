"""Text functions: normalization, digests, split fractions, lenient casts."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All that is not white space, as a Java character class.
_BLANK_LINES = re.compile("\n{3,}")
_NOT_WS = "[^\\n\\r\\t\\x0B\\f\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _clean(text: str) -> str:
    t = text if text.isascii() else unicodedata.normalize("NFC", text)
    lines = t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return _BLANK_LINES.sub("\n\n", "\n".join([" ".join(x.split()) for x in lines])).strip("\n")


@F.arrow_udf(T.StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _normalize(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _clean(t) for t in text.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Composed form; nulls stay null."""
    return _nfc(text)


def normalize_text(text: Column) -> Column:
    """Composed, line ends as \\n, other white space as single blanks, lines trimmed, at most one blank line, ends trimmed.

    Spark has no composition, so text goes to an Arrow batch function anyway; the rest is done there in the same visit.
    """
    return _normalize(text)


def has_visible(text: Column) -> Column:
    """True where text has a character that is not white space; false for null."""
    return F.coalesce(text.rlike(_NOT_WS), F.lit(False))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def fraction(seed: int | str, value: Column) -> Column:
    """The first 64 bits of sha256(seed:value) as a fraction of 2^64."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), value), 256)
    return F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def split_label(seed: int | str, value: Column, train: float, validation: float) -> Column:
    """train, validation or test by the fraction; the upper bound of validation is the floating-point sum of both ratios."""
    u = fraction(seed, value)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def lenient_double(value: Column) -> Column:
    """Numbers, and strings that read as numbers (blanks around them allowed); anything else null."""
    return value.try_cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.when(b != 0, a.cast("double") / b)


def code_points(text: Column) -> Column:
    """Characters of a text as an array of code points; empty for an empty text, null for null."""
    chars = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.transform(chars, lambda c: F.ascii(c))


def close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    """|a - b| within the relative or absolute tolerance; null if either is null."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of an id list written as a compact JSON array."""
    return F.sha2(F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ","), F.lit("]")), 256)


def repeat_to(ids: Column, n: int) -> Column:
    """The list repeated and cut to n entries; an empty list stays empty."""
    times = F.when(F.size(ids) > 0, F.ceil(F.lit(n) / F.size(ids)).cast("int")).otherwise(F.lit(0))
    return F.slice(F.flatten(F.array_repeat(ids, times)), 1, n)


def first_divergence(a: Column, b: Column) -> Column:
    """0-based place of the first difference; the shorter length if one list is the other's start; null if equal."""
    both = F.least(F.size(a), F.size(b))
    p = F.array_position(F.zip_with(F.slice(a, 1, F.greatest(both, F.lit(0))), F.slice(b, 1, F.greatest(both, F.lit(0))), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(p > 0, (p - 1).cast("int")).when(F.size(a) != F.size(b), both)


def cosine_rate(step: Column, total: int, warm: int, high: float, low: float) -> Column:
    """Learning rate at a 0-based step: linear warm-up, cosine decay, clamped to [low, high]."""
    span = total - warm - 1
    body = F.lit(low) if span <= 0 else F.lit(low) + (high - low) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (step - warm) / span))
    rate = F.when(step >= total, F.lit(low)).when(step < warm, F.lit(high) * (step + 1) / max(1, warm)).otherwise(body)
    return F.least(F.greatest(rate, F.lit(0.0 if warm else low)), F.lit(high))
