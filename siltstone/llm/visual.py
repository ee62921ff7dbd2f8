"""Visually identical text with different characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, ship, small, written

# Letters that look like Latin ones, each with the letter it looks like; confusables() adds those of the Unicode data.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "d", "Һ": "h", "Ӏ": "I", "Ғ": "F",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ү": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J", "Ϲ": "C", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "υ": "u", "ρ": "p",
    "Օ": "O", "Ս": "U", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g", "ա": "w", "ɡ": "g", "ɑ": "a", "ʏ": "Y",
}
# Kinds of compatibility forms that a reader tells from the plain characters.
SHOWN = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")
# Default-ignorable characters, the zero-width joiner aside.
_IGNORED = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​‌‎‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
_PICTURE = "←-⯿〰〽㊗㊙\U0001f000-\U0001faff"
#: A joiner counts only between two pictures (the first may have a skin tone or a presentation mark).
_JOINER = re.compile(f"(?<![{_PICTURE}])‍|‍(?![{_PICTURE}])")
# Blanks and hyphens of other kinds.
_MAPPED = str.maketrans({**dict.fromkeys("               　", " "), **dict.fromkeys("‐‑﹣－", "-")})
_LINE_END = re.compile("\r\n?|\u0085| | ")
_NOT_PLAIN = re.compile("[^\n\t\x20-\x7e]")


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of further alphabets and the Latin letter each looks like, by the Unicode confusables data (Spark brings it along).

    A letter counts if its skeleton is one Latin letter.  Where several letters of one script and case share a skeleton, readers of that
    script tell them apart (as they tell a dotless i from a small capital one), so only LOOKALIKES decides about them.
    """
    scripts = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.name(c, "").startswith(scripts) and not unicodedata.decomposition(c)]
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    alike: dict[tuple[str, str, str], list[str]] = {}
    for c, s in zip(letters, skeletons):
        if len(s) == 1 and s.isascii() and s.isalpha():
            small = unicodedata.category(c) == "Ll"
            alike.setdefault((unicodedata.name(c).split()[0], unicodedata.category(c), "I" if s == "l" and not small else s), []).append(c)
    return {found[0]: key[2] for key, found in alike.items() if len(found) == 1} | LOOKALIKES


class Forms(dict):
    """What each character becomes: blanks, hyphens and look-alikes their plain form, others their compatibility form,
    unless a reader sees the difference."""

    def __init__(self, alike: dict[str, str]):
        super().__init__()
        self.alike = alike

    def __missing__(self, ch: str) -> str:
        out = ch.translate(_MAPPED)
        kind = unicodedata.decomposition(out).split(" ")[0]
        if kind.startswith("<") and kind not in SHOWN:
            plain = unicodedata.normalize("NFKC", out).translate(_MAPPED)
            if not (plain[:1] == " " and len(plain) > 1) and not any(unicodedata.decomposition(c).split(" ")[0] in SHOWN for c in plain):
                out = plain
        out = self[ch] = "".join(self.alike.get(c, c) for c in out)
        return out


_letters = Forms(LOOKALIKES)
_known: dict[int, Forms] = {}


def _forms_of(alike: dict[str, str]) -> Forms:
    """The worker's table for these look-alikes, so that characters met in one batch are known in the next."""
    return _known.setdefault(hash(frozenset(alike.items())), Forms(alike))


def _replaced(text: str, table: dict[str, str]) -> str:
    """text with the characters that the table changes replaced; no outcome is itself changed, so the order is free."""
    for c in set(text):
        if c > "~" and (out := table[c]) != c:
            text = text.replace(c, out)
    return text


def shown_form(text: str, letters: Forms = _letters) -> str:
    """The consistent form in which texts are equal exactly if they show the same.

    Width, composition, ligatures, kinds of blanks and hyphens, invisible characters and look-alike letters are brought
    to one form; case, accents, superscripts, circled digits, fractions, joined emoji and longer dashes stay.
    """
    if not _NOT_PLAIN.search(text):
        return text
    t = _LINE_END.sub("\n", text)
    t = _IGNORED.sub("", t)
    if "\u200d" in t:
        t = _JOINER.sub("", t)
    return unicodedata.normalize("NFC", _replaced(unicodedata.normalize("NFC", t), letters))


def comparison_form(shown: str, alike: dict[str, str] = LOOKALIKES) -> str:
    """Compatibility-composed, full case folding, blanks as single spaces, no ignorable characters, look-alikes mapped again."""
    if not _NOT_PLAIN.search(shown):
        return " ".join(shown.lower().split())
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", shown).casefold())
    t = _IGNORED.sub("", t.replace("\u200d", ""))
    for c in alike.keys() & set(t):
        t = t.replace(c, alike[c])
    return " ".join(t.casefold().split())


def both_forms(values: pa.Array, letters: Forms) -> tuple[pa.Array, pa.Array]:
    """Shown and comparison form of an array of texts.  Plain ones are worked out in Arrow, all at once; the rest value by value."""
    other = pc.match_substring_regex(values, "[^\n\t\x20-\x7e]")
    plain = values.filter(pc.invert(other))
    squeezed = pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(plain), "[\n\t ][\n\t ]+|[\n\t]", " "), " ")
    rest = [shown_form(v, letters) for v in values.filter(other).to_pylist()]
    mixed = pa.array([comparison_form(s, letters.alike) for s in rest], pa.string())
    loose = pc.replace_with_mask(pc.replace_with_mask(values, other, mixed), pc.invert(other), squeezed)
    return pc.replace_with_mask(values, other, pa.array(rest, pa.string())), loose


def forms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, comparison): the consistent form and the comparison form; null texts stay null, blank ones may become empty.

    Each distinct value of a batch is worked out once.
    """
    ship(docs.sparkSession)
    alike = confusables(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _forms_of(alike)
        for b in batches:
            d = b.column(1).dictionary_encode()
            shown, loose = both_forms(d.dictionary.cast(pa.string()), letters)
            yield pa.RecordBatch.from_arrays([b.column(0), shown.take(d.indices), loose.take(d.indices)], names=[key, "form", "comparison"])

    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` bigint, form string, comparison string")


def same_looking_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: texts that differ in their characters and show a reader the same.

    The comparison form is the key: only keys under which two different texts stand go on.  Under a key, texts are a pair if
    their shown forms are equal, as case and other visible signs tell texts apart.  Copies are counted as one variant first: variants
    are paired, and then written out as documents.  Null texts, and texts that show nothing, make no pair.
    """
    ship(docs.sparkSession)
    alike = confusables(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _forms_of(alike)
        for b in batches:
            if not b.num_rows:
                continue
            d = b.column(1).dictionary_encode()
            values = d.dictionary.cast(pa.string())
            shown, loose = both_forms(values, letters)
            digest = lambda c: pa.array([xxhash.xxh3_128_digest(x) for x in c.to_pylist()], pa.binary()).take(d.indices)
            visible = pa.array([s != "" and not s.isspace() for s in shown.to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), digest(loose), digest(shown), digest(values)], names=["id", "lk", "sk", "tk"]).filter(visible.take(d.indices))

    keyed = written(docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").mapInArrow(run, "id bigint, lk binary, sk binary, tk binary"), "shown")
    several = keyed.groupBy("lk").agg(F.min("tk").alias("lo"), F.max("tk").alias("hi")).where("lo < hi").select("lk")
    rows = written(keyed.join(small(several, 50_000), "lk", "left_semi"), "several")
    discard(keyed)
    v = rows.select("lk", "sk", "tk").distinct()
    pairs = v.select("lk", "sk", F.col("tk").alias("ta")).join(v.select("lk", "sk", F.col("tk").alias("tb")), ["lk", "sk"]).where("ta < tb").select("ta", "tb")
    a = rows.select(F.col("tk").alias("ta"), F.col("id").alias("x"))
    b = rows.select(F.col("tk").alias("tb"), F.col("id").alias("y"))
    return pairs.join(a, "ta").join(b, "tb").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
