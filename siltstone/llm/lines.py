"""Lines repeated across one site's documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, small, starts, written

# All white space but the line feed.
_BLANKS = re.compile("[\t\x0b\x0c\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_BREAK = re.compile("\r\n?")
_DIGITS = re.compile("[0-9]+")


def line_keys(text: str) -> list[str]:
    """Key of each line: cleaned, case-folded, each run of digits as one zero; blank lines have an empty key."""
    t = _BREAK.sub("\n", text)
    t = _DIGITS.sub("0", unicodedata.normalize("NFC", t)).casefold()
    return [x.strip(" ") for x in _BLANKS.sub(" ", t).split("\n")]


_seen: dict[str, int] = {}


def _hash(key: str) -> int:
    h = _seen.get(key)
    if h is None:
        if len(_seen) > 500_000:
            _seen.clear()
        h = _seen[key] = xxhash.xxh3_64_intdigest(key)
    return h


def documents_with_lines(docs: DataFrame, key: str, text: str, site: str, at: str) -> DataFrame:
    """(id, day, sk, dk, lines array<bigint>): hashes of site, of the whole document's lines, and of each line (0 for a blank one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            flat: list[int] = []
            count, sk, dk, keep = np.zeros(n, np.int64), [], [], []
            for i, (s, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                keys = line_keys(t)
                if not any(keys):
                    continue
                keep.append(i)
                h = [_hash(x) if x else 0 for x in keys]
                flat += h
                count[i] = len(h)
                sk.append(xxhash.xxh3_64_intdigest(s))
                dk.append(xxhash.xxh3_64_intdigest(np.array([s_ for s_ in h if s_] + [sk[-1]], np.uint64).tobytes()))
            rows = pa.array(np.array(keep, np.int64))
            u = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), u(sk), u(dk), pa.ListArray.from_arrays(pa.array(starts(count[np.array(keep, np.int64)]).astype(np.int32)), u(flat))],
                names=["id", "day", "sk", "dk", "lines"],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.to_date(F.col(at)).alias("day"), F.col(site).alias("site"), F.col(text).alias("text")).where("id is not null and site is not null and text is not null")
    return rows.mapInArrow(run, "id bigint, day date, sk bigint, dk bigint, lines array<bigint>")


def line_counts(docs: DataFrame, rows_least: int = 8, share_least: float = 0.2, clusters_least: int = 1, days_least: int = 1) -> DataFrame:
    """(sk, line, records, clusters, days, site_records) of the lines that are excessive in their site.

    Equal documents of a site are collapsed first; each line is then counted over these clusters (with the records they
    stand for) and over publication dates.  With clusters_least above 1, republished articles alone make no line excessive.
    """
    n = docs.groupBy("sk", "dk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    total = n.groupBy("sk").agg(F.sum("n").alias("site_records"))
    one = docs.select("id", "sk", "dk", "day", "lines").join(n.select("id", "n"), "id")
    each = one.select("sk", "day", "n", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
    by_day = each.groupBy("sk", "line", "day").agg(F.sum("n").alias("r"), F.count(F.lit(1)).alias("c"))
    counts = by_day.groupBy("sk", "line").agg(F.sum("r").alias("records"), F.sum("c").alias("clusters"), F.count("day").alias("days"))
    counts = counts.where((F.col("records") >= rows_least) & (F.col("clusters") >= clusters_least) & (F.col("days") >= days_least))
    return counts.join(total, "sk").where(F.col("records") >= F.col("site_records") * share_least - 1e-9)


def excessive_lines(docs: DataFrame, key: str = "source_ord", text: str = "text", site: str = "site", at: str = "crawled_at", **limits) -> DataFrame:
    """(id, line_no, records, clusters, days, site_records): each place of an excessive, non-blank line, numbered from 1.

    Rows without a site, or without visible text, are no records of a site.  A record counts once for a line however
    often it has it.  Null dates count as no date.
    """
    ship(docs.sparkSession)
    d = written(documents_with_lines(docs, key, text, site, at), "lines")
    counts = written(line_counts(d, **limits), "excessive")
    place = d.select("id", "sk", F.posexplode("lines").alias("pos", "line")).where("line <> 0")
    return place.join(small(counts, 100_000), ["sk", "line"]).select("id", (F.col("pos") + 1).alias("line_no"), "records", "clusters", "days", "site_records")


def without_lines(docs: DataFrame, places: DataFrame, key: str = "source_ord", text: str = "text") -> DataFrame:
    """(key, text, lines_removed) with the placed lines taken out, line ends and other lines as they were.

    Null texts stay null; a text of which every line goes becomes empty.
    """
    gone = places.groupBy(F.col("id").alias(key)).agg(F.collect_set("line_no").alias("_gone"))
    cut = F.expr(f"regexp_extract_all({text}, '[^\\\\r\\\\n]*(?:\\\\r\\\\n|\\\\r|\\\\n|$)', 0)")
    kept = F.array_join(F.filter(F.transform(cut, lambda x, i: F.struct(x.alias("s"), (i + 1).alias("i"))), lambda r: ~F.array_contains(F.col("_gone"), r["i"])).getField("s"), "")
    joined = docs.select(key, text).join(gone, key, "left")
    return joined.select(key, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept).alias(text), F.coalesce(F.size("_gone"), F.lit(0)).alias("lines_removed"))
