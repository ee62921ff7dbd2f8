"""The site of a url."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCHEME = re.compile(r"^[a-z][a-z0-9+.\-]*://", re.I)
# Schemes whose urls name no host.
_HOSTLESS = re.compile(r"^(?:about|blob|cid|data|file|javascript|mailto|mid|news|sms|tel|urn|view-source):", re.I)
_LABEL = re.compile(r"^[^\W_](?:[\w\-]*[^\W_])?$")


def host_of(url: str | None) -> str | None:
    """Host of a url in Unicode lower case, or None where it names none."""
    if url is None:
        return None
    s = url.strip()
    m = _SCHEME.match(s)
    if m:
        s = s[m.end() :]
    elif s.startswith("//"):
        s = s[2:]
    elif _HOSTLESS.match(s):
        return None
    s = re.split(r"[/?#\\]", s, maxsplit=1)[0].rpartition("@")[2]
    s = re.sub(r":\d*$", "", s).strip().rstrip(".").lower()
    if not s:
        return None
    labels = []
    for label in unicodedata.normalize("NFC", s).replace("。", ".").split("."):
        if label.startswith("xn--"):
            try:
                label = unicodedata.normalize("NFC", label[4:].encode("ascii").decode("punycode").lower())
            except (UnicodeError, ValueError, OverflowError):
                return None
        if not _LABEL.match(label):
            return None
        labels.append(label)
    return ".".join(labels)


def site_of(url: str | None, suffixes: frozenset[str]) -> str | None:
    """Longest matching suffix plus the label before it, or None.

    Null, blank and hostless urls, hosts that are only a suffix, and hosts under no listed suffix have no site.
    """
    host = host_of(url)
    if host is None:
        return None
    labels = host.split(".")
    for i in range(1, len(labels)):
        if ".".join(labels[i:]) in suffixes:
            return ".".join(labels[i - 1 :])
    return None


def suffix_list(suffixes: DataFrame) -> frozenset[str]:
    """The suffix table as a set; it is a fixed list of registries, not data that grows (TESTDATA: 12 rows)."""
    return frozenset(
        unicodedata.normalize("NFC", r[0].strip().strip(".").lower()) for r in suffixes.select("suffix").na.drop().distinct().limit(100_000).collect()
    )


def site_udf(suffixes: frozenset[str]):
    """Arrow function url -> site; each distinct url of a batch is parsed once, each host once."""

    @F.arrow_udf(T.StringType())
    def site(url: pa.Array) -> pa.Array:
        d = url.cast(pa.string()).dictionary_encode()
        values = [site_of(u, suffixes) for u in d.dictionary.to_pylist()]
        return pa.array(values, pa.string()).take(d.indices)

    return site


def with_site(df: DataFrame, suffixes: DataFrame, url: str = "url", out: str = "site") -> DataFrame:
    return df.withColumn(out, site_udf(suffix_list(suffixes))(F.col(url)))


def owner_table(spark: SparkSession, owners: DataFrame) -> DataFrame:
    """site -> owner_key with sites in the form that site_of gives."""

    def plain(c: Column) -> Column:
        return F.lower(F.trim(c))

    return owners.select(plain(F.col("site")).alias("site"), "owner_key").na.drop().dropDuplicates(["site"])
