"""Landed files of smaller formats: registries, feature pages, result tables, fetch manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_registry(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """S-16: the entries of a YAML list of flat maps: one column for each of ``names``; comments and quotes go, what is not said is null."""
    lines = F.regexp_replace(F.regexp_replace("value", r"(?m)(^|\s)#.*$", ""), r"\r", "")
    entries = F.slice(F.split(lines, r"(?m)^\s*-\s+"), 2, 1 << 30)
    rows = spark.read.text(path, wholetext=True).select(F.explode(entries).alias("e"))

    def said(name: str) -> Column:
        raw = F.trim(F.regexp_extract("e", rf"(?m)^\s*{name}:[ \t]*(.*)$", 1))
        bare = F.regexp_replace(raw, r"^([\"'])(.*)\1$", "$2")
        return F.when((raw != "") & ~raw.isin("null", "~"), bare).alias(name)

    return rows.select(*map(said, names))


def read_features(spark: SparkSession, path: str, attributes: str, key: str) -> DataFrame:
    """S-29: features of landed pages: their attributes and rings; a key that several pages hold counts once."""
    kind = f"array<struct<attributes:struct<{attributes.replace(' ', ':').replace(',:', ',')}>,geometry:struct<rings:array<array<array<double>>>>>>"
    pages = spark.read.text(path, wholetext=True)
    f = pages.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), kind)).alias("f"))
    return f.select("f.attributes.*", F.col("f.geometry.rings").alias("rings")).dropDuplicates([key])


def number(name: str, default: float | None = None) -> Column:
    """S-30: a cell as a number; blanks, dashes and words are the default."""
    return F.coalesce(F.regexp_replace(F.col(name), "[,£ ]", "").try_cast("double"), F.lit(default).cast("double"))


def still_to_fetch(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """S-31: the wanted rows (url) that the manifest (url, status) has no finished file for, with the file's name."""
    done = manifest.where("status = 'ok'").select("url")
    return wanted.join(done, "url", "left_anti").withColumn("file", F.sha1(F.col("url").cast("binary")))
