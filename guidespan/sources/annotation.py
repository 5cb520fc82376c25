"""Annotation lines (nine columns, places from 1, both ends included) as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def attributes(text: Column) -> Column:
    """Array of (k, v) from ``key=value;`` or ``key "value";`` items, in their order; items of neither form are left out."""
    items = F.filter(F.split(text, ";"), lambda x: x.rlike("=|^[^ ]* "))
    cut = lambda x: F.when(x.contains("="), "=").otherwise(" ")
    key, value = lambda x: F.trim(F.substring_index(x, "=", 1)), lambda x: F.trim(F.substring(x, F.position(F.lit("="), x) + 1, F.length(x)))
    spaced = lambda x: F.struct(F.trim(F.substring_index(x, " ", 1)).alias("k"), F.trim(F.trim(F.substring(x, F.position(F.lit(" "), x) + 1, F.length(x))), F.lit('"')).alias("v"))
    return F.transform(items, lambda x: F.when(cut(x) == "=", F.struct(key(x).alias("k"), value(x).alias("v"))).otherwise(spaced(x)))


def attribute(pairs: Column, *names: str) -> Column:
    """Value of the first of the names that has one that is not empty; of a name that comes twice, the last."""
    got = [F.nullif(F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"], F.lit("")) for name in names]  # noqa: B023
    return F.coalesce(*got)


def parsed(lines: DataFrame) -> DataFrame:
    """(seq_id, type, start, end, strand, attrs) of lines (value). Comments, short lines and lines without numbers are left out."""
    parts = F.split("value", "\t")
    rows = lines.where("value not like '#%'").select(parts.alias("_p")).where(F.size("_p") >= 9)
    at = lambda i: F.col("_p")[i]
    return rows.select(at(0).alias("seq_id"), at(2).alias("type"), at(3).try_cast("long").alias("start"), at(4).try_cast("long").alias("end"), F.when(at(6).isin("+", "-"), at(6)).otherwise(".").alias("strand"), attributes(at(8)).alias("attrs")).where("start is not null and end is not null")


def from_gff(spark: SparkSession, path: str) -> DataFrame:
    """The rows of files, compressed or not."""
    return parsed(spark.read.text(path))
