"""Units of a batch (scopes times patterns): ids, what is left to do, the manifest after a run, the union of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns that name the unit of a row in a union of results.
KEYS = ("batch_label", "unit_id", "scope_id", "pattern_id")
DONE = ("done", "empty")


def units(groups: DataFrame, scopes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(unit_id, scope_id, pattern_id) of groups (group_id, scope_ids, pattern_ids): each pair once, that both tables hold.

    The lists are exploded, so nothing is crossed but what a group names.
    """
    rows = groups.select(F.explode("scope_ids").alias("scope_id"), "pattern_ids").select("scope_id", F.explode("pattern_ids").alias("pattern_id")).distinct()
    rows = rows.join(scopes.select("scope_id").distinct(), "scope_id", "left_semi").join(patterns.select("pattern_id").distinct(), "pattern_id", "left_semi")
    return rows.select(unit_id("scope_id", "pattern_id").alias("unit_id"), "scope_id", "pattern_id")


def unit_id(scope: str, pattern: str, longest: int = 80):
    """Both ids, joined; a longer one is cut and ends in the first eight digits of its hash."""
    whole = F.regexp_replace(F.concat_ws("__", F.col(scope).cast("string"), F.col(pattern).cast("string")), "[^A-Za-z0-9_.-]", "_")
    return F.when(F.length(whole) <= longest, whole).otherwise(F.concat(F.substring(whole, 1, longest - 9), F.lit("-"), F.substring(F.sha1(whole.cast("binary")), 1, 8)))


def remaining(units: DataFrame, manifest: DataFrame) -> DataFrame:
    """The units that no earlier run has finished."""
    return units.join(manifest.where(F.col("status").isin(*DONE)).select("unit_id"), "unit_id", "left_anti")


def merged(new: DataFrame, prior: DataFrame) -> DataFrame:
    """The manifest after a run: its own rows, and the earlier ones of all other units, once each. Columns that one lacks are null.

    Rows of a unit that came twice earlier: the one whose values are least. Earlier rows without a unit go.
    """
    old = prior.where(F.trim("unit_id") != "").groupBy("unit_id").agg(F.min(F.struct(*(c for c in prior.columns if c != "unit_id"))).alias("_r")).select("unit_id", "_r.*")
    return new.unionByName(old.join(new.select("unit_id"), "unit_id", "left_anti"), allowMissingColumns=True)


def united(tables: list[DataFrame], label: str) -> DataFrame:
    """Results of units in one table: all their columns, in the order in which they first appear, and which unit a row is of.

    Each table brings unit_id, scope_id and pattern_id as its last three columns; own columns of those names have been renamed before,
    by ``keyed``.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).withColumn("batch_label", F.lit(label))
    return rows.select(*KEYS, *(c for c in rows.columns if c not in KEYS))


def keyed(table: DataFrame, unit, scope, pattern) -> DataFrame:
    """The table with the unit's columns; own columns of the same names get the prefix ``batch_``."""
    for name in KEYS:
        if name in table.columns:
            table = table.withColumnRenamed(name, f"batch_{name}")
    return table.withColumns({"unit_id": unit, "scope_id": scope, "pattern_id": pattern})


def provenance(rows: DataFrame, model: str, note: str) -> DataFrame:
    """(model, n_rows, n_fallback, notes): which models scored how many rows, how many by a stand-in (a note), and the notes, in order."""
    per = rows.groupBy(F.col(model).alias("model"), F.col(note).alias("_note")).agg(F.count("*").alias("_n"))
    return per.groupBy("model").agg(F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_note") != "", F.col("_n"))), F.lit(0)).alias("n_fallback"), F.concat_ws("; ", F.array_sort(F.collect_set(F.nullif("_note", F.lit(""))))).alias("notes"))
