"""Numbers 1, 2, ... in a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guidespan.operators.lineage import cut

#: Bits of a row's place within its range, as Spark numbers them.
PLACE_BITS = 33


def numbered(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Adds ``name``: the place of each row in the order, which must tell all rows apart.

    The rows are dealt to ranges of the whole order (of equal numbers of rows, tie-breakers included, as sampling finds them) and
    sorted there; a row's number is what the ranges before hold and its place in its own. Keys may be of any type that has an order.
    """
    return _ranges(rows, name, order).drop("_range")


def _ranges(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """What ``numbered`` gives, and the range that a row was dealt to, as ``_range``."""
    place = F.col("_place")
    dealt = cut(rows).repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("_place", F.monotonically_increasing_id()))
    counts = dealt.groupBy(F.shiftright(place, PLACE_BITS).alias("_range")).agg(F.count("*").alias("_n"))
    # This window orders one row a range.
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    met = dealt.withColumn("_range", F.shiftright(place, PLACE_BITS)).join(F.broadcast(before), "_range")
    return met.withColumn(name, F.col("_before") + place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1).drop("_place", "_before")


def ranked(rows: DataFrame, name: str, by: list[str], key: list[Column], ties: Sequence[Column] = ()) -> DataFrame:
    """Adds ``name``: ranks 1, 1, 3, ... by ascending ``key`` among the rows of equal ``by``; rows of equal keys share one. Nulls are equal.

    ``ties`` orders the rows of equal keys; rows that it leaves equal go to one range. Rows are dealt to ranges of the whole order as in
    ``numbered``. A range takes the first number of each of its keys and groups; those that go on from an earlier range get theirs from
    one row a range. So neither one group nor one key gathers in a task.
    """
    keys = [f"_k{i}" for i in range(len(key))]
    out = cut(_ranges(rows.withColumns(dict(zip(keys, key, strict=True))), "_number", [*map(F.col, by), *key, *ties]))
    for part, first in (([*by, *keys], "_tie"), (by, "_group")):
        out = _first(out, part, first)
    return out.withColumn(name, F.col("_tie") - F.col("_group") + 1).drop("_number", "_range", "_tie", "_group", *keys)


def _first(dealt: DataFrame, part: list[str], name: str) -> DataFrame:
    """Adds the least ``_number`` of the rows of equal ``part``, which follow one another over the ranges."""
    same = F.struct(*part) if part else F.struct(F.lit(0))
    ends = dealt.groupBy("_range").agg(F.min_by(same, "_number").alias("_head"), F.max_by(same, "_number").alias("_tail"))
    own = dealt.withColumn(name, F.min("_number").over(Window.partitionBy("_range", *part)))
    starts = dealt.join(F.broadcast(ends.select("_range", "_tail")), "_range").where(same.eqNullSafe(F.col("_tail"))).groupBy("_range").agg(F.min("_number").alias("_start"), F.first("_tail").alias("_tail"))
    # What goes on from earlier ranges began in one of which it is the tail: a row a range meets a row a range.
    went = ends.select("_range", "_head").join(starts.select("_start", "_tail"), F.col("_head").eqNullSafe(F.col("_tail"))).groupBy("_range").agg(F.first("_head").alias("_head"), F.min("_start").alias("_start"))
    return own.join(F.broadcast(went), "_range", "left").withColumn(name, F.when(same.eqNullSafe(F.col("_head")), F.least("_start", name)).otherwise(F.col(name))).drop("_head", "_start")


def summed(rows: DataFrame, by: list[str], order: list[Column], weight: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of the weights of the rows before each one, in the order within its group (``by``).

    Works as ``numbered`` does: ranges of the whole order are summed apart, then added up.
    """
    key = [*map(F.col, by), *order]
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()))
    earlier = (Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("_range").orderBy(*key).rowsBetween(*earlier)), F.lit(0))
    sums = dealt.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    # This window orders one row a range.
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(*earlier)), F.lit(0))).drop("_sum")
    out = dealt.withColumn("_own", own).join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
    if not by:
        return out
    first = out.groupBy(*by).agg(F.min(name).alias("_first"))
    return out.join(F.broadcast(first), by).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
