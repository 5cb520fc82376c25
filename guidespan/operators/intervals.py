"""Half-open intervals (seq_id, start, end): merging, and joins by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 256


#: Bases of a stretch whose rows are put in order together.
SPAN = 1 << 20
_EARLIER, _LATER = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)


def merge(intervals: DataFrame, span: int = SPAN) -> DataFrame:
    """Touching and overlapping intervals become one. Empty ones and nulls are left out.

    Rows are ordered within stretches of a sequence; how far earlier stretches reach, and how many merged intervals they start, is
    added from one row a stretch.
    """
    rows = intervals.select("seq_id", "start", "end").where("start < end").withColumn("_span", F.floor(F.col("start") / span))
    inside, along = Window.partitionBy("seq_id", "_span").orderBy("start", "end"), Window.partitionBy("seq_id").orderBy("_span")
    ends = rows.groupBy("seq_id", "_span").agg(F.max("end").alias("_end"))
    ends = ends.withColumn("_carried", F.max("_end").over(along.rowsBetween(*_EARLIER))).drop("_end")
    reach = F.greatest("_carried", F.max("end").over(inside.rowsBetween(*_EARLIER)))
    rows = rows.join(ends, ["seq_id", "_span"]).withColumn("_reach", reach)
    rows = rows.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0))
    starts = rows.groupBy("seq_id", "_span").agg(F.sum("_new").alias("_starts"))
    starts = starts.withColumn("_before", F.coalesce(F.sum("_starts").over(along.rowsBetween(*_EARLIER)), F.lit(0))).drop("_starts")
    rows = rows.withColumn("_own", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(starts, ["seq_id", "_span"])
    return rows.groupBy("seq_id", (F.col("_before") + F.col("_own")).alias("_group")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def _binned(intervals: DataFrame, start, end, name: str) -> DataFrame:
    return intervals.withColumn(name, F.explode(F.sequence(F.floor(start / BIN), F.floor((end - 1) / BIN))))


def starts_within(points: DataFrame, intervals: DataFrame, start: str = "start", how: str = "left_anti") -> DataFrame:
    """Points whose start lies in no interval (left_anti) or in one (left_semi): an equi-join by bins and a residual test."""
    marks = _binned(intervals.where("start < end").select(F.col("seq_id").alias("_seq"), F.col("start").alias("_from"), F.col("end").alias("_to")), F.col("_from"), F.col("_to"), "_bin")
    on = (F.col("seq_id") == F.col("_seq")) & (F.floor(F.col(start) / BIN) == F.col("_bin")) & (F.col(start) >= F.col("_from")) & (F.col(start) < F.col("_to"))
    return points.join(marks, on, how)


def ranged(left: DataFrame, right: DataFrame, lo, hi, right_pos: str) -> DataFrame:
    """Pairs of rows of one seq_id with lo <= right_pos <= hi (columns of left). right's columns must be named apart but for seq_id."""
    right = right.withColumnRenamed("seq_id", "_seq").withColumn("_bin", F.floor(F.col(right_pos) / BIN))
    left = left.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
    left = left.withColumn("_left_bin", F.explode(F.sequence(F.floor(F.col("_lo") / BIN), F.floor(F.col("_hi") / BIN))))
    on = (F.col("seq_id") == F.col("_seq")) & (F.col("_left_bin") == F.col("_bin")) & F.col(right_pos).between(F.col("_lo"), F.col("_hi"))
    return left.join(right, on).drop("_seq", "_bin", "_left_bin", "_lo", "_hi")


def nearest(points: DataFrame, marks: DataFrame, pos: str = "pos", info: str | None = None, span: int = SPAN) -> DataFrame:
    """Points (seq_id, pos, ...) with the nearest mark of their seq_id (seq_id, mark), null without any: the lower one on ties, or that
    of the lesser ``info``, which then comes along as ``nearest_info``.

    Only distinct bins are put in order, within stretches of a sequence: each knows its own marks, BIN of them at most, and the next
    ones outside, in its stretch or in others, of which there is one row each.
    """
    own = marks.select("seq_id", "mark", (F.col(info) if info else F.lit(0)).alias("i")).groupBy("seq_id", "mark").agg(F.min("i").alias("i"))
    held = own.groupBy("seq_id", F.floor(F.col("mark") / BIN).alias("_bin")).agg(F.collect_list(F.struct("mark", "i")).alias("_marks"))
    bins = points.select("seq_id", F.floor(F.col(pos) / BIN).alias("_bin")).distinct().join(held, ["seq_id", "_bin"], "full").withColumn("_span", F.floor(F.col("_bin") * BIN / span))
    whole = bins.groupBy("seq_id", "_span").agg(F.max(F.array_max("_marks")).alias("_max"), F.min(F.array_min("_marks")).alias("_min"))
    along, inside = Window.partitionBy("seq_id").orderBy("_span"), Window.partitionBy("seq_id", "_span").orderBy("_bin")
    whole = whole.select("seq_id", "_span", F.max("_max").over(along.rowsBetween(*_EARLIER)).alias("_below"), F.min("_min").over(along.rowsBetween(*_LATER)).alias("_above"))
    bins = bins.withColumn("_low", F.max(F.array_max("_marks")).over(inside.rowsBetween(*_EARLIER))).withColumn("_high", F.min(F.array_min("_marks")).over(inside.rowsBetween(*_LATER)))
    bins = bins.join(whole, ["seq_id", "_span"]).withColumn("_low", F.coalesce("_low", "_below")).withColumn("_high", F.coalesce("_high", "_above")).drop("_span", "_below", "_above")
    near = F.array_compact(F.concat(F.coalesce("_marks", F.array("_low")), F.array("_low", "_high")))
    best = F.array_min(F.transform(near, lambda m: F.struct(F.abs(m["mark"] - F.col(pos)).alias("d"), m["i"].alias("i"), m["mark"].alias("mark"))))
    rows = points.withColumn("_bin", F.floor(F.col(pos) / BIN)).join(bins, ["seq_id", "_bin"], "left").withColumn("_best", best)
    return rows.select(*points.columns, F.col("_best.mark").alias("nearest"), *([F.col("_best.i").alias("nearest_info")] if info else []))
