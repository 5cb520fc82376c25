"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slot i of the schedule has the point frac((i + 1) / golden ratio). The sources' shares, laid end to end, cut the unit interval; the
point's interval names the source of the slot. The slots of a source are ranked, and rank r takes block r of the source's words:
its documents shuffled, laid end to end, cut in blocks of equally many words, and repeated as often as the target asks. Any run of
slots thus holds the sources in nearly the target proportions. What a source gives is what its slots take and nothing else: its
number of slots differs from its share of all by the discrepancy of the points, a few slots however many there are. The remainder
rule: a block ends at the source's target (rounded down), so slots that a source has beyond it take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guidespan.llm.common import cut, fresh

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Words of a block at most; small tables have smaller blocks, so that there are SLOTS slots at least.
BLOCK_WORDS, SLOTS = 1024, 65536
GOLDEN = 0.6180339887498949
BINS = 1024
CHUNK = 4096


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): sid (1, 2, ... by code point, null last), weight and target.

    The weights share the sum of all sizes; a source takes MAX_PASSES times its size at most, and what it leaves is shared by weight
    among the others until none is above. In the order of size over weight, the sources at their limit come first, so running sums
    find them. The table has one row a source.
    """
    # One row a source: these windows order the sources, never the documents.
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(MAX_PASSES))
    everything, earlier = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy(F.col("_cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    words, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (words - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / (weight - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    full = ranked.withColumn("_full", level > F.col("_cap") / F.col("weight"))
    left = (words - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0))) / (weight - F.coalesce(F.sum(F.when(F.col("_full"), F.col("weight"))).over(everything), F.lit(0.0)))
    return full.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least("_cap", F.col("weight") * left))).select("sid", "source", "source_size", "weight", "target")


def point(slot: Column) -> Column:
    """The point of a slot, in [0, 1)."""
    x = (slot + 1) * F.lit(GOLDEN)
    return x - F.floor(x)


def schedule(sources: DataFrame, total_words: int, block: int) -> DataFrame:
    """The slots (slot, sid, rank): which block of which source comes when. sources: the result of ``targets``."""
    spark = sources.sparkSession
    slots = -(-total_words // block)
    by = Window.orderBy("sid")  # one row a source
    shares = sources.withColumn("_lo", F.coalesce(F.sum("target").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / total_words)
    shares = shares.withColumn("_hi", F.sum("target").over(by.rowsBetween(Window.unboundedPreceding, 0)) / total_words).where("_hi > _lo").select("sid", "_lo", "_hi")
    # Points meet their share by an equal bin of the unit interval, never by a cross join.
    bins = shares.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") * BINS), F.floor(F.col("_hi") * BINS))))
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("_point")).withColumn("_bin", F.floor(F.col("_point") * BINS))
    named = points.join(bins, "_bin").where("_point >= _lo and _point < _hi").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("_chunk"))
    named = cut(named)
    # Ranks of a source: within a chunk of slots, then by the chunks' counts, so that a large source is not ordered in one task.
    counts = named.groupBy("sid", "_chunk").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = named.withColumn("_in", F.row_number().over(Window.partitionBy("sid", "_chunk").orderBy("slot"))).join(counts, ["sid", "_chunk"])
    return ranked.select("slot", "sid", (F.col("_before") + F.col("_in") - 1).alias("rank"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame | None, int]:
    """Every row with its place among the words of its source, (_id, _text_hash, size, sid, source_size, target, _at); slots; block."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("_text_hash"))
    rows = cut(rows.withColumn("_key", F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit("/"), F.col("size").cast("string")).cast("binary"))))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(BLOCK_WORDS, total // SLOTS))
    known = sources.select(F.col("source").alias("_source"), "sid", "source_size", "target")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).select("_id", "_text_hash", "size", "_key", "sid", "source_size", "target", F.substring("_key", 1, 3).alias("_bucket"))
    # The place of a document in its shuffled source: within a bucket of keys, then by the buckets' sums.
    sums = placed.groupBy("sid", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("sid", "_bucket", "_base")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "_bucket").orderBy("_key", "_id", "_text_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("_inside", inside).join(sums, ["sid", "_bucket"]).withColumn("_at", F.col("_base") + F.col("_inside"))
    placed = placed.select("_id", "_text_hash", "size", "sid", "source_size", "target", "_at")
    return placed, (schedule(sources, total, block) if total else None), block


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_id, _text_hash, size, sid, source_size, target, taken, first_slot) of every row."""
    placed, slots, block = _placed(docs, id_col, text_col, source_col)
    none = lambda rows: rows.select("_id", "_text_hash", "size", "sid", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    if slots is None:
        return none(placed)
    placed = cut(placed)
    # Rows that no block meets (without words, or behind the target in each pass) need no slot, so they stay out of the join.
    within = (F.col("size") > 0) & (F.col("_at") < F.floor("target"))
    passes = placed.where(within).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1))))
    passes = passes.withColumn("_first", F.col("_at") + F.col("_pass") * F.col("source_size")).withColumn("_last", F.least(F.col("_first") + F.col("size"), F.floor("target"))).where("_last > _first")
    passes = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_first") / block), F.floor((F.col("_last") - 1) / block))))
    words = F.least(F.col("_last"), (F.col("rank") + 1) * block) - F.greatest(F.col("_first"), F.col("rank") * block)
    met = passes.join(slots, ["sid", "rank"], "left")
    per = met.groupBy("_id", "_text_hash", "_at", "size", "sid", "source_size", "target").agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), words)), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"))
    return per.drop("_at").unionByName(none(placed.where(~within)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Return id, size, source_size, target, taken (words that the slots take of the document, repeats counted) and first_slot (the
    first slot that takes some, null if none does) of every row.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source, the last. Repeated rows are rows of their
    own. If no document has a word, all is 0. An empty table gives an empty result. Other columns are not read.
    """
    return _taken(docs, id_col, text_col, source_col).select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken", "first_slot")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns, each partition in the order of the schedule.

    The last document that a source's slots reach is taken whole if half of its words are, and left out if not. Rows without words
    are never taken. Every row is taken as often as itself asks: rows of one id, null or not, are told apart by their text, and
    rows that agree in both by their number among themselves. An empty table gives an empty result.
    """
    times = F.floor(F.col("taken") / F.col("size") + 0.5)
    rows = _taken(docs, id_col, text_col, source_col).where("size > 0").select(F.col("_id").cast("string").alias("_id"), "_text_hash", times.alias("_times"), "first_slot")
    ident, text, number, often, slot, one = fresh(docs, "ident", "text_hash", "number", "often", "slot", "one")
    # Rows that are there once meet by id and text; only rows that are repeated as they stand are numbered.
    per = rows.groupBy("_id", "_text_hash").agg(F.count("*").alias("n"), F.sum("_times").alias("_times"), F.min("first_slot").alias("first_slot"))
    per = cut(per.where("_times > 0").select(F.coalesce(F.concat(F.lit("/"), "_id"), F.lit("")).alias(ident), F.col("_text_hash").alias(text), F.col("n").alias(number), F.col("_times").alias(often), F.col("first_slot").alias(slot)))
    known = docs.withColumn(ident, F.coalesce(F.concat(F.lit("/"), F.col(id_col).cast("string")), F.lit(""))).withColumn(text, F.xxhash64(F.col(text_col).cast("string")))
    single = known.join(per.where(F.col(number) == 1).drop(number), [ident, text])
    again = known.join(per.where(F.col(number) > 1), [ident, text])
    again = again.withColumn(one, F.row_number().over(Window.partitionBy(ident, text).orderBy(F.lit(0))))
    again = again.withColumn(often, F.floor(F.col(often) / F.col(number)) + (F.col(one) <= F.col(often) % F.col(number)).cast("long")).drop(number, one)
    both = single.unionByName(again).where(F.col(often) > 0)
    return both.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(often)))).sortWithinPartitions(slot, ident, one).select(*(both[c] for c in docs.columns))
