"""Hits of guides after the search: missing fields, filters, one row of several, counts by mismatches, and the score of a guide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidespan.functions import scores as V
from guidespan.functions import seq as S

#: What the composition of bulges is called, and what is said of it.
BULGE_METHOD = "conservative_bulge_v1"
BULGE_NOTE = f"Bulge hits use an uncalibrated conservative penalty ({BULGE_METHOD})."


def normalised(hits: DataFrame, engine: str) -> DataFrame:
    """Hits with all fields: those that a search leaves out, or null ones, get what they are by default.

    The target ends a guide's length after its start, less the bulges, unless it is told.
    """
    has = set(hits.columns)
    value = lambda c, other: F.coalesce(F.col(c), other) if c in has else other
    whole = lambda c, other: value(c, other).cast("long")
    guide = F.coalesce(F.col("guide"), F.lit(""))
    start, indel = whole("start", F.lit(0)), whole("indel", F.lit(0))
    target_start = whole("target_start", start)
    return hits.select(
        "qid", guide.alias("guide"), F.col("seq_id").alias("target"), start.alias("start"), value("strand", F.lit("+")).alias("strand"), whole("mismatch", F.lit(0)).alias("mismatch"), indel.alias("indel"),
        whole("rna_bulges", F.lit(0)).alias("rna_bulges"), whole("dna_bulges", F.lit(0)).alias("dna_bulges"), value("pam", F.lit("")).alias("pam"), value("bitscore", F.lit(0.0)).cast("double").alias("bitscore"),
        target_start.alias("target_start"), whole("target_end", target_start + F.length(guide) - indel).alias("target_end"), whole("query_start", F.lit(0)).alias("query_start"), whole("query_end", F.length(guide)).alias("query_end"),
        value("cigar", F.lit("")).alias("cigar"), value("aligned_guide", guide).alias("aligned_guide"), value("aligned_target", F.lit("")).alias("aligned_target"), F.lit(engine).alias("engine"),
    )


def seed_edits(guide: Column, target: Column, size: int, side: str = "3prime") -> Column:
    """Edits within the ``size`` bases of the guide next to the PAM, of aligned strings: a base without partner counts as one.

    Columns without a base of the guide do not count.
    """
    n = F.length(F.translate(guide, "-", ""))
    first = F.lit(0) if side == "5prime" else F.greatest(n - size, F.lit(0))

    def step(a: Column, i: Column) -> Column:
        g, t = F.substring(guide, i, F.lit(1)), F.substring(target, i, F.lit(1))
        inside = (a["at"] >= first) & (a["at"] < first + size) & (g != t)
        return F.when(g == "-", a).otherwise(F.struct((a["at"] + 1).alias("at"), (a["n"] + inside.cast("int")).alias("n")))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    # Without gaps the seed is the first or last bases of both, and the others need no look.
    part = (lambda x: F.left(x, F.lit(size))) if side == "5prime" else (lambda x: F.right(x, F.lit(size)))
    plain = ~guide.contains("-") & (F.length(guide) == F.length(target)) & (F.length(guide) > 0)
    return F.when(plain, S.mismatches(part(guide), part(target))).when(F.length(guide) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(guide), F.lit(1))), start, step, lambda a: a["n"])).otherwise(0)


def within_budget(hits: DataFrame, mismatches: int, seed: int = 0, seed_mismatches: int | None = None, side: str = "3prime") -> DataFrame:
    """Hits (normalised) of so many mismatches at most, and of so many edits in the seed if asked for.

    Where the aligned strings are not known, all edits count as the seed's.
    """
    kept = F.col("mismatch") <= mismatches
    if seed and seed_mismatches is not None:
        blank = F.coalesce("aligned_target", F.lit("")) == ""
        edits = F.when(blank, F.col("mismatch") + F.col("indel")).otherwise(seed_edits(F.col("aligned_guide"), F.col("aligned_target"), seed, side))
        # Spark would put what is the same in every task into the search's join, and look at the letters of each pair that meets there.
        kept = kept & (edits + F.spark_partition_id() * 0 <= seed_mismatches)
    return hits.where(kept)


def without_expected(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Hits that are not the guide's own site (qid, target, start), whatever the strand. Guides without one keep all."""
    return hits.join(expected.select("qid", "target", "start").distinct(), ["qid", "target", "start"], "left_anti")


def deduplicated(hits: DataFrame) -> DataFrame:
    """One hit of each guide and place (target, start, end, strand): that of the fewest mismatches, then bulges, then the least."""
    key = ["qid", "target", "target_start", "target_end", "strand"]
    others = [c for c in hits.columns if c not in key]
    best = F.min(F.struct("mismatch", "indel", *(c for c in others if c not in ("mismatch", "indel")))).alias("_best")
    return hits.groupBy(*key).agg(best).select(*key, *(F.col(f"_best.{c}").alias(c) for c in others)).select(*hits.columns)


def buckets(hits: DataFrame, budget: int) -> DataFrame:
    """(qid, mm0, ..., mm of the budget): hits by mismatches; the last counts those of more too."""
    count = lambda k: F.coalesce(F.count_if(F.col("mismatch") >= k if k == budget else F.col("mismatch") == k), F.lit(0))
    return hits.groupBy("qid").agg(*(count(k).alias(f"mm{k}") for k in range(budget + 1)))


def key_differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, status): keys that are missing in ``found``, and extra ones."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("status", F.lit("extra")))


def backfilled(rows: DataFrame, scores: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Rows with the columns of ``scores`` (one row a key), null where it has none. strict: both must have the same keys."""
    if strict and (first := key_differences(rows, scores, key).first()):
        raise ValueError(f"{first['status']}: {first[key]}")
    return rows.join(scores, key, "left")


def guide_scores(guides: DataFrame, hits: DataFrame, weights: list[float] | None = None, preset: str = "cas9", weights_name: str = "rule_weights", calibrated: bool = False) -> DataFrame:
    """One scored row a guide: model, specificity, how it was composed and calibrated.

    weights_name is what the given weights are called, calibrated whether they come from measurements; those made by a rule do not.

    Hits without bulges are weighed by the mismatch weights and the PAM (preset cas9; by the length's identity if a guide has another
    length than 20), or by the preset's seed. Hits with bulges add their cautious risk to the burden 1 / specificity - 1. Without hits a
    guide is wholly specific. on_target_score is the rule-based activity, which stands in where no window of 30 bases is known.
    """
    g = F.col("guide")
    bulge = F.col("indel") > 0
    hits = hits.withColumn("_c", V.compared(g, F.col("aligned_guide"), F.col("aligned_target"), weights))
    alike = V.weighted_of(F.col("_c"), F.col("pam")) if preset == "cas9" else V.seeded_of(F.col("_c"), preset)
    risk = V.risk_of(F.col("_c"), F.col("mismatch"), F.col("rna_bulges"), F.col("dna_bulges"), F.col("indel"))
    rows = hits.withColumn("_alike", F.when(~bulge, F.round(alike, 12))).withColumn("_risk", F.when(bulge, F.round(risk, 12)))
    per = rows.groupBy("qid").agg(F.count("*").alias("input_offtargets"), F.count("_alike").alias("substitution_offtargets"), F.count("_risk").alias("bulge_hits"), F.sum("_alike").alias("_sum"), F.max("_alike").alias("_best"), F.sum("_risk").alias("_risks"))
    rows = guides.select("qid", "guide").join(per, "qid", "left").fillna(0)
    total = F.when(F.col("_best") >= 0.999999, F.greatest(F.col("_sum") - 1, F.lit(0.0))).otherwise(F.col("_sum"))
    specific = F.when(F.col("bulge_hits") > 0, 1 / (1 + F.greatest(total, F.lit(0.0)) + F.col("_risks"))).otherwise(1 / (1 + total))
    uncalibrated = (F.col("bulge_hits") > 0) | F.lit(preset != "cas9" or not calibrated)
    return rows.select(
        "qid", "guide", "input_offtargets", "substitution_offtargets", "bulge_hits", F.round("_risks", 6).alias("bulge_risk_sum"), F.round(specific, 6).alias("off_target_specificity"), F.lit(weights_name if preset == "cas9" else f"{preset}_rules").alias("off_target_model"),
        F.when(F.col("bulge_hits") > 0, BULGE_NOTE).otherwise("").alias("off_target_model_note"), F.when(F.col("bulge_hits") > 0, BULGE_METHOD).otherwise("not_applicable").alias("bulge_score_method"),
        F.when(uncalibrated, "uncalibrated").otherwise("calibrated_reference").alias("calibration_status"), F.round(S.activity(g), 9).alias("on_target_score"), F.lit("nuc_features").alias("on_target_model"),
    )


def first_rows(rows: DataFrame, key: str, order: list[Column], count: str) -> DataFrame:
    """The first row of each key in the order, and how many rows the key has."""
    place, held = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order))), F.struct(*(c for c in rows.columns if c != key))
    return rows.groupBy(key).agg(F.min_by(held, place).alias("_row"), F.count("*").alias(count)).select(key, "_row.*", count)


def activities(hits: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Hits (normalised) with one column a model, null where a model can't score them, and the activity that counts with its model.

    Weighted similarity and those by preset take hits without bulges; the cautious risk takes those with.
    """
    c, bulge, held = F.col("_c"), F.col("indel") > 0, hits.withColumn("_c", V.compared(F.col("guide"), F.col("aligned_guide"), F.col("aligned_target"), weights or V.rule_weights()))
    plain = lambda x: F.when(~bulge, F.round(x, 9))
    risk = V.risk_of(c, F.col("mismatch"), F.col("rna_bulges"), F.col("dna_bulges"), F.col("indel"))
    out = held.withColumns({"activity_cfd": plain(V.weighted_of(c, F.col("pam"))), "activity_identity": plain(V.identity_of(c)), **{f"activity_{n}": plain(V.seeded_of(c, n)) for n in V.SEEDS}, "activity_bulge": F.when(bulge, F.round(risk, 9))}).drop("_c")
    return out.withColumn("activity", F.coalesce("activity_cfd", "activity_bulge")).withColumn("activity_model", F.when(bulge, BULGE_METHOD).otherwise("cfd"))


def hard_filtered(rows: DataFrame, asked: bool, gc_hint: str = "gc_hint", repeat_hint: str | None = None) -> DataFrame:
    """Rows whose hints pass, if that is asked for; else all."""
    kept = F.col(gc_hint) == "pass"
    return rows.where(kept & (F.col(repeat_hint) == "pass") if repeat_hint else kept) if asked else rows
