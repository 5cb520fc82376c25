"""Ranking of paired sites."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidespan.functions import formats
from guidespan.operators.lineage import cut
from guidespan.operators.ordinals import ranked, summed


@dataclass(frozen=True)
class Policy:
    """Thresholds of activity (e_*), of the sum (b_*) and the maximum (m_*) of risks, of a high risk and of how many may be high; and
    what a risk without an upper bound is raised by."""

    e_high: float = 0.8
    e_min: float = 0.5
    e_fail: float = 0.2
    b_low: float = 0.4
    b_high: float = 0.8
    m_low: float = 0.2
    m_high: float = 0.45
    h_max: int = 1
    delta_default: float = 0.05
    h_risk: float = 0.7

    def __post_init__(self):
        if not (self.e_fail <= self.e_min <= self.e_high and self.b_low <= self.b_high and self.m_low <= self.m_high) or self.h_max != int(self.h_max) or self.delta_default <= 0:
            raise ValueError("thresholds out of order")


def percentile(rows: DataFrame, score: str, by: list[str], name: str) -> DataFrame:
    """Adds the mean rank of a score among its group, over the group's size; null in groups of one. Ties share their mean rank.

    Counted from the distinct scores, so that large groups are summed before they are ordered.
    """
    ranks = _mean_ranks(rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("_n")), by, score, name)
    return rows.join(ranks, [*by, score], "left")


def percentiles(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The same for several scores over all rows, {score: name of its percentile}, counted in one pass.

    ``rows`` is read twice, so its lineage should be cut before.
    """
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(s).alias("_which"), F.col(s).cast("double").alias("_score")) for s in names))).alias("x")).select("x.*")
    ranks = cut(_mean_ranks(each.where("_score is not null").groupBy("_which", "_score").agg(F.count("*").alias("_n")), ["_which"], "_score", "_rank"))
    for score, name in names.items():
        rows = rows.join(ranks.where(F.col("_which") == score).select(F.col("_score").alias(score), F.col("_rank").alias(name)), score, "left")
    return rows


def _mean_ranks(counts: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """The mean rank of every distinct score of a group, over the group's size. counts: (by, score, _n)."""
    counts = summed(counts, by, [F.col(score)], "_n", "_below")
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    counts = counts.join(totals, by) if by else counts.crossJoin(F.broadcast(totals))  # one row
    return counts.withColumn(name, F.when(F.col("_total") >= 2, (F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total"))).drop("_n", "_below", "_total")


def tier(scores: list[Column], calibrated: list[Column], policy: Policy) -> Column:
    """A: two calibrated models or more, all high; B: one reaches the minimum; C: else."""
    enough = sum((c.cast("int") for c in calibrated), F.lit(0)) >= 2
    high = F.forall(F.array(*scores), lambda s: s >= policy.e_high)
    return F.when(F.lit(len(scores) >= 2) & enough & high, "A").when(F.array_max(F.array(*scores)) >= policy.e_min, "B").otherwise("C")


def risk_class(burden: Column, maximum: Column, high: Column, policy: Policy) -> Column:
    """0, 1 or 2. An unknown maximum rules out 0, but not 1; so does an unknown count of high risks."""
    low = maximum.isNotNull() & (burden <= policy.b_low) & (maximum <= policy.m_low) & (F.coalesce(high, F.lit(1)) == 0)
    middle = (burden <= policy.b_high) & (maximum.isNull() | (maximum <= policy.m_high)) & (high.isNull() | (high <= policy.h_max))
    return F.when(low, 0).when(middle, 1).otherwise(2)


def competition(rows: DataFrame, key: list[Column], name: str, by: list[str], ties: Sequence[Column] = ()) -> DataFrame:
    """Adds ranks 1, 1, 3, ... by ascending keys: rows of equal ones share one. ``by``: columns that part the rows into rankings; ``ties``: see ``ranked``."""
    return ranked(rows, name, by, key, ties)


def _risks(policy: Policy) -> list[Column]:
    """Burden, maximum, high count and reasons of a side's off_hits; known from the aggregate alone, the latter two are null."""
    hits, whole = F.coalesce("off_hits", F.filter("off_hits", lambda h: F.lit(False))), F.col("aggregate_specificity")
    flag = lambda c: F.coalesce(c, F.lit(False))
    upper = lambda h: F.when(h["upper"].isNotNull(), F.when(h["upper"].between(0, 1), h["upper"])).when(h["score"].between(0, 1), F.least(h["score"] + policy.delta_default, F.lit(1.0)))
    says = lambda what, h: F.concat(F.lit(what + ":"), F.col("side"), F.lit(":"), h["locus_id"])
    each = F.flatten(F.transform(hits, lambda h: F.array(F.when(flag(h["forbidden"]), says("forbidden_offtarget", h)), F.when(flag(h["is_bulge"]) & ~flag(h["bulge_calibrated"]), says("uncalibrated_bulge", h)), F.when(upper(h).isNull(), F.when(h["upper"].isNull(), says("invalid_offtarget_score", h)).otherwise(says("invalid_offtarget_upper", h))))))
    ups, none = F.array_compact(F.transform(hits, upper)), F.coalesce(F.size("off_hits"), F.lit(0)) <= 0
    bad = F.array_compact(F.array(F.when(none & (whole <= 0), F.concat(F.lit("invalid_aggregate_specificity:"), F.col("side")))))
    burden = F.when(none, F.when(whole > 0, F.greatest(1 / whole - 1, F.lit(0.0))).otherwise(0.0)).otherwise(F.aggregate(ups, F.lit(0.0), lambda a, b: a + b))
    maximum = F.when(none, F.when(whole.isNull(), 0.0)).otherwise(F.coalesce(F.array_max(ups), F.lit(0.0)))
    high = F.when(none, F.when(whole.isNull(), 0)).otherwise(F.size(F.filter(ups, lambda u: u >= policy.h_risk)))
    return [burden.alias("burden"), maximum.alias("maximum"), high.alias("high"), F.concat(bad, F.array_compact(each)).alias("risk_reasons")]


def _models(sides: DataFrame, policy: Policy) -> DataFrame:
    """Per pair and side: tier, how many models rank, their disagreement, and why others don't. Uncalibrated ones count by percentile."""
    rows = sides.select("pair_id", "side", F.posexplode("on_models").alias("n", "m"))
    flag = lambda name: F.coalesce(F.col(f"m.{name}"), F.lit(False))
    name = F.coalesce(F.nullif(F.lower(F.trim("m.name")), F.lit("")), F.concat(F.lit("model_"), F.col("n").cast("string")))
    why = F.when(~flag("applicable"), "inapplicable_model").when(flag("is_fallback"), "fallback_model").when(flag("reference_only"), "reference_only_model").when(~F.coalesce(F.col("m.score").between(0, 1), F.lit(False)), "invalid_model_score")
    rows = rows.select("pair_id", "side", "n", name.alias("name"), flag("calibrated").alias("calibrated"), why.alias("why"), F.when(why.isNull(), F.col("m.score")).alias("score"))
    rows = percentile(rows, "score", ["name"], "p")
    value = F.when(F.col("calibrated"), F.col("score")).otherwise(F.col("p"))
    rows = rows.withColumn("value", F.when(F.col("score").isNotNull(), value)).withColumn("p", F.when(F.col("value").isNotNull(), F.col("p")))
    reason = F.when(F.col("why").isNotNull(), F.struct("n", F.concat_ws(":", "why", "side", "name").alias("r")))
    rows = rows.groupBy("pair_id", "side").agg(F.count("value").alias("n_models"), F.count_if(F.col("calibrated") & F.col("value").isNotNull()).alias("_c"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("p").alias("_np"), (F.max("p") - F.min("p")).alias("_d"), F.transform(F.array_sort(F.collect_list(reason)), lambda x: x["r"]).alias("model_reasons"))
    kind = F.when((F.col("n_models") >= 2) & (F.col("_c") >= 2) & (F.col("_lo") >= policy.e_high), "A").when(F.col("_hi") >= policy.e_min, "B").otherwise("C")
    return rows.select("pair_id", "side", kind.alias("tier"), "n_models", F.when((F.col("n_models") >= 2) & (F.col("_np") >= 2), F.col("_d")).otherwise(1.0).alias("apart"), "model_reasons")


def evaluate(rows: DataFrame, policy: Policy) -> DataFrame:
    """Status (pass, conditional or rejected), reasons, tier, risk and rank of each pair.

    rows: pair_id (unique), search_complete, left and right (structs of one type: valid, search_complete, on_models, off_hits without the
    own target, aggregate_specificity), compatibility (hard_fail, soft_warnings). Hard reasons reject; others make a pair conditional.
    pair_rank orders the passing, conditional_rank the conditional ones; equal keys share a rank.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("s"))
    sides = rows.select("pair_id", F.explode(F.array(side("left"), side("right"))).alias("x")).select("pair_id", "x.side", "x.s.*")
    gate = F.array_compact(F.array(F.when(~flag("valid"), F.concat("side", F.lit("_invalid"))), F.when(~flag("search_complete"), F.concat("side", F.lit("_search_incomplete")))))
    both = sides.select("pair_id", "side", gate.alias("gate"), *_risks(policy)).join(_models(sides, policy), ["pair_id", "side"], "left")
    both = both.fillna("C", ["tier"]).fillna(0, ["n_models"]).fillna(1.0, ["apart"]).withColumn("model_reasons", F.coalesce("model_reasons", F.array().cast("array<string>")))
    names = [c for c in both.columns if c not in ("pair_id", "side")]
    per = both.groupBy("pair_id").agg(*(F.max(F.when(F.col("side") == s, F.struct(*names))).alias(s[0]) for s in ("left", "right")))
    own = rows.select("pair_id", F.when(~flag("search_complete"), "pair_search_incomplete").alias("_open"), F.when(flag("compatibility.hard_fail"), "compatibility_hard_fail").alias("_hard"), F.greatest(F.coalesce(F.size("compatibility.soft_warnings"), F.lit(0)), F.lit(0)).alias("penalty"))
    lists = [F.array("_open"), F.col("l.gate"), F.col("r.gate"), F.array("_hard"), *(F.col(f"{s}.{c}") for c in ("risk_reasons", "model_reasons") for s in "lr")]
    out = own.join(per, "pair_id").select("pair_id", "penalty", F.array_compact(F.concat(*lists)).alias("_hard_reasons"), F.greatest("l.tier", "r.tier").alias("tier"), F.col("l.n_models").alias("left_models"), F.col("r.n_models").alias("right_models"), (F.col("l.burden") + F.col("r.burden")).alias("burden"), F.when(F.col("l.maximum").isNotNull() & F.col("r.maximum").isNotNull(), F.greatest("l.maximum", "r.maximum")).alias("maximum"), (F.col("l.high") + F.col("r.high")).alias("high"), F.greatest("l.apart", "r.apart").alias("disagreement"))
    out = out.withColumn("risk_class", risk_class(F.col("burden"), F.col("maximum"), F.col("high"), policy))
    soft = F.array_compact(F.array(F.when(F.col("tier") == "C", "tier_c"), F.when(F.col("burden") > policy.b_high, "burden_above_b_high"), F.when(F.col("maximum") > policy.m_high, "max_offtarget_above_m_high"), F.when(F.col("high") > policy.h_max, "high_risk_above_h_max"), F.when(F.col("risk_class") == 2, "risk_2")))
    out = out.withColumn("status", F.when(F.size("_hard_reasons") > 0, "rejected").when((F.size(soft) > 0), "conditional").otherwise("pass")).withColumn("reasons", F.concat("_hard_reasons", soft)).drop("_hard_reasons")
    last = F.lit(float("inf"))
    key = [F.col("risk_class"), F.col("tier"), F.col("burden"), F.coalesce("maximum", last), F.coalesce(F.col("high").cast("double"), last), F.col("disagreement"), F.col("penalty")]
    # Rejected pairs get no rank.
    out = ranked(out, "_rank", ["status"], key, [F.col("pair_id")])
    return out.select("*", *(F.when(F.col("status") == status, F.col("_rank")).alias(name) for status, name in (("pass", "pair_rank"), ("conditional", "conditional_rank")))).drop("_rank")


def model_records(rows: DataFrame, side: str, calibration: str = "calibration_status") -> Column:
    """Array of the on-target models of a side (name, score, applicable, calibrated, is_fallback, reference_only) of wide rows.

    Each column <side>_on_target_score_<name>, or without any such on_target_score_<name>, is a model; its label, in
    <side>_on_target_model_<name>, tells whether it stands in for another or is for reference only. Without any, the columns without
    a name at the end are one. Scores that are null give no record.
    """
    has = set(rows.columns)
    marks = [f"{side}_on_target_score_", "on_target_score_"]
    names = sorted({c[len(m) :] for m in marks for c in has if c.startswith(m)})
    first = lambda *columns: F.coalesce(*(F.col(c) for c in columns if c in has)) if has & set(columns) else F.lit(None).cast("string")
    status = F.lower(F.trim(first(f"{side}_{calibration}", calibration)))
    own_reference = F.coalesce(first(f"{side}_reference_only").cast("boolean"), F.lit(False))

    def record(name: str | None) -> Column:
        tail = f"_{name}" if name else ""
        score = first(f"{side}_on_target_score{tail}", f"on_target_score{tail}").cast("double")
        label = F.coalesce(first(f"{side}_on_target_model{tail}", f"on_target_model{tail}"), F.lit(name or "primary"))
        other, reference = formats.is_fallback(label), own_reference | formats.is_reference_only(label)
        calibrated = F.coalesce(status == "calibrated_reference", F.lit(False)) & ~other & ~reference
        return F.when(score.isNotNull(), F.struct((F.lit(name) if name else label).alias("name"), score.alias("score"), F.lit(True).alias("applicable"), calibrated.alias("calibrated"), other.alias("is_fallback"), reference.alias("reference_only")))

    return F.array_compact(F.array(*map(record, names or [None])))


def attached(rows: DataFrame, evaluation: DataFrame, key: str = "pair_id") -> DataFrame:
    """Rows with the evaluation of their pair; those without one are rejected, for no result. Columns of one name are the evaluation's."""
    clash = [c for c in evaluation.columns if c != key and c in rows.columns]
    out = rows.drop(*clash).join(evaluation, key, "left")
    return out.withColumn("status", F.coalesce("status", F.lit("rejected")))


def gap_reasons(gap: Column, least: float | None, most: float | None, sides: dict[str, tuple[Column, str]] | None = None) -> Column:
    """Array of the hard reasons of a pair's gap and of the sides that its flanks lie on: {left or right: (actual, expected)}."""
    value = gap.cast("double")
    out = [F.when(value.isNull(), "gap_missing")] if least is not None or most is not None else []
    if least is not None:
        out.append(F.when(value < least, F.concat(F.lit("gap_below_min:"), value.cast("string"))))
    if most is not None:
        out.append(F.when(value > most, F.concat(F.lit("gap_above_max:"), value.cast("string"))))
    for name, (actual, expected) in (sides or {}).items():
        held = F.coalesce(F.nullif(F.trim(actual), F.lit("")), F.lit("missing"))
        out.append(F.when(held != expected, F.concat(F.lit(f"direction_mismatch:{name}:{expected}:"), held)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")
