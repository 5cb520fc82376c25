"""Scores of guides of several nucleases in one plan: rules as a relation joined to guides, and all models of a guide at once."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidespan.functions import scores as V
from guidespan.functions import seq as S


@dataclass(frozen=True)
class Rule:
    """How guides of a nuclease are scored.

    on: activity, logistic (of the 30 bases around, where they are known), bias or compact; off: weights, seed, flank or identity. The
    models are named on_model and off_model. Scores of a model that was made for another nuclease are for reference only.
    """

    nuclease: str
    on: str
    off: str
    on_model: str
    off_model: str
    seed_start: int | None = None
    seed_end: int | None = None
    penalty: float | None = None
    reference_only: bool = False
    note: str = ""

    def __post_init__(self):
        if self.on not in ON or self.off not in OFF or (self.off == "seed" and None in (self.seed_start, self.seed_end, self.penalty)):
            raise ValueError(f"bad rule: {self}")


ON, OFF = ("activity", "logistic", "bias", "compact"), ("weights", "seed", "flank", "identity")
#: Names of models and what is said of them.
REFERENCE_NOTE = "Model is not validated for custom nucleases; for reference only; not for experimental decisions"
RNA_NOTE = "Cas13 RNA scoring rules apply only to the cas13 subtype; results for other Cas13 variants are for reference only"
TNPB_NOTE = "TnpB omegaRNA/TEEP rules apply only to the ISDra2 TnpB (isdra2) subtype; results for other TnpB variants are for reference only"
RULES = [
    Rule("cas9", "logistic", "weights", "logistic", "weights"),
    *(Rule(name, "activity", "seed", "preset_heuristic", f"preset_{name}", *seed) for name, seed in V.SEEDS.items()),
    Rule("cas13", "bias", "flank", "cas13_rna_rules", "cas13_pfs", note=RNA_NOTE),
    Rule("tnpb", "compact", "identity", "omega_rna", "identity_heuristic", note=TNPB_NOTE),
]
#: What holds for nucleases without a rule.
GENERIC = Rule("", "activity", "identity", "nuc_features", "identity_heuristic")
_TYPES = {"seed_start": "int", "seed_end": "int", "penalty": "double", "reference_only": "boolean"}


def rule_table(spark, rules: Iterable[Rule]) -> DataFrame:
    """The rules as a table, one row a nuclease; an error if two rules are of one."""
    rows = [astuple(r) for r in rules]
    if len({r[0].lower() for r in rows}) < len(rows):
        raise ValueError("two rules of one nuclease")
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {_TYPES.get(f.name, 'string')}" for f in fields(Rule)))


def scored(guides: DataFrame, hits: DataFrame, rules: DataFrame, weights: list[float]) -> DataFrame:
    """One row a guide: model, score and status on and off target by the rule of its own nuclease.

    guides: (qid, guide, nuclease) and, if known, context (30 bases); hits without bulges: (qid, guide, target, pam). Nucleases without
    a rule, null ones too, are scored by the generic one. A logistic rule falls back to the activity where the context is not known and
    says so. Guides without hits are wholly specific. Statuses: ok, fallback, reference_only.
    """
    spark = guides.sparkSession
    names = [f.name for f in fields(Rule) if f.name != "nuclease"]
    table = rules.select(F.lower("nuclease").alias("_nuclease"), *names)
    generic = rule_table(spark, [GENERIC]).first()
    has_rule = F.col("_nuclease").isNotNull()
    context = F.col("context") if "context" in guides.columns else F.lit(None).cast("string")
    own = guides.select("qid", F.col("guide").alias("_guide"), "nuclease", context.alias("_context"))
    own = own.join(table, F.lower(F.trim("nuclease")) == F.col("_nuclease"), "left").select("qid", "_guide", "nuclease", "_context", *(F.when(has_rule, F.col(c)).otherwise(F.lit(generic[c])).alias(c) for c in names))
    g, t, off = F.col("_guide"), F.col("target"), F.col("off")
    same = V.identity(g, t)
    alike = F.when(off == "weights", V.weighted_similarity(g, t, weights, F.col("pam"))).when(off == "seed", V.seeded_similarity(g, t, F.col("seed_start"), F.col("seed_end"), F.col("penalty"))).when(off == "flank", same * S.flank_weight(F.right("pam", F.lit(1)))).otherwise(same)
    met = hits.select("qid", "target", "pam").join(own, "qid").withColumns({"_alike": F.round(alike, 9), "_perfect": F.when(off == "flank", same).otherwise(alike) >= 0.999999})
    per = met.groupBy("qid").agg(F.count("*").alias("n_hits"), F.round(V.specificity(F.col("_alike"), F.col("_perfect")), 6).alias("_specificity"))
    model = F.when(F.col("on") == "logistic", V.logistic(F.col("_context")))
    fell = (F.col("on") == "logistic") & model.isNull()
    on = F.when(F.col("on") == "bias", V.bias(g)).when(F.col("on") == "compact", V.compact_activity(g)).otherwise(F.coalesce(model, S.activity(g)))
    return own.join(per, "qid", "left").select(
        "qid", "nuclease", F.round(on, 9).alias("on_score"), F.concat("on_model", F.when(F.col("reference_only"), "_reference_only").when(fell, "_fallback").otherwise("")).alias("on_model"), F.coalesce("_specificity", F.lit(1.0)).alias("off_specificity"),
        F.concat("off_model", F.when(F.col("reference_only"), "_reference_only").otherwise("")).alias("off_model"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.when(F.col("reference_only"), "reference_only").when(fell, "fallback").otherwise("ok").alias("status"), F.when(F.col("reference_only") & (F.col("note") == ""), REFERENCE_NOTE).otherwise(F.col("note")).alias("note"),
    )


def fanned(guides: DataFrame, hits: DataFrame, weights: list[float]) -> DataFrame:
    """(qid, role, model, score, status): every model of every guide, hits read once for all off-target models.

    status is scored, or unavailable with a null score where a model can't score the guide (the logistic one without its context).
    """
    g, t = F.col("guide"), F.col("target")
    same = V.identity(g, t)
    alike = {"weights": V.weighted_similarity(g, t, weights, F.col("pam")), "identity": same, "flank": same * S.flank_weight(F.right("pam", F.lit(1))), **{n: V.seeded_similarity(g, t, *s) for n, s in V.SEEDS.items()}}
    rows = hits.select("qid", same.alias("_same"), *(F.round(c, 9).alias(n) for n, c in alike.items()))
    per = rows.groupBy("qid").agg(*(F.round(V.specificity(F.col(n), (F.col("_same") if n == "flank" else F.col(n)) >= 0.999999), 6).alias(n) for n in alike))
    context = F.col("context") if "context" in guides.columns else F.lit(None).cast("string")
    on = {"activity": S.activity(g), "bias": V.bias(g), "compact": V.compact_activity(g), "logistic": V.logistic(context)}
    record = lambda role, name, score: F.struct(F.lit(role).alias("role"), F.lit(name).alias("model"), score.alias("score"))
    records = [*(record("on", n, F.round(c, 9)) for n, c in on.items()), *(record("off", n, F.coalesce(n, F.lit(1.0))) for n in alike)]
    out = guides.join(per, "qid", "left").select("qid", F.explode(F.array(*records)).alias("r")).select("qid", "r.*")
    return out.withColumn("status", F.when(F.col("score").isNull(), "unavailable").otherwise("scored"))


def widened(rows: DataFrame, models: list[str]) -> DataFrame:
    """One row a guide: a column of each of the models, ``role_model``, and in ``models`` the names of those that scored it."""
    key = F.concat_ws("_", "role", "model")
    columns = [F.max(F.when(key == m, F.col("score"))).alias(m) for m in models]
    ran = F.array_sort(F.collect_set(F.when(F.col("score").isNotNull() & key.isin(models), key)))  # as many as models at most
    return rows.groupBy("qid").agg(*columns, F.array_join(ran, ",").alias("models"))


def lengthened(rows: DataFrame, models: list[str]) -> DataFrame:
    """The long rows (qid, key, score) of a wide table again, without the models that did not score."""
    return rows.unpivot(["qid"], models, "key", "score").where(F.col("score").isNotNull())
