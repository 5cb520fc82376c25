"""Queries of scores by rule tables and by many models, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guidespan.functions import scores as V
from guidespan.jobs import queries as Q
from guidespan.jobs import scoring
from guidespan.operators import models

#: Two nucleases of a user's own, and one that another's model stands in for.
CUSTOM = [
    models.Rule("own_short", "activity", "seed", "nuc_features", "own_short_rules", 13, 20, 0.5),
    models.Rule("own_free", "bias", "weights", "cas13_rna_rules", "weights", reference_only=True),
    models.Rule("casx", "logistic", "weights", "logistic", "weights", reference_only=True, note="Cas9 model applied to an unsupported nuclease; result is not validated."),
]
NUCLEASES = ["cas9", "cas12a", "Cas12b", "cas14a", "cas13", "tnpb", "casx", "own_short", "own_free", "other"]
MODELS = ["on_activity", "on_bias", "on_compact", "on_logistic", "off_weights", "off_identity", "off_flank", *(f"off_{n}" for n in V.SEEDS)]


def _guides(spark, sf_dir):
    """The stated guides, dealt to the nucleases in turn."""
    turn = F.floor(F.substring("qid", 2, 20).cast("long") / 50) % len(NUCLEASES) + 1
    return Q.guides(Q.contigs(spark, sf_dir)).withColumn("nuclease", F.element_at(F.array(*map(F.lit, NUCLEASES)), turn.cast("int")))


def mixed_scores(spark, sf_dir):
    """Guides of ten nucleases, each scored by its own rule in one plan."""
    return models.scored(_guides(spark, sf_dir), Q.search_hits(spark, sf_dir), models.rule_table(spark, models.RULES + CUSTOM), scoring.WEIGHTS)


def model_scores(spark, sf_dir):
    """Every model of every guide, one row each; -1 where it can't score."""
    return models.fanned(_guides(spark, sf_dir), Q.search_hits(spark, sf_dir), scoring.WEIGHTS).fillna(-1.0, ["score"])


def model_columns(spark, sf_dir):
    """The same, one row a guide; -1 where a model can't score."""
    return models.widened(models.fanned(_guides(spark, sf_dir), Q.search_hits(spark, sf_dir), scoring.WEIGHTS), MODELS).fillna(-1.0)


QUERIES = {f.__name__: f for f in (mixed_scores, model_scores, model_columns)}

# SQL

_FLANK = "CASE WHEN right(pam, 1) = 'G' THEN 0.25 ELSE 1.0 END"
_SEEDED = "round((20 - mismatch) / 20 * pow({p}, {mm}), 9)"
_seeded = lambda a, b, p: _SEEDED.format(p=p, mm=scoring._MM.format(a=a, b=b))
_OFF = {"weights": f"round({scoring._WEIGHTED}, 9)", "identity": "round((20 - mismatch) / 20, 9)", "flank": f"round((20 - mismatch) / 20 * {_FLANK}, 9)", **{n: _seeded(*s) for n, s in V.SEEDS.items()}, "own_short": _seeded(13, 20, 0.5)}
_BIAS = scoring._bias("guide", "T", "'TT', 'AT'")
_COMPACT = scoring._COMPACT.replace("hairpin", f"({scoring._hairpin('guide')})").replace("0.30 * 1.0", "0.30 * 0.75")
_N = "n AS (SELECT *, [" + ", ".join(f"'{n}'" for n in NUCLEASES) + f"][CAST(CAST(substr(qid, 2) AS BIGINT) // 50 % {len(NUCLEASES)} + 1 AS BIGINT)] AS nuclease FROM g)"
_SPEC = ", ".join(f"{scoring._spec(n, 'mismatch = 0' if n == 'flank' else None)} AS {n}" for n in _OFF)
_ALL = f"{_N}, x AS (SELECT qid, mismatch, {', '.join(f'{c} AS {n}' for n, c in _OFF.items())} FROM h), s AS (SELECT qid, count(*) AS n_hits, {_SPEC} FROM x GROUP BY qid), " + (
    f"o AS (SELECT n.qid, nuclease, coalesce(n_hits, 0) AS n_hits, round({Q._activity('guide')}, 9) AS activity, round({_BIAS}, 9) AS bias, round(({_COMPACT}) / 0.75, 9) AS compact, {', '.join(f'coalesce({n}, 1.0) AS {n}' for n in _OFF)} FROM n LEFT JOIN s ON s.qid = n.qid)"
)
_ROWS = {
    "cas9": ("activity", "logistic_fallback", "weights", "weights", "fallback", ""),
    **{n: ("activity", "preset_heuristic", n, f"preset_{n}", "ok", "") for n in V.SEEDS},
    "cas13": ("bias", "cas13_rna_rules", "flank", "cas13_pfs", "ok", models.RNA_NOTE),
    "tnpb": ("compact", "omega_rna", "identity", "identity_heuristic", "ok", models.TNPB_NOTE),
    "casx": ("activity", "logistic_reference_only", "weights", "weights_reference_only", "reference_only", CUSTOM[2].note),
    "own_short": ("activity", "nuc_features", "own_short", "own_short_rules", "ok", ""),
    "own_free": ("bias", "cas13_rna_rules_reference_only", "weights", "weights_reference_only", "reference_only", models.REFERENCE_NOTE),
    "other": ("activity", "nuc_features", "identity", "identity_heuristic", "ok", ""),
}
_MIXED = " UNION ALL ".join(f"SELECT qid, nuclease, {on} AS on_score, '{on_name}' AS on_model, {off} AS off_specificity, '{off_name}' AS off_model, n_hits, '{status}' AS status, '{note}' AS note FROM o WHERE lower(nuclease) = '{n}'" for n, (on, on_name, off, off_name, status, note) in _ROWS.items())
_score = lambda m: "-1.0" if m == "on_logistic" else m.split("_", 1)[1]
_LONG = " UNION ALL ".join(f"SELECT qid, '{m.split('_')[0]}' AS role, '{m.split('_', 1)[1]}' AS model, CAST({_score(m)} AS DOUBLE) AS score, '{'unavailable' if m == 'on_logistic' else 'scored'}' AS status FROM o" for m in MODELS)
_RAN = ",".join(sorted(m for m in MODELS if m != "on_logistic"))


def _with(select: str) -> str:
    return Q._sql("h g", "").rstrip() + ", " + _ALL + " " + select


SQL = {
    "mixed_scores": _with(_MIXED),
    "model_scores": _with(_LONG),
    "model_columns": _with(f"SELECT qid, {', '.join(f'CAST({_score(m)} AS DOUBLE) AS {m}' for m in MODELS)}, '{_RAN}' AS models FROM o"),
}
