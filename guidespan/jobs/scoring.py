"""Queries of scores, guide libraries and batches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guidespan.functions import scores as V
from guidespan.functions import seq as S
from guidespan.jobs import queries as Q
from guidespan.operators import batches, library, pairs
from guidespan.operators.lineage import cut
from guidespan.sources import contigs as C

WEIGHTS = V.rule_weights(20)
LONG_MOTIF = "GAT"


def weighted_hits(spark, sf_dir):
    """Hits with their weighted similarity, PAM counted, and their similarity by preset."""
    g, t = F.col("guide"), F.col("target")
    own = {name: F.round(V.seeded_similarity(g, t, *seed), 9).alias(name) for name, seed in V.SEEDS.items()}
    return Q.search_hits(spark, sf_dir).select("qid", "seq_id", "start", "strand", F.round(V.weighted_similarity(g, t, WEIGHTS, F.col("pam")), 9).alias("weighted"), *own.values())


def specificities(spark, sf_dir):
    """Specificity of each guide that has hits, by weights and by preset."""
    rows = weighted_hits(spark, sf_dir)
    return rows.groupBy("qid").agg(F.count("*").alias("n_hits"), *(F.round(V.specificity(F.col(c)), 6).alias(c) for c in ("weighted", *V.SEEDS)))


def flanked_specificity(spark, sf_dir):
    """Specificity of guides that cut RNA: identity, weighted by the base beside the hit."""
    rows = Q.search_hits(spark, sf_dir)
    alike = V.identity(F.col("guide"), F.col("target"))
    flank = F.right("pam", F.lit(1))
    return rows.groupBy("qid").agg(F.round(V.specificity(alike * S.flank_weight(flank), alike >= 0.999999), 6).alias("specificity"))


def guide_activities(spark, sf_dir):
    """Rule-based activities of all distinct sites, by the kind of nuclease."""
    s = F.col("guide")
    rows = library.distinct_guides(library.find_guides(Q.contigs(spark, sf_dir), 16, "TTG", "5prime")).select(F.col("guide_seq").alias("guide"))
    rows = rows.withColumns({"activity": S.activity(s), "hairpin": V.hairpin(s)})  # each read by several models
    own, longest = F.col("activity"), F.col("hairpin")
    models = {"u_rich": V.bias(s, activity=own), "a_rich": V.bias(s, "A", ("AA", "TA"), own), "flanked": V.flanked_activity(s, F.left(s, F.lit(1)), own), "compact": V.compact_activity(s, longest=longest), "compact_repeat": V.compact_activity(s, "GATTACAGTAATC", longest)}
    of = lambda name: F.round(models[name], 9).alias(name)
    return rows.select("guide", of("u_rich"), of("a_rich"), of("flanked"), "hairpin", of("compact"), of("compact_repeat"))


def best_windows(spark, sf_dir):
    """The best window of each contig by the logistic model: 25 bases, GG and three more."""
    rows = C.windows(Q.contigs(spark, sf_dir), 30, "[ACGT]{25}GG[ACGT]{3}").withColumn("score", F.round(V.logistic(F.col("window")), 9))
    return rows.groupBy("seq_id").agg(F.count("*").alias("n_windows"), F.max("score").alias("score"), F.min_by("pos", F.struct((-F.col("score")).alias("a"), "pos")).alias("pos"))


def library_candidates(spark, sf_dir):
    return library.filtered(library.find_guides(Q.contigs(spark, sf_dir), 20, "NGG", "3prime", LONG_MOTIF), 1, 20, 80, (13, 20), 25)


def all_stretches(spark, sf_dir):
    """Candidates without a PAM, counted by contig and strand."""
    rows = library.find_guides(Q.contigs(spark, sf_dir), 20, motif=LONG_MOTIF)
    return rows.groupBy("seq_id", "strand").agg(F.count("*").alias("n"), F.count_if(F.col("motif_overlap") > 0).alias("n_overlap"), F.max("spacer_end").alias("last_end"))


def library_guides(spark, sf_dir):
    return library.distinct_guides(library_candidates(spark, sf_dir))


def library_summary(spark, sf_dir):
    return library.summary(library_candidates(spark, sf_dir))


def _prior(units):
    """The manifest of an earlier run of all units: it failed where a unit has more than twenty sites."""
    return units.select("unit_id", "seq_id", "pattern", F.when(F.col("n_sites") > 20, "failed").otherwise(F.col("status")).alias("status"))


def _remaining(units):
    return batches.remaining(units.select("unit_id", "seq_id", "pattern"), _prior(units))


def batch_remaining(spark, sf_dir):
    return _remaining(cut(Q.batch_units(spark, sf_dir)))


def batch_manifest(spark, sf_dir):
    """The manifest after the units that the earlier run left have been run."""
    units = cut(Q.batch_units(spark, sf_dir))  # read four times
    new = units.join(_remaining(units).select("unit_id"), "unit_id", "left_semi").select("unit_id", "seq_id", "pattern", "status", "n_sites")
    return batches.merged(new, _prior(units)).fillna(-1, ["n_sites"])


def batch_union(spark, sf_dir):
    """Sites of two patterns in one table, whose columns differ."""
    one = Q.single_motif_sites(spark, sf_dir).select("seq_id", "strand", "motif_pos", "sequence")
    two = Q.centre_sites(spark, sf_dir).select("seq_id", "strand", "y_start")
    tables = [batches.keyed(t, F.concat_ws("__", F.col("seq_id").cast("string"), F.lit(name)), F.col("seq_id"), F.lit(name)) for name, t in (("motif", one), ("centre", two))]
    return batches.united(tables, "all").fillna(-1, ["motif_pos", "y_start"]).fillna("", ["sequence"])


def model_provenance(spark, sf_dir):
    """How many sites each on-target model scored: the logistic one where a window of 30 bases is there, else the activity rule."""
    rows = Q.single_motif_sites(spark, sf_dir).join(Q.contigs(spark, sf_dir).select("seq_id", F.length("seq").alias("_n")), "seq_id")
    whole = (F.col("window_start") >= 4) & (F.col("window_start") + 26 <= F.col("_n"))
    rows = rows.select(F.when(whole, "logistic").otherwise("rule").alias("model"), F.when(whole, "").when(F.col("window_start") < 4, "window cut at the start").otherwise("window cut at the end").alias("note"))
    return batches.provenance(rows, "model", "note")


def pair_evaluation(spark, sf_dir):
    """Gap pairs with two models and one hit a side, evaluated and ranked; ranks of pairs that have none are -1."""
    return _evaluated(Q.gap_pairs(spark, sf_dir))


def _evaluated(rows):
    def side(name):
        flank = F.col(f"{name}_flank_seq")
        score = F.round(S.activity(flank), 9)
        model = lambda n, s, own: F.struct(F.lit(n).alias("name"), s.alias("score"), F.lit(True).alias("applicable"), F.lit(own).alias("calibrated"), F.lit(False).alias("is_fallback"), F.lit(False).alias("reference_only"))
        hit = F.struct(F.lit("h").alias("locus_id"), F.round((1 - score) / 4, 6).alias("score"), F.lit(None).cast("double").alias("upper"), F.lit(False).alias("forbidden"), F.lit(False).alias("is_bulge"), F.lit(False).alias("bulge_calibrated"))
        return F.struct((flank != "").alias("valid"), F.lit(True).alias("search_complete"), F.array(model("rule", score, True), model("balance", F.round(S.gc_fraction(flank), 6), False)).alias("on_models"), F.array(hit).alias("off_hits"), F.lit(None).cast("double").alias("aggregate_specificity")).alias(name)

    ids = F.concat_ws(":", *(F.col(c).cast("string") for c in ("seq_id", "left_pos", "right_pos")))
    compatibility = F.struct((F.col("gap") == 4).alias("hard_fail"), F.when(F.col("gap") > 10, F.array(F.lit("wide"))).otherwise(F.array().cast("array<string>")).alias("soft_warnings"))
    rows = pairs.evaluate(rows.select(ids.alias("pair_id"), F.lit(True).alias("search_complete"), side("left"), side("right"), compatibility.alias("compatibility")), pairs.Policy())
    return rows.select("pair_id", "status", "tier", "risk_class", F.round("burden", 6).alias("burden"), F.round("disagreement", 6).alias("disagreement"), "penalty", F.concat_ws(";", "reasons").alias("reasons"), F.coalesce(F.col("pair_rank").cast("long"), F.lit(-1)).alias("pair_rank"), F.coalesce(F.col("conditional_rank").cast("long"), F.lit(-1)).alias("conditional_rank"))


QUERIES = {f.__name__: f for f in (weighted_hits, specificities, flanked_specificity, guide_activities, best_windows, library_candidates, all_stretches, library_guides, library_summary, batch_remaining, batch_manifest, batch_union, model_provenance, pair_evaluation)}

# SQL

_MM = "list_sum(list_transform(range({a}, {b} + 1), lambda i: CAST(substr(guide, i, 1) <> substr(target, i, 1) AS INTEGER)))"
_PAM = "CASE right(pam, 2) " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in V.PAM_WEIGHTS.items()) + " ELSE 0 END"
_WEIGHTED = f"list_product(list_transform(range(1, 21), lambda i: CASE WHEN substr(guide, i, 1) = substr(target, i, 1) THEN 1.0 ELSE {WEIGHTS}[(i - 1) * 16 + (instr('ACGT', substr(guide, i, 1)) - 1) * 4 + instr('ACGT', substr(target, i, 1))] END)) * {_PAM}"
_W = "SELECT qid, seq_id, start, strand, pam, mismatch, round(" + _WEIGHTED + ", 9) AS weighted, " + ", ".join(f"round((20 - mismatch) / 20 * pow({p}, {_MM.format(a=a, b=b)}), 9) AS {name}" for name, (a, b, p) in V.SEEDS.items()) + " FROM h"


def _spec(x: str, perfect: str | None = None) -> str:
    return f"round(1 / (1 + CASE WHEN bool_or({perfect or x + ' >= 0.999999'}) THEN greatest(sum({x}) - 1, 0.0) ELSE sum({x}) END), 6)"


def _found(n: int, pam: str, side: str, motif: str = "") -> str:
    out, p = [], len(pam)
    for strand, own in (("+", pam), ("-", S.flipped(pam))):
        last = (side == "3prime") == (strand == "+")
        near = S.pattern(own) if pam else ""
        where = Q._match(n + p, f"[ACGT]{{{n}}}{near}" if last else f"{near}[ACGT]{{{n}}}")
        beside = f"substr(w, {n + 1 if last else 1}, {p})" if pam else "''"
        beside = beside if strand == "+" else Q._RC.format(beside)
        at = f"pos + {n if last else 0}" if pam else "CAST(-1 AS BIGINT)"
        out.append(f"SELECT seq_id, '{strand}' AS strand, substr(w, {1 if last else p + 1}, {n}) AS guide_seq, {beside} AS pam_seq, pos + {0 if last else p} AS spacer_start, pos + {n + (0 if last else p)} AS spacer_end, {at} AS pam_start, {at} + {p} AS pam_end FROM ({Q._windows(n + p, where)})")
    overlap = f"CASE WHEN contains(guide_seq, '{motif}') OR contains(guide_seq, '{S.flipped(motif)}') THEN {len(motif)} ELSE 0 END" if motif else "0"
    return f"SELECT *, CAST({overlap} AS INTEGER) AS motif_overlap, round({Q._gc('guide_seq')}, 4) AS gc FROM ({' UNION ALL '.join(out)})"


_LIB = f"SELECT * FROM ({_found(20, 'NGG', '3prime', LONG_MOTIF)}) WHERE motif_overlap >= 1 AND gc >= 0.2 AND gc <= 0.8 AND {Q._gc('substr(guide_seq, 13, 8)')} >= 0.25"


def _bias(x: str, base: str, pairs: str) -> str:
    return f"least(0.35 * least(greatest(((length({x}) - length(replace({x}, '{base}', ''))) / length({x}) - 0.20) / 0.20, 0.0), 1.0) + 0.15 * least(len(list_filter(range(1, length({x})), lambda i: substr({x}, i, 2) IN ({pairs}))) / (length({x}) - 1) * 2, 1.0) + 0.50 * {Q._activity(x)}, 1.0)"


def _hairpin(x: str) -> str:
    return f"CAST(coalesce(list_max(list_filter(range(1, length({x}) + 1), lambda k: len(list_filter(range(1, CAST(length({x}) - k + 2 AS BIGINT)), lambda i: contains({Q._RC.format(x)}, substr({x}, i, k)))) > 0)), 0) AS INTEGER)"


_COMPACT = f"0.30 * 1.0 + 0.25 * (1 - least(greatest((hairpin - 3) / 6, 0.0), 1.0)) + 0.20 * greatest(0.0, 1 - abs({Q._gc('guide')} - 0.5) / 0.3)"
_Z = " + ".join(f"CASE WHEN substr(w, {p + 1}, {len(b)}) = '{b}' THEN {w} ELSE 0.0 END" for (p, b), w in V.LOGISTIC.items())
_PRIOR = "SELECT unit_id, seq_id, pattern, CASE WHEN n_sites > 20 THEN 'failed' ELSE status END AS status FROM units"
SQL = {
    "weighted_hits": Q._sql("h", f"SELECT * EXCLUDE (pam, mismatch) FROM ({_W})"),
    "specificities": Q._sql("h", f"SELECT qid, count(*) AS n_hits, {', '.join(f'{_spec(c)} AS {c}' for c in ('weighted', *V.SEEDS))} FROM ({_W}) GROUP BY qid"),
    "flanked_specificity": Q._sql("h", f"SELECT qid, {_spec('x', 'mismatch = 0')} AS specificity FROM (SELECT qid, mismatch, (20 - mismatch) / 20 * CASE WHEN right(pam, 1) = 'G' THEN 0.25 ELSE 1.0 END AS x FROM h) GROUP BY qid"),
    "guide_activities": Q._sql("", f"""SELECT guide, u_rich, a_rich, round(0.35 * CASE WHEN guide LIKE 'G%' THEN 0.25 ELSE 1.0 END + 0.65 * raw, 9) AS flanked, hairpin, round(({_COMPACT}) / 0.75, 9) AS compact, round({_COMPACT} + 0.25 * least({_hairpin("'GATTACAGTAATC'")} / 6, 1.0), 9) AS compact_repeat
      FROM (SELECT guide, raw, round(raw, 9) AS u_rich, round({_bias('guide', 'A', "'AA', 'TA'")}, 9) AS a_rich, {_hairpin('guide')} AS hairpin FROM (SELECT guide, {_bias('guide', 'T', "'TT', 'AT'")} AS raw FROM (SELECT DISTINCT guide_seq AS guide FROM ({_found(16, 'TTG', '5prime')}))))"""),
    "best_windows": Q._sql("", f"SELECT seq_id, count(*) AS n_windows, max(score) AS score, arg_min(pos, (-score, pos)) AS pos FROM (SELECT seq_id, pos, round(1 / (1 + exp(-({V.INTERCEPT} + CASE WHEN {Q._gc('w')} < 0.5 THEN {V.LOW_GC} ELSE {V.HIGH_GC} END + {_Z}))), 9) AS score FROM ({Q._windows(30, Q._match(30, '[ACGT]{25}GG[ACGT]{3}'))})) GROUP BY seq_id"),
    "library_candidates": Q._sql("", _LIB),
    "all_stretches": Q._sql("", f"SELECT seq_id, strand, count(*) AS n, count(*) FILTER (motif_overlap > 0) AS n_overlap, max(spacer_end) AS last_end FROM ({_found(20, '', '3prime', LONG_MOTIF)}) GROUP BY ALL"),
    "library_guides": Q._sql("", f"SELECT guide_seq, gc, f[1] AS seq_id, f[3] AS strand, f[2] AS spacer_start, occurrence_count, n_regions FROM (SELECT guide_seq, min(gc) AS gc, min((seq_id, spacer_start, strand)) AS f, count(*) AS occurrence_count, count(DISTINCT seq_id) AS n_regions FROM ({_LIB}) GROUP BY guide_seq)"),
    "library_summary": Q._sql("", f"SELECT count(*) AS candidate_count, count(DISTINCT guide_seq) AS unique_guide_count, round(avg(gc), 4) AS gc_mean, round(min(gc), 4) AS gc_min, round(max(gc), 4) AS gc_max FROM ({_LIB})"),
    "batch_remaining": Q._sql("units", f"SELECT unit_id, seq_id, pattern FROM units WHERE n_sites > 20"),
    "batch_manifest": Q._sql("units", f"SELECT unit_id, seq_id, pattern, status, n_sites FROM units WHERE n_sites > 20 UNION ALL SELECT unit_id, seq_id, pattern, status, -1 FROM ({_PRIOR}) WHERE status <> 'failed'"),
    "batch_union": Q._sql("sites y", "SELECT 'all' AS batch_label, seq_id || '__motif' AS unit_id, seq_id AS scope_id, 'motif' AS pattern_id, seq_id, strand, motif_pos, sequence, -1::BIGINT AS y_start FROM sites UNION ALL SELECT 'all', seq_id || '__centre', seq_id, 'centre', seq_id, strand, -1, '', y_start FROM y"),
    "model_provenance": Q._sql("sites", """SELECT model, count(*) AS n_rows, count(*) FILTER (note <> '') AS n_fallback, coalesce(string_agg(DISTINCT nullif(note, ''), '; ' ORDER BY nullif(note, '')), '') AS notes FROM (
      SELECT CASE WHEN window_start >= 4 AND window_start + 26 <= length(seq) THEN 'logistic' ELSE 'rule' END AS model, CASE WHEN window_start >= 4 AND window_start + 26 <= length(seq) THEN '' WHEN window_start < 4 THEN 'window cut at the start' ELSE 'window cut at the end' END AS note FROM sites JOIN c USING (seq_id)) GROUP BY model"""),
}

_PAIRS = ", ".join((
    "pe AS (SELECT seq_id || ':' || left_pos || ':' || right_pos AS pair_id, gap, coalesce(left_flank_seq, '') AS lf, coalesce(right_flank_seq, '') AS rf FROM p)",
    f"ps AS (SELECT pair_id, gap, lf, rf, round({Q._activity('lf')}, 9) AS ls, round({Q._activity('rf')}, 9) AS rs, round({Q._gc('lf')}, 6) AS lb, round({Q._gc('rf')}, 6) AS rb FROM pe)",
    "pv AS (SELECT 'rule' AS m, ls AS v FROM ps UNION ALL SELECT 'rule', rs FROM ps UNION ALL SELECT 'balance', lb FROM ps UNION ALL SELECT 'balance', rb FROM ps)",
    "pc AS (SELECT m, v, (coalesce(sum(n) OVER (PARTITION BY m ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2) / sum(n) OVER (PARTITION BY m) AS x FROM (SELECT m, v, count(*) AS n FROM pv GROUP BY ALL))",
    "px AS (SELECT ps.*, a.x AS lsp, b.x AS rsp, c.x AS lbp, d.x AS rbp, least(round((1 - ls) / 4, 6) + 0.05::DOUBLE, 1.0) AS lu, least(round((1 - rs) / 4, 6) + 0.05::DOUBLE, 1.0) AS ru FROM ps JOIN pc a ON a.m = 'rule' AND a.v = ls JOIN pc b ON b.m = 'rule' AND b.v = rs JOIN pc c ON c.m = 'balance' AND c.v = lb JOIN pc d ON d.m = 'balance' AND d.v = rb)",
    "py AS (SELECT *, CASE WHEN least(greatest(ls, lbp), greatest(rs, rbp)) >= 0.5 THEN 'B' ELSE 'C' END AS tier, lu + ru AS burden, greatest(lu, ru) AS maximum, greatest(abs(lsp - lbp), abs(rsp - rbp)) AS disagreement, CASE WHEN gap > 10 THEN 1 ELSE 0 END AS penalty FROM px)",
    "pz AS (SELECT *, CASE WHEN burden <= 0.4 AND maximum <= 0.2 THEN 0 WHEN burden <= 0.8 AND maximum <= 0.45 THEN 1 ELSE 2 END AS risk_class, concat_ws(';', CASE WHEN lf = '' THEN 'left_invalid' END, CASE WHEN rf = '' THEN 'right_invalid' END, CASE WHEN gap = 4 THEN 'compatibility_hard_fail' END) AS hard FROM py)",
    "pw AS (SELECT *, concat_ws(';', nullif(hard, ''), CASE WHEN tier = 'C' THEN 'tier_c' END, CASE WHEN risk_class = 2 THEN 'risk_2' END) AS reasons, CASE WHEN hard <> '' THEN 'rejected' WHEN tier = 'C' OR risk_class = 2 THEN 'conditional' ELSE 'pass' END AS status FROM pz)",
))
SQL["pair_evaluation"] = Q._sql("p", "").rstrip() + ", " + _PAIRS + """ SELECT pair_id, status, tier, CAST(risk_class AS INTEGER) AS risk_class, round(burden, 6) AS burden, round(disagreement, 6) AS disagreement, penalty, reasons,
  CASE WHEN status = 'pass' THEN k ELSE -1 END AS pair_rank, CASE WHEN status = 'conditional' THEN k ELSE -1 END AS conditional_rank FROM (SELECT *, rank() OVER (PARTITION BY status ORDER BY risk_class, tier, burden, maximum, disagreement, penalty) AS k FROM pw)"""
