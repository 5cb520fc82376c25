"""Queries of candidate rows, hits after the search, formatted tables and lines, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from guidespan.functions import formats
from guidespan.functions import scores as V
from guidespan.functions import seq as S
from guidespan.jobs import annotation as A
from guidespan.jobs import queries as Q
from guidespan.jobs import scoring
from guidespan.jobs.scoring import SQL as SCORING_SQL
from guidespan.jobs.scoring import WEIGHTS
from guidespan.operators import export, hits, library, pairs, search, windows
from guidespan.operators.lineage import cut, cut_folder
from guidespan.operators.ordinals import numbered
from guidespan.sources import contigs as C
from guidespan.sources import fasta
from guidespan.sources import tables as T

LEFT_PAM = "NGG"


def _library(spark, sf_dir):
    """Distinct sites with their numbers and places as JSON."""
    names = Q.unique_sites(spark, sf_dir).select("qid", "sequence")
    sites = Q.single_motif_sites(spark, sf_dir).join(names, "sequence").select("qid", "sequence", "seq_id", "strand", F.col("window_start").alias("start"))
    return export.library(sites)


def library_lines(spark, sf_dir):
    """The input of a library search: number, sequence and places."""
    return export.delimited(_library(spark, sf_dir)).select("line")


def candidate_rows(spark, sf_dir):
    """One row a place, from the JSON of places."""
    return windows.candidates(_library(spark, sf_dir), Q.MOTIF.side, Q.MOTIF.flank)


def embedded_pams(spark, sf_dir):
    """Where the PAM lies in each distinct site, and the guide read in its direction, without the motif."""
    rows = Q.single_motif_sites(spark, sf_dir).select("sequence", "strand").distinct()
    rows = rows.withColumn("span", windows.pam_span(F.col("sequence"), Q.MOTIF.codes, LEFT_PAM, Q.MOTIF.side))
    guide = F.when(F.col("strand") == "plus", F.col("sequence")).otherwise(S.reverse_complement(F.col("sequence")))
    return rows.select("sequence", "strand", "span.start", "span.end", "span.expected", windows.spacer(guide, len(Q.MOTIF.codes), Q.MOTIF.side).alias("spacer"))


def normalised_hits(spark, sf_dir):
    return hits.normalised(Q.search_hits(spark, sf_dir).withColumn("aligned_target", F.col("target")), "seeded")


def hit_lines(spark, sf_dir):
    return export.hit_json(normalised_hits(spark, sf_dir))


def seed_hits(spark, sf_dir):
    """Hits of two mismatches at most, one of them in the eight bases next to the PAM."""
    found = hits.normalised(Q.found(spark, sf_dir, 2).withColumn("aligned_target", F.col("target")), "seeded")
    return hits.within_budget(found, 2, 8, 1).select("qid", "target", "start", "strand", "mismatch")


def off_target_hits(spark, sf_dir):
    """Hits without the guides' own sites, which are where the contigs begin that they are cut from."""
    held = Q.contigs(spark, sf_dir)
    own = held.where(F.col("seq_id") % 50 == 0).select(F.substring("seq", 1, 20).alias("guide"), F.col("seq_id").alias("target")).join(Q.guides(held), "guide").select("qid", "target", F.lit(0).cast("long").alias("start"))
    return hits.without_expected(normalised_hits(spark, sf_dir), own).select("qid", "target", "start", "strand", "mismatch")


def hit_buckets(spark, sf_dir):
    return hits.buckets(normalised_hits(spark, sf_dir), 2)


def deduplicated_hits(spark, sf_dir):
    """Hits of the search with bulges and of that without, each place of a guide once."""
    both = normalised_hits(spark, sf_dir).unionByName(hits.normalised(Q.bulge_alignments(spark, sf_dir).withColumn("target_start", F.col("start")), "bulges"))
    return hits.deduplicated(both).select("qid", "target", "target_start", "target_end", "strand", "mismatch", "indel")


def guide_differences(spark, sf_dir):
    """Guides that only one of both searches finds anywhere. What they find needs no places for that."""
    plain = search.search_pairs(search.beside_pam(Q.contigs(spark, sf_dir), 20), Q.own_guides(spark, sf_dir), 20, Q.BUDGET)
    # Each side is read twice.
    return hits.key_differences(*(cut(rows.select("qid").distinct()) for rows in (plain, Q.bulge_pairs(spark, sf_dir))), "qid")


def guide_scores(spark, sf_dir):
    """One scored row a guide, bulges included."""
    return hits.guide_scores(Q.own_guides(spark, sf_dir), hits.normalised(Q.bulge_alignments(spark, sf_dir), "bulges"), WEIGHTS)


def score_lines(spark, sf_dir):
    """BED lines of the perfect hits of each guide, scored by its specificity."""
    # The scores are cut off, so the driver never holds the plans of both searches as one, which it would plan anew after every stage.
    scores = cut(guide_scores(spark, sf_dir).select("qid", "off_target_specificity"))
    rows = hits.backfilled(Q.perfect_hits(spark, sf_dir), scores, "qid")
    return export.score_bed(rows, "qid", "off_target_specificity", "start", "guide")


def formatted_summary(spark, sf_dir):
    """The guides' summary as lines of a table with two decimals."""
    return export.delimited(export.without_blank_columns(cut(Q.guide_summary(spark, sf_dir))))  # read twice


def window_models(spark, sf_dir):
    """Sites scored by the logistic model, where their context of 30 bases is there, or else by the activity rule."""
    held = Q.contigs(spark, sf_dir)
    sites = C.windows(held, 23, "[ACGT]{20}" + S.pattern("NGG")).select("seq_id", F.col("pos").alias("start"), (F.col("pos") + 23).alias("end"), "window")
    rows = windows.with_context(sites, held, "start", "end", 4, 3)
    score = V.logistic(F.col("context"))
    rule = S.activity(F.substring("window", 1, 20))
    return rows.select("seq_id", "start", "window", "context_start", F.round(F.coalesce(score, rule), 9).alias("on_target_score"), F.when(score.isNotNull(), "logistic").otherwise("nuc_features").alias("on_target_model"), F.when(score.isNull(), "no window of 30 bases").otherwise("").alias("note"))


def unique_guide_ranks(spark, sf_dir):
    """Each guide once, at its best place, with the number of its places, ranked."""
    rows = window_models(spark, sf_dir).select(F.substring("window", 1, 20).alias("guide"), "seq_id", "start", "on_target_score", "on_target_model")
    rows = hits.first_rows(rows, "guide", [-F.col("on_target_score"), F.col("seq_id"), F.col("start")], "position_count")
    return numbered(rows, "rank", [F.col("on_target_score").desc(), F.col("seq_id"), F.col("start"), F.col("guide")])


def annotation_with_utrs(spark, sf_dir):
    """Annotation lines, and lines of the untranslated regions that follow from them."""
    return A.gff_lines(spark, sf_dir).unionByName(export.annotation_lines(A.inferred_utrs(spark, sf_dir)))


def guides_read_back(spark, sf_dir):
    """Distinct sites written as a table of guides and as FASTA, and read from these files."""
    rows = cut(Q.unique_sites(spark, sf_dir).select("qid", F.left("sequence", F.lit(20)).alias("guide")))
    base = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    rows.select("qid", F.col("guide").alias("guide_seq"), F.lit("x\ty").alias("note")).write.csv(f"{base}/guides", sep="\t", header=True)
    export.fasta(rows, "qid", "guide").write.text(f"{base}/fasta")
    read = T.guides(T.read(spark, f"{base}/guides"))
    return read.join(C.from_fasta(spark, f"{base}/fasta").select(F.col("seq_id").alias("qid"), "seq"), "qid").select("qid", "guide", F.length("seq").cast("long").alias("n_bases"))


def fasta_chunks(spark, sf_dir):
    """All contigs written as FASTA and read back by ranges of bytes, in chunks with an overlap, each by its hash."""
    folder = f"{cut_folder(spark)}/{uuid.uuid4().hex}"
    export.fasta(Q.contigs(spark, sf_dir), "seq_id", "seq").write.text(folder)
    rows = C.chunks(fasta.from_fasta_ranges(spark, folder), 22)
    return rows.select(F.col("seq_id").cast("long").alias("seq_id"), "chunk_start", F.col("own").cast("long").alias("own"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def flank_files(spark, sf_dir):
    """The ten bases beside every perfect hit, written with a folder for each sequence and guide, and read back."""
    held, found = Q.contigs(spark, sf_dir), hits.normalised(cut(Q.perfect_hits(spark, sf_dir)), "seeded")  # read twice
    places = found.select(F.col("target").alias("seq_id"), "start", "strand").distinct()
    after = F.col("strand") == "+"
    start = F.when(after, F.col("start") + 20).otherwise(F.col("start") - 10)
    flanks = C.fetch(places, held, start, F.when(after, start + 10).otherwise(F.col("start")), "flank", 10).withColumnRenamed("seq_id", "target")
    flanks = cut(flanks)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    lines = export.flank_fasta(found, flanks)
    export.write_by(lines, path, ["seq_id", "qid"])
    return export.read_by(lines.select("seq_id", "qid").distinct(), path).select("seq_id", "qid", "line")


def guide_regions(spark, sf_dir):
    """The places of every guide of the library, in pages of at most five."""
    rows = library.region_pages(scoring.library_candidates(spark, sf_dir), 5)
    return rows.select("guide_seq", "page", F.array_join(F.transform("regions", lambda r: F.concat_ws(":", r["seq_id"].cast("string"), r["spacer_start"].cast("string"), r["strand"])), ";").alias("regions"))


def side_guides(spark, sf_dir):
    """The guide beside each motif next to a centre, and labels for its row."""
    rows = Q.centre_flanks(spark, sf_dir).where("flank_seq <> ''")
    before = F.col("motif_strand") == "plus"
    start = F.when(before, F.col("motif_start") - F.length("flank_seq")).otherwise(F.col("motif_start"))
    window = F.when(before, F.concat("flank_seq", "motif_seq")).otherwise(F.concat("motif_seq", "flank_seq"))
    guide = windows.beside_motif(window, start, start + F.length(window), F.col("motif_start"), F.col("motif_start") + 3)
    return rows.select("seq_id", "y_start", "motif_start", "motif_strand", guide.alias("guide"), formats.slug(F.concat_ws(" / ", F.col("seq_id").cast("string"), F.col("y_start").cast("string"), "motif_strand")).alias("label"))


def scanned_hits(spark, sf_dir):
    """What the seeded search finds, by comparing everything."""
    held = Q.contigs(spark, sf_dir)
    return search.scan(held, Q.guides(held), 20, Q.BUDGET)


def kmer_index(spark, sf_dir):
    """Every place of every stretch of eight plain bases, by its code."""
    return C.windows(Q.contigs(spark, sf_dir), 8, "[ACGT]{8}").select(S.kmer_code(F.col("window")).alias("code"), "seq_id", "pos")


def hit_activities(spark, sf_dir):
    """Hits, bulges included, by each model."""
    rows = hits.activities(hits.normalised(Q.bulge_alignments(spark, sf_dir), "bulges"), WEIGHTS)
    return rows.select("qid", "target", "start", "strand", "target_end", *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in rows.columns if c.startswith("activity_") and c != "activity_model"), "activity", "activity_model")


def passing_sites(spark, sf_dir):
    """Scored sites whose share of G and C passes."""
    return hits.hard_filtered(Q.scored_sites(spark, sf_dir), True).select("qid", "gc_percent", "score")


def edit_counts(spark, sf_dir):
    """Edit distance of each guide and each target of its hits."""
    # An alignment within the budgets has three edits at most, and is the same at each place of a target.
    return Q.bulge_pairs(spark, sf_dir).select("qid", "guide", "target", "mismatch", "indel").distinct().select("qid", "target", F.levenshtein("guide", "target", 3).alias("edits"), "mismatch", "indel")


def _pairs(rows):
    ids = F.concat_ws(":", *(F.col(c).cast("string") for c in ("seq_id", "left_pos", "right_pos")))
    score = lambda name: F.round(S.activity(F.col(f"{name}_flank_seq")), 9)
    wide = {f"{n}_on_target_score_rule": score(n) for n in ("left", "right")} | {f"{n}_on_target_score_balance": F.round(S.gc_fraction(F.col(f"{n}_flank_seq")), 6) for n in ("left", "right")}
    wide |= {f"{n}_on_target_model_balance": F.lit("gc_heuristic") for n in ("left", "right")} | {"calibration_status": F.when(F.col("gap") < 8, "calibrated_reference").otherwise("uncalibrated")}
    return rows.withColumn("pair_id", ids).withColumns(wide)


def pair_models(spark, sf_dir):
    """The models of both sides of each pair, collected from columns by their names."""
    rows = _pairs(Q.gap_pairs(spark, sf_dir))
    of = lambda side: F.transform(pairs.model_records(rows, side), lambda m: F.struct(F.lit(side).alias("side"), m.alias("m")))
    both = F.concat(of("left"), of("right"))
    return rows.select("pair_id", F.explode(both).alias("x")).select("pair_id", "x.side", "x.m.name", "x.m.score", "x.m.calibrated", "x.m.is_fallback", "x.m.reference_only")


def pair_compatibility(spark, sf_dir):
    """Why pairs can't go together: their gap, and the side that their left flank lies on."""
    side = F.when(F.col("left_strand") == "plus", "upstream").otherwise("downstream")
    return Q.gap_pairs(spark, sf_dir).select("seq_id", "left_pos", "right_pos", F.concat_ws(";", pairs.gap_reasons(F.col("gap"), 5, 10, {"left": (side, "upstream")})).alias("reasons"))


def ranked_pairs(spark, sf_dir):
    """Pairs with their evaluation."""
    held = cut(Q.gap_pairs(spark, sf_dir))
    rows = _pairs(held).where("gap <> 6").select("pair_id", "gap", F.lit("old").alias("status"))
    return pairs.attached(rows, scoring._evaluated(held).select("pair_id", "status", "tier", "pair_rank"))


QUERIES = {f.__name__: f for f in (library_lines, candidate_rows, embedded_pams, normalised_hits, hit_lines, seed_hits, off_target_hits, hit_buckets, deduplicated_hits, guide_differences, guide_scores, flank_files, guide_regions, score_lines, formatted_summary, window_models, unique_guide_ranks, annotation_with_utrs, guides_read_back, fasta_chunks, side_guides, scanned_hits, kmer_index, hit_activities, passing_sites, edit_counts, pair_models, pair_compatibility, ranked_pairs)}

# SQL

_N = "SELECT qid, guide, seq_id AS target, start, strand, CAST(mismatch AS BIGINT) AS mismatch, 0::BIGINT AS indel, 0::BIGINT AS rna_bulges, 0::BIGINT AS dna_bulges, pam, 0.0::DOUBLE AS bitscore, start AS target_start, start + 20 AS target_end, 0::BIGINT AS query_start, 20::BIGINT AS query_end, '' AS cigar, guide AS aligned_guide, target AS aligned_target, 'seeded' AS engine FROM h"
_PLACES = """string_agg('[' || seq_id || ', "' || strand || '", ' || window_start || ']', ', ' ORDER BY seq_id, strand, window_start)"""
_B = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, seq_id, strand, border ORDER BY 2 * mm + CASE WHEN length(target) = 20 THEN 0 ELSE 3 END, mm, length(target) <> 20, length(target)) AS k FROM ({Q._BULGES}) WHERE mm <= 2) WHERE k = 1"
_SCORES = f"""SELECT qid, guide, CAST(coalesce(n, 0) AS BIGINT) AS input_offtargets, CAST(coalesce(subs, 0) AS BIGINT) AS substitution_offtargets, CAST(coalesce(bulges, 0) AS BIGINT) AS bulge_hits, round(coalesce(risks, 0.0), 6) AS bulge_risk_sum,
  round(1 / (1 + CASE WHEN coalesce(best, 0) >= 0.999999 THEN greatest(total - 1, 0.0) ELSE coalesce(total, 0.0) END + coalesce(risks, 0.0)), 6) AS off_target_specificity, 'rule_weights' AS off_target_model, CASE WHEN bulges > 0 THEN '{hits.BULGE_NOTE}' ELSE '' END AS off_target_model_note,
  CASE WHEN bulges > 0 THEN '{hits.BULGE_METHOD}' ELSE 'not_applicable' END AS bulge_score_method, 'uncalibrated' AS calibration_status, round({Q._activity('guide')}, 9) AS on_target_score, 'nuc_features' AS on_target_model
  FROM g LEFT JOIN (SELECT qid, count(*) AS n, count(w) AS subs, count(*) - count(w) AS bulges, sum(w) AS total, max(w) AS best, sum(risk) AS risks FROM (SELECT qid, CASE WHEN length(target) = 20 THEN round(@W, 12) END AS w,
  CASE WHEN length(target) <> 20 THEN round(least(greatest((least(length(target), 20) - mm) / least(length(target), 20)::DOUBLE * 0.5 * pow(0.75, mm), 0.01), 1.0), 12) END AS risk FROM ({_B})) GROUP BY qid) USING (qid)"""
_SITES23 = f"SELECT seq_id, pos AS start, w AS window, seq FROM ({Q._windows(23, Q._match(23, '[ACGT]{20}' + S.pattern('NGG')))})"


def _models() -> str:
    from guidespan.jobs.scoring import _Z

    z = _Z.replace("substr(w,", "substr(context,")
    logistic = f"1 / (1 + exp(-({V.INTERCEPT} + CASE WHEN {Q._gc('context')} < 0.5 THEN {V.LOW_GC} ELSE {V.HIGH_GC} END + {z})))"
    whole = "length(context) = 30 AND regexp_full_match(context, '[ACGT]{30}')"
    return f"""SELECT seq_id, start, "window", least(start, 4) AS context_start, round(CASE WHEN {whole} THEN {logistic} ELSE {Q._activity('substr("window", 1, 20)')} END, 9) AS on_target_score, CASE WHEN {whole} THEN 'logistic' ELSE 'nuc_features' END AS on_target_model, CASE WHEN {whole} THEN '' ELSE 'no window of 30 bases' END AS note
      FROM (SELECT *, substr(seq, greatest(start - 4, 0) + 1, start + 26 - greatest(start - 4, 0)) AS context FROM ({_SITES23.replace(' AS window', ' AS "window"')}))"""


def _weighted() -> str:
    from guidespan.jobs.scoring import _WEIGHTED

    return _WEIGHTED


_SEED = "list_sum([" + ", ".join(f"CAST(substr(guide, {i}, 1) <> substr(x, {i}, 1) AS INTEGER)" for i in range(13, 21)) + "])"
_LINE = lambda c, d: f"CASE WHEN round({c}, {d}) = 0 THEN '0.{'0' * d}' ELSE printf('%.{d}f', round({c}, {d})) END"
SQL = {
    "library_lines": Q._sql("u", f"SELECT qid || chr(9) || sequence || chr(9) || '\"' || replace('[' || p || ']', '\"', '\"\"') || '\"' AS line FROM u JOIN (SELECT sequence, {_PLACES} AS p FROM sites GROUP BY sequence) USING (sequence)"),
    "candidate_rows": Q._sql("u", "SELECT u.qid AS query_id, sequence AS query_seq, CAST(seq_id AS VARCHAR) AS seq_id, strand, window_start + 1 AS start, window_start + 23 AS \"end\", CASE WHEN strand = 'plus' THEN substr(sequence, 1, 3) ELSE substr(sequence, 21, 3) END AS motif_seq, CASE WHEN strand = 'plus' THEN substr(sequence, 4) ELSE substr(sequence, 1, 20) END AS flank_seq FROM sites JOIN u USING (sequence)"),
    "embedded_pams": Q._sql("sites", f"SELECT DISTINCT sequence, strand, CASE WHEN sequence SIMILAR TO '[ACGT]GG.*' THEN 0 ELSE 20 END AS start, CASE WHEN sequence SIMILAR TO '[ACGT]GG.*' THEN 3 ELSE 23 END AS \"end\", CASE WHEN sequence SIMILAR TO '[ACGT]GG.*' THEN 'NGG' ELSE 'CCN' END AS expected, right(CASE WHEN strand = 'plus' THEN sequence ELSE {Q._RC.format('sequence')} END, 20) AS spacer FROM sites"),
    "normalised_hits": Q._sql("h", _N),
    "hit_lines": Q._sql("h", """SELECT '{"type":"hit","qid":"' || qid || '","guide":"' || guide || '","target":"' || seq_id || '","start":' || start || ',"strand":"' || strand || '","mismatch":' || mismatch || ',"indel":0,"rna_bulges":0,"dna_bulges":0,"pam":"' || pam || '","bitscore":0.00,"target_start":' || start || ',"target_end":' || (start + 20) || ',"query_start":0,"query_end":20,"cigar":"","aligned_guide":"' || guide || '","aligned_target":"' || target || '","engine":"seeded"}' AS line FROM h"""),
    "off_target_hits": Q._sql("h", "SELECT qid, seq_id AS target, start, strand, CAST(mismatch AS BIGINT) AS mismatch FROM h WHERE NOT (start = 0 AND EXISTS (SELECT 1 FROM c WHERE c.seq_id = h.seq_id AND c.seq_id % 50 = 0 AND substr(c.seq, 1, 20) = h.guide))"),
    "hit_buckets": Q._sql("h", "SELECT qid, count(*) FILTER (mismatch = 0) AS mm0, count(*) FILTER (mismatch = 1) AS mm1, count(*) FILTER (mismatch >= 2) AS mm2 FROM h GROUP BY qid"),
    "deduplicated_hits": Q._sql("h", f"SELECT qid, target, target_start, target_end, strand, f[1] AS mismatch, f[2] AS indel FROM (SELECT qid, target, target_start, target_end, strand, min((mismatch, indel)) AS f FROM (SELECT qid, seq_id AS target, start AS target_start, start + 20 AS target_end, strand, CAST(mismatch AS BIGINT) AS mismatch, 0::BIGINT AS indel FROM h UNION ALL SELECT qid, seq_id, start, start + length(target), strand, CAST(mm AS BIGINT), CASE WHEN length(target) = 20 THEN 0 ELSE 1 END FROM ({_B})) GROUP BY ALL)"),
    "guide_differences": Q._sql("h", f"SELECT qid, 'missing' AS status FROM (SELECT DISTINCT qid FROM h) WHERE qid NOT IN (SELECT qid FROM ({_B})) UNION ALL SELECT qid, 'extra' FROM (SELECT DISTINCT qid FROM ({_B})) WHERE qid NOT IN (SELECT qid FROM h)"),
    "guide_scores": Q._sql("g", _SCORES.replace("@W", _weighted())),
    "score_lines": Q._sql("h", f"SELECT concat_ws(chr(9), seq_id, start, start + 20, h.qid, printf('%.6f', 1 / greatest(off_target_specificity, 1e-12)), strand) AS line FROM h JOIN ({_SCORES.replace('@W', _weighted())}) z USING (qid) WHERE mismatch = 0"),
    "formatted_summary": Q.SQL["guide_summary"].replace("SELECT qid, guide, CAST(coalesce(mm0", "SELECT concat_ws(chr(9), qid, guide, mm0, mm1, mm2, mm3, mm4, mm5, " + ", ".join(_LINE(c, 2) for c in ("legacy_score", "specificity", "seed_specificity")) + ") AS line FROM (SELECT qid, guide, CAST(coalesce(mm0", 1) + ")",
    "window_models": Q._sql("", _models()),
    "unique_guide_ranks": Q._sql("", f"SELECT guide, f[2] AS seq_id, f[3] AS start, -f[1] AS on_target_score, model AS on_target_model, position_count, row_number() OVER (ORDER BY f[1], f[2], f[3], guide) AS rank FROM (SELECT substr(\"window\", 1, 20) AS guide, min((-on_target_score, seq_id, start)) AS f, arg_min(on_target_model, (-on_target_score, seq_id, start)) AS model, count(*) AS position_count FROM ({_models()}) GROUP BY 1)"),
    "seed_hits": Q._sql("h", f"SELECT qid, seq_id AS target, start, strand, CAST(mismatch AS BIGINT) AS mismatch FROM h WHERE mismatch <= 2 AND {_SEED.replace('substr(x,', 'substr(target,')} <= 1"),
    "flank_files": Q._sql("h", """SELECT seq_id, qid, unnest(['>' || qid || ':' || seq_id || ':' || start || ':' || strand, flank]) AS line FROM (
      SELECT h.seq_id, qid, start, strand, CASE WHEN strand = '+' THEN substr(seq, start + 21, 10) ELSE substr(seq, greatest(start - 10, 0) + 1, start - greatest(start - 10, 0)) END AS flank FROM h JOIN c ON c.seq_id = h.seq_id WHERE mismatch = 0) WHERE flank <> ''"""),
    "guide_regions": Q._sql("", f"SELECT guide_seq, (k - 1) // 5 AS page, string_agg(seq_id || ':' || spacer_start || ':' || strand, ';' ORDER BY k) AS regions FROM (SELECT *, row_number() OVER (PARTITION BY guide_seq ORDER BY seq_id, spacer_start, strand) AS k FROM ({scoring._LIB})) GROUP BY ALL"),
    "guides_read_back": Q._sql("u", "SELECT qid, substr(sequence, 1, 20) AS guide, 20::BIGINT AS n_bases FROM u"),
    "fasta_chunks": Q._sql("", "SELECT seq_id, k * 1024 AS chunk_start, least(1024, length(seq) - k * 1024) AS own, md5(substr(seq, k * 1024 + 1, 1046)) AS chunk_md5 FROM (SELECT seq_id, seq, unnest(range(0, (length(seq) + 1023) // 1024)) AS k FROM c)"),
    "side_guides": Q.SQL["centre_flanks"].replace("SELECT y.seq_id, y_start", "SELECT seq_id, y_start, motif_start, motif_strand, flank_seq AS guide, seq_id || '_' || y_start || '_' || motif_strand AS label FROM (SELECT y.seq_id, y_start", 1) + ") WHERE flank_seq <> ''",
    "annotation_with_utrs": A._sql("SELECT concat_ws(chr(9), seq_id, 'inferred', type, start, \"end\", '.', strand, '.', 'Parent=' || transcript_id) AS value FROM utrs" + "".join(f" UNION ALL SELECT concat_ws(chr(9), seq_id, 'made', '{kind}', {a.replace('div', '//')}, {b.replace('div', '//')}, '.', strand, '.', {attrs}) FROM n" for kind, a, b, attrs in A._PARTS)),
    "scanned_hits": Q.SQL["search_hits"],
    "kmer_index": Q._sql("", f"SELECT CAST(list_sum(list_transform(range(0, 8), lambda i: CAST(pow(4, 7 - i) AS BIGINT) * (instr('ACGT', substr(w, i + 1, 1)) - 1))) AS BIGINT) AS code, seq_id, pos FROM ({Q._windows(8)})"),
    "hit_activities": Q._sql("g", f"""SELECT *, CASE WHEN activity_cfd >= 0 THEN activity_cfd ELSE activity_bulge END AS activity, CASE WHEN activity_cfd >= 0 THEN 'cfd' ELSE '{hits.BULGE_METHOD}' END AS activity_model FROM (SELECT qid, seq_id AS target, start, strand, start + length(target) AS target_end,
      CASE WHEN length(target) = 20 THEN round({_weighted()}, 9) ELSE -1.0 END AS activity_cfd, CASE WHEN length(target) = 20 THEN round((20 - mm) / 20, 9) ELSE -1.0 END AS activity_identity, """ + ", ".join(f"CASE WHEN length(target) = 20 THEN round((20 - mm) / 20 * pow({p}, list_sum(list_transform(range({a}, {b} + 1), lambda i: CAST(substr(guide, i, 1) <> substr(target, i, 1) AS INTEGER)))), 9) ELSE -1.0 END AS activity_{name}" for name, (a, b, p) in V.SEEDS.items()) + f""",
      CASE WHEN length(target) <> 20 THEN round(least(greatest((least(length(target), 20) - mm) / least(length(target), 20)::DOUBLE * 0.5 * pow(0.75, mm), 0.01), 1.0), 9) ELSE -1.0 END AS activity_bulge FROM ({_B}))"""),
    "passing_sites": "SELECT qid, gc_percent, score FROM (" + Q.SQL["scored_sites"] + ") WHERE gc_hint = 'pass'",
    "edit_counts": Q._sql("g", f"SELECT DISTINCT qid, target, CAST(levenshtein(guide, target) AS INTEGER) AS edits, CAST(mm AS INTEGER) AS mismatch, CASE WHEN length(target) = 20 THEN 0 ELSE 1 END AS indel FROM ({_B})"),
    "pair_models": Q._sql("p", f"""SELECT pair_id, side, name, score, calibrated AND NOT is_fallback AS calibrated, is_fallback, false AS reference_only FROM (SELECT seq_id || ':' || left_pos || ':' || right_pos AS pair_id, gap < 8 AS calibrated, unnest([{', '.join(f"{{'side': '{n}', 'name': '{m}', 'score': {x}, 'is_fallback': {f}}}" for n in ('left', 'right') for m, x, f in (('balance', f"round({Q._gc(f'coalesce({n}_flank_seq, chr(0))').replace('chr(0)', chr(39) * 2)}, 6)", 'true'), ('rule', f"round({Q._activity(f'coalesce({n}_flank_seq, chr(0))').replace('chr(0)', chr(39) * 2)}, 9)", 'false')))}], recursive := true) FROM p)"""),
    "pair_compatibility": Q._sql("p", "SELECT seq_id, left_pos, right_pos, concat_ws(';', CASE WHEN gap < 5 THEN 'gap_below_min:' || gap || '.0' END, CASE WHEN gap > 10 THEN 'gap_above_max:' || gap || '.0' END, CASE WHEN left_strand <> 'plus' THEN 'direction_mismatch:left:upstream:downstream' END) AS reasons FROM p"),
    "ranked_pairs": "SELECT e.pair_id, gap, status, tier, pair_rank FROM (" + SCORING_SQL["pair_evaluation"] + ") e JOIN (" + Q._sql("p", "SELECT seq_id || ':' || left_pos || ':' || right_pos AS pair_id, gap FROM p WHERE gap <> 6") + ") USING (pair_id)",
}
