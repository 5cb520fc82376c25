"""The queries over sequences, and their SQL.

The test tables hold no sequences, so contigs are the letters a, c, g and t of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guidespan.functions import seq as S
from guidespan.operators import alignment, export, intervals, pairs, patterns, search
from guidespan.operators.lineage import cut
from guidespan.operators.ordinals import numbered
from guidespan.sources import contigs as C

MOTIF = patterns.Motif("NGG", 20, "downstream")
LEFT, RIGHT = patterns.Motif("TGA", 8, "upstream"), patterns.Motif("ACR", 8, "downstream")
BESIDE = patterns.Motif("NGG", 12, "upstream")
CENTRE = "GATTA"
BUDGET = 3
#: Groups that the places of one seed are dealt to.
SPREAD = 16


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def guides(held: DataFrame) -> DataFrame:
    """The stated query set: the first 20 bases of every contig whose id is divisible by 50, once each."""
    own = held.where(F.col("seq_id") % 50 == 0).select("seq_id", F.substring("seq", 1, 20).alias("guide"))
    return own.groupBy("guide").agg(F.concat(F.lit("g"), F.min("seq_id").cast("string")).alias("qid")).select("qid", "guide")


def own_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``guides`` of all contigs, read from the texts that they come from alone."""
    return guides(C.from_text(spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") % 50 == 0)))


def contig_summary(spark, sf_dir):
    return contigs(spark, sf_dir).select("seq_id", F.length("seq").cast("long").alias("n_bases"), F.round(S.gc_fraction(F.col("seq")) * 100, 6).alias("gc_percent"), S.longest_run(F.col("seq")).cast("long").alias("longest_run"), S.dinucleotides(F.col("seq")).cast("long").alias("dinucleotides"), S.reverse_complement(F.substring("seq", 1, 30)).alias("head_flipped"), S.gc_hint(S.gc_fraction(F.col("seq")) * 100).alias("gc_hint"))


def kmer_postings(spark, sf_dir):
    found = C.windows(contigs(spark, sf_dir), 8)
    return found.groupBy(F.col("window").alias("kmer")).agg(F.count("*").alias("n"), F.min(F.struct("seq_id", "pos")).alias("p")).select("kmer", S.kmer_code(F.col("kmer")).alias("code"), "n", F.col("p.seq_id").alias("first_seq_id"), F.col("p.pos").alias("first_pos"))


def single_motif_sites(spark, sf_dir):
    return patterns.single(contigs(spark, sf_dir), MOTIF)


def unique_sites(spark, sf_dir):
    return patterns.unique(patterns.single(contigs(spark, sf_dir), MOTIF))


def scored_sites(spark, sf_dir):
    """The flagship: sites, one row a sequence, scored and ranked."""
    rows = unique_sites(spark, sf_dir).select("qid", "sequence", "n_positions", F.round(S.gc_fraction(F.col("sequence")) * 100, 6).alias("gc_percent"), F.round(S.activity(F.col("sequence")), 9).alias("score"))
    rows = numbered(rows, "rank", [F.col("score").desc(), F.substring("qid", 6, 20).cast("long")])
    return rows.select("qid", "sequence", "n_positions", "gc_percent", S.gc_hint(F.col("gc_percent")).alias("gc_hint"), "score", "rank")


def search_hits(spark, sf_dir):
    return found(spark, sf_dir, BUDGET)


def found(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    return search.search(contigs(spark, sf_dir), own_guides(spark, sf_dir), 20, budget)


def perfect_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of ``search_hits`` without mismatches: a search of its own, whose only seed is the whole guide."""
    return found(spark, sf_dir, 0)


def top_hits(spark, sf_dir):
    return search.top(search_hits(spark, sf_dir), 5)


def guide_summary(spark, sf_dir):
    rows = search.summary(own_guides(spark, sf_dir), search_hits(spark, sf_dir))
    return rows.select(*(c for c in rows.columns if c not in ("legacy_score", "specificity", "seed_specificity")), *(F.round(c, 6).alias(c) for c in ("legacy_score", "specificity", "seed_specificity")))


def masks(held: DataFrame) -> DataFrame:
    found = C.windows(held, 4, "TTTT|AATA")
    return intervals.merge(found.select("seq_id", F.greatest(F.col("pos") - 6, F.lit(0)).alias("start"), (F.col("pos") + 10).alias("end")))


def merged_intervals(spark, sf_dir):
    return masks(contigs(spark, sf_dir))


def masked_hits(spark, sf_dir):
    return intervals.starts_within(search_hits(spark, sf_dir), masks(contigs(spark, sf_dir)), how="left_anti").select("qid", "seq_id", "start", "strand", "mismatch")


def forbidden_hits(spark, sf_dir):
    hits = intervals.starts_within(search_hits(spark, sf_dir), masks(contigs(spark, sf_dir)), how="left_semi")
    return hits.groupBy("seq_id", "start", "strand").agg(F.min("mismatch").alias("mismatch"), F.count("*").alias("n_guides"))


def gap_pairs(spark, sf_dir):
    rows = patterns.gap_pairs(contigs(spark, sf_dir), LEFT, RIGHT, 4, 12)
    return rows.select("seq_id", "strand", "left_strand", "right_strand", "left_pos", "right_pos", "gap", "compound_end", "left_motif_seq", "right_motif_seq", F.coalesce("left_flank_seq", F.lit("")).alias("left_flank_seq"), F.coalesce("right_flank_seq", F.lit("")).alias("right_flank_seq"))


def centre_sites(spark, sf_dir):
    return patterns.centres(contigs(spark, sf_dir), CENTRE)


def centre_flanks(spark, sf_dir):
    held = contigs(spark, sf_dir)
    rows = patterns.beside_centres(held, patterns.centres(held, CENTRE), BESIDE, 0, 25)
    return rows.select("seq_id", "y_start", "strand", "motif_start", "motif_strand", "motif_seq", "distance", F.coalesce("flank_seq", F.lit("")).alias("flank_seq"))


def pair_ranking(spark, sf_dir):
    """Gap pairs with activities of both flanks, their percentiles, tier and risk class, ranked within each contig."""
    policy, flank = pairs.Policy(), lambda name: F.round(S.activity(F.col(f"{name}_flank_seq")), 9)
    rows = gap_pairs(spark, sf_dir).select("seq_id", "left_pos", "right_pos", "gap", flank("left").alias("left_score"), flank("right").alias("right_score"))
    rows = pairs.percentiles(cut(rows), {"left_score": "left_percentile", "right_score": "right_percentile"})
    risk = F.round(1 - F.least("left_score", "right_score"), 6)
    rows = rows.withColumn("tier", pairs.tier([F.col("left_score"), F.col("right_score")], [F.lit(True), F.lit(True)], policy))
    rows = rows.withColumn("risk_class", pairs.risk_class(risk, F.round(risk / 2, 6), F.when(risk >= 0.7, 1).otherwise(0), policy))
    key = [F.col("tier"), F.col("risk_class"), -F.least("left_score", "right_score"), F.col("gap")]
    rows = pairs.competition(rows, key, "pair_rank", ["seq_id"], [F.col("left_pos"), F.col("right_pos")])
    return rows.select("seq_id", "left_pos", "right_pos", "left_score", "right_score", F.round("left_percentile", 9).alias("left_percentile"), F.round("right_percentile", 9).alias("right_percentile"), "tier", "risk_class", "pair_rank")


def hit_annotations(spark, sf_dir):
    """Hits with the nearest start codon of their contig and the signed distance to it."""
    held = contigs(spark, sf_dir)
    marks = C.windows(held, 3, "ATG").select("seq_id", F.col("pos").alias("mark"))
    hits = search_hits(spark, sf_dir).select("qid", "seq_id", "strand", F.col("start").alias("pos"))
    return intervals.nearest(hits, marks).select("qid", "seq_id", "strand", "pos", "nearest", (F.col("pos") - F.col("nearest")).alias("distance"))


def batch_units(spark, sf_dir):
    """Scopes (contigs) times patterns: one unit each, with its id, status and number of sites."""
    held = contigs(spark, sf_dir)
    motifs = [MOTIF, patterns.Motif("TTTV", 12, "upstream"), patterns.Motif("ACGT", 6)]
    name = F.get(F.array(*(F.lit(m.codes) for m in motifs)), F.col("motif"))
    found = patterns.several(held, motifs).groupBy("seq_id", name.alias("pattern")).agg(F.count("*").alias("n_sites"))
    units = held.select("seq_id", F.explode(F.array(*(F.lit(m.codes) for m in motifs))).alias("pattern"))
    rows = units.join(found, ["seq_id", "pattern"], "left").withColumn("n_sites", F.coalesce("n_sites", F.lit(0)))
    return rows.select("seq_id", "pattern", "n_sites", F.md5(F.concat_ws("/", F.col("seq_id").cast("string"), "pattern").cast("binary")).alias("unit_id"), F.when(F.col("n_sites") > 0, "done").otherwise("empty").alias("status"))


def batch_status(spark, sf_dir):
    return batch_units(spark, sf_dir).groupBy("pattern", "status").agg(F.count("*").alias("n_units"), F.sum("n_sites").alias("n_sites"))


def bed_lines(spark, sf_dir):
    rows = single_motif_sites(spark, sf_dir).select("seq_id", F.col("window_start").alias("start"), (F.col("window_start") + F.length("sequence")).alias("end"), "strand", F.concat_ws(":", F.col("seq_id").cast("string"), F.col("motif_pos").cast("string")).alias("pos_id"))
    return export.bed(rows, "pos_id")


def fasta_lines(spark, sf_dir):
    return export.fasta(unique_sites(spark, sf_dir), "qid", "sequence")


def bulge_alignments(spark, sf_dir):
    """Every place beside a PAM where a guide aligns with two mismatches and one bulge at most."""
    return search.bulge_search(contigs(spark, sf_dir), own_guides(spark, sf_dir), 20, 2, 1)


def bulge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``bulge_alignments`` finds, each guide with each distinct stretch beside a PAM once, without places."""
    return search.bulge_pairs(search.bulge_sites(contigs(spark, sf_dir), 20, 1), own_guides(spark, sf_dir), 20, 2, 1)


def bulge_hits(spark, sf_dir):
    return bulge_alignments(spark, sf_dir).select("qid", "guide", "seq_id", "start", "target_end", "strand", "target", "pam", "mismatch", "rna_bulges", "dna_bulges", "bitscore")


def centre_alignments(spark, sf_dir):
    """The best alignment, with two mismatches and one bulge at most, near each place that has the middle eight bases of a guide.

    embedded_pam: whether the last three bases of the guide, read as its PAM, stand on unbroken columns that spell NNG; pam_place: where.
    """
    held = contigs(spark, sf_dir)
    seeds = own_guides(spark, sf_dir).withColumns({"seed": F.substring("guide", 7, 8), "_g": search.base_code(F.col("guide"), 20, False)})
    # The scan cuts each place with the bases around it; beyond a contig's ends they are N. Places of no guide are left out before they are shuffled.
    padded = held.select("seq_id", F.concat(F.lit("N" * 7), "seq", F.lit("N" * 8)).alias("seq"))
    found = C.windows(padded, 23, "[A-Z]{7}[ACGT]{8}[A-Z]{8}").where("pos >= 6").withColumn("seed", F.substring("window", 8, 8))
    known = F.broadcast(seeds.select("seed").distinct())  # 65,536 rows at most
    # The places of a frequent seed are dealt to several groups, each of which has all its guides.
    found = found.join(known, "seed", "left_semi").withColumns({"_w": search.base_code(F.col("window"), 23, False), "_part": F.pmod(F.xxhash64("seq_id", "pos"), F.lit(SPREAD)).cast("int")})
    every = seeds.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    # A merge join, so that pairs are compared in a stage of their own: within that of the scan, Spark's code for both is too long to be compiled.
    met = found.join(every.hint("merge"), ["seed", "_part"])
    # Most pairs that meet don't align, and never come to Python.
    met = met.select("qid", "guide", "seq_id", "pos", "window", alignment.may_align_near(F.col("_g"), F.col("_w"), 20, 2).alias("ok")).where("ok")
    rows = met.select("qid", "guide", "seq_id", (F.col("pos") - 6).alias("place"), F.translate("window", "N", "").alias("window")).withColumn("centre", F.least("place", F.lit(1)).cast("int"))
    found = alignment.near_centres(rows, 2, 1)
    begin = F.col("place") - F.col("centre")
    found = found.withColumns({"start": begin + F.col("start"), "target_end": begin + F.col("target_end")})
    ok = alignment.pam_on_columns(F.col("aligned_guide"), F.col("aligned_target"), 17, 20, "NNG")
    first = F.length("aligned_guide") - 2
    place = alignment.places_of_columns(F.col("aligned_target"), first, F.col("start"), F.col("target_end"), F.lit("+"))
    return found.select("qid", "guide", "seq_id", "place", "start", "target_end", "mismatch", "rna_bulges", "dna_bulges", "aligned_guide", "aligned_target", ok.alias("embedded_pam"), F.when(ok, place).alias("pam_place"))


QUERIES = {f.__name__: f for f in (centre_alignments, scored_sites, contig_summary, kmer_postings, single_motif_sites, unique_sites, search_hits, top_hits, guide_summary, merged_intervals, masked_hits, forbidden_hits, gap_pairs, centre_sites, centre_flanks, pair_ranking, hit_annotations, batch_units, batch_status, bed_lines, fasta_lines, bulge_hits, bulge_alignments)}

# SQL: common table expressions, each by name with those that it needs.

_RC = "reverse(translate({}, 'ACGTUN', 'TGCAAN'))"


def _gc(x: str) -> str:
    return f"(CASE WHEN length({x}) > 0 THEN (length({x}) - length(translate({x}, 'GC', ''))) / length({x}) ELSE 0.0 END)"


def _activity(x: str) -> str:
    seed, run = f"right({x}, 8)", f"coalesce(list_max(list_transform(regexp_extract_all({x}, 'A+|C+|G+|T+'), lambda r: length(r))), 1)"
    kinds = f"len(list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2))))"
    return f"""(CASE WHEN length({x}) = 0 THEN 0.0 ELSE least(greatest(0.35 * greatest(0.0, 1.0 - abs({_gc(x)} - 0.5) / 0.3) + 0.25 * greatest(0.0, 1.0 - abs({_gc(seed)} - 0.5) / 0.5)
      + 0.20 * greatest(0.0, 1.0 - ({run} - 3) / 6.0) + 0.20 * (CASE WHEN length({x}) >= 2 THEN least(1.0, {kinds} / least(16, length({x}) - 1)) ELSE 1.0 END), 0.0), 1.0) END)"""


def _hint(x: str) -> str:
    return f"CASE WHEN {x} < 40 THEN 'low' WHEN {x} > 70 THEN 'high' ELSE 'pass' END"


def _windows(n: int, where: str = "true") -> str:
    return f"SELECT seq_id, pos, substr(seq, pos + 1, {n}) AS w, length(seq) AS total, seq FROM (SELECT seq_id, seq, CAST(unnest(range(0, length(seq) - {n} + 1)) AS BIGINT) AS pos FROM c) WHERE {where}"


def _match(n: int, pattern: str, at: str = "pos + 1") -> str:
    return f"regexp_full_match(substr(seq, {at}, {n}), '{pattern}')"


def _sites(codes: str, flank: int, side: str) -> str:
    n, out = len(codes), []
    for strand, own, before in (("plus", codes, side == "upstream"), ("minus", S.flipped(codes), side != "upstream")):
        p = f"[A-Z]{{{flank}}}{S.pattern(own)}" if before else f"{S.pattern(own)}[A-Z]{{{flank}}}"
        out.append(f"SELECT seq_id, '{strand}' AS strand, pos + {flank if before else 0} AS motif_pos, pos AS window_start, w AS sequence FROM ({_windows(n + flank, _match(n + flank, p))})")
    return " UNION ALL ".join(out)


def _flank(name: str, n: int, m: patterns.Motif, strand: str) -> str:
    before = f"({strand} = '{'plus' if m.side == 'upstream' else 'minus'}')"
    return f"CASE WHEN {before} THEN substr(seq, greatest({name} - {m.flank}, 0) + 1, {name} - greatest({name} - {m.flank}, 0)) ELSE substr(seq, {name} + {n} + 1, {m.flank}) END"


_CTE = {
    "c": "SELECT * FROM (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^acgtACGT]', '', 'g')) AS seq FROM documents) WHERE length(seq) >= 23",
    "sites": _sites("NGG", 20, "downstream"),
    "u": """SELECT 'uniq_' || CAST(row_number() OVER (ORDER BY f) AS VARCHAR) AS qid, sequence, n_positions, positions FROM (SELECT sequence, min((seq_id, CASE WHEN strand = 'plus' THEN 0 ELSE 1 END, motif_pos, window_start)) AS f, count(*) AS n_positions,
      string_agg(seq_id || ':' || strand || ':' || motif_pos || ':' || window_start, ';' ORDER BY seq_id, CASE WHEN strand = 'plus' THEN 0 ELSE 1 END, motif_pos, window_start) AS positions FROM sites GROUP BY sequence)""",
    "g": "SELECT 'g' || CAST(min(seq_id) AS VARCHAR) AS qid, guide FROM (SELECT seq_id, substr(seq, 1, 20) AS guide FROM c WHERE seq_id % 50 = 0) GROUP BY guide",
    "t": f"""SELECT seq_id, pos AS start, '+' AS strand, substr(w, 1, 20) AS target, substr(w, 21, 3) AS pam FROM ({_windows(23, _match(23, '[ACGT]{20}' + S.pattern('NGG')))})
      UNION ALL SELECT seq_id, pos + 3, '-', {_RC.format('substr(w, 4, 20)')}, {_RC.format('substr(w, 1, 3)')} FROM ({_windows(23, _match(23, S.pattern('CCN') + '[ACGT]{20}'))})""",
    "h": f"SELECT qid, guide, seq_id, start, strand, target, pam, CAST(hamming(guide, target) AS INTEGER) AS mismatch FROM g JOIN t ON hamming(guide, target) <= {BUDGET}",
    "mk": f"SELECT seq_id, greatest(pos - 6, 0) AS a, pos + 10 AS b FROM ({_windows(4, _match(4, 'TTTT|AATA'))})",
    "m": """SELECT seq_id, min(a) AS start, max(b) AS "end" FROM (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k
      FROM (SELECT *, max(b) OVER (PARTITION BY seq_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mk)) GROUP BY seq_id, k""",
    "l": " UNION ALL ".join(f"SELECT seq_id, seq, pos AS left_pos, w AS left_motif_seq, '{s}' AS left_strand, {k} AS lo FROM ({_windows(3, _match(3, S.pattern(x)))})" for k, (s, x) in enumerate((("plus", "TGA"), ("minus", S.flipped("TGA"))))),
    "r": " UNION ALL ".join(f"SELECT seq_id, pos AS right_pos, w AS right_motif_seq, '{s}' AS right_strand, {k} AS ro FROM ({_windows(3, _match(3, S.pattern(x)))})" for k, (s, x) in enumerate((("plus", "ACR"), ("minus", S.flipped("ACR"))))),
    "p": f"""SELECT seq_id, CASE WHEN left_strand = 'minus' AND right_strand = 'minus' THEN 'minus' ELSE 'plus' END AS strand, left_strand, right_strand, left_pos, right_pos, right_pos - left_pos - 3 AS gap, right_pos + 3 AS compound_end, left_motif_seq, right_motif_seq,
      {_flank('left_pos', 3, LEFT, 'left_strand')} AS left_flank_seq, {_flank('right_pos', 3, RIGHT, 'right_strand')} AS right_flank_seq
      FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, left_pos, right_pos ORDER BY lo, ro) AS k FROM l JOIN r USING (seq_id) WHERE right_pos BETWEEN left_pos + 7 AND left_pos + 15) WHERE k = 1""",
    "y": f"SELECT seq_id, pos AS y_start, pos + 5 AS y_end, CASE WHEN w = '{CENTRE}' THEN '+' ELSE '-' END AS strand FROM ({_windows(5, _match(5, CENTRE + '|' + S.flipped(CENTRE)))})",
    "b": " UNION ALL ".join(f"SELECT seq_id, seq, pos AS motif_start, w AS motif_seq, '{s}' AS motif_strand FROM ({_windows(3, _match(3, S.pattern(x)))})" for s, x in (("plus", "NGG"), ("minus", "CCN"))),
    "q": f"SELECT seq_id, left_pos, right_pos, gap, round({_activity('left_flank_seq')}, 9) AS left_score, round({_activity('right_flank_seq')}, 9) AS right_score FROM p",
    "units": "SELECT seq_id, pattern, CAST(coalesce(n_sites, 0) AS BIGINT) AS n_sites, md5(seq_id || '/' || pattern) AS unit_id, CASE WHEN coalesce(n_sites, 0) > 0 THEN 'done' ELSE 'empty' END AS status FROM (SELECT seq_id, unnest(['NGG', 'TTTV', 'ACGT']) AS pattern FROM c) LEFT JOIN ("
    + " UNION ALL ".join(f"SELECT seq_id, '{m}' AS pattern, count(*) AS n_sites FROM ({_sites(m, f, s)}) GROUP BY seq_id" for m, f, s in (("NGG", 20, "downstream"), ("TTTV", 12, "upstream"), ("ACGT", 6, "downstream")))
    + ") USING (seq_id, pattern)",
}
_NEEDS = {"u": ["sites"], "h": ["g", "t"], "m": ["mk"], "p": ["l", "r"], "q": ["p"]}


def _sql(names: str, select: str) -> str:
    order: list[str] = ["c"]

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({_CTE[n]})" for n in order) + " " + select


def _seed_mm(n: int, start: int, end: int) -> str:
    return "list_sum([" + ", ".join(f"CAST(substr(guide, {i}, 1) <> substr(target, {i}, 1) AS INTEGER)" for i in range(start, end + 1)) + "])"


def _bulge_sites(n: int) -> str:
    """Targets of n bases beside their PAM, with the border between both."""
    bases, near = f"[ACGT]{{{n}}}", f"substr(w, 1, {n})"
    return f"""SELECT seq_id, pos AS start, pos + {n} AS border, '+' AS strand, {near} AS target, substr(w, {n + 1}, 3) AS pam FROM ({_windows(n + 3, _match(n + 3, bases + S.pattern('NGG')))})
      UNION ALL SELECT seq_id, pos + 3, pos + 3, '-', {_RC.format(f'substr(w, 4, {n})')}, {_RC.format('substr(w, 1, 3)')} FROM ({_windows(n + 3, _match(n + 3, S.pattern('CCN') + bases))})"""


def _skip(x: str) -> str:
    return f"substr({x}, 1, i - 1) || substr({x}, i + 1)"


_BULGES = f"""SELECT *, CASE length(target) WHEN 20 THEN hamming(guide, target) WHEN 19 THEN list_min(list_transform(range(1, 21), lambda i: hamming({_skip('guide')}, target))) ELSE list_min(list_transform(range(1, 22), lambda i: hamming(guide, {_skip('target')}))) END AS mm
  FROM g CROSS JOIN ({' UNION ALL '.join(map(_bulge_sites, (19, 20, 21)))})"""
_RISK = "round(1 - least(left_score, right_score), 6)"
SQL = {
    "bulge_alignments": _sql("g", f"""SELECT qid, guide, seq_id, start, target_end, strand, target, pam, mismatch, indel, rna_bulges, dna_bulges, aligned_guide, aligned_target, bitscore,
      array_to_string(list_transform(regexp_extract_all(array_to_string(list_transform(range(1, length(aligned_guide) + 1), lambda k: CASE WHEN substr(aligned_guide, k, 1) = '-' THEN 'D' WHEN substr(aligned_target, k, 1) = '-' THEN 'I' WHEN substr(aligned_guide, k, 1) = substr(aligned_target, k, 1) THEN 'M' ELSE 'X' END), ''), 'M+|X+|I+|D+'), lambda r: CAST(length(r) AS VARCHAR) || r[1]), '') AS cigar
      FROM (SELECT *, start + length(target) AS target_end, CAST(mm AS INTEGER) AS mismatch, CAST(length(target) <> 20 AS INTEGER) AS indel, CAST(length(target) = 19 AS INTEGER) AS rna_bulges, CAST(length(target) = 21 AS INTEGER) AS dna_bulges, 100.0::DOUBLE - mm * 12 - CASE WHEN length(target) = 20 THEN 0 ELSE 18 END AS bitscore,
        CASE WHEN length(target) = 21 THEN substr(guide, 1, i - 1) || '-' || substr(guide, i) ELSE guide END AS aligned_guide, CASE WHEN length(target) = 19 THEN substr(target, 1, i - 1) || '-' || substr(target, i) ELSE target END AS aligned_target,
        row_number() OVER (PARTITION BY qid, seq_id, strand, border ORDER BY 2 * mm + CASE WHEN length(target) = 20 THEN 0 ELSE 3 END, mm, length(target) <> 20, length(target)) AS k
        FROM (SELECT *, CASE length(target) WHEN 20 THEN 0 WHEN 19 THEN list_position(list_transform(range(1, 21), lambda i: hamming({_skip('guide')}, target)), mm) ELSE list_position(list_transform(range(1, 22), lambda i: hamming(guide, {_skip('target')})), mm) END AS i FROM ({_BULGES})) WHERE mm <= 2) WHERE k = 1"""),
    # All starts and lengths; a gap stands as far to the left as it may.
    "centre_alignments": _sql("g", f"""SELECT * FROM (WITH w AS (SELECT qid, guide, seq_id, pos - 6 AS place FROM ({_windows(8)}) JOIN g ON w = substr(guide, 7, 8) WHERE pos >= 6),
      v AS (SELECT w.*, seq, greatest(place - 1, 0, least(place, length(seq) - 20)) AS centre FROM w JOIN c USING (seq_id)),
      t AS (SELECT v.*, centre + s AS start, n, substr(seq, CAST(centre + s AS INTEGER) + 1, n) AS target FROM v, (VALUES (-1), (0), (1)) x(s), (VALUES (19), (20), (21)) y(n) WHERE centre + s >= greatest(place - 1, 0) AND centre + s + n <= least(length(seq), place + 22)),
      d AS (SELECT *, CASE n WHEN 20 THEN [hamming(guide, target)] WHEN 19 THEN list_transform(range(1, 21), lambda i: hamming({_skip('guide')}, target)) ELSE list_transform(range(1, 22), lambda i: hamming(guide, {_skip('target')})) END AS h FROM t),
      b AS (SELECT *, list_min(h) AS mm, list_position(h, list_min(h)) AS i, row_number() OVER (PARTITION BY qid, seq_id, place ORDER BY 2 * list_min(h) + CASE WHEN n = 20 THEN 0 ELSE 3 END, list_min(h), n <> 20, abs(start - centre), start, n) AS k FROM d WHERE list_min(h) <= 2),
      a AS (SELECT *, CASE WHEN n = 21 THEN substr(guide, 1, i - 1) || '-' || substr(guide, i) ELSE guide END AS ag, CASE WHEN n = 19 THEN substr(target, 1, i - 1) || '-' || substr(target, i) ELSE target END AS tg FROM b WHERE k = 1),
      e AS (SELECT *, NOT contains(substr(ag, CASE WHEN n = 21 THEN 18 ELSE 17 END), '-') AND regexp_matches(right(tg, 3), '^[ACGT][ACGT]G$') AS ok FROM a)
      SELECT qid, guide, seq_id, place, start, start + n AS target_end, CAST(mm AS INTEGER) AS mismatch, CAST(n = 19 AS INTEGER) AS rna_bulges, CAST(n = 21 AS INTEGER) AS dna_bulges, ag AS aligned_guide, tg AS aligned_target, ok AS embedded_pam, CASE WHEN ok THEN start + n - 3 END AS pam_place FROM e)"""),
    # With one bulge: leave out each base of the longer one in turn.
    "bulge_hits": _sql("g", f"""SELECT qid, guide, seq_id, start, start + length(target) AS target_end, strand, target, pam, CAST(mm AS INTEGER) AS mismatch, CAST(length(target) = 19 AS INTEGER) AS rna_bulges, CAST(length(target) = 21 AS INTEGER) AS dna_bulges,
      100.0::DOUBLE - mm * 12 - CASE WHEN length(target) = 20 THEN 0 ELSE 18 END AS bitscore FROM (SELECT *, row_number() OVER (PARTITION BY qid, seq_id, strand, border ORDER BY 2 * mm + CASE WHEN length(target) = 20 THEN 0 ELSE 3 END, mm, length(target) <> 20, length(target)) AS k FROM ({_BULGES}) WHERE mm <= 2) WHERE k = 1"""),
    "contig_summary": _sql("", f"SELECT seq_id, length(seq) AS n_bases, round({_gc('seq')} * 100, 6) AS gc_percent, CAST(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda r: length(r))) AS BIGINT) AS longest_run, CAST(len(list_distinct(list_transform(range(1, length(seq)), lambda i: substr(seq, i, 2)))) AS BIGINT) AS dinucleotides, {_RC.format('substr(seq, 1, 30)')} AS head_flipped, {_hint(_gc('seq') + ' * 100')} AS gc_hint FROM c"),
    "kmer_postings": _sql("", f"SELECT w AS kmer, CAST(list_sum(list_transform(range(0, 8), lambda i: CAST(pow(4, 7 - i) AS BIGINT) * (instr('ACGT', substr(w, i + 1, 1)) - 1))) AS BIGINT) AS code, count(*) AS n, min((seq_id, pos))[1] AS first_seq_id, min((seq_id, pos))[2] AS first_pos FROM ({_windows(8)}) GROUP BY w"),
    "single_motif_sites": _sql("sites", "SELECT * FROM sites"),
    "unique_sites": _sql("u", "SELECT * FROM u"),
    "scored_sites": _sql("u", f"SELECT *, row_number() OVER (ORDER BY score DESC, CAST(substr(qid, 6) AS BIGINT)) AS rank FROM (SELECT qid, sequence, n_positions, round({_gc('sequence')} * 100, 6) AS gc_percent, {_hint('round(' + _gc('sequence') + ' * 100, 6)')} AS gc_hint, round({_activity('sequence')}, 9) AS score FROM u)"),
    "search_hits": _sql("h", "SELECT * FROM h"),
    "top_hits": _sql("h", "SELECT *, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY mismatch, seq_id, start, strand) AS k FROM h) WHERE k <= 5").replace("SELECT *, CAST(k", "SELECT qid, guide, seq_id, start, strand, target, pam, mismatch, CAST(k"),
    "guide_summary": _sql("h", f"""SELECT qid, guide, {', '.join(f'CAST(coalesce(mm{k}, 0) AS BIGINT) AS mm{k}' for k in range(6))},
      round({' + '.join(f'coalesce({" + ".join(f"mm{j}" for j in range(k + 1))}, 0) * {10.0 ** (1 - k)}' for k in range(6))}, 6) AS legacy_score,
      round(1 / (1 + CASE WHEN coalesce(best, 0) >= 0.999999 THEN greatest(0.0, total - 1) ELSE coalesce(total, 0) END), 6) AS specificity, round(1 / (1 + CASE WHEN coalesce(seed_best, 0) >= 0.999999 THEN greatest(0.0, seed_total - 1) ELSE coalesce(seed_total, 0) END), 6) AS seed_specificity
      FROM g LEFT JOIN (SELECT qid, {', '.join(f'count(*) FILTER (mismatch = {k}) AS mm{k}' for k in range(6))}, sum(a) AS total, max(a) AS best, sum(a * pow(0.25, s)) AS seed_total, max(a * pow(0.25, s)) AS seed_best
      FROM (SELECT *, (20 - mismatch) / 20 AS a, {_seed_mm(20, 13, 20)} AS s FROM h) GROUP BY qid) USING (qid)"""),
    "merged_intervals": _sql("m", "SELECT * FROM m"),
    "masked_hits": _sql("h m", 'SELECT qid, seq_id, start, strand, mismatch FROM h WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.seq_id = h.seq_id AND h.start >= m.start AND h.start < m."end")'),
    "forbidden_hits": _sql("h m", 'SELECT seq_id, start, strand, min(mismatch) AS mismatch, count(*) AS n_guides FROM h WHERE EXISTS (SELECT 1 FROM m WHERE m.seq_id = h.seq_id AND h.start >= m.start AND h.start < m."end") GROUP BY ALL'),
    "gap_pairs": _sql("p", "SELECT * FROM p"),
    "centre_sites": _sql("y", "SELECT * FROM y"),
    "centre_flanks": _sql("y b", f"SELECT y.seq_id, y_start, strand, motif_start, motif_strand, motif_seq, motif_start - y_end AS distance, {_flank('motif_start', 3, BESIDE, 'motif_strand')} AS flank_seq FROM y JOIN b ON y.seq_id = b.seq_id AND motif_start >= y_end AND motif_start < y_end + 25"),
    "pair_ranking": _sql("q", f"""SELECT seq_id, left_pos, right_pos, left_score, right_score, round(lp, 9) AS left_percentile, round(rp, 9) AS right_percentile, tier, risk_class, CAST(rank() OVER (PARTITION BY seq_id ORDER BY tier, risk_class, least(left_score, right_score) DESC, gap) AS INTEGER) AS pair_rank
      FROM (SELECT *, (rank() OVER (ORDER BY left_score) + (count(*) OVER (PARTITION BY left_score) - 1) / 2) / count(*) OVER () AS lp, (rank() OVER (ORDER BY right_score) + (count(*) OVER (PARTITION BY right_score) - 1) / 2) / count(*) OVER () AS rp,
      CASE WHEN least(left_score, right_score) >= 0.8 THEN 'A' WHEN greatest(left_score, right_score) >= 0.5 THEN 'B' ELSE 'C' END AS tier,
      CASE WHEN {_RISK} <= 0.4 AND round({_RISK} / 2, 6) <= 0.2 AND {_RISK} < 0.7 THEN 0 WHEN {_RISK} <= 0.8 AND round({_RISK} / 2, 6) <= 0.45 THEN 1 ELSE 2 END AS risk_class FROM q)"""),
    "hit_annotations": _sql("h", f"""SELECT qid, seq_id, strand, pos, nearest, pos - nearest AS distance FROM (SELECT qid, h.seq_id, strand, start AS pos, (SELECT arg_min(z.pos, (abs(z.pos - h.start), z.pos)) FROM ({_windows(3, _match(3, 'ATG'))}) z WHERE z.seq_id = h.seq_id) AS nearest FROM h)"""),
    "batch_units": _sql("units", "SELECT * FROM units"),
    "batch_status": _sql("units", "SELECT pattern, status, count(*) AS n_units, CAST(sum(n_sites) AS BIGINT) AS n_sites FROM units GROUP BY ALL"),
    "bed_lines": _sql("sites", "SELECT concat_ws(chr(9), seq_id, window_start, window_start + length(sequence), seq_id || ':' || motif_pos, '0', CASE WHEN strand = 'plus' THEN '+' ELSE '-' END) AS line FROM sites"),
    "fasta_lines": _sql("u", "SELECT '>' || qid || chr(10) || sequence AS line FROM u"),
}
