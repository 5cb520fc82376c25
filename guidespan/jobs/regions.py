"""Queries of regions of genes, of both sides of a centre and of the agreement of searches, and their SQL.

Annotation is made from the contigs, as in the queries of annotation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from guidespan.functions import seq as S
from guidespan.jobs import annotation
from guidespan.jobs import queries as Q
from guidespan.operators import export, patterns, regions, search, sides
from guidespan.operators.lineage import cut

LEFT = sides.Side(Q.BESIDE, 0, 25)
RIGHT = sides.Side(patterns.Motif("TGA", 8, "downstream"), 2, 30)
BEST = {"left": 6, "right": 10}
BOUNDS = {"left": (1, 20), "right": (4, None)}
PAD = 30


def region_sequences(spark, sf_dir):
    """All regions of all genes."""
    return regions.of_genes(annotation._parsed(spark, sf_dir), Q.contigs(spark, sf_dir))


def region_lines(spark, sf_dir):
    """Exons of all genes as records: each gene's own, joined."""
    rows = regions.of_genes(annotation._parsed(spark, sf_dir), Q.contigs(spark, sf_dir), "exons")
    return export.fasta(rows.withColumn("name", F.concat_ws("-", "gene", "region")), "name", "sequence")


def padded_masks(spark, sf_dir):
    """The masked stretches and the bases around them."""
    held = Q.contigs(spark, sf_dir)
    named = Q.masks(held).withColumn("name", F.concat_ws(":", F.col("seq_id").cast("string"), F.col("start").cast("string"))).withColumn("strand", F.lit("+"))
    return regions.padded(named, held, PAD)


def self_complementarity(spark, sf_dir):
    """Distinct sites with their longest inverted repeat."""
    rows = Q.single_motif_sites(spark, sf_dir).select("sequence").distinct().withColumn("self_comp", S.inverted_repeat(F.col("sequence")))
    return rows.withColumn("self_comp_hint", S.repeat_hint(F.col("self_comp")))


def _sides(spark, sf_dir):
    held = Q.contigs(spark, sf_dir)
    return sides.candidates(held, patterns.centres(held, Q.CENTRE, sides.reach(LEFT, RIGHT)), LEFT, RIGHT)


def side_candidates(spark, sf_dir):
    rows = sides.shown(_sides(spark, sf_dir), Q.contigs(spark, sf_dir), 64)
    return rows.select("seq_id", "y_start", "strand", "side", "motif_start", "motif_strand", "motif_seq", "distance", "full_start", "full_end", "sequence", "region_seq")


def side_pairs(spark, sf_dir):
    """Each centre with its best candidate of either side, and why the two can't go together."""
    rows = sides.paired(_sides(spark, sf_dir), BEST).withColumn("c", sides.compatibility(F.col("left"), F.col("right"), BOUNDS))
    own = lambda side: [F.coalesce(F.col(f"{side}.{c}").cast("long"), F.lit(-1).cast("long")).alias(f"{side}_{c}") for c in ("motif_start", "distance_score")]
    return rows.select("seq_id", "y_start", "strand", *own("left"), *own("right"), F.col("c.hard_fail").alias("hard_fail"), F.array_join("c.hard_reasons", ";").alias("hard_reasons"))


def search_recall(spark, sf_dir):
    """Per guide, what a search of one mismatch at most finds of what the full one does."""
    held = Q.contigs(spark, sf_dir)
    own, sites = cut(Q.guides(held)), cut(search.beside_pam(held, 20))  # read by both searches
    rows = sides.recall({"full": search.search_sites(sites, own, 20, Q.BUDGET), "narrow": search.search_sites(sites, own, 20, 1)}, "full")
    return rows.select("qid", "reference", "full", "narrow", F.round("full_recall", 9).alias("full_recall"), F.round("narrow_recall", 9).alias("narrow_recall"))


QUERIES = {f.__name__: f for f in (region_sequences, region_lines, padded_masks, self_complementarity, side_candidates, side_pairs, search_recall)}

_PIECES = """SELECT seq_id, strand, 'gene' AS region, 1 AS a, n AS b FROM n
  UNION ALL SELECT seq_id, strand, unnest(['exons', CASE WHEN strand = '+' THEN 'exon1' ELSE 'exon2' END]), 1, n // 3 FROM n
  UNION ALL SELECT seq_id, strand, unnest(['exons', CASE WHEN strand = '+' THEN 'exon2' ELSE 'exon1' END]), n // 2, n FROM n
  UNION ALL SELECT seq_id, strand, unnest(['introns', 'intron1']), n // 3 + 1, n // 2 - 1 FROM n
  UNION ALL SELECT seq_id, strand, CASE WHEN type = 'five_prime_UTR' THEN '5utr' ELSE '3utr' END, start, "end" FROM utrs WHERE transcript_id LIKE '%a'"""
_REGIONS = f"""SELECT 'g' || seq_id AS gene_key, 'G' || seq_id AS gene, region, strand, CAST(n_parts AS INTEGER) AS n_parts, CASE WHEN strand = '-' THEN {Q._RC.format('s')} ELSE s END AS sequence
  FROM (SELECT seq_id, region, strand, count(*) AS n_parts, string_agg(substr(seq, a, b - a + 1), '' ORDER BY a) AS s FROM ({_PIECES}) JOIN c USING (seq_id) GROUP BY ALL)"""


def _side(name: str, motifs: str, side: sides.Side) -> str:
    """Candidates of one side; motifs gives (seq_id, seq, motif_start, motif_seq, motif_strand)."""
    n, flank = len(side.motif.codes), side.motif.flank
    after = f"strand = '{'-' if name == 'left' else '+'}'"
    before = f"motif_strand = '{'plus' if side.motif.side == 'upstream' else 'minus'}'"
    return f"""SELECT seq_id, seq, y_start, y_end, strand, '{name}' AS side, motif_start, motif_strand, motif_seq,
      CASE WHEN {after} THEN motif_start - y_end ELSE y_start - motif_start - {n} END AS distance,
      CASE WHEN {before} THEN greatest(motif_start - {flank}, 0) ELSE motif_start END AS full_start,
      CASE WHEN {before} THEN motif_start + {n} ELSE least(length(seq), motif_start + {n + flank}) END AS full_end
      FROM y JOIN ({motifs}) USING (seq_id)
      WHERE CASE WHEN {after} THEN motif_start - y_end ELSE y_start - motif_start - {n} END BETWEEN {side.nearest} AND {side.farthest}"""


_SIDES = _side("left", "SELECT * FROM b", LEFT) + " UNION ALL " + _side("right", "SELECT seq_id, seq, left_pos AS motif_start, left_motif_seq AS motif_seq, left_strand AS motif_strand FROM l", RIGHT)
_SHOWN = """substr(seq, least(full_start, y_start) + 1, y_start - least(full_start, y_start)) || lower(substr(seq, y_start + 1, y_end - y_start))
  || substr(seq, y_end + 1, greatest(full_end, y_end) - y_end)"""
_TARGET = f"abs(distance - CASE WHEN side = 'left' THEN {BEST['left']} ELSE {BEST['right']} END)"
_BEST = f"""SELECT seq_id, y_start, strand, arg_min(motif_start, k) FILTER (side = 'left') AS lm, arg_min(d, k) FILTER (side = 'left') AS ld, arg_min(distance, k) FILTER (side = 'left') AS la,
  arg_min(motif_start, k) FILTER (side = 'right') AS rm, arg_min(d, k) FILTER (side = 'right') AS rd, arg_min(distance, k) FILTER (side = 'right') AS ra
  FROM (SELECT *, {_TARGET} AS d, ({_TARGET}, distance, motif_start, motif_strand) AS k FROM ({_SIDES})) GROUP BY ALL"""
_WHY = """concat_ws(';', CASE WHEN lm IS NULL THEN 'missing_side:left' END, CASE WHEN rm IS NULL THEN 'missing_side:right' END,
  CASE WHEN la IS NULL THEN 'distance_missing:left' WHEN la < 1 THEN 'distance_below_min:left:' || CAST(la AS DOUBLE) WHEN la > 20 THEN 'distance_above_max:left:' || CAST(la AS DOUBLE) END,
  CASE WHEN ra IS NULL THEN 'distance_missing:right' WHEN ra < 4 THEN 'distance_below_min:right:' || CAST(ra AS DOUBLE) END)"""
_MEETS = f"len(list_filter(range(1, length(sequence) - 2 * l + 2), lambda i: instr(substr(sequence, i + l), {Q._RC.format('substr(sequence, i, l)')}) > 0)) > 0"
SQL = {
    "region_sequences": annotation._sql(_REGIONS),
    "region_lines": annotation._sql(f"SELECT '>' || gene || '-exons' || chr(10) || sequence AS line FROM ({_REGIONS}) WHERE region = 'exons'"),
    "padded_masks": Q._sql("m", f"""SELECT seq_id, seq_id || ':' || start AS region, greatest(start - {PAD}, 0) AS start, least("end" + {PAD}, length(seq)) AS "end", '+' AS strand,
      substr(seq, greatest(start - {PAD}, 0) + 1, least("end" + {PAD}, length(seq)) - greatest(start - {PAD}, 0)) AS sequence FROM m JOIN c USING (seq_id)"""),
    "self_complementarity": Q._sql("sites", f"""SELECT sequence, CAST(k AS INTEGER) AS self_comp, CASE WHEN k <= 4 THEN 'pass' ELSE 'warn' END AS self_comp_hint
      FROM (SELECT sequence, coalesce(list_max(list_filter(range(3, length(sequence) // 2 + 1), lambda l: {_MEETS})), 0) AS k FROM (SELECT DISTINCT sequence FROM sites))"""),
    "side_candidates": Q._sql("y b l", f"SELECT seq_id, y_start, strand, side, motif_start, motif_strand, motif_seq, distance, full_start, full_end, substr(seq, full_start + 1, full_end - full_start) AS sequence, {_SHOWN} AS region_seq FROM ({_SIDES})"),
    "side_pairs": Q._sql("y b l", f"""SELECT seq_id, y_start, strand, coalesce(lm, -1) AS left_motif_start, coalesce(ld, -1) AS left_distance_score, coalesce(rm, -1) AS right_motif_start, coalesce(rd, -1) AS right_distance_score, why <> '' AS hard_fail, why AS hard_reasons
      FROM (SELECT *, {_WHY} AS why FROM ({_BEST}))"""),
    "search_recall": Q._sql("h", 'SELECT qid, count(*) AS reference, count(*) AS "full", count(*) FILTER (mismatch <= 1) AS narrow, 1.0::DOUBLE AS full_recall, round(count(*) FILTER (mismatch <= 1) / count(*), 9) AS narrow_recall FROM h GROUP BY qid'),
}
