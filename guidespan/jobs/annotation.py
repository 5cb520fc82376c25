"""Queries of annotation, and their SQL.

The test tables hold no annotation, so lines are made from the contigs: a gene over each of 60 bases or more, on the plus strand where the
id is even; its first transcript (tagged) of two exons and coding parts, and a second, shorter one that names an unknown parent first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from guidespan.jobs import queries as Q
from guidespan.operators import annotate
from guidespan.operators.lineage import cut
from guidespan.sources import annotation as A

_PARTS = (
    ("gene", "1", "n", "'ID=g' || seq_id || ';gene=G' || seq_id || ';locus_tag=L' || seq_id"),
    ("mRNA", "1", "n", "'ID=t' || seq_id || 'a;Parent=g' || seq_id || ';Name=T' || seq_id || 'a;tag=MANE Select'"),
    ("mRNA", "n div 4", "n", "'ID=t' || seq_id || 'b;Parent=missing,g' || seq_id"),
    ("exon", "1", "n div 3", "'Parent=t' || seq_id || 'a'"),
    ("exon", "n div 2", "n", "'Parent=t' || seq_id || 'a'"),
    ("CDS", "n div 6 + 1", "n div 3", "'Parent=t' || seq_id || 'a'"),
    ("CDS", "n div 2", "n - n div 6", "'Parent=t' || seq_id || 'a'"),
    ("exon", "n div 4", "n", "'Parent \"t' || seq_id || 'b\"'"),
    ("CDS", "n div 3", "n div 2", "'Parent=t' || seq_id || 'b'"),
)


def gff_lines(spark, sf_dir):
    """(value): annotation lines."""
    rows = Q.contigs(spark, sf_dir).select(F.col("seq_id").cast("string").alias("seq_id"), F.length("seq").alias("n"), F.when(F.col("seq_id") % 2 == 0, "+").otherwise("-").alias("strand")).where("n >= 60")
    line = lambda kind, a, b, attrs: f"concat_ws('\\t', seq_id, 'made', '{kind}', {a}, {b}, '.', strand, '.', {attrs})".replace('"', '\\"')
    return rows.select(F.explode(F.array(*(F.expr(line(*p)) for p in _PARTS))).alias("value"))


def _parsed(spark, sf_dir):
    """The lines' rows, taken apart once: genes, transcripts and parts are each read from them, several times."""
    return cut(A.parsed(gff_lines(spark, sf_dir)).withColumn("seq_id", F.col("seq_id").cast("long")))


def _sites(spark, sf_dir):
    """Intervals of the sites of the motif, as (seq_id, start, end, strand)."""
    return Q.single_motif_sites(spark, sf_dir).select("seq_id", F.col("window_start").alias("start"), (F.col("window_start") + F.length("sequence")).alias("end"), "strand").distinct()


def gff_features(spark, sf_dir):
    """Features with their genes and transcripts, those that follow from others among them."""
    return annotate.features(_parsed(spark, sf_dir)).select("seq_id", "type", "start", "end", "strand", "gene", "locus_tag", "transcript_id", "transcript_name", "mane")


def inferred_utrs(spark, sf_dir):
    return annotate.utrs(annotate.parts(_parsed(spark, sf_dir)))


def chosen_transcripts(spark, sf_dir):
    return annotate.chosen(annotate.transcripts(_parsed(spark, sf_dir)))


def annotated_sites(spark, sf_dir):
    """Sites with what lies there; on contigs without annotation the feature is empty."""
    rows = annotate.overlaps(_sites(spark, sf_dir), cut(annotate.features(_parsed(spark, sf_dir))))  # read twice
    return rows.fillna("", ["feature"])


def nearest_starts(spark, sf_dir):
    """Sites with the nearest start of a transcript."""
    rows = annotate.nearest_start(_sites(spark, sf_dir), annotate.transcripts(_parsed(spark, sf_dir)))
    return rows.fillna(-1, ["tss", "tss_distance"]).fillna("", ["tss_transcript", "tss_gene"])


def downstream_starts(spark, sf_dir):
    """Sites with the next start codon within 500 bases in their direction; -1 without one."""
    return annotate.downstream_atg(_sites(spark, sf_dir), Q.contigs(spark, sf_dir)).fillna(-1, ["atg"])


QUERIES = {f.__name__: f for f in (gff_features, inferred_utrs, chosen_transcripts, annotated_sites, nearest_starts, downstream_starts)}

# SQL: from the places of the parts themselves, without lines.

_N = "SELECT seq_id, length(seq) AS n, CASE WHEN seq_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM c WHERE length(seq) >= 60"
_TRANSCRIPTS = """SELECT 't' || seq_id || 'a' AS transcript_id, 'T' || seq_id || 'a' AS transcript_name, 0 AS mane, seq_id, 1 AS a, n AS b, strand FROM n
  UNION ALL SELECT 't' || seq_id || 'b', 't' || seq_id || 'b', 2, seq_id, n // 4, n, strand FROM n"""
_CODING = "SELECT 't' || seq_id || 'a' AS transcript_id, seq_id, strand, 1 AS a, n // 6 + 1 AS b, n - n // 6 AS c, n AS d FROM n UNION ALL SELECT 't' || seq_id || 'b', seq_id, strand, n // 4, n // 3, n // 2, n FROM n"
_UTRS = """SELECT seq_id, CASE WHEN strand = '+' THEN 'five_prime_UTR' ELSE 'three_prime_UTR' END AS type, a AS start, b - 1 AS "end", strand, transcript_id FROM coding WHERE a < b
  UNION ALL SELECT seq_id, CASE WHEN strand = '+' THEN 'three_prime_UTR' ELSE 'five_prime_UTR' END, c + 1, d, strand, transcript_id FROM coding WHERE c < d"""
_FEATURES = "SELECT seq_id, 'gene' AS type, 1 AS start, n AS \"end\", strand, 'G' || seq_id AS gene, 'L' || seq_id AS locus_tag, '' AS transcript_id, '' AS transcript_name, 2 AS mane FROM n UNION ALL SELECT p.seq_id, type, p.start, p.\"end\", p.strand, 'G' || p.seq_id, 'L' || p.seq_id, transcript_id, transcript_name, mane FROM (" + " UNION ALL ".join(
    ["SELECT seq_id, 'mRNA' AS type, a AS start, b AS \"end\", strand, transcript_id FROM transcripts", "SELECT * FROM utrs"]
    + [f"SELECT seq_id, '{kind}', {a.replace('div', '//')}, {b.replace('div', '//')}, strand, 't' || seq_id || '{'b' if 'b' in attrs[-7:] else 'a'}' FROM n" for kind, a, b, attrs in _PARTS[3:]]
) + ") p JOIN transcripts USING (transcript_id)"
_RANK = "CASE WHEN type = 'CDS' THEN 0 WHEN type = 'exon' THEN 1 WHEN type LIKE '%UTR' THEN 2 ELSE 3 END"
_POINTS = 'SELECT DISTINCT seq_id, window_start AS start, window_start + length(sequence) AS "end", strand FROM sites'


def _sql(select: str) -> str:
    more = f"n AS ({_N}), transcripts AS ({_TRANSCRIPTS}), coding AS ({_CODING}), utrs AS ({_UTRS}), features AS ({_FEATURES}), points AS ({_POINTS}) "
    return Q._sql("sites", "").rstrip() + ", " + more + select


_NEAR = """SELECT p.*, r.* FROM points p LEFT JOIN (SELECT q.seq_id AS sid, q.start AS s, q."end" AS e, arg_min((a, d, t, g), (abs(a - q.start - ("end" - start) // 2 - 1), mane, t)) AS f FROM
  (SELECT DISTINCT seq_id, start, "end" FROM points) q JOIN (SELECT seq_id AS k, CASE WHEN strand = '+' THEN a ELSE b END AS a, CASE WHEN strand = '+' THEN 1 ELSE -1 END AS d, transcript_id AS t, 'G' || seq_id AS g, mane FROM transcripts) z ON q.seq_id = z.k GROUP BY ALL) r ON p.seq_id = sid AND p.start = s AND p."end" = e"""
SQL = {
    "gff_features": _sql("SELECT * FROM features"),
    "inferred_utrs": _sql("SELECT * FROM utrs"),
    "chosen_transcripts": _sql("SELECT 'g' || seq_id AS gene_key, transcript_id, seq_id, a AS start, b AS \"end\", strand, mane FROM transcripts WHERE mane = 0"),
    "annotated_sites": _sql(f"""SELECT p.seq_id, p.start, p."end", coalesce(feature, CASE WHEN n IS NULL THEN '' ELSE 'intergenic' END) AS feature, coalesce(gene, '') AS gene, coalesce(locus_tag, '') AS locus_tag, coalesce(transcript_id, '') AS transcript_id, coalesce(o.strand, '') AS strand, coalesce(isoforms, '') AS isoforms
      FROM (SELECT DISTINCT seq_id, start, "end" FROM points) p LEFT JOIN n USING (seq_id) LEFT JOIN (SELECT seq_id, start, "end", CASE WHEN min(r) < 3 THEN arg_min(type, k) ELSE 'intron' END AS feature, arg_min(gene, k) AS gene, arg_min(locus_tag, k) AS locus_tag, arg_min(transcript_id, k) AS transcript_id, arg_min(strand, k) AS strand,
      string_agg(transcript_name || CASE WHEN mane = 0 THEN '(MANE)' ELSE '' END || '(' || type || ')', ',' ORDER BY k) FILTER (transcript_id <> '') AS isoforms
      FROM (SELECT p.seq_id, p.start, p."end", type, gene, locus_tag, transcript_id, f.strand, transcript_name, mane, {_RANK} AS r, ({_RANK}, f.start, f."end", transcript_id) AS k, row_number() OVER (PARTITION BY p.seq_id, p.start, p."end", transcript_id ORDER BY {_RANK}, f.start, f."end") AS i
      FROM (SELECT DISTINCT seq_id, start, "end" FROM points) p JOIN features f ON p.seq_id = f.seq_id AND p.start + 1 <= f."end" AND p."end" >= f.start) WHERE i = 1 GROUP BY seq_id, start, "end") o ON p.seq_id = o.seq_id AND p.start = o.start AND p."end" = o."end\""""),
    "nearest_starts": _sql(f"""SELECT seq_id, start, "end", strand, coalesce(f[1], -1) AS tss, coalesce(f[2] * (start + ("end" - start) // 2 + 1 - f[1]), -1) AS tss_distance, coalesce(f[3], '') AS tss_transcript, coalesce(f[4], '') AS tss_gene FROM ({_NEAR})"""),
    "downstream_starts": _sql("""SELECT p.seq_id, start, "end", strand, CASE WHEN strand = 'plus' THEN CASE WHEN instr(substr(seq, "end" + 1, 500), 'ATG') > 0 THEN "end" + instr(substr(seq, "end" + 1, 500), 'ATG') - 1 ELSE -1 END
      ELSE CASE WHEN instr(reverse(substr(seq, greatest(start - 500, 0) + 1, start - greatest(start - 500, 0))), 'TAC') > 0 THEN start - instr(reverse(substr(seq, greatest(start - 500, 0) + 1, start - greatest(start - 500, 0))), 'TAC') + 1 ELSE -1 END END AS atg FROM points p JOIN c USING (seq_id)"""),
}
