"""Genes, transcripts and their parts: the chain of parents, untranslated regions, and what lies at or near an interval.

Features are closed and count from 1; intervals of queries are half-open and count from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidespan.operators import intervals
from guidespan.sources.annotation import attribute
from guidespan.sources.contigs import fetch

#: The types that count as genes and as transcripts.
GENES = ("gene", "pseudogene", "ncRNA_gene", "rRNA_gene", "tRNA_gene")
TRANSCRIPTS = ("mRNA", "transcript", "primary_transcript", "lnc_RNA", "ncRNA", "miRNA", "tRNA", "rRNA", "snoRNA", "snRNA", "antisense_RNA", "misc_RNA", "guide_RNA", "telomerase_RNA", "vault_RNA", "Y_RNA", "RNase_P_RNA", "RNase_MRP_RNA", "C_gene_segment", "V_gene_segment", "D_gene_segment", "J_gene_segment")
#: Tags of the transcripts whose regions are preferred, in order.
TAGS = ("MANE", "RefSeq", "APPRIS P1")
#: Bases of a bin of features: a gene is in few bins, and a bin holds few genes.
BIN = 4096


def _with_parent(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows (with parents, a list of ids) joined with the first parent that is known; rows without one are left out, equal rows are one."""
    own = [c for c in rows.columns if c != "parents"]
    met = rows.select(*rows.columns, F.posexplode("parents").alias("_n", key)).join(parents, key)
    more = [c for c in parents.columns if c != key]
    best = met.groupBy(*rows.columns).agg(F.min_by(F.struct(key, *more), "_n").alias("_best"))
    return best.select(*own, "_best.*")


def genes(parsed: DataFrame) -> DataFrame:
    a = F.col("attrs")
    rows = parsed.where(F.col("type").isin(*GENES)).withColumn("gene_key", attribute(a, "ID", "gene_id")).where("gene_key is not null")
    return rows.select("gene_key", "seq_id", "start", "end", "strand", F.coalesce(attribute(a, "gene", "Name", "gene_name", "locus_tag"), F.lit("")).alias("gene"), F.coalesce(attribute(a, "locus_tag"), F.lit("")).alias("locus_tag"))


def transcripts(parsed: DataFrame) -> DataFrame:
    """(transcript_id, seq_id, start, end, strand, transcript_name, mane, tag_rank, gene_key, gene, locus_tag); mane: 0, 1 or, without a tag, 2.

    tag_rank is the place among TAGS of the first of the line's tags that is there. The id is the line's ID. The parent may stand before or after its children.
    """
    a = F.col("attrs")
    tags = F.translate(F.coalesce(attribute(a, "tag"), F.lit("")), "_", " ")
    mane = F.when(tags.contains("MANE Select"), 0).when(tags.contains("MANE Plus Clinical"), 1).otherwise(2)
    listed = F.transform(F.split(F.coalesce(attribute(a, "tag"), F.lit("")), ","), F.trim)
    tag_rank = F.coalesce(*(F.when(F.array_contains(listed, tag), i) for i, tag in enumerate(TAGS)), F.lit(len(TAGS)))
    rows = parsed.where(F.col("type").isin(*TRANSCRIPTS)).select(attribute(a, "ID", "transcript_id").alias("transcript_id"), "seq_id", "start", "end", "strand", attribute(a, "Name", "ID", "transcript_id").alias("transcript_name"), mane.alias("mane"), tag_rank.alias("tag_rank"), F.split(attribute(a, "Parent"), ",").alias("parents"))
    known = genes(parsed).groupBy("gene_key").agg(F.min(F.struct("gene", "locus_tag")).alias("_g")).select("gene_key", "_g.*")
    return _with_parent(rows.where("transcript_id is not null"), known, "gene_key")


def parts(parsed: DataFrame) -> DataFrame:
    """Exons, coding and untranslated parts (type, part_start, part_end) with their transcript's columns."""
    kind = F.when(F.col("type").isin("5'UTR", "3'UTR"), "exon").otherwise(F.col("type"))
    rows = parsed.where(F.col("type").isin("exon", "CDS", "five_prime_UTR", "three_prime_UTR", "5'UTR", "3'UTR")).select(kind.alias("type"), F.col("start").alias("part_start"), F.col("end").alias("part_end"), F.split(attribute(F.col("attrs"), "Parent"), ",").alias("parents"))
    return _with_parent(rows, transcripts(parsed), "transcript_id")


def utrs(parts: DataFrame) -> DataFrame:
    """(seq_id, type, start, end, strand, transcript_id): what the exons of a transcript hold before and after its coding part.

    Transcripts without exons, coding parts or strand have none.
    """
    own = ("transcript_id", "seq_id", "strand")
    at = lambda f, c, kind: f(F.when(F.col("type") == kind, F.col(c)))
    ends = parts.groupBy(*own).agg(at(F.min, "part_start", "exon").alias("a"), at(F.max, "part_end", "exon").alias("d"), at(F.min, "part_start", "CDS").alias("b"), at(F.max, "part_end", "CDS").alias("c")).where("strand in ('+', '-')")
    both = ends.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("start"), (F.col("b") - 1).alias("end")), F.struct(F.lit(1).alias("side"), (F.col("c") + 1).alias("start"), F.col("d").alias("end")))).alias("u"))
    five = (F.col("u.side") == 0) == (F.col("strand") == "+")
    return both.select("seq_id", F.when(five, "five_prime_UTR").otherwise("three_prime_UTR").alias("type"), "u.start", "u.end", "strand", "transcript_id").where("start <= end")


def features(parsed: DataFrame) -> DataFrame:
    """All features, untranslated regions that follow from exons and coding parts among them, with gene and transcript."""
    out = ("seq_id", "type", "start", "end", "strand", "gene", "locus_tag", "transcript_id", "transcript_name", "mane")
    held, known = parts(parsed), transcripts(parsed)
    rows = genes(parsed).select("seq_id", F.lit("gene").alias("type"), "start", "end", "strand", "gene", "locus_tag", F.lit("").alias("transcript_id"), F.lit("").alias("transcript_name"), F.lit(2).alias("mane"))
    rows = rows.unionByName(known.withColumn("type", F.lit("mRNA")).select(*out))
    rows = rows.unionByName(held.withColumn("start", F.col("part_start")).withColumn("end", F.col("part_end")).select(*out))
    named = known.select("transcript_id", "gene", "locus_tag", "transcript_name", "mane")
    return rows.unionByName(utrs(held).join(named, "transcript_id").select(*out))


def overlaps(points: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, gene, locus_tag, transcript_id, strand, isoforms) at each distinct interval (seq_id, start, end) of the points.

    Coding parts go before exons, these before untranslated regions, these before the rest, which is an intron; then the first by place.
    isoforms: the first six transcripts there. Without a feature: intergenic; on a sequence without any annotation: null.
    """
    points = points.select("seq_id", "start", "end").where("start < end").distinct()
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN), F.floor(b / BIN)))
    rank = F.when(F.col("type") == "CDS", 0).when(F.col("type") == "exon", 1).when(F.col("type").like("%UTR"), 2).otherwise(3)
    marks = features.select(F.col("seq_id").alias("_seq"), (F.col("start") - 1).alias("_from"), F.col("end").alias("_to"), F.struct(rank.alias("rank"), "start", "end", "transcript_id", "type", "gene", "locus_tag", "strand", "transcript_name", "mane").alias("f"))
    left = points.withColumn("_bin", bins(F.col("start"), F.col("end") - 1))
    right = marks.where("_from < _to").withColumn("_at", bins(F.col("_from"), F.col("_to") - 1))
    on = (F.col("seq_id") == F.col("_seq")) & (F.col("_bin") == F.col("_at")) & (F.col("start") < F.col("_to")) & (F.col("end") > F.col("_from"))
    met = left.join(right, on).where(F.col("_bin") == F.floor(F.greatest("start", "_from") / BIN))  # of the bins that both are in, the first
    key = ["seq_id", "start", "end"]
    each = met.groupBy(*key, F.col("f.transcript_id").alias("_t")).agg(F.min("f").alias("f"))
    label = lambda f: F.concat(f["transcript_name"], F.when(f["mane"] == 0, "(MANE)").otherwise(""), F.lit("("), f["type"], F.lit(")"))
    best = each.groupBy(*key).agg(F.min("f").alias("f"), F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.col("f")))).alias("_all"))
    best = best.select(*key, F.when(F.col("f.rank") < 3, F.col("f.type")).otherwise("intron").alias("feature"), "f.gene", "f.locus_tag", "f.transcript_id", "f.strand", F.concat_ws(",", F.transform(F.slice("_all", 1, 6), label)).alias("isoforms"))
    known = features.select("seq_id").distinct().withColumn("_known", F.lit(True))
    rows = points.join(best, key, "left").join(known, "seq_id", "left").withColumn("feature", F.when(F.col("_known"), F.coalesce("feature", F.lit("intergenic")))).drop("_known")
    return rows.fillna("", ["gene", "locus_tag", "transcript_id", "strand", "isoforms"])


def nearest_start(points: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Points (seq_id, start, end) with the transcript whose start is nearest to their middle, and the signed distance along it.

    Ties: the better tag, then the lesser id.
    """
    plus = F.col("strand") == "+"
    marks = transcripts.select("seq_id", F.when(plus, F.col("start")).otherwise(F.col("end")).alias("mark"), F.struct("mane", "transcript_id", "transcript_name", "gene", "strand").alias("_t"))
    middle = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2) + 1
    rows = intervals.nearest(points.withColumn("_pos", middle), marks, "_pos", "_t")
    away = F.when(F.col("nearest_info.strand") == "+", F.col("_pos") - F.col("nearest")).otherwise(F.col("nearest") - F.col("_pos"))
    return rows.select(*points.columns, F.col("nearest").alias("tss"), away.alias("tss_distance"), F.col("nearest_info.transcript_id").alias("tss_transcript"), F.col("nearest_info.gene").alias("tss_gene"))


def chosen(transcripts: DataFrame) -> DataFrame:
    """One transcript of each gene: the best tag, then the longest, then the least id."""
    order = F.struct("mane", (F.col("start") - F.col("end")).alias("n"), "transcript_id")
    return transcripts.groupBy("gene_key").agg(F.min_by(F.struct("transcript_id", "seq_id", "start", "end", "strand", "mane"), order).alias("t")).select("gene_key", "t.*")


def downstream_atg(points: DataFrame, contigs: DataFrame, window: int = 500) -> DataFrame:
    """Points (seq_id, start, end, strand) with atg: where the next start codon begins, in their direction and within the window."""
    plus = F.col("strand").isin("+", "plus")
    rows = fetch(points, contigs, F.when(plus, F.col("end")).otherwise(F.greatest(F.col("start") - window, F.lit(0))), F.when(plus, F.col("end") + window).otherwise(F.col("start")), "_seq", window)
    ahead, behind = F.instr("_seq", "ATG"), F.instr(F.translate(F.reverse("_seq"), "ACGT", "TGCA"), "ATG")
    return rows.withColumn("atg", F.when(plus & (ahead > 0), F.col("end") + ahead - 1).when(~plus & (behind > 0), F.col("start") - behind + 1)).drop("_seq")
