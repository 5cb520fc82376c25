"""Sequences of stretches of contigs that may consist of several pieces: regions of genes, and padded intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guidespan.functions import seq as S
from guidespan.operators import annotate
from guidespan.operators.lineage import cut
from guidespan.sources.annotation import attribute
from guidespan.sources.contigs import CHUNK, chunks

#: The transcripts whose regions are read.
CODED = ("mRNA", "transcript", "primary_transcript", "C_gene_segment", "V_gene_segment", "D_gene_segment", "J_gene_segment")


def stretches(pieces: DataFrame, contigs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, strand, n_parts, sequence) of pieces (*by, seq_id, strand, start, end), half-open from 0: the bases of all pieces of a group in
    the order of their places, flipped as a whole on the minus strand.

    Each chunk of a contig goes to the pieces that touch it, so neither a contig nor a long piece is carried whole before the pieces of
    one group, which are the result, are put together. Pieces are clamped to the contig; groups without a base are left out.
    """
    held = chunks(contigs, 0).select(F.col("seq_id").alias("_seq"), "chunk_start", "chunk")
    touched = F.sequence(F.floor(F.greatest("start", F.lit(0)) / CHUNK), F.floor((F.col("end") - 1) / CHUNK))
    rows = pieces.where("start < end and end > 0").withColumn("_at", F.explode(touched))
    met = rows.join(held, (F.col("seq_id") == F.col("_seq")) & (F.col("_at") * CHUNK == F.col("chunk_start")))
    first, last = F.greatest(F.col("start"), F.col("chunk_start")), F.least(F.col("end"), F.col("chunk_start") + CHUNK)
    part = F.substring("chunk", (first - F.col("chunk_start") + 1).cast("int"), (last - first).cast("int"))
    groups = met.groupBy(*by, "strand").agg(F.array_sort(F.collect_list(F.struct("start", "end", "chunk_start", part.alias("part")))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["part"]), "")
    n_parts = F.size(F.array_distinct(F.transform("_p", lambda p: F.struct(p["start"], p["end"]))))
    rows = groups.select(*by, "strand", n_parts.alias("n_parts"), text.alias("_text")).where("_text <> ''")
    return rows.withColumn("sequence", F.when(F.col("strand") == "-", S.reverse_complement(F.col("_text"))).otherwise(F.col("_text"))).drop("_text")


def padded(regions: DataFrame, contigs: DataFrame, pad: int = 0) -> DataFrame:
    """(seq_id, region, start, end, strand, sequence) of intervals (seq_id, start, end, name, strand) and ``pad`` bases on both sides.

    Bounds are clamped to the contig, empty intervals left out. Sequences read as on the plus strand; equal intervals are one.
    """
    wide = regions.select("seq_id", F.col("name").alias("region"), "strand", F.greatest(F.col("start") - pad, F.lit(0)).alias("start"), (F.col("end") + pad).alias("end")).distinct()
    keyed = wide.select("seq_id", "region", F.col("strand").alias("_own"), F.col("start").alias("_from"), F.col("end").alias("_to"), F.lit("+").alias("strand"), "start", "end")
    rows = stretches(keyed, contigs, ["seq_id", "region", "_own", "_from", "_to"])
    return rows.select("seq_id", "region", F.col("_from").alias("start"), (F.col("_from") + F.length("sequence")).alias("end"), F.col("_own").alias("strand"), "sequence")


def described(text: Column) -> Column:
    """Struct (chrom, start, end, strand, target_start) of the first word ``region:chrom:start:end:strand[:target_start]``; null if it has
    another form."""
    word = F.try_element_at(F.filter(F.split(text, r"\s+"), lambda w: w.startswith("region:")), F.lit(1))
    at = lambda i: F.try_element_at(F.split(word, ":"), F.lit(i))
    number = lambda i: at(i).try_cast("long")
    whole = number(3).isNotNull() & number(4).isNotNull() & at(5).isNotNull() & (at(6).isNull() | number(6).isNotNull())
    return F.when(whole, F.struct(at(2).alias("chrom"), number(3).alias("start"), number(4).alias("end"), at(5).alias("strand"), F.coalesce(number(6), F.lit(0)).alias("target_start")))


def pieces(parsed: DataFrame) -> DataFrame:
    """(gene_key, gene, seq_id, strand, region, start, end), half-open from 0, of every gene that has a transcript.

    Regions: gene, exons, exon1 and so on, introns, intron1 and so on, 5utr, 3utr. All but the first are those of one transcript: of the best
    tag, then the longest, then the least id. Exons and introns are numbered in the direction of the strand.
    """
    a = F.col("attrs")
    other = [t for t in annotate.TRANSCRIPTS if t not in CODED] + ["5'UTR", "3'UTR"]
    own = parsed.where(~F.col("type").isin(*other))
    key = attribute(a, "ID", "gene_id")
    named = own.where(F.col("type").isin(*annotate.GENES) & key.isNotNull()).select(key.alias("gene_key"), F.coalesce(attribute(a, "gene_name", "Name", "gene"), key).alias("gene"), F.struct("seq_id", "start", "end", "strand").alias("g"))
    named = named.groupBy("gene_key").agg(F.min("gene").alias("gene"), F.min("g").alias("g"))
    known = annotate.transcripts(own)
    best = F.struct("tag_rank", (F.col("start") - F.col("end")).alias("n"), "transcript_id")
    picked = cut(known.groupBy("gene_key").agg(F.min_by("transcript_id", best).alias("transcript_id")))
    whole = named.join(picked, "gene_key", "left_semi").select("gene_key", "gene", "g.seq_id", "g.strand", F.lit("gene").alias("region"), "g.start", "g.end")

    parts = cut(annotate.parts(own).join(picked.select("transcript_id"), "transcript_id", "left_semi"))  # read three times
    keys = ["gene_key", "transcript_id", "seq_id", "strand"]
    exons = parts.where("type = 'exon'").select(*keys, F.col("part_start").alias("start"), F.col("part_end").alias("end"))
    # These windows order the exons of one transcript.
    along = Window.partitionBy(*keys).orderBy("start", "end")
    introns = exons.select(*keys, (F.col("end") + 1).alias("start"), (F.lead("start").over(along) - 1).alias("end")).where("start <= end")
    turn = Window.partitionBy(*keys).orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start")), "end")

    def numbered(rows: DataFrame, kind: str) -> DataFrame:
        each = F.concat(F.lit(kind), F.row_number().over(turn).cast("string"))
        return rows.withColumn("_each", each).select("gene_key", "seq_id", "strand", F.explode(F.array(F.lit(kind + "s"), F.col("_each"))).alias("region"), "start", "end")

    ends = annotate.utrs(parts).join(picked, "transcript_id").select("gene_key", "seq_id", "strand", F.when(F.col("type") == "five_prime_UTR", "5utr").otherwise("3utr").alias("region"), "start", "end")
    inner = numbered(exons, "exon").unionByName(numbered(introns, "intron")).unionByName(ends).join(named.select("gene_key", "gene"), "gene_key")
    return whole.unionByName(inner).withColumn("start", F.col("start") - 1)


def of_genes(parsed: DataFrame, contigs: DataFrame, region: str | None = None) -> DataFrame:
    """(gene_key, gene, region, strand, n_parts, sequence) of all regions of all genes, or of one region; seq_id is a string or a number in both."""
    rows = pieces(parsed)
    return stretches(rows.where(F.col("region") == region) if region else rows, contigs, ["gene_key", "gene", "region"])
