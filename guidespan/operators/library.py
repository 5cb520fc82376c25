"""Libraries of guides: candidates in sequences, filters, one row a guide, and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidespan.functions import seq as S
from guidespan.operators.ordinals import ranked
from guidespan.sources.contigs import marked


def find_guides(contigs: DataFrame, spacer: int = 20, pam: str = "", side: str = "3prime", motif: str = "", both: bool = True) -> DataFrame:
    """(seq_id, strand, guide_seq, pam_seq, spacer_start, spacer_end, pam_start, pam_end, motif_overlap, gc) of all candidates.

    guide_seq reads along the plus strand on either strand, pam_seq along its own. Places are half-open on the plus strand; without a PAM
    every stretch counts, and its PAM's places are -1. motif_overlap: the motif's length if it or its reverse complement is inside, else 0.
    """
    p, wanted = len(pam), []
    for strand in "+-" if both else "+":
        codes = pam if strand == "+" else S.flipped(pam)
        near = S.pattern(codes) if pam else ""
        last = (side == "3prime") == (strand == "+")  # the PAM is to the right
        bases = f"[ACGT]{{{spacer}}}"
        wanted.append((spacer + p, bases + near if last else near + bases, S.anchor(codes, spacer if last else 0) if pam else None))
    found, plus = marked(contigs, wanted), F.col("which") == 0
    last = plus if side == "3prime" else ~plus
    start = F.col("pos") + F.when(last, 0).otherwise(p)
    beside = F.when(last, F.substring("window", spacer + 1, p)).otherwise(F.substring("window", 1, p)) if pam else F.lit("")
    at = F.col("pos") + F.when(last, spacer).otherwise(0) if pam else F.lit(-1).cast("long")
    guide = F.when(last, F.substring("window", 1, spacer)).otherwise(F.substring("window", p + 1, spacer))
    out = found.select("seq_id", F.when(plus, "+").otherwise("-").alias("strand"), guide.alias("guide_seq"), F.when(plus, beside).otherwise(S.reverse_complement(beside)).alias("pam_seq"), start.alias("spacer_start"), (start + spacer).alias("spacer_end"), at.alias("pam_start"), (at + p if pam else at).alias("pam_end"))
    own = motif.upper().replace("U", "T")
    inside = F.when(F.contains("guide_seq", F.lit(own)) | F.contains("guide_seq", F.lit(S.flipped(own))), len(own)).otherwise(0) if own else F.lit(0)
    return out.withColumn("motif_overlap", inside).withColumn("gc", F.round(S.gc_fraction(F.col("guide_seq")), 4))


def filtered(guides: DataFrame, overlap: int = 1, gc_min: float | None = None, gc_max: float | None = None, seed: tuple[int, int] | None = None, seed_gc_min: float | None = None) -> DataFrame:
    """Guides with the overlap, share of G and C (per cent) and that of the seed (first and last position, from 1) that are asked for."""
    kept: Column = F.lit(True)
    if overlap:
        kept = kept & (F.col("motif_overlap") >= overlap)
    if gc_min is not None:
        kept = kept & (F.col("gc") >= gc_min / 100)
    if gc_max is not None:
        kept = kept & (F.col("gc") <= gc_max / 100)
    if seed and seed_gc_min is not None:
        part = F.substring("guide_seq", seed[0], seed[1] - seed[0] + 1)
        kept = kept & ((part == "") | (S.gc_fraction(part) >= seed_gc_min / 100))
    return guides.where(kept)


def distinct_guides(guides: DataFrame) -> DataFrame:
    """(guide_seq, gc, seq_id, strand, spacer_start, occurrence_count, n_regions): each guide once, at its first place."""
    first = F.min(F.struct("seq_id", "spacer_start", "strand")).alias("_f")
    # Counted per region first, so that a guide with very many places is summed before its regions are.
    per = guides.where("guide_seq <> ''").groupBy("guide_seq", "seq_id").agg(first, F.count("*").alias("_n"), F.first("gc").alias("gc"))
    rows = per.groupBy("guide_seq").agg(F.min("_f").alias("_f"), F.sum("_n").alias("occurrence_count"), F.count("*").alias("n_regions"), F.first("gc").alias("gc"))
    return rows.select("guide_seq", "gc", "_f.seq_id", "_f.strand", "_f.spacer_start", "occurrence_count", "n_regions")


def region_pages(guides: DataFrame, size: int) -> DataFrame:
    """(guide_seq, page, regions): the places of each guide in order, in arrays of at most ``size``, pages numbered from 0.

    Places are numbered over ranges, so a guide with very many of them is dealt to many tasks and no array grows without bound. A place
    that is there several times counts once.
    """
    place = ["seq_id", "spacer_start", "strand"]
    rows = ranked(guides.where("guide_seq <> ''").select("guide_seq", *place).distinct(), "_k", ["guide_seq"], [F.col(c) for c in place])
    rows = rows.withColumn("page", F.floor((F.col("_k") - 1) / size))
    return rows.groupBy("guide_seq", "page").agg(F.array_sort(F.collect_list(F.struct(*place))).alias("regions"))


def summary(guides: DataFrame) -> DataFrame:
    """One row: candidates, distinct guides, and mean, least and greatest share of G and C (0 without rows)."""
    per = guides.groupBy("guide_seq").agg(F.count("*").alias("_n"), F.sum("gc").alias("_sum"), F.min("gc").alias("_min"), F.max("gc").alias("_max"))
    r = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("candidate_count"), F.count_if(F.col("guide_seq") != "").alias("unique_guide_count"), r(F.sum("_sum") / F.sum("_n")).alias("gc_mean"), r(F.min("_min")).alias("gc_min"), r(F.max("_max")).alias("gc_max"))
