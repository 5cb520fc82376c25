"""Parts of a stored window: motif and flank, the spacer, where a PAM lies in it, and the bases around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidespan.functions import formats
from guidespan.functions import seq as S
from guidespan.sources.contigs import CHUNK, fetch


def motif_and_flank(window: Column, strand: Column, side: str, flank: int) -> tuple[Column, Column]:
    """The motif and the flank of a window as it stands on the plus strand. A flank as long as the window: all is motif."""
    n = F.length(window)
    first = (strand == "plus") if side == "downstream" else (strand != "plus")
    short = F.lit(flank) >= n
    motif = F.when(short, window).when(first, F.left(window, n - flank)).otherwise(F.right(window, n - flank))
    return motif, F.when(short, F.lit("")).when(first, F.right(window, F.lit(flank))).otherwise(F.left(window, F.lit(flank)))


def spacer(window: Column, motif: int, side: str) -> Column:
    """The part of a window, read in the guide's direction, that is not its motif."""
    n = F.length(window)
    return F.left(window, n - motif) if side == "upstream" else F.right(window, n - motif)


def beside_motif(window: Column, start: Column, end: Column, motif_start: Column, motif_end: Column) -> Column:
    """The guide of a window around a motif whose places are known: what stands before the motif, or else what follows it."""
    after = end - motif_end
    return F.when(motif_start > start, F.left(window, motif_start - start)).when(after > 0, F.right(window, after)).otherwise(window)


def candidates(library: DataFrame, side: str, flank: int) -> DataFrame:
    """One row a place of each sequence of a library (qid, sequence, positions as JSON); places count from 1, both ends included."""
    rows = library.select("qid", "sequence", F.explode(formats.places_of(F.col("positions"))).alias("p"))
    motif, rest = motif_and_flank(F.col("sequence"), F.col("p.strand"), side, flank)
    return rows.select(F.col("qid").alias("query_id"), F.col("sequence").alias("query_seq"), "p.seq_id", "p.strand", (F.col("p.start") + 1).alias("start"), (F.col("p.start") + F.length("sequence")).alias("end"), motif.alias("motif_seq"), rest.alias("flank_seq"))


def may_overlap(motif: str, pam: str) -> bool:
    """Whether a motif can sit on a PAM: each of its codes has a base in common with the PAM's code there."""
    return bool(motif and pam) and all(set(S.IUPAC[a]) & set(S.IUPAC[b]) for a, b in zip(motif.upper(), pam.upper(), strict=False))


def pam_span(window: Column, motif: str, pam: str, side: str = "downstream") -> Column:
    """(start, end, expected) of the PAM within a window whose edge is the motif; null if the PAM has to be looked for beside it."""
    if not may_overlap(motif, pam):
        return F.lit(None).cast("struct<start:int,end:int,expected:string>")
    n, p, head = F.length(window), len(pam), side != "upstream"
    span = lambda at_head, expected: F.struct((F.lit(0) if at_head else n - p).alias("start"), (F.lit(p) if at_head else n).alias("end"), F.lit(expected).alias("expected"))
    edge = lambda codes, at_head: window.rlike(f"^{S.pattern(codes)}" if at_head else f"{S.pattern(codes)}$")
    found = F.when(edge(motif, head), span(head, pam.upper())).when(edge(S.flipped(motif), not head), span(not head, S.flipped(pam)))
    return F.when(n >= max(p, len(motif)), found)


def all_embed_pam(windows: DataFrame, window: str, motif: str, pam: str, length: int) -> bool:
    """Whether the PAM need not be looked for beside the windows: the motif is the PAM, and all windows have one length."""
    return motif.upper() == pam.upper() and windows.where(F.length(window) != length).isEmpty()


def with_context(rows: DataFrame, contigs: DataFrame, start: str, end: str, before: int, after: int) -> DataFrame:
    """Rows with the bases around [start, end), clamped to the contig, as ``context``, and where the stretch begins in them.

    No context may be longer than a chunk.
    """
    out = fetch(rows, contigs, F.col(start) - before, F.col(end) + after, "context", CHUNK)
    return out.withColumn("context_start", F.least(F.col(start), F.lit(before).cast("long")))
