"""Candidate sites of the three pattern kinds. Positions count from 0 on the plus strand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guidespan.functions import seq as S
from guidespan.operators.intervals import ranged
from guidespan.operators.lineage import cut
from guidespan.operators.ordinals import numbered
from guidespan.sources.contigs import fetch, marked, windows


@dataclass(frozen=True)
class Motif:
    """A motif in ambiguity codes, and how many bases on which side of it belong to the site."""

    codes: str
    flank: int
    side: str = "downstream"

    def __post_init__(self):
        S.pattern(self.codes)
        if self.flank < 0 or self.side not in ("upstream", "downstream"):
            raise ValueError(f"bad flank: {self.flank} {self.side}")


def single(contigs: DataFrame, motif: Motif) -> DataFrame:
    """(seq_id, strand, motif_pos, window_start, sequence): the motif and its flank on both strands.

    Sites of the minus strand are given as they stand on the plus strand, where the flank is on the other side. A site whose flank
    leaves the contig is none. A motif that equals its own reverse complement gives a site for each strand.
    """
    return several(contigs, [motif]).drop("motif")


def several(contigs: DataFrame, motifs: list[Motif]) -> DataFrame:
    """The sites of several motifs, found in one scan, with the place of their motif in the list as ``motif``."""
    wanted, ahead, plus = [], [], F.col("which") % 2 == 0
    for m in motifs:
        any_base = f"[A-Z]{{{m.flank}}}"
        for codes, first in ((m.codes, m.side == "upstream"), (S.flipped(m.codes), m.side != "upstream")):
            wanted.append((len(codes) + m.flank, any_base + S.pattern(codes) if first else S.pattern(codes) + any_base, S.anchor(codes, m.flank if first else 0)))
            ahead.append(m.flank if first else 0)
    found = marked(contigs, wanted)
    start = F.col("pos") + F.get(F.array(*map(F.lit, ahead)), F.col("which"))
    return found.select("seq_id", F.when(plus, "plus").otherwise("minus").alias("strand"), start.alias("motif_pos"), F.col("pos").alias("window_start"), F.col("window").alias("sequence"), F.shiftright("which", 1).alias("motif"))


def both_strands(contigs: DataFrame, codes: str, name: str) -> DataFrame:
    """(seq_id, pos, motif_seq, strand, order) of a motif on either strand, named by ``name``; order is 0 for plus, 1 for minus."""
    return _named(_either(contigs, [codes]), 0, name)


def _either(contigs: DataFrame, motifs: list[str]) -> DataFrame:
    """All motifs on either strand, found in one scan; ``which`` is twice the motif's place in the list, one more for minus."""
    return marked(contigs, [(len(codes), S.pattern(c), S.anchor(c)) for codes in motifs for c in (codes, S.flipped(codes))])


def _named(found: DataFrame, place: int, name: str) -> DataFrame:
    minus = F.col("which") - 2 * place
    return found.where(F.shiftright("which", 1) == place).select("seq_id", F.col("pos").alias(f"{name}_pos"), F.col("window").alias(f"{name}_motif_seq"), F.when(minus == 0, "plus").otherwise("minus").alias(f"{name}_strand"), minus.alias(f"_{name}_order"))


def unique(sites: DataFrame) -> DataFrame:
    """One row a sequence: its number in the order of first sight, its places in order as text, and how many they are."""
    place = F.struct("seq_id", F.when(F.col("strand") == "plus", 0).otherwise(1).alias("minus"), "motif_pos", "window_start")
    groups = sites.groupBy("sequence").agg(F.min(place).alias("_first"), F.count("*").alias("n_positions"), F.array_sort(F.collect_list(place)).alias("_all"))
    text = F.array_join(F.transform("_all", lambda p: F.concat_ws(":", p["seq_id"].cast("string"), F.when(p["minus"] == 0, "plus").otherwise("minus"), p["motif_pos"].cast("string"), p["window_start"].cast("string"))), ";")
    rows = numbered(groups, "_number", [F.col("_first"), F.col("sequence")])
    return rows.select(F.concat(F.lit("uniq_"), F.col("_number").cast("string")).alias("qid"), "sequence", "n_positions", text.alias("positions"))


def _flank(pos, n: int, motif: Motif, strand):
    """(start, end) of the flank of a motif at pos, unclamped: the minus strand has it on the other side."""
    before = (strand == "plus") if motif.side == "upstream" else (strand == "minus")
    return F.when(before, pos - motif.flank).otherwise(pos + n), F.when(before, pos).otherwise(pos + n + motif.flank)


def gap_pairs(contigs: DataFrame, left: Motif, right: Motif, least: int, most: int) -> DataFrame:
    """Pairs of motifs, each on either strand, with ``least`` to ``most`` bases between them, and their flanks.

    Flanks are clamped to the contig. A pair of places is given once: both strands plus come first, then plus and minus, minus and
    plus, both minus.
    """
    n, m = len(left.codes), len(right.codes)

    found = cut(_either(contigs, [left.codes, right.codes]))
    pairs = ranged(_named(found, 0, "left"), _named(found, 1, "right"), F.col("left_pos") + n + least, F.col("left_pos") + n + most, "right_pos")
    first = F.row_number().over(Window.partitionBy("seq_id", "left_pos", "right_pos").orderBy("_left_order", "_right_order"))
    pairs = pairs.withColumn("_first", first).where("_first = 1").drop("_first", "_left_order", "_right_order")
    # One look-up brings the stretch that holds both flanks.
    begin = F.greatest(F.col("left_pos") - left.flank, F.lit(0))
    pairs = fetch(pairs, contigs, begin, F.col("right_pos") + m + right.flank, "_around", left.flank + n + most + m + right.flank)
    for motif, name, size in ((left, "left", n), (right, "right", m)):
        start, end = _flank(F.col(f"{name}_pos"), size, motif, F.col(f"{name}_strand"))
        start = F.greatest(start, F.lit(0))
        piece = F.when(end > start, F.nullif(F.substring("_around", (start - begin + 1).cast("int"), (end - start).cast("int")), F.lit("")))
        pairs = pairs.withColumn(f"{name}_flank_seq", piece)
    pairs = pairs.drop("_around")
    both = (F.col("left_strand") == "minus") & (F.col("right_strand") == "minus")
    return pairs.withColumn("strand", F.when(both, "minus").otherwise("plus")).withColumn("gap", F.col("right_pos") - F.col("left_pos") - n).withColumn("compound_end", F.col("right_pos") + m)


def centres(contigs: DataFrame, literal: str, reach: int = 0) -> DataFrame:
    """(seq_id, y_start, y_end, strand) of a literal sequence on both strands; one that is its own reverse complement counts as plus.

    reach: the scan also cuts as many bases on either side, clamped to the contig, with the centre between them: around, which begins at
    around_start. For contigs that are a row each, of letters of A to Y.
    """
    plus, minus = literal.upper(), S.flipped(literal)
    if set(plus) - set("ACGT"):
        raise ValueError("a centre is literal bases")
    if reach:
        pad, beside = F.lit("Z" * reach), f"[A-Z]{{{reach}}}"
        padded = contigs.select("seq_id", F.concat(pad, "seq", pad).alias("seq"))
        out = windows(padded, len(plus) + 2 * reach, f"{beside}{plus}{beside}|{beside}{minus}{beside}")
        strand = F.when(F.substring("window", reach + 1, len(plus)) == plus, "+").otherwise("-")
        around = F.translate("window", "Z", "")
        return out.select("seq_id", F.col("pos").alias("y_start"), (F.col("pos") + len(plus)).alias("y_end"), strand.alias("strand"), F.greatest(F.col("pos") - reach, F.lit(0)).alias("around_start"), around.alias("around"))
    out = windows(contigs, len(plus), f"{plus}|{minus}")
    return out.select("seq_id", F.col("pos").alias("y_start"), (F.col("pos") + len(plus)).alias("y_end"), F.when(F.col("window") == plus, "+").otherwise("-").alias("strand"))


def beside_centres(contigs: DataFrame, sites: DataFrame, motif: Motif, nearest: int, farthest: int) -> DataFrame:
    """Motifs that start ``nearest`` to ``farthest`` bases after a centre's end (exclusive), on either strand, with clamped flanks."""
    n = len(motif.codes)
    out = both_strands(contigs, motif.codes, "motif").select("seq_id", F.col("motif_pos").alias("motif_start"), F.col("motif_motif_seq").alias("motif_seq"), "motif_strand")
    pairs = ranged(sites, out, F.col("y_end") + nearest, F.col("y_end") + farthest - 1, "motif_start")
    start, end = _flank(F.col("motif_start"), n, motif, F.col("motif_strand"))
    return fetch(pairs, contigs, start, end, "flank_seq", motif.flank).withColumn("distance", F.col("motif_start") - F.col("y_end"))
