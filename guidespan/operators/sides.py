"""Candidates on both sides of a literal centre, and pairs of one of each side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidespan.functions import seq as S
from guidespan.operators.intervals import ranged
from guidespan.operators.patterns import Motif
from guidespan.sources.contigs import fetch, windows


@dataclass(frozen=True)
class Side:
    """A motif with its flank, and how many bases at least and at most lie between it and the centre."""

    motif: Motif
    nearest: int
    farthest: int

    def __post_init__(self):
        if not 0 <= self.nearest <= self.farthest:
            raise ValueError(f"bad distances: {self.nearest} {self.farthest}")


def reach(*sides: Side) -> int:
    """How far from a centre a candidate of these sides may reach."""
    return max(side.farthest + len(side.motif.codes) + side.motif.flank for side in sides)


def _around(centres: DataFrame, left: Side, right: Side) -> DataFrame:
    """``candidates`` of centres that come with the bases around them."""
    found, from_place = [], lambda place: (place - F.col("around_start") + 1).cast("int")

    def add(name: str, side: Side, strand: str, codes: str) -> None:
        n, flank = len(codes), side.motif.flank
        after = F.col("strand") == ("-" if name == "left" else "+")
        start = lambda d: F.when(after, F.col("y_end") + d).otherwise(F.col("y_start") - n - d)
        motif = lambda d: F.substring("around", from_place(start(d)), F.lit(n))
        before = strand == ("plus" if side.motif.side == "upstream" else "minus")
        first = lambda d: F.greatest(start(d) - flank, F.lit(0)) if before else start(d)
        site = lambda d: F.substring("around", from_place(first(d)), (start(d) + (n if before else n + flank) - first(d)).cast("int"))
        row = lambda d: F.struct(start(d).alias("motif_start"), motif(d).alias("motif_seq"), F.lit(strand).alias("motif_strand"), F.lit(name).alias("side"), d.cast("long").alias("distance"), first(d).alias("full_start"), site(d).alias("sequence"))
        there = F.filter(F.sequence(F.lit(side.nearest), F.lit(side.farthest)), lambda d: (start(d) >= F.col("around_start")) & motif(d).rlike(f"^{S.pattern(codes)}$"))
        found.append(F.transform(there, row))

    for name, side in (("left", left), ("right", right)):
        add(name, side, "plus", side.motif.codes)
        add(name, side, "minus", S.flipped(side.motif.codes))
    return centres.withColumn("_m", F.explode(F.concat(*found))).select(*centres.columns, "_m.*").withColumn("full_end", F.col("full_start") + F.length("sequence"))


def candidates(contigs: DataFrame, centres: DataFrame, left: Side, right: Side) -> DataFrame:
    """Centres (seq_id, y_start, y_end, strand) with side, motif_start, motif_strand, motif_seq, distance, full_start, full_end, sequence.

    Left and right are those of the centre's own strand: beside a centre of the minus strand, the left side is the one after it. The
    motif may stand on either strand; its flank is clamped to the contig and its site is given as on the plus strand.

    Centres that come with the bases around them (``patterns.centres`` with the ``reach`` of both sides) are looked at one by one, so nothing
    is shuffled. Others meet all places of the motifs in a join, and the bases of their sites are looked up.
    """
    if "around" in centres.columns:
        return _around(centres, left, right)
    out = None
    for name, side in (("left", left), ("right", right)):
        motif, n = side.motif, len(side.motif.codes)
        found = None
        for strand, codes in (("plus", motif.codes), ("minus", S.flipped(motif.codes))):
            part = windows(contigs, n, S.pattern(codes)).select("seq_id", F.col("pos").alias("motif_start"), F.col("window").alias("motif_seq"), F.lit(strand).alias("motif_strand"))
            found = part if found is None else found.unionByName(part)
        after = F.col("strand") == ("-" if name == "left" else "+")
        low = F.when(after, F.col("y_end") + side.nearest).otherwise(F.col("y_start") - n - side.farthest)
        high = F.when(after, F.col("y_end") + side.farthest).otherwise(F.col("y_start") - n - side.nearest)
        rows = ranged(centres, found, low, high, "motif_start")
        distance = F.when(after, F.col("motif_start") - F.col("y_end")).otherwise(F.col("y_start") - F.col("motif_start") - n)
        before = F.col("motif_strand") == ("plus" if motif.side == "upstream" else "minus")
        start = F.when(before, F.greatest(F.col("motif_start") - motif.flank, F.lit(0))).otherwise(F.col("motif_start"))
        end = F.col("motif_start") + n + F.when(before, 0).otherwise(motif.flank)
        rows = rows.withColumn("side", F.lit(name)).withColumn("distance", distance).withColumn("full_start", start)
        rows = fetch(rows, contigs, F.col("full_start"), end, "sequence", n + motif.flank).withColumn("full_end", F.col("full_start") + F.length("sequence"))
        out = rows if out is None else out.unionByName(rows)
    return out


def shown(rows: DataFrame, contigs: DataFrame, longest: int) -> DataFrame:
    """Candidates with region_seq: all from the site to the centre, the centre in lower case. No region is longer than ``longest``."""
    start, end = F.least("full_start", "y_start"), F.greatest("full_end", "y_end")
    if "around" in rows.columns:
        rows = rows.withColumn("_region", F.substring("around", (start - F.col("around_start") + 1).cast("int"), (end - start).cast("int"))).drop("around", "around_start")
    else:
        rows = fetch(rows, contigs, start, end, "_region", longest)
    size = F.col("y_end") - F.col("y_start")
    cut = lambda at, n: F.substring("_region", at.cast("int"), n.cast("int"))
    ahead = F.col("y_start") - start
    whole = F.concat(cut(F.lit(1), ahead), F.lower(cut(ahead + 1, size)), cut(ahead + size + 1, end - F.col("y_end")))
    return rows.withColumn("region_seq", whole).drop("_region")


def compatibility(left: Column, right: Column, distances: dict[str, tuple[int | None, int | None]], same: tuple[str, ...] = ("seq_id", "y_start", "y_end", "strand"), nucleases: dict[str, str] | None = None) -> Column:
    """Struct (hard_fail, soft_warnings, hard_reasons) of two candidates, either of which may be null.

    Hard: a side is missing, a distance is missing or out of its bounds, a strand is neither plus nor minus, the first of the columns
    ``same`` that differs. Soft: nucleases, a column of the candidates, that differ between the sides or from those expected.
    """
    sides = (("left", left), ("right", right))
    hard = [F.when(row.isNull(), f"missing_side:{name}") for name, row in sides]
    hard += [F.when(~row["motif_strand"].isin("plus", "minus"), F.concat(F.lit(f"invalid_strand:{name}:"), row["motif_strand"])) for name, row in sides]
    for name, row in sides:
        if name in distances:
            low, high = distances[name]
            away = row["distance"].cast("double")
            hard.append(F.when(away.isNull(), f"distance_missing:{name}"))
            if low is not None:
                hard.append(F.when(away < low, F.concat(F.lit(f"distance_below_min:{name}:"), away.cast("string"))))
            if high is not None:
                hard.append(F.when(away > high, F.concat(F.lit(f"distance_above_max:{name}:"), away.cast("string"))))
    if same:
        differs = F.coalesce(*(F.when(left[c] != right[c], f"locus_mismatch:{c}") for c in same))
        hard.append(differs)
    soft = []
    if nucleases is not None:
        a, b = left["nuclease"], right["nuclease"]
        soft.append(F.when(a != b, F.concat(F.lit("nuclease_mismatch:left_right:"), a, F.lit(":"), b)))
        soft += [F.when(row["nuclease"] != nucleases[name], F.concat(F.lit(f"nuclease_mismatch:{name}:{nucleases[name]}:"), row["nuclease"])) for name, row in sides if name in nucleases]
    reasons = F.array_compact(F.array(*hard))
    return F.struct((F.size(reasons) > 0).alias("hard_fail"), (F.array_compact(F.array(*soft)) if soft else F.array().cast("array<string>")).alias("soft_warnings"), reasons.alias("hard_reasons"))


def paired(rows: DataFrame, best: dict[str, int]) -> DataFrame:
    """One row a centre: left and right, structs of the candidate of either side whose distance is next to the best one, null without any;
    ties go to the nearer one, then to the first by place. distance_score of a candidate is how far it is from the best distance."""
    target = F.when(F.col("side") == "left", best["left"]).otherwise(best["right"])
    rows = rows.drop("around", "around_start").withColumn("distance_score", F.abs(F.col("distance") - target))
    own = F.struct(*rows.columns)
    order = F.struct("distance_score", "distance", "motif_start", "motif_strand")
    pick = lambda side: F.min_by(own, F.when(F.col("side") == side, order)).alias(side)
    return rows.groupBy("seq_id", "y_start", "strand").agg(pick("left"), pick("right"))


def recall(found: dict[str, DataFrame], reference: str) -> DataFrame:
    """Hits (qid, seq_id, start, strand) of several searches, by guide: how many the reference has, how many each has, and the share of the
    reference's that each finds, null where the reference has none. Guides that no search hits are not listed."""
    if reference not in found:
        raise ValueError(f"no such search: {reference}")
    key, rows = ["qid", "seq_id", "start", "strand"], None
    for name, hits in found.items():
        part = hits.select(*key, F.lit(name).alias("_by"))
        rows = part if rows is None else rows.unionByName(part)
    per = rows.groupBy(*key).agg(*(F.bool_or(F.col("_by") == name).alias(f"_{name}") for name in found))
    known = F.count_if(F.col(f"_{reference}"))
    columns = [known.alias("reference")]
    for name in found:
        columns += [F.count_if(F.col(f"_{name}")).alias(name), F.when(known > 0, F.count_if(F.col(f"_{name}") & F.col(f"_{reference}")) / known).alias(f"{name}_recall")]
    return per.groupBy("qid").agg(*columns)
