"""Approximate search of guides in contigs under a mismatch budget, by seeds that must agree."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import comb
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guidespan.functions import seq as S
from guidespan.operators.alignment import best_ends, fewest, from_first
from guidespan.operators.lineage import cut
from guidespan.sources.contigs import marked


LOOKED_UP = 1e6


@dataclass(frozen=True)
class SeedPlan:
    """Segments (start, length) of which at least one holds ``changes`` mismatches at most."""

    segments: tuple[tuple[int, int], ...]
    changes: int


def seed_plan(length: int, budget: int, most_variants: int = 500_000, bulges: int = 0) -> SeedPlan:
    """The plan of the fewest expected lookups: n segments, more than there are bulges. Of the n - bulges that no bulge touches one
    has budget // (n - bulges) mismatches or fewer.

    A variant of a seed costs one lookup and what it finds: a share of LOOKED_UP random targets.
    """
    if length < 1 or budget < 0 or bulges < 0 or budget + bulges >= length:
        raise ValueError("no plan finds such sites")
    best = None
    for n in range(bulges + 1, min(length, budget + bulges + 1) + 1):
        size, more = divmod(length, n)
        starts = [i * size + min(i, more) for i in range(n)]
        segments = tuple((s, size + (i < more)) for i, s in enumerate(starts))
        changes = budget // (n - bulges)
        variants = sum(comb(k, c) * 3**c for _, k in segments for c in range(min(changes, k) + 1))
        cost = sum(sum(comb(k, c) * 3**c for c in range(min(changes, k) + 1)) * (1 + LOOKED_UP / 4.0**k) for _, k in segments)
        if variants <= most_variants and (best is None or (cost, n) < best[0]):
            best = (cost, n), SeedPlan(segments, changes)
    if best is None:
        raise ValueError("every plan has too many variants")
    return best[1]


def _changed(seeds: Column, size: int) -> Column:
    """The seeds and all that differ from one of them in one place, each once."""

    def near(s: Column) -> Column:
        place = lambda i: F.transform(F.array(*map(F.lit, "ACGT")), lambda b: F.concat(F.substring(s, F.lit(1), i - 1), b, F.substring(s, i + 1, F.lit(size))))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(size)), place))

    return F.array_distinct(F.concat(seeds, F.flatten(F.transform(seeds, near))))


def _dealt(guides: DataFrame) -> DataFrame:
    """The guides in as many tasks as shuffles have: a few guides would be one task, and their variants are many.

    In turn, not by a column: Spark leaves out a shuffle by what the rows are dealt by already, and puts them together in one task.
    """
    return guides.repartition(int(guides.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _seed_variants(guides: DataFrame, plan: SeedPlan) -> DataFrame:
    """(segment, seed), with the guide's columns, for every variant of every segment, made by built-in functions from the changed places."""
    guides, out = _dealt(guides), None
    for k, (start, size) in enumerate(plan.segments):
        seeds = F.array(F.substring("guide", start + 1, size))
        for _ in range(plan.changes):
            seeds = _changed(seeds, size)
        part = guides.select("*", F.lit(k).alias("segment"), F.explode(seeds).alias("seed"))
        out = part if out is None else out.unionByName(part)
    # Spark takes the variants for as few as the guides, and would send all of them through the driver.
    return out.hint("merge")


def _shifts(plan: SeedPlan, segment: int, budget: int, bulges: int, last: bool) -> list[int]:
    """How far a segment that no bulge touches may stand shifted by those between it and the PAM.

    A bulge between two segments touches the one nearer to the PAM. Where every untouched segment is within the changes, the one nearest to the
    PAM is looked for: each of those before it has a bulge or more.
    """
    before = len(plan.segments) - 1 - segment if last else segment
    if before == 0:
        return [0]
    if plan.changes < budget:
        return list(range(-bulges, bulges + 1))
    return sorted({d for t in range(before, bulges + 1) for d in range(-t, t + 1, 2)})


def _code(bases: Column, length: int, last: bool) -> Column:
    """Bases as a number of two bits each, the one next to the PAM lowest; other letters count as A."""
    plain = F.translate(F.regexp_replace(bases, "[^ACGT]", "A"), "ACGT", "0123")
    return F.when(F.length(bases) == length, F.conv(plain if last else F.reverse(plain), 4, 10).cast("long"))


def base_code(bases: Column, length: int, last: bool) -> Column:
    """Bases as a number of two bits each, the last one (or the first) lowest; other letters count as A, other lengths give null."""
    return _code(bases, length, last)


def _mismatches(length: int) -> tuple[dict[str, Column], Column, Column]:
    """What a guide carries, a target's code, and the number of places at which both differ, from these by bits; longer ones by letters.

    Bits differ where a base does; a guide's letters other than ACGT, which no target has, are told by a second code.
    """
    if length > 31:
        return {}, F.lit(None), S.mismatches(F.col("guide"), F.col("target"))
    code = lambda x, odd, plain: F.conv(F.translate(F.regexp_replace(x, "[^ACGT]", odd), "ACGTN", plain), 4, 10).cast("long")
    own = F.col("guide")
    return {"_g": code(own, "A", "01230"), "_odd": code(own, "N", "00001")}, F.conv(F.translate("target", "ACGT", "0123"), 4, 10).cast("long"), F.bit_count(_places())


def _places() -> Column:
    """Bits of the places, of 31 at most, at which a guide and a target that meet differ."""
    differ = F.col("_g").bitwiseXOR(F.col("_t"))
    return differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseAND(F.lit(sum(1 << 2 * i for i in range(31)))).bitwiseOR(F.col("_odd"))


def _may_align(guide: Column, beside: Column, n: int, budget: int, bulges: int) -> Column:
    """Whether a guide may align within both budgets with a stretch of one base more, both as codes; true for other bulges than one.

    A bulge leaves the bases between it and the PAM as they stand and moves those beyond it by one. Only which four bases it stands in
    is told, and these are not compared, so no pair that aligns is left out.
    """
    if bulges != 1 or n > 30:
        return F.lit(True)
    ones, whole = sum(1 << 2 * i for i in range(n)), (1 << 2 * n) - 1
    differ = lambda x: (x.bitwiseOR(F.shiftright(x, 1))).bitwiseAND(F.lit(ones))
    stands, skipped, missed = (differ(guide.bitwiseXOR(x.bitwiseAND(F.lit(whole)))) for x in (beside, F.shiftright(beside, 2), F.shiftleft(beside, 2)))
    count = lambda x, low, high: F.bit_count(x.bitwiseAND(F.lit(sum(1 << 2 * i for i in range(low, min(high, n))))))
    fits = count(stands, 0, n) <= budget
    for at in range(0, n, 4):
        for moved in (skipped, missed):
            fits = fits | (count(stands, 0, at) + count(moved, at + 4, n) <= budget)
    return F.coalesce(fits, F.lit(True))


def beside_pam(contigs: DataFrame, length: int, pam: str = "NGG", side: str = "3prime") -> DataFrame:
    """(seq_id, start, strand, target, pam) of all stretches of this length beside a PAM, on both strands, in the guide's direction."""
    n, p = length, len(pam)
    bases, last = f"[ACGT]{{{n}}}", side == "3prime"
    own, other = pam, S.flipped(pam)
    wanted = [(n + p, bases + S.pattern(c) if behind else S.pattern(c) + bases, S.anchor(c, n if behind else 0)) for c, behind in ((own, last), (other, not last))]
    plus = F.col("which") == 0
    found = marked(contigs, wanted)
    behind = plus if last else ~plus
    target = F.when(behind, F.substring("window", 1, n)).otherwise(F.substring("window", p + 1, n))
    near = F.when(behind, F.substring("window", n + 1, p)).otherwise(F.substring("window", 1, p))
    turned = lambda x: F.when(plus, x).otherwise(S.reverse_complement(x))
    sites = found.select("seq_id", (F.col("pos") + F.when(behind, 0).otherwise(p)).alias("start"), F.when(plus, "+").otherwise("-").alias("strand"), turned(target).alias("target"), turned(near).alias("pam"))
    return sites


def search(contigs: DataFrame, guides: DataFrame, length: int, budget: int, pam: str = "NGG", side: str = "3prime") -> DataFrame:
    """(qid, guide, seq_id, start, strand, target, pam, mismatch): all sites within the budget beside a PAM, on both strands.

    guides: (qid, guide), all of one length. The PAM is tested in the scan, before anything is joined; sites then meet guides on
    equal seeds, and meeting pairs, each once, are compared in full. target and pam read in the guide's direction.
    """
    return search_sites(cut(beside_pam(contigs, length, pam, side)), guides, length, budget)


def search_sites(sites: DataFrame, guides: DataFrame, length: int, budget: int) -> DataFrame:
    """What ``search`` returns, of the stretches of ``beside_pam``, which are read twice."""
    return sites.join(search_pairs(sites, guides, length, budget), "target").select("qid", "guide", "seq_id", "start", "strand", "target", "pam", "mismatch")


def search_pairs(sites: DataFrame, guides: DataFrame, length: int, budget: int) -> DataFrame:
    """(qid, guide, target, mismatch): each guide with each distinct target within the budget, without places."""
    plan = seed_plan(length, budget)
    seeds = F.array(*(F.struct(F.lit(k).alias("segment"), F.substring("target", s + 1, size).alias("seed")) for k, (s, size) in enumerate(plan.segments)))
    # Equal targets are compared once: places are joined back after the comparison. Candidates are many, about the square of the input, so
    # each costs a few operations on bits where it meets, and only hits are shuffled.
    own, code, differ = _mismatches(length)
    targets = sites.select("target").distinct().withColumn("_t", code)
    variants = _seed_variants(guides.where(F.length("guide") == length).select("qid", "guide", *(c.alias(n) for n, c in own.items())).distinct(), plan)
    met = targets.withColumn("_s", F.explode(seeds)).select("target", "_t", "_s.segment", "_s.seed").join(variants, ["segment", "seed"])
    pairs = met.withColumn("mismatch", differ).where(F.col("mismatch") <= budget)
    if length > 31:
        return pairs.select("qid", "guide", "target", "mismatch").distinct()
    # A pair meets on each segment of few changes: it counts on the first of these.
    before = [F.bit_count(_places().bitwiseAND(F.lit(sum(1 << 2 * i for i in range(length - s - size, length - s))))) > plan.changes for s, size in plan.segments]
    first = F.lit(True)
    for k in range(len(before) - 1, 0, -1):
        first = F.when(F.col("segment") == k, reduce(and_, before[:k])).otherwise(first)
    return pairs.where(first).select("qid", "guide", "target", "mismatch")


def bulge_search(contigs: DataFrame, guides: DataFrame, length: int, budget: int, bulges: int, pam: str = "NGG", side: str = "3prime") -> DataFrame:
    """All places beside a PAM, on both strands, where a guide aligns with so many mismatches and so many bulges at most.

    One row a guide and PAM place: the best target of length - bulges to length + bulges bases that ends at the PAM, by cost (two a
    mismatch, three a bulge), then fewer mismatches, bulges, a length nearer the guide's, the shorter one. start and target_end
    are places on the plus strand; target, pam and the aligned strings read in the guide's direction. bitscore falls from 100 by
    12 a mismatch and 18 a bulge.

    Stretches beside PAMs are cut once. A guide's seeds meet those of the distinct stretches at every shift that bulges allow; then each
    pair that meets is aligned in full. A target stands for its cheapest alignment: one whose cheapest has too many mismatches is
    no hit, even if a dearer one has fewer. No target whose cheapest alignment is within the budgets is missed.
    """
    last = side == "3prime"
    sites = cut(bulge_sites(contigs, length, bulges, pam, side))
    rows = sites.join(bulge_pairs(sites, guides, length, budget, bulges, side), "_beside")
    ends_there = (F.col("strand") == "+") if last else (F.col("strand") == "-")
    start = F.when(ends_there, F.col("_border") - F.length("target")).otherwise(F.col("_border"))
    rows = rows.select("qid", "guide", "seq_id", start.alias("start"), (start + F.length("target")).alias("target_end"), "strand", "target", "pam", "mismatch", "indel", "rna_bulges", "dna_bulges", "cigar", "aligned_guide", "aligned_target")
    return rows.withColumn("bitscore", F.greatest(F.lit(0.0), F.lit(100.0) - F.col("mismatch") * 12.0 - F.col("indel") * 18.0))


def bulge_sites(contigs: DataFrame, length: int, bulges: int, pam: str = "NGG", side: str = "3prime") -> DataFrame:
    """(seq_id, strand, _border, _beside, pam): the bases beside each PAM, bulges more than the length, and the place between both."""
    n, p, room = length, len(pam), length + bulges
    # Bases outside the contig are N, so that sites near its ends have their shorter targets.
    edge = F.lit("N" * (2 * bulges))
    padded = contigs.select("seq_id", F.concat(edge, "seq", edge).alias("seq"))
    last = side == "3prime"
    far, near = f"[A-Z]{{{2 * bulges}}}", f"[ACGT]{{{n - bulges}}}"
    wanted = [(room + p, far + near + S.pattern(c) if behind else S.pattern(c) + near + far, S.anchor(c, room if behind else 0)) for c, behind in ((pam, last), (S.flipped(pam), not last))]
    plus = F.col("which") == 0
    behind = plus if last else ~plus
    turned = lambda x: F.when(plus, x).otherwise(S.reverse_complement(x))
    found = marked(padded, wanted)
    beside = F.when(behind, F.substring("window", 1, room)).otherwise(F.substring("window", p + 1, room))
    own_pam = F.when(behind, F.substring("window", room + 1, p)).otherwise(F.substring("window", 1, p))
    return found.select("seq_id", F.when(plus, "+").otherwise("-").alias("strand"), (F.col("pos") - 2 * bulges + F.when(behind, room).otherwise(p)).alias("_border"), turned(beside).alias("_beside"), turned(own_pam).alias("pam"))


def bulge_pairs(sites: DataFrame, guides: DataFrame, length: int, budget: int, bulges: int, side: str = "3prime") -> DataFrame:
    """(qid, guide, _beside, target, mismatch, indel, rna_bulges, dna_bulges, cigar, aligned_guide, aligned_target): each guide with each
    distinct stretch of ``bulge_sites`` where it aligns, without places."""
    n, room, last = length, length + bulges, side == "3prime"
    stretches = sites.select("_beside").distinct().withColumn("_b", _code(F.col("_beside"), room, last))
    if bulges == 1 and budget < 3 and 4 <= n <= 30:
        pairs = _halves_met(stretches, guides, n, budget, last)
    else:
        pairs = _segments_met(stretches, guides, n, budget, bulges, last)
    best = best_ends(pairs.select("qid", "guide", "_beside"), "_beside", budget, bulges, last)
    return best.withColumn("indel", F.col("rna_bulges") + F.col("dna_bulges"))


def _segments_met(stretches: DataFrame, guides: DataFrame, n: int, budget: int, bulges: int, last: bool) -> DataFrame:
    """Pairs of guides and stretches that meet on a seed at any shift that bulges allow, each once."""
    room, plan = n + bulges, seed_plan(n, budget, bulges=bulges)
    # Places of a seed count from the PAM: bulges between both shift it.
    begin = lambda s, size, d: (room - n + s - d if last else s + d) + 1
    seeds = F.array(*(F.struct(F.lit(k).alias("segment"), F.substring("_beside", begin(s, size, d), size).alias("seed")) for k, (s, size) in enumerate(plan.segments) for d in _shifts(plan, k, budget, bulges, last) if 0 < begin(s, size, d) <= room - size + 1))
    variants = _seed_variants(guides.select("qid", "guide", _code(F.col("guide"), n, last).alias("_g")), plan)
    met = stretches.withColumn("_s", F.explode(seeds)).select("_beside", "_b", "_s.segment", "_s.seed").join(variants, ["segment", "seed"])
    # Pairs that can't align are left out where they meet, so that only the others are shuffled.
    return met.where(_may_align(F.col("_g"), F.col("_b"), n, budget, bulges)).select("qid", "guide", "_beside").distinct()


def _low(n: int) -> int:
    """Bits of the n bases next to the PAM."""
    return (1 << 2 * n) - 1


def _edited(seed: Column, size: int) -> tuple[Column, Column, Column]:
    """Codes of a seed of a guide as a target may hold it: with one base changed (or none), one base more, or one less and any base after it."""
    moved = lambda name, x, bases: F.call_function(name, x, (2 * bases).cast("int"))
    low = lambda i: seed.bitwiseAND(moved("shiftleft", F.lit(1).cast("long"), i) - 1)
    base, high = (lambda b, i: moved("shiftleft", b, i)), (lambda i: moved("shiftleft", moved("shiftright", seed, i), i))
    every, whole = F.array(*(F.lit(b).cast("long") for b in range(4))), F.lit(_low(size))
    put = lambda f: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.transform(every, lambda b: f(i, b))))
    return (
        put(lambda i, b: low(i).bitwiseOR(base(b, i)).bitwiseOR(high(i + 1))),
        put(lambda i, b: low(i).bitwiseOR(base(b, i)).bitwiseOR(F.shiftleft(high(i), 2)).bitwiseAND(whole)),
        put(lambda i, b: low(i).bitwiseOR(F.shiftright(high(i + 1), 2)).bitwiseOR(F.shiftleft(b, 2 * (size - 1)))),
    )


def _halves_met(stretches: DataFrame, guides: DataFrame, n: int, budget: int, last: bool) -> DataFrame:
    """Pairs of guides and stretches that align with two mismatches and one bulge at most, each once.

    Of both halves of a guide one has one edit at most. That next to the PAM stands where it is: as it is, or with a base changed, more or
    less. Where it has two edits or more, the other half has a base more or less and no change, or, beyond a bulge, stands shifted by one
    with a base changed at most. All seeds are numbers of two bits a base, the one next to the PAM lowest.
    """
    h = n // 2
    f, g, b = n - h, F.col("_g"), F.col("_b")
    own = _dealt(guides.where(F.length("guide") == n).select("qid", "guide", _code(F.col("guide"), n, last).alias("_g")).distinct())
    near, beyond = g.bitwiseAND(F.lit(_low(h))), F.shiftright(g, 2 * h)
    changed, more, less = _edited(beyond, f)
    kinds = [F.concat(*_edited(near, h)), F.concat(F.array(beyond), more, less), changed]
    kept = lambda k: lambda seed: F.struct(F.lit(k).alias("segment"), seed.alias("seed"))
    seeds = F.concat(*(F.transform(F.array_distinct(kind), kept(k)) for k, kind in enumerate(kinds)))
    variants = own.withColumn("_s", F.explode(seeds)).select("qid", "guide", "_g", "_s.segment", "_s.seed")
    # (turn, kind of seed, first base from the PAM, bases)
    looked = [(0, 0, 0, h), (1, 1, h, f), (2, 2, h + 1, f), (3, 2, h - 1, f)]
    keys = F.array(*(F.struct(F.lit(turn).alias("turn"), F.lit(kind).alias("segment"), F.shiftright(b, 2 * at).bitwiseAND(F.lit(_low(size))).alias("seed")) for turn, kind, at, size in looked))
    # Spark takes the variants for as few as the guides, and would send all of them through the driver.
    met = stretches.withColumn("_s", F.explode(keys)).select("_beside", "_b", "_s.turn", "_s.segment", "_s.seed").join(variants.hint("merge"), ["segment", "seed"])
    ones = sum(1 << 2 * i for i in range(n))
    stands, skipped, missed = ((x := g.bitwiseXOR(y)).bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(ones)) for y in (b, F.shiftleft(b, 2), F.shiftright(b, 2)))
    # A pair meets on several seeds, but counts at the first turn.
    span = lambda x, low, high: x.bitwiseAND(F.lit(_low(high) ^ _low(low)))

    def one_gap(low: int, high: int) -> Column:
        beyond = from_first(span(stands, low, high))
        return (span(missed, low, high - 1).bitwiseAND(beyond) == 0) | (span(skipped, low, high).bitwiseAND(F.shiftleft(beyond, 2)) == 0)

    nearby = (F.bit_count(span(stands, 0, h)) < 2) | one_gap(0, h)
    further = (span(stands, h, n) == 0) | one_gap(h, n)
    moved = F.bit_count(span(missed, h, n)) < 2
    turn = F.when(nearby, 0).when(further, 1).when(moved, 2).otherwise(3)
    return met.select("qid", "guide", "_beside", ((fewest([(stands, skipped, missed)], budget) <= budget) & (turn == F.col("turn"))).alias("ok")).where("ok")


#: Targets, and guides, that a task of a scan without seeds compares with each other: two tables of that size meet in one group.
SCANNED = 1 << 15
#: Rows of the products that it holds at a time.
STRIP = 256


def scan(contigs: DataFrame, guides: DataFrame, length: int, budget: int, pam: str = "NGG", side: str = "3prime") -> DataFrame:
    """What ``search`` returns, by comparing every distinct stretch beside a PAM with every guide: for budgets that no seed plan serves.

    Both are dealt to blocks, and every block of stretches meets every block of guides in a group of its own: any number of guides is served,
    no task holds more than two blocks, and the work is the product of both numbers. Equal bases of a block are counted by a matrix product.
    """
    sites = beside_pam(contigs, length, pam, side)
    targets, own = cut(sites.select("target").distinct()), cut(guides.select("qid", "guide").distinct())
    n_targets, n_guides = (max(1, -(-rows.count() // SCANNED)) for rows in (targets, own))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = targets.withColumn("_t", F.pmod(F.xxhash64("target"), F.lit(n_targets)).cast("int")).withColumn("_g", every(n_guides))
    right = own.where(F.length("guide") == length).withColumn("_g", F.pmod(F.xxhash64("qid", "guide"), F.lit(n_guides)).cast("int")).withColumn("_t", every(n_targets))

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        letters = [np.frombuffer("".join(t.column(c).to_pylist()).encode("ascii", "replace"), np.uint8).reshape(-1, length) for t, c in ((a, "target"), (b, "guide"))]
        ours, theirs = (np.concatenate([x == ord(base) for base in "ACGT"], axis=1).astype(np.float32) for x in letters)
        found = []
        for at in range(0, len(ours), STRIP):
            equal = ours[at : at + STRIP] @ theirs.T
            i, j = np.nonzero(equal >= length - budget)
            found.append((i + at, j, length - equal[i, j]))
        i, j, bad = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
        i, j = pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64))
        return pa.table({"target": a.column("target").take(i), "qid": b.column("qid").take(j), "guide": b.column("guide").take(j), "mismatch": pa.array(bad.astype(np.int32))})

    pairs = left.groupBy("_t", "_g").cogroup(right.groupBy("_t", "_g")).applyInArrow(met, "target string, qid string, guide string, mismatch int")
    return sites.join(pairs, "target").select("qid", "guide", "seq_id", "start", "strand", "target", "pam", "mismatch")


def top(hits: DataFrame, n: int) -> DataFrame:
    """The n best hits of each guide, by mismatches, then place."""
    order = Window.partitionBy("qid").orderBy("mismatch", "seq_id", "start", "strand")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def summary(guides: DataFrame, hits: DataFrame, seed_start: int = 13, seed_end: int = 20, penalty: float = 0.25) -> DataFrame:
    """Each guide's hits by mismatches, the weighted count, and two specificities.

    legacy: hits of k mismatches or fewer, times ten to the power 1 - k, over k from 0 to 5. specificity: 1 / (1 + sum of the
    similarities), where one perfect hit is taken to be the guide's own site; seed_specificity multiplies a similarity by the penalty
    for each mismatch within the seed (from 1, both ends included). A guide without hits is wholly specific.
    """
    g, t = F.col("guide"), F.col("target")
    alike = (F.length("guide") - F.col("mismatch")) / F.length("guide")
    in_seed = S.mismatches(F.substring(g, seed_start, seed_end - seed_start + 1), F.substring(t, seed_start, seed_end - seed_start + 1))
    hits = hits.withColumn("_alike", alike).withColumn("_seed", alike * F.pow(F.lit(penalty), in_seed))
    counts = [F.coalesce(F.count_if(F.col("mismatch") == k), F.lit(0)).alias(f"mm{k}") for k in range(6)]
    per = hits.groupBy("qid").agg(*counts, F.sum("_alike").alias("_sum"), F.max("_alike").alias("_best"), F.sum("_seed").alias("_seed_sum"), F.max("_seed").alias("_seed_best"))
    rows = guides.select("qid", "guide").join(per, "qid", "left").fillna(0)
    legacy = sum((sum((F.col(f"mm{j}") for j in range(1, k + 1)), F.col("mm0")) * (10.0 ** (1 - k)) for k in range(1, 6)), F.col("mm0") * 10.0)
    left = lambda s, b: F.when(F.col(b) >= 0.999999, F.greatest(F.lit(0.0), F.col(s) - 1)).otherwise(F.col(s))
    return rows.select("qid", "guide", *(f"mm{k}" for k in range(6)), legacy.alias("legacy_score"), (1 / (1 + left("_sum", "_best"))).alias("specificity"), (1 / (1 + left("_seed_sum", "_seed_best"))).alias("seed_specificity"))
