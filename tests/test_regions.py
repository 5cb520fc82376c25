import random

import pytest
from pyspark.sql import functions as F

from guidespan.functions import seq as S
from guidespan.operators import regions, sides
from guidespan.operators.patterns import Motif, centres
from guidespan.sources import annotation as A

BASES = "".join(random.Random(3).choices("ACGT", k=3000))
LINES = [
    "c1\tx\tgene\t11\t2900\t.\t-\t.\tID=g1;Name=one",
    "c1\tx\tmRNA\t11\t2900\t.\t-\t.\tID=long;Parent=g1",
    "c1\tx\tmRNA\t100\t2500\t.\t-\t.\tID=ref;Parent=g1;tag=basic, RefSeq",
    "c1\tx\tmRNA\t100\t2400\t.\t-\t.\tID=best;Parent=g1;tag=MANE",
    "c1\tx\tlnc_RNA\t11\t2900\t.\t-\t.\tID=other;Parent=g1;tag=MANE",
    "c1\tx\texon\t11\t2900\t.\t-\t.\tParent=long",
    "c1\tx\texon\t1500\t2400\t.\t-\t.\tParent=best",
    "c1\tx\texon\t100\t1200\t.\t-\t.\tParent=best",
    "c1\tx\texon\t1201\t1300\t.\t-\t.\tParent=best",
    "c1\tx\tCDS\t150\t1200\t.\t-\t.\tParent=best",
    "c1\tx\tgene\t1\t50\t.\t+\t.\tID=bare",
    "c2\tx\tgene\t1\t5000\t.\t+\t.\tID=g2",
    "c2\tx\tmRNA\t1\t5000\t.\t+\t.\tID=t2;Parent=g2",
]


def flipped(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([("c1", BASES), ("c2", "ACGTACGTAC"), ("c3", "")], "seq_id string, seq string")


def test_regions_of_the_preferred_transcript(spark, contigs):
    parsed = A.parsed(spark.createDataFrame([(x,) for x in LINES], "value string"))
    got = {(r.gene_key, r.region): r.sequence for r in regions.of_genes(parsed, contigs).collect()}
    at = lambda a, b: BASES[a - 1 : b]
    assert got == {
        ("g1", "gene"): flipped(at(11, 2900)),
        ("g1", "exons"): flipped(at(100, 1200) + at(1201, 1300) + at(1500, 2400)),
        ("g1", "exon1"): flipped(at(1500, 2400)),
        ("g1", "exon2"): flipped(at(1201, 1300)),
        ("g1", "exon3"): flipped(at(100, 1200)),
        ("g1", "introns"): flipped(at(1301, 1499)),
        ("g1", "intron1"): flipped(at(1301, 1499)),
        ("g1", "5utr"): flipped(at(1201, 2400)),
        ("g1", "3utr"): flipped(at(100, 149)),
        ("g2", "gene"): "ACGTACGTAC",
    }
    assert [r.gene for r in regions.of_genes(parsed, contigs, "exon2").collect()] == ["one"]
    assert regions.of_genes(parsed.limit(0), contigs).count() == 0


def test_padded_intervals(spark, contigs):
    held = spark.createDataFrame([("c1", 1020, 1030, "a", "-"), ("c2", 0, 4, "b", "+"), ("c2", 90, 99, "c", "+"), ("c2", 5, 5, "d", "+"), ("c9", 1, 9, "e", "+"), ("c2", 0, 4, "b", "+")], "seq_id string, start long, end long, name string, strand string")
    got = sorted((r.region, r.start, r.end, r.strand, r.sequence) for r in regions.padded(held, contigs, 8).collect())
    assert got == [("a", 1012, 1038, "-", BASES[1012:1038]), ("b", 0, 10, "+", "ACGTACGTAC"), ("d", 0, 10, "+", "ACGTACGTAC")]


@pytest.mark.parametrize(
    ("text", "want"),
    [("x region:c1:5:9:+ y", ("c1", 5, 9, "+", 0)), ("region:c1:5:9:-:7", ("c1", 5, 9, "-", 7)), ("region:c1:a:9:-", None), ("region:c1:5:9", None), ("region:c1:5:9:+:q", None), ("nothing", None), ("", None), (None, None)],
)
def test_described(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(regions.described(F.col("t")).alias("d")).first().d
    assert (tuple(got) if got else None) == want


def test_inverted_repeats_equal_brute_force(spark):
    draw = random.Random(5)
    texts = ["", "AC", "ACGT", "AAATTT", "GGGACCC"] + ["".join(draw.choices("ACGTN", [9, 9, 9, 9, 1], k=draw.randrange(6, 30))) for _ in range(60)]

    def longest(s):
        return max((n for n in range(3, len(s) // 2 + 1) for i in range(len(s) - 2 * n + 1) if s.find(flipped(s[i : i + n]), i + n) >= 0), default=0)

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.inverted_repeat(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: longest(t) for t in texts}


def test_sides_equal_brute_force(spark, contigs):
    left, right = sides.Side(Motif("GG", 5, "upstream"), 1, 12), sides.Side(Motif("AC", 4, "downstream"), 0, 9)
    rows = sides.shown(sides.candidates(contigs, centres(contigs, "GAT"), left, right), contigs, 40).collect()
    want = set()
    for i in range(len(BASES) - 2):
        for strand, y in (("+", "GAT"), ("-", "ATC")):
            if BASES[i : i + 3] != y:
                continue
            for name, side in (("left", left), ("right", right)):
                for direction, codes in (("plus", side.motif.codes), ("minus", flipped(side.motif.codes))):
                    for m in range(len(BASES) - 1):
                        away = m - i - 3 if (strand == "-") == (name == "left") else i - m - 2
                        if BASES[m : m + 2] == codes and side.nearest <= away <= side.farthest:
                            before = (direction == "plus") == (side.motif.side == "upstream")
                            a, b = (max(0, m - side.motif.flank), m + 2) if before else (m, min(len(BASES), m + 2 + side.motif.flank))
                            shown = BASES[min(a, i) : i] + y.lower() + BASES[i + 3 : max(b, i + 3)]
                            want.add(("c1", i, strand, name, m, direction, away, BASES[a:b], shown))
    assert len(rows) == len(want) > 50
    assert {(r.seq_id, r.y_start, r.strand, r.side, r.motif_start, r.motif_strand, r.distance, r.sequence, r.region_seq) for r in rows} == want


def test_centres_with_the_bases_around_them_shuffle_nothing(spark, contigs):
    # Contigs end beside centres, and hold an N, so that all is clamped and compared as by the join.
    held = contigs.unionByName(spark.createDataFrame([("c3", "CCGATAC"), ("c4", "GTATCNGGATGGGATTACACC"), ("c5", "GAT")], "seq_id string, seq string"))
    left, right = sides.Side(Motif("GG", 5, "upstream"), 1, 12), sides.Side(Motif("AC", 4, "downstream"), 0, 9)
    plain = sides.candidates(held, centres(held, "GAT"), left, right)
    rows = sides.candidates(held, centres(held, "GAT", sides.reach(left, right)), left, right)
    key = ["seq_id", "y_start", "y_end", "strand", "side", "motif_start", "motif_strand", "motif_seq", "distance", "full_start", "full_end", "sequence", "region_seq"]
    shown = [sides.shown(r, held, 40).select(*key) for r in (plain, rows)]
    assert shown[0].schema.simpleString() == shown[1].schema.simpleString()
    got, want = sorted(map(tuple, shown[1].collect())), sorted(map(tuple, shown[0].collect()))
    assert got == want and {r[0] for r in got} >= {"c1", "c3", "c4"}
    plan = shown[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_pairs_of_sides_and_why_they_fail(spark):
    schema = "seq_id string, y_start long, y_end long, strand string, side string, motif_start long, motif_strand string, distance long, nuclease string"
    rows = spark.createDataFrame(
        [("c", 50, 55, "+", "left", 40, "plus", 8, "a"), ("c", 50, 55, "+", "left", 45, "plus", 3, "a"), ("c", 50, 55, "+", "right", 70, "minus", 15, "b"), ("c", 90, 95, "+", "right", 96, "odd", 1, "b")], schema
    )
    out = sides.paired(rows, {"left": 4, "right": 4})
    why = sides.compatibility(F.col("left"), F.col("right"), {"left": (5, None), "right": (2, 10)}, nucleases={"left": "a", "right": "a"})
    got = {r.y_start: (r.left and r.left.motif_start, r.c.hard_fail, r.c.hard_reasons, r.c.soft_warnings) for r in out.withColumn("c", why).collect()}
    assert got == {
        50: (45, True, ["distance_below_min:left:3.0", "distance_above_max:right:15.0"], ["nuclease_mismatch:left_right:a:b", "nuclease_mismatch:right:a:b"]),
        90: (None, True, ["missing_side:left", "invalid_strand:right:odd", "distance_missing:left", "distance_below_min:right:1.0"], ["nuclease_mismatch:right:a:b"]),
    }


def test_recall(spark):
    hits = lambda *rows: spark.createDataFrame(list(rows), "qid string, seq_id long, start long, strand string")
    full = hits(("a", 1, 5, "+"), ("a", 1, 5, "+"), ("a", 1, 9, "-"))
    some = hits(("a", 1, 9, "-"), ("a", 2, 9, "-"), ("b", 1, 1, "+"))
    got = {r.qid: (r.reference, r.some, r.some_recall) for r in sides.recall({"full": full, "some": some}, "full").collect()}
    assert got == {"a": (2, 2, 0.5), "b": (0, 1, None)}
    with pytest.raises(ValueError):
        sides.recall({"full": full}, "none")
