import math
import random

import pytest
from pyspark.sql import functions as F

from guidespan.functions import scores as V
from guidespan.operators import annotate, batches, intervals, library
from guidespan.sources import annotation as A

LINES = [
    "##gff-version 3",
    "c1\tx\tgene\t1\t900\t.\t+\t.\tID=g1;Name=one;locus_tag=l1",
    "c1\tx\tmRNA\t1\t900\t.\t+\t.\tID=t1;Parent=none,g1;tag=MANE Select",
    "c1\tx\tmRNA\t1\t950\t.\t+\t.\tID=t2;Parent=g1",
    "c1\tx\texon\t1\t300\t.\t+\t.\tParent=t1",
    "c1\tx\texon\t400\t900\t.\t+\t.\tParent=t1",
    "c1\tx\tCDS\t100\t300\t.\t+\t.\tParent=t1",
    "c1\tx\tCDS\t400\t700\t.\t+\t.\tParent=t1",
    "c2\tx\tgene\t1\t900\t.\t-\t.\tgene_id \"g2\"",
    "c2\tx\tmRNA\t1\t900\t.\t-\t.\tID=t3;Parent=g2",
    "c2\tx\texon\t1\t300\t.\t-\t.\tParent=t3",
    "c2\tx\tCDS\t100\t250\t.\t-\t.\tParent=t3",
    "c2\tx\tmRNA\tq\t900\t.\t-\t.\tID=t4;Parent=g2",
    "c3\tx\tmRNA\t1\t900\t.\t-\t.\tID=t5;Parent=gone",
    "short\tline",
]


@pytest.fixture(scope="module")
def parsed(spark):
    return A.parsed(spark.createDataFrame([(x,) for x in LINES], "value string")).cache()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_attributes_of_both_forms(spark):
    pairs = A.attributes(F.lit('a=1;b "two w";;c;a= 3=4 '))
    assert value(spark, A.attribute(pairs, "a")) == "3=4"
    assert value(spark, A.attribute(pairs, "z", "b")) == "two w"
    assert value(spark, A.attribute(pairs, "c")) is None
    assert value(spark, A.attribute(A.attributes(F.lit(".")), "a")) is None


def test_parents_and_untranslated_regions(spark, parsed):
    assert sorted((r.transcript_id, r.gene_key, r.mane) for r in annotate.transcripts(parsed).collect()) == [("t1", "g1", 0), ("t2", "g1", 2), ("t3", "g2", 2)]
    got = {(r.transcript_id, r.type, r.start, r.end) for r in annotate.utrs(annotate.parts(parsed)).collect()}
    assert got == {("t1", "five_prime_UTR", 1, 99), ("t1", "three_prime_UTR", 701, 900), ("t3", "five_prime_UTR", 251, 300), ("t3", "three_prime_UTR", 1, 99)}
    assert sorted((r.gene_key, r.transcript_id) for r in annotate.chosen(annotate.transcripts(parsed)).collect()) == [("g1", "t1"), ("g2", "t3")]


def test_what_lies_at_an_interval(spark, parsed):
    points = spark.createDataFrame([("c1", 150, 160), ("c1", 320, 330), ("c1", 10, 20), ("c1", 960, 970), ("c9", 0, 5), ("c1", 5, 5), ("c1", 0, 9000)], "seq_id string, start long, end long")
    got = {(r.seq_id, r.start): (r.feature, r.gene, r.isoforms) for r in annotate.overlaps(points, annotate.features(parsed)).collect()}
    assert got == {
        ("c1", 150): ("CDS", "one", "t1(MANE)(CDS),t2(mRNA)"),
        ("c1", 320): ("intron", "one", "t1(MANE)(mRNA),t2(mRNA)"),
        ("c1", 10): ("exon", "one", "t1(MANE)(exon),t2(mRNA)"),
        ("c1", 960): ("intergenic", "", ""),
        ("c9", 0): (None, "", ""),
        ("c1", 0): ("CDS", "one", "t1(MANE)(CDS),t2(mRNA)"),
    }


def test_nearest_start_of_a_transcript(spark, parsed):
    points = spark.createDataFrame([("c1", 9, 11), ("c2", 1000, 1002), ("c9", 0, 2)], "seq_id string, start long, end long")
    got = {r.seq_id: (r.tss, r.tss_distance, r.tss_transcript) for r in annotate.nearest_start(points, annotate.transcripts(parsed)).collect()}
    assert got == {"c1": (1, 10, "t1"), "c2": (900, -102, "t3"), "c9": (None, None, None)}


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    marks = [(s, rng.randrange(-2000, 5000)) for s in (1, 2) for _ in range(40)]
    points = [(s, rng.randrange(-3000, 9000)) for s in (1, 2, 3) for _ in range(60)]
    got = intervals.nearest(spark.createDataFrame(points, "seq_id long, pos long"), spark.createDataFrame(marks, "seq_id long, mark long")).collect()
    want = [(s, p, min((m for t, m in marks if t == s), key=lambda m: (abs(m - p), m), default=None)) for s, p in points]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_downstream_start(spark):
    held = spark.createDataFrame([("c", "CCCATGGTTTTCATGACCATGA")], "seq_id string, seq string")
    points = spark.createDataFrame([("c", 5, 7, "+"), ("c", 18, 20, "-"), ("c", 20, 22, "+"), ("c", 0, 2, "-")], "seq_id string, start long, end long, strand string")
    got = {(r.start, r.strand): r.atg for r in annotate.downstream_atg(points, held).collect()}
    assert got == {(5, "+"): 12, (18, "-"): 14, (20, "+"): None, (0, "-"): None}


def test_weighted_similarity(spark):
    weights = V.rule_weights(20)
    sim = lambda g, t, pam=None: value(spark, V.weighted_similarity(F.lit(g), F.lit(t), weights, None if pam is None else F.lit(pam)))
    guide = "ACGTACGTACGTACGTACGT"
    assert sim(guide, guide) == 1 and sim(guide, guide, "AGG") == 1 and sim(guide, guide, "AAG") == 0.259259259 and sim(guide, guide, "TTT") == 0
    assert sim(guide, "G" + guide[1:]) == pytest.approx(1 - 0.6 / 20) and sim(guide, guide[:-1] + "A") == pytest.approx(0.1)
    assert sim(guide, guide[:5]) == 0 and sim("", "") == 0 and sim(guide, "N" + guide[1:]) == 1


def brute_hairpin(s):
    pair, best = {"A": "T", "T": "A", "C": "G", "G": "C"}, 0
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            n = 0
            while i + n < len(s) and j - n >= 0 and pair.get(s[i + n]) == s[j - n]:
                n += 1
            best = max(best, n)
    return best


def test_hairpins_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["", "A", "AT", "NN", "ANT"] + ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 24))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", V.hairpin(F.col("s")).alias("n")).collect()
    assert all(r.n == brute_hairpin(r.s) for r in rows)


def test_hairpins_are_looked_for_in_batches(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choices("acgtUN-é", [9, 9, 9, 9, 1, 1, 1, 1], k=rng.choice([0, 1, 2, 15, 16, 40]))) for _ in range(300)]

    def plain(s):
        dna = s.upper().replace("U", "T")
        other = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(b, ".") for b in reversed(dna))
        return max((k for k in range(1, len(dna) + 1) for i in range(len(dna) - k + 1) if dna[i : i + k] in other), default=0)

    want = list(map(plain, texts))
    assert V.hairpins([*texts, None]).tolist() == [*want, 0]
    monkeypatch.setattr(V, "HELD", 64)
    assert V.hairpins(texts).tolist() == want
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(V.compact_activity(F.col("s"), "GATTACA"))
    assert "lambdafunction" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_bulge_risk(spark):
    risk = lambda g, t, mm, rna, dna, indel: value(spark, V.bulge_risk(F.lit(g), F.lit(t), F.lit(mm), F.lit(rna), F.lit(dna), F.lit(indel)))
    assert risk("ACGT", "AC-T", 0, 1, 0, 1) == 0.5
    assert risk("ACGT", "AC-A", 1, 1, 0, 2) == pytest.approx(2 / 3 * 0.25 * 0.75)
    assert risk("", "", 0, 0, 0, 0) == 0.01


def test_logistic(spark):
    seq = "ACGT" * 7 + "GG"
    weights = {(0, "A"): 0.5, (1, "C"): -0.25, (28, "GG"): 1.0, (3, "A"): 9.0}
    got = lambda s: value(spark, V.logistic(F.lit(s), weights, 0.1, -0.2, -0.3))
    assert got(seq) == pytest.approx(1 / (1 + math.exp(-(0.5 - 0.25 + 1.0 + 0.1 - 0.3))))
    assert got(seq[:29]) is None and got("N" + seq[1:]) is None


def test_biases_of_empty_sequences(spark):
    assert value(spark, V.bias(F.lit(""))) == 0 and value(spark, V.compact_activity(F.lit(""))) == pytest.approx(0.25 / 0.75)
    assert value(spark, V.identity(F.lit(""), F.lit("A"))) == 0


def test_guides_on_both_strands(spark):
    held = spark.createDataFrame([("c", "CCATTTTAAGG")], "seq_id string, seq string")
    rows = library.find_guides(held, 4, "NGG", "3prime", "AAAA").collect()
    assert sorted((r.strand, r.guide_seq, r.pam_seq, r.spacer_start, r.spacer_end, r.pam_start, r.pam_end, r.motif_overlap) for r in rows) == [("+", "TTTA", "AGG", 4, 8, 8, 11, 0), ("-", "TTTT", "TGG", 3, 7, 0, 3, 4)]
    assert {r.spacer_start for r in library.find_guides(held, 4, both=False).collect()} == set(range(8))
    assert library.filtered(library.find_guides(held, 4, "NGG", motif="AAAA"), 0, 10).count() == 0
    none = library.summary(library.find_guides(held.where("false"), 4)).first()
    assert tuple(none) == (0, 0, 0.0, 0.0, 0.0)


def test_batches(spark):
    groups = spark.createDataFrame([([1, 2, 9], ["p"]), ([1], ["p", "q/" + "z" * 100])], "scope_ids array<long>, pattern_ids array<string>")
    rows = batches.units(groups, spark.createDataFrame([(1,), (2,)], "scope_id long"), groups.select(F.explode("pattern_ids").alias("pattern_id")))
    ids = [r.unit_id for r in rows.collect()]
    assert len(ids) == 3 == len(set(ids)) and {"1__p", "2__p"} < set(ids) and max(map(len, ids)) == 80
    prior = spark.createDataFrame([("1__p", "done", "a"), ("2__p", "failed", "b"), (" ", "done", "c"), ("2__p", "failed", "a")], "unit_id string, status string, message string")
    assert "1__p" not in [r.unit_id for r in batches.remaining(rows, prior).collect()]
    new = spark.createDataFrame([("1__p", "failed", 3)], "unit_id string, status string, n long")
    assert sorted((r.unit_id, r.status, r.n, r.message) for r in batches.merged(new, prior).collect()) == [("1__p", "failed", 3, None), ("2__p", "failed", None, "a")]
    one = batches.keyed(spark.createDataFrame([(1, "own")], "x long, unit_id string"), F.lit("u1"), F.lit("s"), F.lit("p"))
    two = batches.keyed(spark.createDataFrame([(2,)], "y long"), F.lit("u2"), F.lit("s"), F.lit("p"))
    got = batches.united([one, two], "b")
    assert got.columns == ["batch_label", "unit_id", "scope_id", "pattern_id", "x", "batch_unit_id", "y"]
    assert sorted(map(str, map(tuple, got.collect()))) == ["('b', 'u1', 's', 'p', 1, 'own', None)", "('b', 'u2', 's', 'p', None, None, 2)"]
    used = spark.createDataFrame([("m", ""), ("m", "x"), ("m", "a"), ("k", None)], "model string, note string")
    assert sorted(map(tuple, batches.provenance(used, "model", "note").collect())) == [("k", 1, 0, ""), ("m", 3, 2, "a; x")]
