import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from guidespan.functions import seq as S
from guidespan.operators import export, intervals, pairs, patterns, search
from guidespan.operators.alignment import align
from guidespan.sources import contigs as C

SEQ = "ACGTTGACCAGGTTTTACGNACGGATTACAGGTCATGCCGGTTAACCGGTAGGATTAACGGCCTTAAGGCCAATTGGCCTAGGATTACC"


def flipped(s):
    return s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


@pytest.fixture(scope="module")
def held(spark):
    return spark.createDataFrame([(1, SEQ), (2, SEQ[::-1] * 30), (3, "AC")], "seq_id long, seq string")


def test_windows_cross_chunks(spark, held):
    got = {(r.seq_id, r.pos) for r in C.windows(held, 3, "[ACGT]GG").collect()}
    want = {(i, m.start()) for i, s in ((1, SEQ), (2, SEQ[::-1] * 30)) for m in re.finditer("(?=[ACGT]GG)", s)}
    assert got == want


def test_single_motif_drops_clipped_sites(spark, held):
    got = {tuple(r) for r in patterns.single(held.where("seq_id = 1"), patterns.Motif("NGG", 10, "upstream")).collect()}
    want = set()
    for i in range(len(SEQ)):
        w = SEQ[i : i + 13]
        if re.fullmatch("[A-Z]{10}[ACGT]GG", w):
            want.add((1, "plus", i + 10, i, w))
        if re.fullmatch("CC[ACGT][A-Z]{10}", w):
            want.add((1, "minus", i, i, w))
    assert got == want


def test_unique_numbers_follow_first_sight(spark, held):
    rows = patterns.unique(patterns.single(held, patterns.Motif("GG", 2))).collect()
    assert sorted(int(r.qid[5:]) for r in rows) == list(range(1, len(rows) + 1))
    assert sum(r.n_positions for r in rows) == patterns.single(held, patterns.Motif("GG", 2)).count()


@pytest.mark.parametrize("budget", [0, 1, 3])
@pytest.mark.parametrize(("pam", "side"), [("NGG", "3prime"), ("TTN", "5prime")])
def test_search_equals_brute_force(spark, held, budget, pam, side):
    n, guide = 8, "GATTACAG"
    guides = spark.createDataFrame([("a", guide), ("b", "AACCGGTA")], "qid string, guide string")
    got = {(r.qid, r.seq_id, r.start, r.strand, r.mismatch) for r in search.search(held, guides, n, budget, pam, side).collect()}
    want = set()
    for seq_id, s in ((1, SEQ), (2, SEQ[::-1] * 30)):
        for strand, text in (("+", s), ("-", flipped(s))):
            for i in range(len(text) - n + 1):
                beside = text[i + n : i + n + len(pam)] if side == "3prime" else text[max(0, i - len(pam)) : i]
                target = text[i : i + n]
                if re.fullmatch(S.pattern(pam), beside) and set(target) <= set("ACGT"):
                    for qid, g in (("a", guide), ("b", "AACCGGTA")):
                        mm = sum(x != y for x, y in zip(g, target, strict=True))
                        if mm <= budget:
                            want.add((qid, seq_id, i if strand == "+" else len(s) - i - n, strand, mm))
    assert got == want


@given(st.integers(2, 24), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_seed_plans_are_lossless(length, budget):
    if budget >= length:
        return
    plan = search.seed_plan(length, budget)
    assert sum(k for _, k in plan.segments) == length
    for places in itertools.islice(itertools.combinations(range(length), budget), 2000):
        assert any(sum(s <= p < s + k for p in places) <= plan.changes for s, k in plan.segments)


@given(st.text("ACGT", min_size=1, max_size=7), st.text("ACGT", min_size=1, max_size=7))
@settings(max_examples=200, deadline=None)
def test_alignment_is_cheapest(a, b):
    cost = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = [cost[i - 1, j - 1] + 2 * (a[i - 1] != b[j - 1])] if i and j else []
            options += [cost[i - 1, j] + 3] if i else []
            options += [cost[i, j - 1] + 3] if j else []
            cost[i, j] = min(options, default=0)
    x, g, d, cigar = align(a, b, 14)
    assert 2 * x + 3 * (g + d) == cost[len(a), len(b)]
    assert sum(int(n) for n, op in re.findall(r"(\d+)([MXID])", cigar) if op != "D") == len(a)


def test_known_activity(spark):
    row = spark.range(1).select(S.activity(F.lit("AGGCGAGCGCAAGGTTATACGCT")).alias("a"), S.activity(F.lit("")).alias("b")).first()
    assert row.a == pytest.approx(0.8572463768115942) and row.b == 0


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 10, 300), (1, 20, 30), (2, 4, 4)], "seq_id long, start long, end long")
    assert sorted(map(tuple, intervals.merge(rows).collect())) == [(1, 0, 9), (1, 10, 300)]
    points = spark.createDataFrame([(1, 9), (1, 299), (1, 300), (2, 4)], "seq_id long, start long")
    assert sorted(map(tuple, intervals.starts_within(points, intervals.merge(rows)).collect())) == [(1, 9), (1, 300), (2, 4)]
    assert [tuple(r) for r in intervals.starts_within(points, intervals.merge(rows), how="left_semi").collect()] == [(1, 299)]


def test_nearest(spark):
    marks = spark.createDataFrame([(1, 10), (1, 20)], "seq_id long, mark long")
    points = spark.createDataFrame([(1, p) for p in (0, 10, 15, 16, 99)] + [(2, 1)], "seq_id long, pos long")
    assert sorted(((r.seq_id, r.pos), r.nearest) for r in intervals.nearest(points, marks).collect()) == [((1, 0), 10), ((1, 10), 10), ((1, 15), 10), ((1, 16), 20), ((1, 99), 20), ((2, 1), None)]


def test_fetch_clamps(spark, held):
    rows = spark.createDataFrame([(1, -3, 2), (1, 1, 4), (2, 1020, 1030), (3, 1, 9), (9, 0, 2)], "seq_id long, a long, b long")
    got = {(r.seq_id, r.a): r.s for r in C.fetch(rows, held, F.col("a"), F.col("b"), "s", 20).collect()}
    assert got == {(1, -3): SEQ[:2], (1, 1): SEQ[1:4], (2, 1020): (SEQ[::-1] * 30)[1020:1030], (3, 1): "C", (9, 0): None}


def test_gap_pairs_come_once(spark, held):
    left, right = patterns.Motif("GG", 3, "upstream"), patterns.Motif("CC", 3)
    rows = patterns.gap_pairs(held, left, right, 1, 6).collect()
    assert rows and len({(r.seq_id, r.left_pos, r.right_pos) for r in rows}) == len(rows)
    assert all(1 <= r.gap <= 6 for r in rows)


def test_percentiles_and_ranks(spark):
    rows = spark.createDataFrame([("m", 1.0), ("m", 1.0), ("m", 2.0), ("k", 5.0), ("m", None)], "model string, score double")
    got = sorted(((r.model, r.score or 0), r.p) for r in pairs.percentile(rows, "score", ["model"], "p").collect())
    assert got == [(("k", 5.0), None), (("m", 0), None), (("m", 1.0), 0.5), (("m", 1.0), 0.5), (("m", 2.0), 1.0)]
    ranks = pairs.competition(rows.where("model = 'm' and score is not null"), [F.col("score")], "r", ["model"])
    assert sorted(r.r for r in ranks.collect()) == [1, 1, 3]
    with pytest.raises(ValueError):
        pairs.Policy(e_min=0.9)


def test_sources_and_exports(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first\nACgt\nNN\n>c2\nTT\n")
    assert sorted(map(tuple, C.from_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("c1", "ACGTNN"), ("c2", "TT")]
    (tmp_path / "b.bed").write_text("#x\nc1\t0\t4\tn\t0\t-\nc1\tq\t4\nc2\t1\t2\n")
    assert [tuple(r) for r in C.from_bed(spark, str(tmp_path / "b.bed")).collect()] == [("c1", 0, 4, "n", "-"), ("c2", 1, 2, "c2:1:2", "+")]
    rows = spark.createDataFrame([("c1", -2, 4, "minus", "n", " "), ("c2", 1, 4, "?", "m", None)], "seq_id string, start long, end long, strand string, name string, blank string")
    assert [r.line for r in export.bed(rows, "name").collect()] == ["c1\t0\t4\tn\t0\t-", "c2\t1\t4\tm\t0\t."]
    assert export.without_blank_columns(rows).columns == ["seq_id", "start", "end", "strand", "name"]
    assert [r.line for r in export.fasta(rows, "name", "blank").collect()] == [">n\n "]


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
