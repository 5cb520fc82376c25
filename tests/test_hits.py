import itertools
import random

import pytest
from pyspark.sql import functions as F

from guidespan.functions import formats, scores
from guidespan.functions import seq as S
from guidespan.jobs import queries
from guidespan.operators import alignment, export, hits, intervals, ordinals, patterns, search, windows
from guidespan.sources import contigs as C
from guidespan.sources import tables


def flipped(s):
    return s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


def cost(query, target, gaps):
    """Every alignment, one by one: (cost, mismatches, bulges) of the least cost, then of the fewest bulges; None beyond the gaps."""
    best = None
    for i in range(gaps + 1):
        j = i + len(target) - len(query)
        if j < 0:
            continue
        for a in itertools.combinations(range(len(query)), i):
            for b in itertools.combinations(range(len(target)), j):
                left = [c for k, c in enumerate(query) if k not in a]
                right = [c for k, c in enumerate(target) if k not in b]
                mm = sum(x != y for x, y in zip(left, right, strict=True))
                best = min(filter(None, [best, (2 * mm + 3 * (i + j), i + j, mm)]))
    return None if best is None or best[1] > gaps else (best[0], best[2], best[1])


@pytest.mark.parametrize(("pam", "side", "budget", "bulges"), [("NGG", "3prime", 2, 1), ("TTN", "5prime", 1, 2), ("NGG", "3prime", 1, 0)])
def test_bulge_search_equals_brute_force(spark, pam, side, budget, bulges):
    rng = random.Random(1)
    guides = ["GATTACAGCA", "AACCGGTATC"]
    parts = []
    for _ in range(60):  # guides with planted edits beside a PAM, and noise
        g = list(rng.choice(guides))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(g))
            g[at : at + rng.randint(0, 1)] = rng.choices("ACGT", k=rng.randint(0, 1))
        near = "".join(rng.choice(S.IUPAC[c]) for c in pam)
        site = "".join(g) + near if side == "3prime" else near + "".join(g)
        parts.append(rng.choice([site, flipped(site)]) + "".join(rng.choices("ACGT", k=rng.randint(0, 6))))
    held = {"x": "".join(parts), "y": "".join(g if side == "3prime" else flipped(g) for g in guides) + "".join(parts[:3]) + "N" + guides[0]}
    got = {}
    rows = search.bulge_search(spark.createDataFrame(list(held.items()), "seq_id string, seq string"), spark.createDataFrame([("a", guides[0]), ("b", guides[1])], "qid string, guide string"), 10, budget, bulges, pam, side).collect()
    for r in rows:
        border = r.target_end if (side == "3prime") == (r.strand == "+") else r.start
        assert (r.qid, r.seq_id, r.strand, border) not in got
        got[r.qid, r.seq_id, r.strand, border] = (2 * r.mismatch + 3 * r.indel, r.mismatch, r.indel, len(r.target))
        assert r.aligned_guide.replace("-", "") == r.guide and r.aligned_target.replace("-", "") == r.target
        piece = held[r.seq_id][r.start : r.target_end]
        assert (piece if r.strand == "+" else flipped(piece)) == r.target
        pairs = list(zip(r.aligned_guide, r.aligned_target, strict=True))
        assert (sum("-" not in p and p[0] != p[1] for p in pairs), sum(p[1] == "-" for p in pairs), sum(p[0] == "-" for p in pairs)) == (r.mismatch, r.rna_bulges, r.dna_bulges)
    want = {}
    for (qid, guide), (seq_id, s) in itertools.product(zip("ab", guides, strict=True), held.items()):
        for strand, text in (("+", s), ("-", flipped(s))):
            for at in range(len(text) - len(pam) + 1):
                if not all(c in S.IUPAC[p] for c, p in zip(text[at : at + len(pam)], pam, strict=True)):
                    continue
                for n in range(10 - bulges, 11 + bulges):
                    lo = at - n if side == "3prime" else at + len(pam)
                    target = text[lo : lo + n] if lo >= 0 else ""
                    if len(target) < n or set(target) - set("ACGT"):
                        continue
                    c = cost(guide, target, bulges)
                    if c and c[1] <= budget:
                        edge = at if side == "3prime" else at + len(pam)
                        key = (qid, seq_id, strand, edge if strand == "+" else len(s) - edge)
                        new = (*c, abs(n - 10), n)
                        want[key] = min(want.get(key, new), new)
    assert got == {k: (v[0], v[1], v[2], v[4]) for k, v in want.items()} and len(got) > 10


def test_seed_plan_counts_bulges():
    plan = search.seed_plan(20, 2, bulges=1)
    assert len(plan.segments) > 1 and plan.changes == 2 // (len(plan.segments) - 1) and sum(n for _, n in plan.segments) == 20
    with pytest.raises(ValueError):
        search.seed_plan(4, 3, bulges=1)


def test_aligned_strings():
    assert alignment.strings("ACGT", "AGTT", "1M1I2M1D") == ("ACGT-", "A-GTT")


def test_numbers_follow_any_order(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randint(0, 40)}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long")
    got = [(r.k, r.i) for r in sorted(ordinals.numbered(df, "n", [F.col("k"), F.col("i").desc()]).collect(), key=lambda r: r.n)]
    assert got == sorted(rows, key=lambda r: (r[0], -r[1]))
    assert ordinals.numbered(df.where("1 = 0"), "n", [F.col("k")]).collect() == []


def test_sums_before_a_row(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), i, rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, w long")
    want = {i: sum(w2 for g2, i2, w2 in rows if g2 == g and i2 < i) for g, i, w in rows}
    assert {r.i: r.s for r in ordinals.summed(df, ["g"], [F.col("i")], "w", "s").collect()} == want
    want = {i: sum(w2 for _, i2, w2 in rows if i2 < i) for _, i, _ in rows}
    assert {r.i: r.s for r in ordinals.summed(df, [], [F.col("i")], "w", "s").collect()} == want


def test_stretches_are_put_together(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), s, s + rng.choice([1, 5, 9, 60])) for s in (rng.randint(0, 900) for _ in range(150))]
    want = []
    for q in "xy":
        for s, e in sorted((s, e) for i, s, e in rows if i == q):
            if want and want[-1][0] == q and s <= want[-1][2]:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([q, s, e])
    df = spark.createDataFrame(rows, "seq_id string, start long, end long")
    assert sorted(list(map(list, (r for r in intervals.merge(df, 50).select("seq_id", "start", "end").collect())))) == sorted(want)
    marks = [("x", rng.randint(0, 5000)) for _ in range(25)]
    points = spark.createDataFrame([("x", p) for p in range(0, 6000, 97)] + [("z", 1)], "seq_id string, pos long")
    for r in intervals.nearest(points, spark.createDataFrame(marks, "seq_id string, mark long"), span=512).collect():
        assert r.nearest == (min((m for _, m in marks), key=lambda m: (abs(m - r.pos), m)) if r.seq_id == "x" else None)


def test_fasta_with_text_ids_reaches_unique_sites(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 first\nACGTACGTACGGACGTTTAGGACC\nTTTT\n>chr2\nACGTACGTACGGACGT\n")
    rows = patterns.unique(patterns.single(C.from_fasta(spark, str(tmp_path / "a.fa")), patterns.Motif("NGG", 4, "upstream"))).collect()
    assert rows and all(p.split(":")[0] in ("chr1", "chr2") for r in rows for p in r.positions.split(";"))
    assert C.from_fasta(spark, str(tmp_path / "a.fa"), ["chr2"]).collect()[0].seq_id == "chr2"
    (tmp_path / "none.fa").write_text("\n")
    with pytest.raises(ValueError):
        C.checked(C.from_fasta(spark, str(tmp_path / "none.fa")))


def test_formats(spark):
    rows = spark.createDataFrame([(1.005, -0.001, float("nan"), None, True, "x"), (2.0, 1e20, float("-inf"), 3, False, None)], "a double, b double, c double, d long, e boolean, f string")
    got = [tuple(r) for r in formats.shown(rows).collect()]
    assert got[0][1:] == ("0.00", "nan", "", "True", "x") and got[1] == ("2.00", "100000000000000000000.00", "-inf", "3", "False", "")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(formats.decimal_text(F.lit(x))) for x in ("007", "1.239", "1e3", ".5", "abc", "-2.")] == ["007", "1.24", "1000.00", "0.50", "abc", "-2.00"]
    assert [one(formats.truth(F.lit(x))) for x in (" Yes", "off", "maybe")] == [True, False, None]
    assert [one(formats.number(F.lit(x))) for x in ("1.5", "nan", "x", "inf")] == [1.5, None, None, None]
    assert [one(formats.slug(F.lit(x))) for x in (" a/b c ", "//", "ok-1.x")] == ["a_b_c", "unnamed", "ok-1.x"]
    assert [one(formats.is_fallback(F.lit(x))) for x in ("nuc_features", "cfd", "identity_heuristic")] == [True, False, True]
    assert one(formats.is_reference_only(F.lit("m_reference_only"))) and one(formats.places_of(F.lit("no list"))) == []
    assert one(F.to_json(formats.places_of(F.lit('[["c\\"1", "plus", 5], ["x"]]')))) == '[{"seq_id":"c\\"1","strand":"plus","start":5}]'


def test_hits(spark):
    held = spark.createDataFrame([("q", "ACGTACGTAC", "t", 5, "ACGTACGTAC", "ACGAACG-AC", 1, 1)], "qid string, guide string, seq_id string, start long, aligned_guide string, aligned_target string, mismatch int, indel int")
    r = hits.normalised(held, "e").first()
    assert (r.target, r.target_start, r.target_end, r.strand, r.query_end, r.engine, r.bitscore, r.cigar) == ("t", 5, 14, "+", 10, "e", 0.0, "")
    edits = lambda a, b, n, side="3prime": spark.range(1).select(hits.seed_edits(F.lit(a), F.lit(b), n, side)).first()[0]
    assert (edits("ACGTACGTAC", "ACGAACG-AC", 4), edits("ACGTACGTAC", "ACGAACG-AC", 4, "5prime"), edits("A-CGT", "ATCGA", 2), edits("", "", 3)) == (1, 1, 1, 0)
    both = hits.normalised(held, "e").unionByName(hits.normalised(held.withColumn("mismatch", F.lit(0)), "f"))
    assert [(r.mismatch, r.engine) for r in hits.deduplicated(both).collect()] == [(0, "f")]
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y", 1), ("z", 2)], "k string, v long")
    assert sorted(map(tuple, hits.key_differences(a, b, "k").collect())) == [("x", "missing"), ("z", "extra")]
    assert sorted(map(tuple, hits.backfilled(a, b, "k").collect())) == [("x", None), ("y", 1)]
    with pytest.raises(ValueError):
        hits.backfilled(a, b, "k", strict=True)


def test_windows(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    split = lambda strand, side, flank=4: one(F.array(*windows.motif_and_flank(F.lit("NGGACGT"), F.lit(strand), side, flank)))
    assert split("plus", "downstream") == ["NGG", "ACGT"] and split("minus", "downstream") == ["CGT"[-3:], "NGGA"] and split("plus", "upstream", 9) == ["NGGACGT", ""]
    assert one(windows.pam_span(F.lit("AGGTTTT"), "NGG", "NGG")).asDict() == {"start": 0, "end": 3, "expected": "NGG"}
    assert one(windows.pam_span(F.lit("TTTTCCA"), "NGG", "NGG")).asDict() == {"start": 4, "end": 7, "expected": "CCN"}
    assert one(windows.pam_span(F.lit("TTTTTTT"), "NGG", "NGG")) is None and one(windows.pam_span(F.lit("AGGTTTT"), "AAA", "TTT")) is None
    assert one(windows.beside_motif(F.lit("AAAACCC"), F.lit(10), F.lit(17), F.lit(14), F.lit(17))) == "AAAA"


def test_readers(spark, tmp_path):
    (tmp_path / "g.tsv").write_text('# engine=x length=20\nnote\tid\tguide_seq\n"a\tb"\tq1\tacgu\nz\t\tTTTT\nz\tq3\t\nz\t\tGGGG\n')
    got = sorted(map(tuple, tables.guides(tables.read(spark, str(tmp_path / "g.tsv"))).collect()))
    assert got == [("guide_1", "TTTT"), ("guide_3", "GGGG"), ("q1", "ACGT")]
    assert tables.remarks(spark, str(tmp_path / "g.tsv")) == {"engine": "x", "length": "20"}
    with pytest.raises(ValueError):
        tables.guides(spark.createDataFrame([("x",)], "id string"))
    lines = spark.createDataFrame([("q\tchr1\t95.0\t20\t1\t0\t1\t20\t101\t120\t1e-5\t40.1\tAC\tAG",), ("q\tchr1\t95\t20\t1\t0\t1\t20\t120\t101\t1e-5\t40.1\tAC\tAG",), ("# x",), ("bad",)], "value string")
    assert [(r.start, r.end, r.strand, r.mismatch) for r in tables.hits(lines).collect()] == [(100, 120, "+", 1), (100, 120, "-", 1)]
    pairs = spark.createDataFrame([("scope_id\tpattern_id",), ("# c",), ("s\tp",), ("s\tp",), ("t\t",)], "value string")
    assert [tuple(r) for r in tables.units(pairs).collect()] == [("s", "p")]
    batch = spark.createDataFrame([('{"groups": [{"group_id": "g", "scope_ids": ["a"], "pattern_ids": ["p", "q"]}]}',)], "value string")
    assert batch.select(F.inline(tables.batch(F.col("value")))).first().pattern_ids == ["p", "q"]
    assert tables.collection([pairs, batch.withColumn("x", F.lit(1))]).columns == ["value", "x"]


def test_exports(spark):
    rows = spark.createDataFrame([("a", 'say "x"', 1.0), ("b", "t\tt", 2.345)], "k string, v string, s double")
    assert [r.line for r in export.delimited(rows).collect()] == ['a\t"say ""x"""\t1.00', 'b\t"t\tt"\t2.35']
    sites = spark.createDataFrame([("u1", "ACG", "c1", "plus", 4), ("u1", "ACG", "c1", "minus", 2), ("u2", "", "c1", "plus", 1)], "qid string, sequence string, seq_id string, strand string, start long")
    (row,) = export.library(sites).collect()
    assert row.positions == '[["c1", "minus", 2], ["c1", "plus", 4]]'
    assert sorted((r.strand, r.start, r.end) for r in windows.candidates(export.library(sites), "downstream", 1).collect()) == [("minus", 3, 5), ("plus", 5, 7)]
    assert [tuple(r) for r in export.unique_guides(sites, "sequence", "qid").collect()] == [("u1", "ACG", 2)]
    named = spark.createDataFrame([("", None, 3), ("a", "b", 4)], "query_id string, qid string, n long")
    assert [r[0] for r in named.select(export.first_name(named, "query_id", "qid", number="n")).collect()] == ["candidate_3", "a"]
    hit = hits.normalised(spark.createDataFrame([("q", "AC", "t", 1, 0)], "qid string, guide string, seq_id string, start long, mismatch int"), "e")
    flank = spark.createDataFrame([("t", 1, "+", "GGG")], "target string, start long, strand string, flank string")
    assert export.flank_fasta(hit, flank).first().line == ">q:t:1:+\nGGG"


def test_published_model(spark):
    """By hand: the sum of what holds in the window."""
    w = "TATAGCTGCGATCTGAGGTAGGGAGGGACC"
    z = scores.INTERCEPT + (scores.LOW_GC if sum(c in "GC" for c in w) < 15 else scores.HIGH_GC) + sum(v for (p, b), v in scores.LOGISTIC.items() if w[p : p + len(b)] == b)
    import math

    assert spark.range(1).select(scores.logistic(F.lit(w))).first()[0] == pytest.approx(1 / (1 + math.exp(-z)))
    assert len(scores.LOGISTIC) == 70


def test_logistic_falls_back_to_the_rule(spark):
    from guidespan.jobs import tables as jobs

    got = jobs.window_models(spark, "/root/testdata/sf0.001").groupBy("on_target_model").count().collect()
    assert {r.on_target_model for r in got} == {"logistic", "nuc_features"}
    assert queries.bulge_hits(spark, "/root/testdata/sf0.001").columns[0] == "qid"
