"""The scan in numpy against regular expressions, place by place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from guidespan.functions import seq as S
from guidespan.operators import search
from guidespan.operators.alignment import align
from guidespan.sources import contigs as C
from guidespan.sources import scan


@pytest.mark.parametrize("pattern, length", [("[ACGT]{20}" + S.pattern("NGG"), 23), (S.pattern("CCN") + "[ACGT]{5}", 8), ("TTTT|AATA", 4), ("[A-Z]{3}TGA", 6), ("ATG", 3), ("[ACGT]{8}", 8)])
def test_scan_finds_what_the_expression_finds(spark, pattern, length):
    rng = random.Random(pattern)
    held = [(i, "".join(rng.choices("ACGTNé", [30, 30, 30, 30, 1, 1], k=rng.choice([0, 1, length - 1, length, 40, 1023, 1024, 1025, 5000])))) for i in range(60)]
    whole = re.compile(pattern)
    want = sorted((i, p, s[p : p + length]) for i, s in held for p in range(len(s) - length + 1) if whole.fullmatch(s[p : p + length]))
    assert scan.runs(pattern, length) is not None
    assert sorted(map(tuple, C.windows(spark.createDataFrame(held, "seq_id long, seq string"), length, pattern).collect())) == [w for w in want if "é" not in w[2] or "[A-Z]" not in pattern]


def test_other_expressions_take_the_plain_way(spark):
    assert scan.runs("A.G", 3) is None and scan.runs("ACGT", 3) is None and scan.runs("(A|C)G", 2) is None
    rows = C.windows(spark.createDataFrame([(1, "AAGACG")], "seq_id long, seq string"), 3, "A.G")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "AAG"), (1, 3, "ACG")]


def test_long_contigs_are_worked_on_in_stretches(spark, monkeypatch):
    rng = random.Random(5)
    seq = "".join(rng.choices("ACGTé", [30, 30, 30, 30, 1], k=scan.BLOCK * 2 + 7))
    seq = seq[: scan.BLOCK - 2] + "TTTTT" + seq[scan.BLOCK + 3 :]
    rows = C.windows(spark.createDataFrame([(1, seq), (2, "TTTTAATA")], "seq_id long, seq string"), 4, "TTTT|AATA")
    want = [(1, m.start(), m.group(1)) for m in re.finditer("(?=(TTTT|AATA))", seq)] + [(2, 0, "TTTT"), (2, 4, "AATA")]
    assert sorted(map(tuple, rows.collect())) == want
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()  # no chunks are cut


@pytest.mark.parametrize("length", [12, 31, 34])
def test_search_compares_by_bits_and_letters_alike(spark, length):
    """The first base's code is the highest of the number; a guide's N differs from every base."""
    rng = random.Random(length)
    guides = ["".join(rng.choices("ACGT", k=length)) for _ in range(40)]
    guides = [g[: i % length] + "N" + g[i % length + 1 :] if i % 3 == 0 else g for i, g in enumerate(guides)]
    targets = [mutated(rng, g.replace("N", "A"), i % 4, 0) for i, g in enumerate(guides)]
    contigs = spark.createDataFrame([(i, t + "TGG") for i, t in enumerate(targets)], "seq_id long, seq string")
    found = search.search(contigs, spark.createDataFrame([(str(i), g) for i, g in enumerate(guides)], "qid string, guide string"), length, 2)
    got = {(int(r.qid), r.target, r.mismatch) for r in found.where("strand = '+'").collect()}
    differ = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = {(i, t, n) for i, g in enumerate(guides) for t in targets if (n := differ(g, t)) <= 2}
    assert got == want and len(want) > 10
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"SortMergeJoin \[(segment|seed)", x)]
    assert joins and (length > 31 or all("bit_count" in x and "aggregate(" not in x for x in joins))


def test_letters_of_texts(spark):
    rng = random.Random(7)
    held = [(i, None if i % 9 == 0 else "".join(rng.choices("acgtACGTné 𝄞\n", k=rng.choice([0, 5, 22, 40, 3000])))) for i in range(200)]
    want = sorted((i, s) for i, t in held if t is not None and len(s := re.sub("[^acgtACGT]", "", t).upper()) >= 11)
    assert sorted(map(tuple, C.from_text(spark.createDataFrame(held, "doc_id long, text string"), shortest=11).collect())) == want


def mutated(rng, guide, mismatches, bulge):
    out = list(guide)
    for i in rng.sample(range(len(out)), mismatches):
        out[i] = rng.choice("ACGT".replace(out[i], ""))
    at = rng.randrange(len(out) + 1)
    return "".join(out[:at] + [rng.choice("ACGT")] + out[at:]) if bulge > 0 else "".join(out[: at - 1] + out[at:]) if bulge < 0 and at else "".join(out)


@pytest.mark.parametrize("side", ["3prime", "5prime"])
def test_pairs_that_align_meet_and_pass_the_filter(spark, side):
    rng, rows = random.Random(side), []
    for i in range(1500):
        guide = "".join(rng.choices("ACGT", k=20))
        target = mutated(rng, guide, rng.randrange(3), rng.choice([-1, 0, 1]))
        fill = "".join(rng.choices("ACGTN" if i % 5 == 0 else "ACGT", k=21 - len(target)))
        rows.append((guide, fill + target if side == "3prime" else target + fill, target, i))
    last = side == "3prime"
    held = spark.createDataFrame(rows, "guide string, beside string, target string, i int")
    ok = search._may_align(search._code(F.col("guide"), 20, last), search._code(F.col("beside"), 21, last), 20, 2, 1)
    assert held.where(~ok).count() == 0
    strangers = held.alias("a").crossJoin(held.select("beside").alias("b").limit(200)).select("guide", F.col("b.beside").alias("beside"))
    assert strangers.where(ok).count() < 4000
    # And the search finds every one of them.
    contigs = spark.createDataFrame([(i, b + "TGG" if last else "TTC" + b) for _, b, _, i in rows if "N" not in b], "seq_id long, seq string")
    guides = spark.createDataFrame([(str(i), g) for g, _, _, i in rows], "qid string, guide string")
    found = search.bulge_search(contigs, guides, 20, 2, 1, "NGG" if last else "TTN", side)
    got = {int(r.qid) for r in found.where("qid = cast(seq_id as string)").collect()}
    want = {i for g, b, t, i in rows if "N" not in b and (a := align(g, t, 1)) and a[0] <= 2}
    assert len(want) > 1000 and want <= got
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Broadcast\w*Join \[segment", plan)


def test_seed_variants_are_not_sent_through_the_driver(spark):
    """Spark takes exploded variants for as few as the guides."""
    guides = spark.createDataFrame([(str(i), "".join(random.Random(i).choices("ACGT", k=20))) for i in range(50)], "qid string, guide string")
    contigs = spark.createDataFrame([(1, "ACGTTGCA" * 40 + "GG")], "seq_id long, seq string")
    for rows in (search.search(contigs, guides, 20, 3), search.bulge_search(contigs, guides, 20, 2, 1)):
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [segment" in plan and not re.search(r"Broadcast\w*Join \[segment", plan)


def test_scan_takes_any_number_of_guides(spark, monkeypatch):
    monkeypatch.setattr(search, "SCANNED", 1000)
    rng = random.Random(3)
    contigs = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=400))) for i in range(20)], "seq_id long, seq string")
    guides = spark.range(10_500).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("qid"), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 8), "0123456789abcdef", "ACGTACGTACGTACGT").alias("guide"))
    got = sorted(map(tuple, search.scan(contigs, guides, 8, 0).collect()))
    assert got == sorted(map(tuple, search.search(contigs, guides, 8, 0).collect())) and len(got) > 100
    assert search.scan(contigs, guides.where("1 = 0"), 8, 0).collect() == []
