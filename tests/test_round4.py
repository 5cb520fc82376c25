import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from guidespan.functions import scores
from guidespan.jobs import queries, tables
from guidespan.operators import alignment as A
from guidespan.operators import search

SF = "/root/testdata/sf0.001"


def edited(rng, guide):
    """The guide with up to six changes, of which some are bases left out or put in."""
    out = list(guide)
    for _ in range(rng.randrange(7)):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = rng.choices("ACGT", k=rng.randrange(2))
    return "".join(out)


def test_pairs_that_pass_near_a_centre_are_those_that_align(spark):
    """all pairs with a seed in common came to Python."""
    rng, held = random.Random(1), []
    for _ in range(600):
        guide = "".join(rng.choices("ACGT", k=20))
        held.append((guide, ("".join(rng.choices("ACGT", k=rng.randrange(3))) + edited(rng, guide) + "".join(rng.choices("ACGT", k=5)))[:23]))
    code = lambda c, n: search.base_code(F.col(c), n, False)
    rows = spark.createDataFrame(held, "guide string, window string")
    got = [tuple(r) for r in rows.where(F.length("window") == 23).select("guide", "window", A.may_align_near(code("guide", 20), code("window", 23), 20, 2)).collect()]
    want = A.best_in_windows([g for g, _, _ in got], [w for _, w, _ in got], [1] * len(got), 2, 1)
    assert [ok for _, _, ok in got] == [w is not None for w in want] and 100 < sum(ok for _, _, ok in got) < len(got) - 100


def test_thousands_of_pairs_are_aligned_in_a_moment():
    """F1: 30 microseconds a pair and more, most of them for the texts of one pair after another."""
    rng = random.Random(2)
    guides = ["".join(rng.choices("ACGT", k=20)) for _ in range(4096)]
    query, _ = A._letters(pa.array(guides), 20, 0)
    window, length = A._letters(pa.array(["A" + g + "CG" for g in guides]), 46, 1)
    best = min(_timed(lambda: list(A._near(query, window, length, np.ones(4096, np.int64), 2, 1, None))) for _ in range(5))
    assert best < 0.12


def _timed(f):
    start = time.perf_counter()
    f()
    return time.perf_counter() - start


def test_only_pairs_that_align_come_to_python(spark, monkeypatch):
    """of the rows that the alignment got, most were none."""
    seen = []
    monkeypatch.setattr(A, "near_centres", lambda rows, *more, f=A.near_centres: seen.append(rows) or f(rows, *more))
    found = queries.centre_alignments(spark, SF).count()
    assert found and seen[0].count() <= 1.2 * found


def test_letters_are_compared_as_by_columns(spark):
    """each score went through the letters of a hit on its own, base by base."""
    rng, rows = random.Random(3), [("", "", "", "AGG"), ("ACGU", "ACG-U", "acgtu", "nu"), ("ACGTN", "ACGTN", "ACTTA", None), ("AC", "AC", "ACGT", " tGG ")]
    for _ in range(200):
        guide = "".join(rng.choices("ACGTN", k=rng.choice([5, 20, 20, 23])))
        other = edited(rng, guide)
        at = rng.randrange(len(guide))
        own = guide if rng.random() < 0.5 else guide[:at] + "-" + guide[at:]
        rows.append((guide, own, other.replace(rng.choice("ACGT"), "-") if rng.random() < 0.2 else other, rng.choice("ACGT") + rng.choice(["GG", "AG", "TT", "CG"])))
    df = spark.createDataFrame(rows, "guide string, own string, other string, pam string").withColumns({"mismatch": F.lit(1), "rna": F.lit(1), "dna": F.lit(0), "indel": F.lit(2)})
    g, a, t, c, m = F.col("guide"), F.col("own"), F.col("other"), F.col("c"), [F.col(x) for x in ("mismatch", "rna", "dna", "indel")]
    weights = scores.rule_weights()
    new = [scores.weighted_of(c, F.col("pam")), scores.identity_of(c), *(scores.seeded_of(c, n) for n in scores.SEEDS), scores.risk_of(c, *m)]
    old = [scores.weighted_similarity(g, t, weights, F.col("pam")), scores.identity(g, t), *(scores.seeded_similarity(g, t, *s) for s in scores.SEEDS.values()), scores.bulge_risk(a, t, *m)]
    got = df.withColumn("c", scores.compared(g, a, t, weights)).select(F.array(*new), F.array(*old)).collect()
    assert len(got) == len(rows)
    for x, y in got:
        assert np.allclose(np.array(x, float), np.array(y, float), rtol=0, atol=1e-12)


def test_pairs_meet_once(spark):
    """F3 to F7: pairs met on several seeds, and all of them were shuffled to be counted once."""
    rng = random.Random(4)
    guides = [(f"g{i}", "".join(rng.choices("ACGT", k=20))) for i in range(40)]
    beside = []
    for _ in range(800):
        x = edited(rng, rng.choice(guides)[1])
        beside.append(("".join(rng.choices("ACGTN", k=max(0, 21 - len(x)))) + x)[-21:])
    stretches = spark.createDataFrame([(x,) for x in set(beside)], "_beside string")
    met = search._halves_met(stretches.withColumn("_b", search._code(F.col("_beside"), 21, True)), spark.createDataFrame(guides * 2, "qid string, guide string"), 20, 2, True)
    got = [(r.qid, r._beside) for r in met.select("qid", "_beside").collect()]
    want = {(q, x) for q, g in guides for x in set(beside) if any("N" not in x[-n:] and (a := A.align(g, x[-n:], 1)) and a[0] <= 2 for n in (19, 20, 21))}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 200
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "keys=[qid" not in plan.split("SortMergeJoin")[0]


def test_guides_are_spread(spark):
    """F3 to F7: guides that had been grouped before were one task, with all variants of their seeds."""
    docs = spark.createDataFrame([(i * 50, "".join(random.Random(i).choices("ACGT", k=60))) for i in range(100)], "doc_id long, text string")
    own = queries.guides(queries.C.from_text(docs))
    assert len({r[0] for r in search._dealt(own).select(F.spark_partition_id()).distinct().collect()}) > 1


def test_guides_read_their_own_texts_alone(spark):
    """F2 to F7: all texts were read again for every fiftieth of them."""
    own = queries.own_guides(spark, SF)
    assert sorted(own.collect()) == sorted(queries.guides(queries.contigs(spark, SF)).collect())
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("doc_id#", plan.index("Filter"))


def test_seed_edits_stay_out_of_the_search(spark):
    """Spark put the look at the letters of the seed into the join of the search, for every pair that meets."""
    found = tables.seed_hits(spark, SF)
    found.collect()
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [segment" in x]
    assert joins and all("bit_count" in x and "aggregate" not in x for x in joins)


def test_places_are_not_joined_for_what_guides_find(spark, monkeypatch):
    """both listed all places of all hits before they dropped them."""
    monkeypatch.setattr(search, "bulge_search", None)
    monkeypatch.setattr(search, "search", None)
    assert tables.guide_differences(spark, SF).columns == ["qid", "status"]
    assert tables.edit_counts(spark, SF).where("edits < 0 or edits > mismatch + indel").count() == 0
