"""Ranks over ranges: ties and groups that go on over many ranges."""

from collections import Counter

from pyspark.sql import functions as F

from guidespan.operators import pairs
from guidespan.operators.ordinals import ranked


def expected(rows):
    order = lambda r: (r[0] or "", r[1] is not None, r[1] or 0)
    return Counter((*r, 1 + sum(o[0] == r[0] and order(o) < order(r) for o in rows)) for r in rows)


def test_ranks_equal_a_plain_count(spark):
    cases = [[("a", 1, i) for i in range(300)], [("a", i // 40, i) for i in range(300)], [("ab"[i % 2], i % 3 or None, i) for i in range(200)], [(f"g{i % 70}", 5, i) for i in range(200)], [(None, i % 5, i) for i in range(60)], [("a", 7, 1)] * 5, []]
    for rows in cases:
        frame = spark.createDataFrame(rows, "g string, k int, i int")
        got = ranked(frame, "r", ["g"], [F.col("k")], [F.col("i")])
        assert got.columns == ["g", "k", "i", "r"]
        assert Counter(map(tuple, got.collect())) == expected(rows)


def test_one_ranking_and_tied_rows_over_ranges(spark):
    frame = spark.range(2000).select((F.col("id") % 1).alias("k"), "id")
    got = ranked(frame, "r", [], [F.col("k")], [F.col("id")])
    assert got.select("r").distinct().collect() == [(1,)]
    got = ranked(frame.withColumn("k", F.col("id") - F.col("id") % 900), "r", [], [F.col("k")], [F.col("id")])
    assert Counter(r.r for r in got.collect()) == {1: 900, 901: 900, 1801: 200}


def test_percentiles_in_one_pass_equal_those_one_by_one(spark):
    rows = spark.createDataFrame([(i, float(i % 4), None if i % 3 == 0 else float(i)) for i in range(30)], "i int, a double, b double")
    one = pairs.percentile(pairs.percentile(rows, "a", [], "pa"), "b", [], "pb").select("i", "pa", "pb")
    both = pairs.percentiles(rows, {"a": "pa", "b": "pb"}).select("i", "pa", "pb")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, both.collect()))
    single = pairs.percentiles(rows.limit(1), {"a": "pa"}).collect()
    assert [r.pa for r in single] == [None]
