"""Pages of places and files by folder."""

from guidespan.jobs import queries, tables
from guidespan.operators import export, library


def test_pages_hold_every_place_once(spark):
    rows = [("A", i % 7, i // 7, "+-"[i % 2]) for i in range(500)] + [("C", 1, 1, "+")] * 3 + [("", 1, 1, "+")]
    frame = spark.createDataFrame(rows, "guide_seq string, seq_id long, spacer_start long, strand string")
    got = sorted((r.guide_seq, r.page, [tuple(x) for x in r.regions]) for r in library.region_pages(frame, 30).collect())
    places = sorted({r[1:] for r in rows if r[0] == "A"})
    assert got == [("A", i, places[30 * i : 30 * i + 30]) for i in range(-(-len(places) // 30))] + [("C", 0, [(1, 1, "+")])]
    assert library.region_pages(frame.limit(0), 30).collect() == []


def test_a_folder_for_each_guide(spark, tmp_path):
    rows = [("s1", "g1", f">a{i}\nACGT") for i in range(5)] + [("s2", "g1", ">b\nTT")]
    export.write_by(spark.createDataFrame(rows, "seq_id string, qid string, line string").repartition(4), str(tmp_path / "out"), ["seq_id", "qid"])
    assert [len(list((tmp_path / "out" / f"seq_id={s}" / "qid=g1").glob("part-*"))) for s in ("s1", "s2")] == [1, 1]
    assert spark.read.text(str(tmp_path / "out")).count() == 12


def test_folders_are_read_where_their_rows_are(spark, tmp_path):
    rows = [("c1", "q:1/%", ">a\nGG"), ("c1", "q:1/%", ">b\nCC"), ("c 2", "é'[x]", ">c\nT"), ("c1", "q2", ">d\nA")]
    lines = spark.createDataFrame(rows, "seq_id string, qid string, line string")
    path = str(tmp_path / "out")
    export.write_by(lines, path, ["seq_id", "qid"])
    read = export.read_by(lines.select("seq_id", "qid").distinct(), path)
    assert sorted(map(tuple, read.collect())) == sorted((a, b, x) for a, b, text in rows for x in text.split("\n"))
    assert "FileScan text" not in read._jdf.queryExecution().executedPlan().toString()


def test_perfect_hits_are_the_hits_without_mismatches(spark):
    path = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.perfect_hits(spark, path).collect()))
    assert got == sorted(map(tuple, queries.search_hits(spark, path).where("mismatch = 0").collect()))
    plan = tables.score_lines(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "lambdafunction" not in plan
