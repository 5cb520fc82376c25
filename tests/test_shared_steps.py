"""What a query reads several times is worked out once, and what meets many others is not shuffled."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, most", [("annotated_sites", 2), ("batch_manifest", 0), ("batch_remaining", 0), ("ranked_pairs", 0), ("region_sequences", 1)])
def test_texts_are_read_once_for_all_that_follows(spark, name, most):
    rows = __spark_entry__.queries()[name](spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= most


def test_pairs_of_centre_alignments_are_not_shuffled(spark):
    rows = __spark_entry__.queries()["centre_alignments"](spark, SF)
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("Join")]
    assert "MapInPandas" in above and "Join" not in above
    assert plan.count("Join") == 2  # with the known seeds, and with the guides: no look-up of chunks for each pair
