"""Rules as a relation: every branch, nucleases of a user's own, statuses; the long and the wide table agree."""

import pytest

from guidespan.functions import scores as V
from guidespan.operators import models

G = "ACGTACGTACGTACGTACGT"
ONE = "ACGTACGTACGTACGTACGA"  # the last base differs
WINDOW = "ACGT" + G + "AGGTTC"


@pytest.fixture(scope="module")
def held(spark):
    kinds = ["cas9", "CAS12A", "cas13", "tnpb", "mine", "yours", "what", None]
    guides = spark.createDataFrame([(f"g{i}", G, k, WINDOW if i == 0 else None) for i, k in enumerate(kinds)] + [("bare", G, "cas9", "short")], "qid string, guide string, nuclease string, context string")
    hits = spark.createDataFrame([(f"g{i}", G, t, "AGG") for i in range(8) for t in (G, ONE)], "qid string, guide string, target string, pam string")
    return guides, hits


def test_each_guide_by_its_rule(spark, held):
    own = [models.Rule("Mine", "bias", "seed", "b", "m", 17, 20, 0.1), models.Rule("yours", "activity", "seed", "a", "y", 1, 4, 0.1, reference_only=True)]
    got = {r.qid: r for r in models.scored(*held, models.rule_table(spark, models.RULES + own), V.rule_weights()).collect()}
    assert len(got) == 9
    spec = lambda x: round(1 / (1 + x), 6)
    assert {k: r.off_specificity for k, r in got.items()} == {"g0": spec(0.1), "g1": spec(0.95), "g2": spec(0.25 * 1.95 - 1) if 0.25 * 1.95 > 1 else 1.0, "g3": spec(0.95), "g4": spec(0.095), "g5": spec(0.95), "g6": spec(0.95), "g7": spec(0.95), "bare": 1.0}
    assert [(got[k].on_model, got[k].status) for k in ("g0", "bare", "g5", "g6", "g7")] == [("logistic", "ok"), ("logistic_fallback", "fallback"), ("a_reference_only", "reference_only"), ("nuc_features", "ok"), ("nuc_features", "ok")]
    assert got["g5"].note == models.REFERENCE_NOTE and got["g2"].note == models.RNA_NOTE and got["bare"].n_hits == 0


def test_long_and_wide_agree(spark, held):
    rows = models.fanned(*held, V.rule_weights())
    names = sorted({f"{r.role}_{r.model}" for r in rows.collect()})
    wide = models.widened(rows, names)
    back = {(r.qid, r.key, r.score) for r in models.lengthened(wide, names).collect()}
    assert back == {(r.qid, f"{r.role}_{r.model}", r.score) for r in rows.collect() if r.status == "scored"}
    ran = {r.qid: r.models for r in wide.collect()}
    assert "on_logistic" in ran["g0"].split(",") and "on_logistic" not in ran["bare"].split(",")
    assert rows.where("status = 'unavailable'").count() == 8


def test_bad_rules(spark, held):
    for bad in ({"on": "x"}, {"off": "x"}, {"off": "seed"}):
        with pytest.raises(ValueError):
            models.Rule(**{"nuclease": "n", "on": "bias", "off": "identity", "on_model": "", "off_model": ""} | bad)
    with pytest.raises(ValueError):
        models.rule_table(spark, [models.GENERIC, models.GENERIC])
    assert models.scored(held[0].limit(0), held[1], models.rule_table(spark, []), V.rule_weights()).collect() == []
