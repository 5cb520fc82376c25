from guidespan.operators import pairs

SIDE = "struct<valid:boolean,search_complete:boolean,on_models:array<struct<name:string,score:double,applicable:boolean,calibrated:boolean,is_fallback:boolean,reference_only:boolean>>,off_hits:array<struct<locus_id:string,score:double,upper:double,forbidden:boolean,is_bulge:boolean,bulge_calibrated:boolean>>,aggregate_specificity:double>"
SCHEMA = f"pair_id string, search_complete boolean, left {SIDE}, right {SIDE}, compatibility struct<hard_fail:boolean,soft_warnings:array<string>>"


def model(name, score, applicable=True, calibrated=True, fallback=False, reference=False):
    return (name, score, applicable, calibrated, fallback, reference)


def side(models, hits=(), specificity=None, valid=True):
    return (valid, True, list(models), list(hits), specificity)


GOOD = side([model("a", 0.9), model("b", 0.85)])


def test_evaluation(spark):
    hit = lambda score, upper=None, forbidden=False, bulge=False: ("x", score, upper, forbidden, bulge, False)
    rows = [
        ("best", True, GOOD, GOOD, (False, [])),
        ("same", True, GOOD, GOOD, (False, [])),
        ("warned", True, GOOD, GOOD, (False, ["w"])),
        ("risky", True, side([model("a", 0.9)], [hit(0.3), hit(None, 0.4)]), GOOD, (False, None)),
        ("worse", True, side([model("a", 0.1)], [hit(0.9)]), GOOD, (False, [])),
        ("known", True, side([model("a", 0.6)], specificity=0.5), GOOD, None),
        ("open", None, side([model("a", 0.9, fallback=True), model(" ", 1.5)], [hit(None), hit(0.1, forbidden=True, bulge=True)], valid=False), side([], specificity=0.0), (True, [])),
    ]
    got = {r.pair_id: r for r in pairs.evaluate(spark.createDataFrame(rows, SCHEMA), pairs.Policy()).collect()}
    assert {k: (r.status, r.tier, r.risk_class) for k, r in got.items() if k != "open"} == {"best": ("pass", "A", 0), "same": ("pass", "A", 0), "warned": ("pass", "A", 0), "risky": ("pass", "B", 1), "known": ("conditional", "B", 2), "worse": ("conditional", "C", 2)}
    assert [got[k].pair_rank for k in ("best", "same", "warned", "risky")] == [1, 1, 3, 4]
    assert got["known"].maximum is None and got["known"].high is None and got["known"].burden == 1.0
    assert got["known"].reasons == ["burden_above_b_high", "risk_2"] and got["worse"].reasons == ["tier_c", "burden_above_b_high", "max_offtarget_above_m_high", "risk_2"]
    assert (got["known"].conditional_rank, got["worse"].conditional_rank) == (1, 2)
    assert got["open"].status == "rejected" and got["open"].pair_rank is None and got["open"].conditional_rank is None
    assert got["open"].reasons[:10] == ["pair_search_incomplete", "left_invalid", "compatibility_hard_fail", "invalid_offtarget_score:left:x", "forbidden_offtarget:left:x", "uncalibrated_bulge:left:x", "invalid_aggregate_specificity:right", "fallback_model:left:a", "invalid_model_score:left:model_1", "tier_c"]
