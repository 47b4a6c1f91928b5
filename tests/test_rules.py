"""Decision rules on literal frames: allocation (D11), strategy (D9),
safe budget / EBITDA (D10, D12), consensus (F10), reliability (F9)."""


import pytest

from panelcast.operators import backtest as bt
from panelcast.operators import forecast as fc
from panelcast.operators import scenario


def test_allocation_agree_and_disagree(spark):
    signals = spark.createDataFrame([("S1", "a"), ("S2", "b")], "series_id string, best_channel string")
    budget = spark.createDataFrame([("S1", 1000.0, 1.1), ("S2", 1000.0, 1.1)],
                                   "series_id string, safe_budget double, rec_scale double")
    r = {x.series_id: x for x in fc.allocate({"spend_a": 0.3, "spend_b": 0.1}, signals, budget).collect()}
    assert r["S1"].split_best == 0.65 and r["S1"].best_channel == "a"
    assert r["S2"].split_best == 0.55 and r["S2"].best_channel == "a"
    assert r["S1"].budget_best + r["S1"].budget_other == pytest.approx(1100.0)


def test_strategy_and_safe_budget(spark):
    kpis = spark.createDataFrame([("A", 5.0, 3.0), ("B", 3.5, 3.0), ("C", 2.0, 3.0)],
                                 "series_id string, mer double, be_roas double")
    growth = spark.createDataFrame([("A", 0.1), ("B", 0.1), ("C", 0.1)], "series_id string, growth_rate double")
    st = {r.series_id: r for r in scenario.strategy(kpis, growth).collect()}
    assert (st["A"].strategy, st["A"].rec_scale, st["A"].rec_saturation) == ("aggressive_scaling", 1.25, 0.92)
    assert st["A"].rec_trend == pytest.approx(0.15)
    assert (st["B"].strategy, st["B"].rec_scale) == ("balanced_growth", 1.10)
    assert (st["C"].strategy, st["C"].rec_scale) == ("defend_optimise", 0.85)
    proj = spark.createDataFrame([("A", "base", h, 300.0) for h in range(1, 8)],
                                 "series_id string, scenario_id string, step int, sales double")
    sb = scenario.safe_budget(proj, scenario.strategy(kpis, growth)).first()
    assert sb.next_sales == 1200.0 and sb.safe_budget == pytest.approx(400.0)
    assert sb.target_budget == pytest.approx(400.0 * 1.25 / 1.1)
    assert sb.ebitda == pytest.approx((1200.0 - 400.0) * 1.25)


def test_consensus_and_reliability(spark):
    ens = spark.createDataFrame([("A", "base", 100.0, 110.0), ("B", "base", 100.0, 200.0)],
                                "series_id string, scenario_id string, pred_rf double, pred_additive double")
    rel = spark.createDataFrame([("A", 0.6), ("B", 0.9)], "series_id string, avg_accuracy double")
    c = {r.series_id: r for r in fc.consensus(ens, rel).collect()}
    assert c["A"].consensus == "fragile" and c["A"].optimistic_model == "additive"
    assert c["B"].consensus == "divergent" and c["B"].gap == pytest.approx(1.0)
    scored = spark.createDataFrame([("A", 0.9), ("A", 0.8), ("B", 0.5)], "series_id string, acc_ensemble double")
    r = {x.series_id: x.reliability for x in bt.reliability(scored).collect()}
    assert r == {"A": "high", "B": "low"}
