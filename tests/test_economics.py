import pytest
from pyspark.sql import functions as F

from panelcast.functions.economics import TABLE_ECONOMICS, Economics, economics_columns, stress_multiplier


def _be(spark, econ):
    return spark.range(1).select(*[v.alias(k) for k, v in economics_columns(econ).items()]).first()


def test_break_even_table_economics(spark):
    r = _be(spark, TABLE_ECONOMICS)
    assert round(r["be_roas"], 2) == 3.09


def test_break_even_reference_defaults(spark):
    r = _be(spark, Economics())
    net_aov = 145 * 0.87 / 1.22
    ppo = net_aov * 0.45 - 5
    ppc = ppo + ppo * 0.13 * 1.0
    assert r["net_aov"] == pytest.approx(net_aov)
    assert r["profit_per_order"] == pytest.approx(ppo)
    assert r["be_roas"] == pytest.approx(145 / ppc)


def test_break_even_non_positive_cpa(spark):
    r = _be(spark, Economics(fulfilment=1000.0))
    assert r["be_roas"] == 99.9


def test_stress_multiplier(spark):
    r = spark.range(1).select(stress_multiplier(F.lit(0.0), F.lit(0.0)).alias("a"),
                              stress_multiplier(F.lit(20.0), F.lit(10.0)).alias("b")).first()
    assert r["a"] == 1.0
    assert r["b"] == pytest.approx(0.75)
