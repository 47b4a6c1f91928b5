"""Scale guards on the physical plans of every relational query: no
cartesian / nested-loop joins and no window without a partition key."""

import re

import pytest

from conftest import SF001

import __spark_entry__ as entry

RELATIONAL = sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", RELATIONAL)
def test_plan_shape(spark, name):
    df = entry.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert ", [], [" not in line, f"unpartitioned window in {name}: {line[:200]}"


def test_windows_of_a_bucketed_panel_move_nothing(spark):
    """A series per customer: the panel lies in buckets of series, so its windows need no exchange."""
    df = entry.queries()["lag_features_customer"](spark, SF001)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() > 500


def test_plans_of_staged_steps(spark, monkeypatch):
    """The same guards on every plan that a query runs before it returns: what is written to the shared folder."""
    from pyspark.sql import DataFrameWriter

    seen, write = [], DataFrameWriter.parquet

    def looked_at(self, *args, **kw):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", looked_at)
    from panelcast.operators import prepare
    from panelcast.plans import models

    monkeypatch.setattr(prepare, "_PANELS", {})
    monkeypatch.setattr(models, "_BUNDLES", {})
    from panelcast.plans.registry import QUERIES

    bundle = models.forecast_bundle(spark, SF001, n_trees=2)
    assert bundle.rf is not None and bundle.additive is not None
    QUERIES["weekly_fact_incremental"](spark, SF001)
    assert len(seen) >= 5
    for plan in seen:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert not any(re.search(r"\bWindow \[", x) and ", [], [" in x for x in plan.splitlines())
