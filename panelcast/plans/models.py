"""Fitted-model bundles shared by the forecasting queries of one session.

A bundle is trained once per (session, data folder, grain) - like a model
registry entry.  Its outputs are written to the shared folder when a query first
asks for them and read back from there, so a lost executor costs a read, not a
refit; every query that needs the forest, the additive model or the backtest
reuses them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import backtest as bt
from ..operators import forecast as fc
from ..operators.prepare import source_stamp, weekly_panel
from ..operators.scenario import project_baseline
from ..session import discard, materialised

_BUNDLES: dict = {}


class ForecastBundle:
    """Panel, features, forest and forecasts of one grain; each is made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, grain: str, n_trees: int):
        self.spark, self.n_trees, self.wf = spark, n_trees, weekly_panel(spark, sf_dir, grain)
        self.kept: list[DataFrame] = []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        self.kept.append(materialised(df, name))
        return self.kept[-1]

    @cached_property
    def feats(self) -> DataFrame:
        return self._keep(fc.rf_features(self.wf), "features")

    @cached_property
    def model(self):
        return fc.rf_fit(self.feats, n_trees=self.n_trees)

    @cached_property
    def importances(self) -> dict:
        return dict(zip(fc.BASE_FEATURES + fc.DRIVERS, self.model.stages[-1].featureImportances.toArray().tolist()))

    @cached_property
    def projection(self) -> DataFrame:
        return self._keep(project_baseline(self.wf), "projection")

    @cached_property
    def rf(self) -> DataFrame:
        return self._keep(fc.rf_forecast(self.spark, self.model, self.feats, self.projection), "rf")

    @cached_property
    def additive(self) -> DataFrame:
        return self._keep(fc.additive_forecast(self.spark, self.wf), "additive")


def _key(spark, sf_dir, grain, kind):
    """By application and source files; what an ended application or older files made is forgotten."""
    app, stamp = spark.sparkContext.applicationId, source_stamp(spark, sf_dir)
    for k in [k for k in _BUNDLES if k[0] != app or (k[1] == sf_dir.rstrip("/") and k[4] != stamp)]:
        bundle = _BUNDLES.pop(k)
        if k[0] == app:
            for df in bundle.kept if isinstance(bundle, ForecastBundle) else [bundle]:
                for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                    discard(spark, folder)
    return (app, sf_dir.rstrip("/"), grain, kind, stamp)


def forecast_bundle(spark: SparkSession, sf_dir: str, grain: str = "segment", n_trees: int = 300) -> ForecastBundle:
    k = _key(spark, sf_dir, grain, ("fc", n_trees))
    if k not in _BUNDLES:
        _BUNDLES[k] = ForecastBundle(spark, sf_dir, grain, n_trees)
    return _BUNDLES[k]


def backtest_result(spark: SparkSession, sf_dir: str, grain: str = "segment", n_trees: int = 200) -> DataFrame:
    k = _key(spark, sf_dir, grain, ("bt", n_trees))
    if k not in _BUNDLES:
        _BUNDLES[k] = materialised(bt.backtest(spark, weekly_panel(spark, sf_dir, grain), n_trees=n_trees), "backtest")
    return _BUNDLES[k]
