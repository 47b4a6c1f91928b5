"""Forecasting: F1 features (+A20 median impute, A19 driver means), F2 forest
fit, F3 recursive forecast, F4 importances, F5 additive model, J2 ensemble,
F10 consensus, F11/F12 week validation, F14 timeline, D11 allocation.

* The forest is one pooled MLlib model over all series (lags carry each
  series' level), so a fit is one distributed job however many series exist.
* The recursive forecast is sequential only in the horizon: one fold per
  (series, scenario) over its future weeks, with the fitted trees as a value of
  the query, so the whole horizon is one stage.
* The additive model (trend with changepoints + yearly Fourier terms +
  holidays + spend/driver regressors, normal priors, a Laplace prior on the
  changes of the trend) is fitted per series with ``groupBy('series_id').applyInPandas``: a group is one series' weekly
  rows (bounded by the number of weeks, not by the raw data volume).
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import week_cos, week_sin
from ..functions.economics import AUTO, PRESETS, stress_multiplier
from ..functions.exact import SUM_TYPE, xsum
from ..session import checkpoint_dir
from ..sources.calendar import HOLIDAY_COLS, holidays_in_week
from .scenario import scenario_grid, seasonal_lookup, seasonal_profile
from .windows import lag_features, recency_rank

BASE_FEATURES = ("week_sin", "week_cos", "spend_a", "spend_b", "lag_1", "lag_4")
DRIVERS = ("aov", "returning_rate_pct", "discounts", "cpc_a", "cpc_b", "cpm_b", "sessions", "frequency_b")
FOURIER_ORDER = 10
Z80 = 1.2815515655446004  # two-sided 80 % normal quantile


# -- F1 / A19 / A20 -----------------------------------------------------------
def rf_features(df: DataFrame, drivers=DRIVERS) -> DataFrame:
    """F1 + A20: week cycle, spends, lag 1/4 and drivers; missing values take
    the series median (exact ``median`` per series - a series holds at most
    one row per week)."""
    x = lag_features(df).withColumns({"week_sin": week_sin("iso_week"), "week_cos": week_cos("iso_week")})
    cols = list(BASE_FEATURES) + list(drivers)
    med = x.groupBy("series_id").agg(*[F.median(c).alias("__m_" + c) for c in cols])
    x = x.join(med, "series_id")
    x = x.withColumns({c: F.coalesce(F.col(c), F.col("__m_" + c), F.lit(0.0)) for c in cols})
    return x.drop(*["__m_" + c for c in cols])


def driver_means(df: DataFrame, n: int, drivers=DRIVERS) -> DataFrame:
    """Mean of each driver over the newest ``n`` rows per series."""
    r = recency_rank(df).filter(F.col("rn_desc") <= n)
    return r.groupBy("series_id").agg(
        *[(F.sum(F.col(c).cast(SUM_TYPE)).cast("double") / F.count(c)).alias(c) for c in drivers])


# -- F2 / F4 ------------------------------------------------------------------
def rf_fit(train: DataFrame, features=BASE_FEATURES + DRIVERS, n_trees: int = 300, max_depth: int = 6,
           min_instances: int = 3, seed: int = 42):
    """pooled random forest (all features considered at each split)."""
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    rf = RandomForestRegressor(labelCol="net_sales", featuresCol="features", numTrees=n_trees,
                               maxDepth=max_depth, minInstancesPerNode=min_instances,
                               featureSubsetStrategy="all", seed=seed, maxMemoryInMB=1024)
    return Pipeline(stages=[va, rf]).fit(train)


def rf_importance(spark: SparkSession, model, features=BASE_FEATURES + DRIVERS) -> DataFrame:
    """feature importances of the fitted forest (one row per feature)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double")


# -- F3 -----------------------------------------------------------------------
def _stress_map(scenarios):
    kv = []
    for s in scenarios:
        kv += [F.lit(s.scenario_id), stress_multiplier(F.lit(float(s.cpm_stress_pct)), F.lit(float(s.cr_stress_pct)))]
    return F.create_map(*kv)


def forest(spark: SparkSession, model) -> F.Column:
    """The fitted trees as one value, read where a query needs it: an array with the nodes of
    each tree (numbered as the fit numbers them, so that a node's place is its number).

    Its size is that of the model (trees x nodes), whatever the panel holds.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/panelcast-forest-{uuid.uuid4().hex}"
    model.stages[-1].write().save(path)
    node = F.struct("nodeData.id", F.col("nodeData.split.featureIndex").alias("feature"),
                    F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
                    F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                    F.col("nodeData.prediction").alias("value"))
    nodes = spark.read.parquet(f"{path}/data").filter("nodeData.id >= 0")
    trees = nodes.groupBy("treeID").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    return trees.agg(F.sort_array(F.collect_list(F.struct("treeID", "nodes"))).alias("trees")).scalar()


def forest_value(trees: F.Column, features: F.Column, depth: int) -> F.Column:
    """Mean over the trees of the value of the leaf that the features (an array) lead to."""
    def value(tree):
        nodes = tree["nodes"]

        def child(at):
            node = F.get(nodes, at)
            down = F.when(F.get(features, node["feature"]) <= node["threshold"], node["left"]).otherwise(node["right"])
            return F.when(node["left"] < 0, at).otherwise(down)

        return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda at, _: child(at)))["value"]

    return F.aggregate(trees, F.lit(0.0), lambda total, tree: total + value(tree)) / F.size(trees)


def rf_forecast(spark: SparkSession, model, feats: DataFrame, projection: DataFrame,
                scenarios=PRESETS + (AUTO,), drivers=DRIVERS) -> DataFrame:
    """recursive one-week-ahead forecast for every (series, scenario).

    Spends come from the projection (D2); drivers are the last-4-week means;
    lag 1 / lag 4 are carried as four state values (true lag 4), seeded with
    the last four actual weeks.  The prediction is multiplied by the
    scenario's stress multiplier and fed back into the lags.

    One row per (series, scenario) holds the whole future path of spends as an
    array (bounded by the horizon).  The horizon is one fold over that path: each
    step walks the trees, which are a value of the query, and hands its four last
    predictions on.  So the forecast is one stage of independent rows, with no
    join, write or broadcast per step, however long the horizon is.
    """
    r = recency_rank(feats).filter(F.col("rn_desc") <= 4)
    seed = r.groupBy("series_id").agg(
        *[F.max(F.when(F.col("rn_desc") == k, F.col("net_sales"))).alias(f"s{k}") for k in (1, 2, 3, 4)])
    seed = seed.withColumns({"s2": F.coalesce("s2", "s1"), "s3": F.coalesce("s3", "s2", "s1"),
                             "s4": F.coalesce("s4", "s3", "s2", "s1")})
    seed = seed.join(driver_means(feats, 4, drivers), "series_id")
    path = projection.groupBy("series_id", "scenario_id").agg(F.sort_array(F.collect_list(F.struct(
        "step", "week_start", "iso_week", "spend_a", "spend_b"))).alias("path"))
    state = path.join(seed, "series_id").withColumn("stress", _stress_map(scenarios)[F.col("scenario_id")])
    state = state.withColumn("trees", forest(spark, model))
    trees, depth = F.col("trees"), max(t.depth for t in model.stages[-1].trees)
    # a missing value goes right at every split, as in the fit
    known = {d: F.coalesce(F.col(d), F.lit(float("nan"))) for d in drivers}

    def lags(now, *last):
        return F.struct(now.alias("s1"), *[x.alias(f"s{k}") for k, x in enumerate(last, 2)])

    def step(s, at):
        given = {"week_sin": week_sin(at["iso_week"]), "week_cos": week_cos(at["iso_week"]), "spend_a": at["spend_a"],
                 "spend_b": at["spend_b"], "lag_1": s["last"]["s1"], "lag_4": s["last"]["s4"], **known}
        # folds over one value each, so that the features and the prediction are worked out once
        features = F.array(F.array(*[given[f] for f in BASE_FEATURES + tuple(drivers)]))
        pred = F.aggregate(features, F.lit(0.0), lambda _, v: forest_value(trees, v, depth)) * F.col("stress")
        return F.aggregate(F.array(pred), s, lambda old, p: F.struct(
            lags(p, old["last"]["s1"], old["last"]["s2"], old["last"]["s3"]).alias("last"),
            F.concat(old["preds"], F.array(p)).alias("preds")))

    start = F.struct(lags(*[F.col(f"s{k}") for k in (1, 2, 3, 4)]).alias("last"), F.array().cast("array<double>").alias("preds"))
    preds = F.aggregate("path", start, step, lambda s: s["preds"])
    out = state.select("series_id", "scenario_id", F.explode(F.arrays_zip(F.col("path").alias("at"), preds.alias("pred_rf"))).alias("x"))
    return out.select("series_id", "scenario_id", "x.at.step", "x.at.week_start", "x.pred_rf",
                      (F.col("x.at.spend_a") + F.col("x.at.spend_b")).alias("spend_total"))


# -- F5 additive model ----------------------------------------------------------
def _fourier_cols(t_days: F.Column) -> dict:
    cols = {}
    for k in range(1, FOURIER_ORDER + 1):
        arg = F.lit(2 * math.pi * k / 365.25) * t_days
        cols[f"fs{k}"] = F.sin(arg)
        cols[f"fc{k}"] = F.cos(arg)
    return cols


def additive_design(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """Regressors computed in Spark: days since epoch, yearly Fourier terms and
    one 0/1 column per named national holiday that falls in the week (computed
    from the week's year, so any year has its holidays and nothing is joined)."""
    t_days = F.datediff(F.col("week_start"), F.lit("1970-01-01").cast("date")).cast("double")
    x = frame.withColumn("t_days", t_days).withColumns(_fourier_cols(F.col("t_days")))
    return x.withColumns(holidays_in_week(F.col("week_start")))


REG_COLS = ("spend_a", "spend_b") + DRIVERS
SEAS_COLS = tuple(f"f{s}{k}" for k in range(1, FOURIER_ORDER + 1) for s in ("s", "c"))


CHANGEPOINTS, CHANGE_RANGE = 25, 0.8
#: Prior scales: Laplace for changes of the trend, normal for seasons, holidays and regressors.
CHANGE_SCALE, SEASON_SCALE, REGRESSOR_SCALE = 0.08, 10.0, 10.0
#: Residual variance (of the series scaled to 1) that the fit starts from, and the least it assumes.
FIRST_NOISE, LEAST_NOISE = 0.01, 1e-6


class AdditiveFit:
    """The additive model of one series: intercept, trend with changepoints, seasons, holidays, regressors.

    The most probable coefficients under normal priors, and a Laplace prior on the changes of the
    trend: it keeps most of them at exactly zero, so that a series gets the breaks that it has.
    Everything is fitted from the Gram matrix of the design.  The other coefficients are
    eliminated from it, and the changes are solved for on what is left; the residual variance,
    which weighs the priors, is estimated in turn.
    """

    def __init__(self, train: pd.DataFrame):
        y = train["y"].to_numpy(float)
        self.ref = train
        self.scale = float(np.max(np.abs(y))) if len(y) and np.max(np.abs(y)) > 0 else 1.0
        t = train["t_days"].to_numpy(float)
        self.t0, self.span = float(t.min()), max(float(t.max() - t.min()), 1.0)
        past = ((t - self.t0) / self.span)[: max(int(math.ceil(len(t) * CHANGE_RANGE)), 1)]
        k = min(CHANGEPOINTS, max(int(math.floor(len(t) * CHANGE_RANGE)) - 1, 0))
        self.points = np.quantile(past, np.linspace(0, 1, k + 2)[1:-1]) if k else np.empty(0)
        stats = [(float(train[c].mean()), float(train[c].std(ddof=0))) for c in REG_COLS]
        self.centre, self.spread = np.array([m for m, _ in stats]), np.array([s for _, s in stats])
        plain, hinges = self.design(train)
        self.fit(plain, hinges, y / self.scale)
        self.fitted = self.predict(train)
        self.sigma = float(np.sqrt(np.mean((self.fitted - y) ** 2))) if len(y) else 0.0

    def design(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Columns without the changes of the trend, and those."""
        t = (rows["t_days"].to_numpy(float) - self.t0) / self.span
        regressors = rows[list(REG_COLS)].to_numpy(float)
        regressors = np.where(self.spread > 0, (regressors - self.centre) / np.where(self.spread > 0, self.spread, 1.0), 0.0)
        plain = np.column_stack([np.ones_like(t), t, rows[list(SEAS_COLS + HOLIDAY_COLS)].to_numpy(float), regressors])
        return plain, np.maximum(t[:, None] - self.points, 0.0)

    def fit(self, plain: np.ndarray, hinges: np.ndarray, y: np.ndarray, rounds: int = 4) -> None:
        n_season = len(SEAS_COLS) + len(HOLIDAY_COLS)
        prior = np.r_[0.0, 1e-6, np.full(n_season, SEASON_SCALE ** -2), np.full(len(REG_COLS), REGRESSOR_SCALE ** -2)]
        g_zz, g_zh, c_z = plain.T @ plain, plain.T @ hinges, plain.T @ y
        g_hh, c_h, noise = hinges.T @ hinges, hinges.T @ y, FIRST_NOISE
        self.changes = np.zeros(hinges.shape[1])
        for _ in range(rounds):
            a = g_zz + np.diag(np.r_[0.0, 1e-6, noise * prior[2:]])
            both = np.linalg.lstsq(a, np.column_stack([g_zh, c_z]), rcond=None)[0]
            if len(self.changes):
                left = both[:, :-1]
                self.changes = _sparse_solution(g_hh - g_zh.T @ left, c_h - left.T @ c_z, noise / CHANGE_SCALE)
            self.others = both[:, -1] - both[:, :-1] @ self.changes
            residual = y - plain @ self.others - hinges @ self.changes
            noise = max(float(np.mean(residual ** 2)), LEAST_NOISE) if len(y) else FIRST_NOISE

    def predict(self, rows: pd.DataFrame) -> np.ndarray:
        plain, hinges = self.design(rows)
        return (plain @ self.others + hinges @ self.changes) * self.scale

    def interval(self, rows: pd.DataFrame) -> np.ndarray:
        """Half-width of the 80 % interval of each row: the deviation, by the factor that makes it
        cover 80 % of the weeks after three earlier ends of the history (where that is long enough)."""
        ahead, n = 26, len(self.ref)
        ratios = []
        for end in (n - ahead, n - 2 * ahead, n - 3 * ahead):
            if end >= 2 * ahead:
                past, after = AdditiveFit(self.ref.iloc[:end]), self.ref.iloc[end:end + ahead]
                ratios.append(np.abs(past.predict(after) - after["y"].to_numpy(float)) / np.maximum(past.deviation(after), 1e-9 * self.scale))
        factor = float(np.quantile(np.concatenate(ratios), 0.8)) if ratios else Z80
        return max(factor, Z80) * self.deviation(rows)

    def deviation(self, rows: pd.DataFrame) -> np.ndarray:
        """Standard deviation of each row: residuals, and beyond the last week the trend's own.

        The trend goes on changing as often as there are changepoints in the history, by Laplace
        steps of the mean size fitted; steps at even times up to a distance h have the variance
        rate * h * 2 size**2 * h**2 / 3 by then.
        """
        ahead = np.maximum((rows["t_days"].to_numpy(float) - self.t0) / self.span - 1.0, 0.0)
        size = float(np.abs(self.changes).mean()) if len(self.changes) else 0.0
        trend = len(self.points) * 2.0 * size ** 2 * ahead ** 3 / 3.0
        return np.sqrt(self.sigma ** 2 + trend * self.scale ** 2)


def _sparse_solution(g: np.ndarray, c: np.ndarray, weight: float, rounds: int = 400) -> np.ndarray:
    """The x with the least x'gx / 2 - c'x + weight * sum(abs(x)), by growing the set of coefficients
    that are not zero: with their signs given they solve a linear system, and one whose sign the
    solution turns goes back to zero on the way there."""
    x, sign = np.zeros(len(c)), np.zeros(len(c))

    def cost(v: np.ndarray) -> float:
        return float(v @ g @ v / 2 - c @ v + weight * np.abs(v).sum())

    for _ in range(rounds):
        pull = np.where(sign == 0, np.abs(c - g @ x), 0.0)
        k = int(pull.argmax())
        if pull[k] <= weight + 1e-9:
            break
        sign[k] = np.sign((c - g @ x)[k])
        while sign.any():
            on = np.flatnonzero(sign)
            goal = np.zeros(len(c))
            goal[on] = np.linalg.lstsq(g[np.ix_(on, on)], c[on] - weight * sign[on], rcond=None)[0]
            step = goal - x
            cross = [-x[j] / step[j] for j in on if x[j] * step[j] < 0 and abs(step[j]) > abs(x[j])]
            stops = [x + s * step for s in sorted(cross)] + [goal]
            best = min(range(len(stops)), key=lambda i: cost(stops[i]))
            new = np.where(np.abs(stops[best]) < 1e-12, 0.0, stops[best])
            consistent = best == len(stops) - 1 and (np.sign(new[on]) == sign[on]).all()
            stuck = cost(new) >= cost(x) - 1e-15
            x, sign = (x, np.sign(x)) if stuck and not consistent else (new, np.sign(new))
            if consistent or stuck:
                break
        if stuck and not consistent:
            break
    return x


def _fit_predict(train: pd.DataFrame, target: pd.DataFrame):
    """Fit on ``train`` (needs y), predict ``target``; (predictions, residual deviation, fitted values)."""
    model = AdditiveFit(train)
    return model.predict(target), model.sigma, model.fitted


ADDITIVE_SCHEMA = ("series_id string, scenario_id string, kind string, week_start date, "
                   "yhat double, yhat_lower double, yhat_upper double")


def _additive_group(pdf: pd.DataFrame) -> pd.DataFrame:
    hist = pdf[pdf["kind"] == "hist"].sort_values("week_start")
    fut = pdf[pdf["kind"] == "future"]
    model = AdditiveFit(hist)
    out_f = pd.DataFrame({"series_id": fut["series_id"].to_numpy(), "scenario_id": fut["scenario_id"].to_numpy(),
                          "kind": "forecast", "week_start": fut["week_start"].to_numpy(), "yhat": model.predict(fut)})
    out_h = pd.DataFrame({"series_id": hist["series_id"].to_numpy(), "scenario_id": None, "kind": "fit",
                          "week_start": hist["week_start"].to_numpy(), "yhat": model.fitted})
    out = pd.concat([out_h, out_f], ignore_index=True)
    width = np.r_[np.full(len(hist), Z80 * model.sigma), model.interval(fut)]
    out["yhat_lower"] = out["yhat"] - width
    out["yhat_upper"] = out["yhat"] + width
    return out


def additive_forecast(spark: SparkSession, df: DataFrame, scenarios=PRESETS + (AUTO,),
                      drivers=DRIVERS) -> DataFrame:
    """in-sample fit (kind='fit') and future forecast (kind='forecast')
    per series and scenario.  Future spends = seasonal profile x scale,
    drivers = last-8-week means; forecast and interval x stress."""
    hist = df.select("series_id", "week_start", F.col("net_sales").alias("y"), *REG_COLS)
    grid = scenario_grid(df, scenarios).select("series_id", "scenario_id", "step", "week_start", "iso_week",
                                               "scale_a", "scale_b")
    fut = seasonal_lookup(grid, seasonal_profile(df))
    fut = fut.join(driver_means(df, 8, drivers), "series_id").select(
        "series_id", "scenario_id", "week_start", F.lit(None).cast("double").alias("y"),
        (F.col("base_spend_a") * F.col("scale_a")).alias("spend_a"),
        (F.col("base_spend_b") * F.col("scale_b")).alias("spend_b"), *drivers)
    both = (hist.withColumns({"scenario_id": F.lit(None).cast("string"), "kind": F.lit("hist")})
            .unionByName(fut.withColumn("kind", F.lit("future"))))
    design = additive_design(spark, both)
    res = design.groupBy("series_id").applyInPandas(_additive_group, ADDITIVE_SCHEMA)
    stress = _stress_map(scenarios)
    m = F.coalesce(stress[F.col("scenario_id")], F.lit(1.0))
    return res.withColumns({"yhat": F.col("yhat") * m, "yhat_lower": F.col("yhat_lower") * m,
                            "yhat_upper": F.col("yhat_upper") * m})


# -- J2 / F10 / D11 / F14 ------------------------------------------------------
def ensemble(rf: DataFrame, additive: DataFrame) -> DataFrame:
    """Inner join of both forecasts on (series, scenario, week); mean."""
    a = additive.filter(F.col("kind") == "forecast").select(
        "series_id", "scenario_id", "week_start", F.col("yhat").alias("pred_additive"), "yhat_lower", "yhat_upper")
    j = rf.join(a, ["series_id", "scenario_id", "week_start"])
    return j.withColumn("pred_ensemble", (F.col("pred_rf") + F.col("pred_additive")) / 2.0)


def consensus(ens: DataFrame, reliability: DataFrame | None = None) -> DataFrame:
    """horizon totals, ensemble total, relative gap = |rf - add| / min
    (NULL, and the verdict divergent, where a total is zero or negative);
    < .15 high (fragile if backtest accuracy < .70), < .35 moderate, else
    divergent; which model is the optimistic one."""
    t = ens.groupBy("series_id", "scenario_id").agg(
        xsum("pred_rf").alias("rf_total"), xsum("pred_additive").alias("additive_total"))
    if reliability is not None:
        t = t.join(reliability.select("series_id", "avg_accuracy"), "series_id", "left")
    else:
        t = t.withColumn("avg_accuracy", F.lit(None).cast("double"))
    # a gap has no base where a total is not positive: the models do not agree on a sale at all
    low = F.least("rf_total", "additive_total")
    gap = F.when(low > 0, F.try_divide(F.abs(F.col("rf_total") - F.col("additive_total")), low))
    t = t.withColumns({"ensemble_total": (F.col("rf_total") + F.col("additive_total")) / 2.0, "gap": gap})
    unstable = F.coalesce(F.col("avg_accuracy") < 0.70, F.lit(False))
    return t.withColumns({
        "consensus": F.when(F.col("gap") < 0.15, F.when(unstable, "fragile").otherwise("high"))
        .when(F.col("gap") < 0.35, "moderate").otherwise("divergent"),
        "optimistic_model": F.when(F.col("rf_total") > F.col("additive_total"), "rf").otherwise("additive"),
    })


def allocate(importances: dict, signals: DataFrame, budget: DataFrame) -> DataFrame:
    """Channel split of the scaled safe budget.  ``importances`` are the
    pooled forest's feature importances (model parameters, one per feature).
    If the forest's more important spend channel is also the better-ROAS
    channel, 65 % goes to it; otherwise 55 % goes to the forest's channel."""
    engine = "a" if importances.get("spend_a", 0.0) > importances.get("spend_b", 0.0) else "b"
    j = budget.select("series_id", "safe_budget", "rec_scale").join(
        signals.select("series_id", F.col("best_channel").alias("roas_channel")), "series_id")
    agree = F.col("roas_channel") == F.lit(engine)
    total = F.col("safe_budget") * F.col("rec_scale")
    j = j.withColumns({"engine_channel": F.lit(engine),
                       "split_best": F.when(agree, 0.65).otherwise(0.55),
                       "best_channel": F.when(agree, F.col("roas_channel")).otherwise(F.lit(engine))})
    j = j.withColumn("budget_best", total * F.col("split_best"))
    return j.withColumn("budget_other", total - F.col("budget_best"))


def timeline(df: DataFrame, rf: DataFrame, additive: DataFrame, projection: DataFrame,
             scenario_id: str = "base") -> DataFrame:
    """long form (series, week, measure, value) of history and the three
    forecasts (heuristic, forest, additive with interval) for one scenario."""
    hist = df.select("series_id", "week_start", F.lit("actual").alias("measure"), F.col("net_sales").alias("value"))
    heur = projection.filter(F.col("scenario_id") == scenario_id).select(
        "series_id", "week_start", F.lit("heuristic").alias("measure"), F.col("sales").alias("value"))
    r = rf.filter(F.col("scenario_id") == scenario_id).select(
        "series_id", "week_start", F.lit("rf").alias("measure"), F.col("pred_rf").alias("value"))
    a = additive.filter((F.col("kind") == "forecast") & (F.col("scenario_id") == scenario_id))
    parts = [hist, heur, r]
    for m in ("yhat", "yhat_lower", "yhat_upper"):
        parts.append(a.select("series_id", "week_start", F.lit("additive_" + m).alias("measure"),
                              F.col(m).alias("value")))
    return reduce(DataFrame.unionByName, parts)
