"""Walk-forward backtest: J9 origins, the seasonal arm (F6), scoring F7-F9,
summaries and pivots A14-A17, F13 accuracy band.

Every arm trains strictly on rows before the origin.  The seasonal arm is
expressed with expanding windows (running sums per series and ISO week), so
no (origin x history) pairs are ever materialised: work is linear in the
number of weekly rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import SUM_TYPE, xavg
from .windows import w_series

MODELS = ("seasonal", "rf", "additive", "ensemble")  # tie order for the winner


def origins(df: DataFrame, months: int = 12, min_train: int = 20) -> DataFrame:
    """Backtest origins - weeks in the last ``months`` months of each
    series with at least ``min_train`` earlier rows."""
    last = F.max("week_start").over(Window.partitionBy("series_id"))
    x = df.select("series_id", "week_start", "iso_week", "net_sales",
                  (F.row_number().over(w_series()) - 1).alias("n_train"), last.alias("__last"))
    x = x.filter((F.col("week_start") > F.add_months(F.col("__last"), -months))
                 & (F.col("n_train") >= min_train))
    return x.select("series_id", F.col("week_start").alias("origin_week"), "iso_week",
                    F.col("net_sales").alias("actual"), "n_train")


def seasonal_predictions(df: DataFrame) -> DataFrame:
    """Seasonal arm at every week, using only earlier weeks.

    pred = mean of earlier sales in the same ISO week; if the week has no
    history yet, the mean of the weekly means known at that time.  The
    latter is kept as a running sum of per-week mean *changes* (exact
    decimals), so it is one ordered window pass.
    """
    w_iso = Window.partitionBy("series_id", "iso_week").orderBy("week_start")
    prior = w_iso.rowsBetween(Window.unboundedPreceding, -1)
    upto = w_iso.rowsBetween(Window.unboundedPreceding, 0)
    x = df.select("series_id", "week_start", "iso_week", "net_sales")
    dec = F.col("net_sales").cast(SUM_TYPE)
    x = x.withColumns({
        "p_sum": F.sum(dec).over(prior),
        "p_cnt": F.count("net_sales").over(prior),
        "i_sum": F.sum(dec).over(upto),
        "i_cnt": F.count("net_sales").over(upto),
    })
    x = x.withColumn("i_mean", F.round(F.col("i_sum").cast("double") / F.col("i_cnt"), 6).cast(SUM_TYPE))
    x = x.withColumn("delta", F.col("i_mean") - F.coalesce(F.lag("i_mean").over(w_iso), F.lit(0).cast(SUM_TYPE)))
    x = x.withColumn("is_new", F.when(F.col("p_cnt") == 0, 1).otherwise(0))
    run = w_series().rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"s_run": F.sum("delta").over(run), "c_run": F.sum("is_new").over(run)})
    fallback = F.try_divide((F.col("s_run") - F.col("delta")).cast("double"),
                            (F.col("c_run") - F.col("is_new")).cast("double"))
    pred = F.when(F.col("p_cnt") > 0, F.col("p_sum").cast("double") / F.col("p_cnt")).otherwise(fallback)
    return x.select("series_id", "week_start", pred.alias("pred_seasonal"))


def error_and_accuracy(pred, actual):
    err = F.abs(pred - actual)
    acc = F.when(actual > 0, F.greatest(F.lit(0.0), F.lit(1.0) - err / actual)).otherwise(F.lit(0.0))
    return err, acc


def seasonal_backtest(df: DataFrame, months: int = 12, min_train: int = 20) -> DataFrame:
    """F6 (seasonal arm) + F7 scoring at every origin."""
    o = origins(df, months, min_train)
    p = seasonal_predictions(df).withColumnRenamed("week_start", "origin_week")
    j = o.join(p, ["series_id", "origin_week"])
    err, acc = error_and_accuracy(F.col("pred_seasonal"), F.col("actual"))
    return j.select("series_id", "origin_week", "n_train", "actual", "pred_seasonal",
                    err.alias("err_seasonal"), acc.alias("acc_seasonal"))


def score_models(bt: DataFrame) -> DataFrame:
    """F7 + F8: error and accuracy per model, winner with ties in the order
    seasonal, rf, additive, ensemble."""
    cols = {}
    for m in MODELS:
        e, a = error_and_accuracy(F.col("pred_" + m), F.col("actual"))
        cols["err_" + m] = e
        cols["acc_" + m] = a
    out = bt.withColumns(cols)
    cand = F.array(*[F.struct(F.col("err_" + m).alias("e"), F.lit(i).alias("k"), F.lit(m).alias("m"))
                     for i, m in enumerate(MODELS)])
    return out.withColumn("winner", F.array_min(F.filter(cand, lambda s: s["e"].isNotNull()))["m"])


def accuracy_band(c) -> F.Column:
    """> 0.9 high, > 0.8 medium, else low; NULL unbanded."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c > 0.9, "high").when(c > 0.8, "medium") \
        .otherwise("low")


def reliability(bt_scored: DataFrame) -> DataFrame:
    """mean ensemble accuracy per series -> high (>= .85) / medium (>= .70) / low."""
    s = bt_scored.groupBy("series_id").agg(xavg("acc_ensemble").alias("avg_accuracy"),
                                           F.count(F.lit(1)).alias("n_origins"))
    return s.withColumn("reliability", F.when(F.col("avg_accuracy") >= 0.85, "high")
                        .when(F.col("avg_accuracy") >= 0.70, "medium").otherwise("low"))


def backtest_summary(bt_scored: DataFrame) -> DataFrame:
    """Mean accuracy and mean absolute error per series and model."""
    long = bt_scored.select("series_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col("acc_" + m).alias("acc"), F.col("err_" + m).alias("err"))
        for m in MODELS])).alias("r")).select("series_id", "r.*")
    return long.groupBy("series_id", "model").agg(xavg("acc").alias("mean_accuracy"),
                                                  xavg("err").alias("mean_abs_error"))


MONTH_COLS = tuple(f"m{k:02d}" for k in range(1, 13))


def accuracy_matrix(bt_scored: DataFrame, measure: str = "acc_ensemble") -> DataFrame:
    """Matrix of the mean of ``measure``, one row per (series, year) and one
    column per month; the twelve columns are fixed, so no pass collects values."""
    month = F.month("origin_week")
    return bt_scored.groupBy("series_id", F.year("origin_week").alias("year")).agg(
        *[xavg(F.when(month == k, F.col(measure))).alias(c) for k, c in enumerate(MONTH_COLS, 1)])


def first_winner(bt_scored: DataFrame) -> DataFrame:
    """Winner of the first origin week of each (month, year)."""
    x = bt_scored.withColumns({"year": F.year("origin_week"), "month_num": F.month("origin_week")})
    return x.groupBy("series_id", "year", "month_num").agg(
        F.min_by("winner", "origin_week").alias("first_winner"))


def winner_matrix(bt_scored: DataFrame) -> DataFrame:
    """Matrix of the first winner, one row per (series, year) and one column per month."""
    x = first_winner(bt_scored)
    return x.groupBy("series_id", "year").agg(
        *[F.max(F.when(F.col("month_num") == k, F.col("first_winner"))).alias(c) for k, c in enumerate(MONTH_COLS, 1)])


def top_winner(bt_scored: DataFrame) -> DataFrame:
    """Most frequent winner per series; ties -> alphabetical first."""
    c = bt_scored.groupBy("series_id", "winner").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("series_id").orderBy(F.desc("n"), F.asc("winner"))
    return c.withColumn("rk", F.row_number().over(w)).filter("rk = 1").select(
        "series_id", F.col("winner").alias("top_winner"), F.col("n").alias("wins"))


# -- full walk-forward backtest: forest and additive arms ----------------------
def training_medians(df: DataFrame, weeks: list, cols) -> DataFrame:
    """(series_id, origin, m_<col> ...): the median of each column over a series' rows
    strictly before each origin week.

    One ordered pass for all origins: every series gets a marker per origin that stands
    before the row of that week and holds no values, and the medians expand over the rows
    before it.
    """
    marks = df.select("series_id").distinct().select(
        "series_id", F.explode(F.array(*[F.lit(w) for w in weeks])).alias("week_start"), F.lit(0).alias("is_row"))
    rows = df.select("series_id", "week_start", F.lit(1).alias("is_row"), *cols)
    w = Window.partitionBy("series_id").orderBy("week_start", "is_row").rowsBetween(Window.unboundedPreceding, -1)
    x = rows.unionByName(marks, allowMissingColumns=True)
    x = x.select("series_id", F.col("week_start").alias("origin"), "is_row",
                 *[F.percentile(c, F.lit(0.5)).over(w).alias(f"m_{c}") for c in cols])
    return x.filter("is_row = 0").drop("is_row")


def filled(rows: DataFrame, medians: DataFrame, cols) -> DataFrame:
    """``rows`` with missing values of ``cols`` filled by the medians of their series (0 if it has none)."""
    out = rows.join(medians.drop("origin"), "series_id", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"m_{c}"), F.lit(0.0)) for c in cols})
    return out.drop(*[f"m_{c}" for c in cols])


def rf_backtest(spark, df: DataFrame, orig: DataFrame, n_trees: int = 200, max_depth: int = 6,
                parallelism: int | None = None) -> DataFrame:
    """Forest arm: for each origin week one pooled forest trained on every
    series' rows strictly before it; the origin row is scored with its actual
    spends and drivers (lag 1 / lag 4 are then the last training values).

    Every origin is kept.  Each series has its own last months, so the distinct
    origin weeks are bounded by the weeks of the whole history (53 where all
    series end together), and so is the list that is collected.  ``parallelism``
    fits run at once (default: as many as the cluster has cores, 32 at most); each
    writes its predictions to the shared checkpoint folder as it finishes, and the
    folder is read once.
    """
    import uuid
    from concurrent.futures import ThreadPoolExecutor

    from ..session import checkpoint_dir, materialised
    from ..functions.cleaning import week_cos, week_sin
    from .forecast import BASE_FEATURES, DRIVERS, rf_fit
    from .windows import lag_features

    schema = "series_id string, origin_week date, pred_rf double"
    weeks = sorted(r[0] for r in orig.select("origin_week").distinct().collect())
    if not weeks:
        return spark.createDataFrame([], schema)
    cols = list(BASE_FEATURES) + list(DRIVERS)
    base = lag_features(df).withColumns({"week_sin": week_sin("iso_week"), "week_cos": week_cos("iso_week")})
    base = materialised(base.select("series_id", "week_start", "net_sales", *cols), "backtest-rows")
    medians = materialised(training_medians(base, weeks, cols), "backtest-medians")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/panelcast-rf-backtest-{uuid.uuid4().hex}"

    def one(o):
        at = medians.filter(F.col("origin") == F.lit(o))
        train = filled(base.filter(F.col("week_start") < F.lit(o)), at, cols)
        model = rf_fit(train, cols, n_trees=n_trees, max_depth=max_depth)
        test = base.join(orig.filter(F.col("origin_week") == F.lit(o))
                         .select("series_id", F.col("origin_week").alias("week_start")), ["series_id", "week_start"])
        out = model.transform(filled(test, at, cols)).select("series_id", F.col("week_start").alias("origin_week"),
                                                             F.col("prediction").alias("pred_rf"))
        out.write.parquet(f"{folder}/origin={o.isoformat()}")

    with ThreadPoolExecutor(max_workers=parallelism or max(1, min(32, spark.sparkContext.defaultParallelism))) as ex:
        list(ex.map(one, weeks))
    return spark.read.schema(schema).parquet(*[f"{folder}/origin={o.isoformat()}" for o in weeks])


ADD_BT_SCHEMA = "series_id string, origin_week date, pred_additive double"


def _additive_bt_group(pdf):
    import pandas as pd

    from .forecast import _fit_predict

    pdf = pdf.sort_values("week_start").reset_index(drop=True)
    rows = []
    for i in pdf.index[pdf["is_origin"]]:
        train = pdf.iloc[:i]
        yhat, _, _ = _fit_predict(train, pdf.iloc[i:i + 1])
        rows.append((pdf.at[i, "series_id"], pdf.at[i, "week_start"], float(yhat[0])))
    return pd.DataFrame(rows, columns=["series_id", "origin_week", "pred_additive"])


def additive_backtest(spark, df: DataFrame, orig: DataFrame) -> DataFrame:
    """Additive arm: per series (one ``applyInPandas`` group of weekly rows),
    one ridge fit per origin on the rows before it."""
    from .forecast import REG_COLS, additive_design

    flag = orig.select("series_id", F.col("origin_week").alias("week_start"), F.lit(True).alias("is_origin"))
    x = df.select("series_id", "week_start", F.col("net_sales").alias("y"), *REG_COLS)
    x = x.join(flag, ["series_id", "week_start"], "left").withColumn(
        "is_origin", F.coalesce(F.col("is_origin"), F.lit(False)))
    return additive_design(spark, x).groupBy("series_id").applyInPandas(_additive_bt_group, ADD_BT_SCHEMA)


def backtest(spark, df: DataFrame, months: int = 12, min_train: int = 20, n_trees: int = 200) -> DataFrame:
    """F6 + F7 + F8: all four arms at every origin, scored, with the winner."""
    o = origins(df, months, min_train)
    seas = seasonal_predictions(df).withColumnRenamed("week_start", "origin_week")
    rf = rf_backtest(spark, df, o, n_trees=n_trees)
    add = additive_backtest(spark, df, o)
    j = (o.join(seas, ["series_id", "origin_week"]).join(rf, ["series_id", "origin_week"], "left")
         .join(add, ["series_id", "origin_week"], "left"))
    j = j.withColumn("pred_ensemble", (F.col("pred_rf") + F.col("pred_additive")) / 2.0)
    return score_models(j).withColumns({"year": F.year("origin_week"), "month_num": F.month("origin_week")})


def validate_weeks(spark, df: DataFrame, model, overrides: DataFrame | None = None) -> DataFrame:
    """F11 + F12: score every historical week with the forest and the
    additive model (spends / actual optionally overridden), ensemble,
    accuracy % with tiers (> 92 excellent, > 85 good, else deviation) and
    anomaly flags for deviating weeks."""
    from ..functions.cleaning import week_cos, week_sin
    from .forecast import BASE_FEATURES, DRIVERS, REG_COLS, _fit_predict, additive_design

    w = w_series()
    n_before = F.row_number().over(w) - 1
    x = df.select("series_id", "week_start", "iso_week", "net_sales", *REG_COLS, n_before.alias("n_before"),
                  F.lag("net_sales", 1).over(w).alias("l1"), F.lag("net_sales", 4).over(w).alias("l4"))
    x = overridden(x, overrides)
    x = x.withColumns({
        "week_sin": week_sin("iso_week"), "week_cos": week_cos("iso_week"),
        "lag_1": F.when(F.col("n_before") > 0, F.col("l1")).otherwise(F.col("net_sales")),
        "lag_4": F.when(F.col("n_before") > 3, F.col("l4")).otherwise(F.col("net_sales")),
    })
    rf = model.transform(x.select("series_id", "week_start", *BASE_FEATURES, *DRIVERS)).select(
        "series_id", "week_start", F.col("prediction").alias("pred_rf"))
    hist = df.select("series_id", "week_start", F.col("net_sales").alias("y"), *REG_COLS).withColumn(
        "kind", F.lit("hist"))
    tgt = x.select("series_id", "week_start", F.lit(None).cast("double").alias("y"), *REG_COLS).withColumn(
        "kind", F.lit("target"))

    def group(pdf):
        import pandas as pd
        h = pdf[pdf["kind"] == "hist"].sort_values("week_start")
        t = pdf[pdf["kind"] == "target"]
        yhat, _, _ = _fit_predict(h, t)
        return pd.DataFrame({"series_id": t["series_id"].to_numpy(), "week_start": t["week_start"].to_numpy(),
                             "pred_additive": yhat})

    add = additive_design(spark, hist.unionByName(tgt)).groupBy("series_id").applyInPandas(
        group, "series_id string, week_start date, pred_additive double")
    v = x.select("series_id", "week_start", "actual", "spend_a", "cpc_a").join(rf, ["series_id", "week_start"]) \
        .join(add, ["series_id", "week_start"])
    return judge_weeks(v)


def overridden(x: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """weeks with ``actual`` (their net sales), and spends and actual replaced where a row of
    ``overrides`` (series_id, week_start, spend_a, spend_b, actual) gives them."""
    if overrides is None:
        return x.withColumn("actual", F.col("net_sales"))
    ov = overrides.select("series_id", "week_start", F.col("spend_a").alias("o_a"),
                          F.col("spend_b").alias("o_b"), F.col("actual").alias("o_y"))
    return x.join(ov, ["series_id", "week_start"], "left").withColumns({
        "spend_a": F.coalesce("o_a", "spend_a"), "spend_b": F.coalesce("o_b", "spend_b"),
        "actual": F.coalesce("o_y", "net_sales")}).drop("o_a", "o_b", "o_y")


def judge_weeks(v: DataFrame) -> DataFrame:
    """F11 + F12 on weeks with ``actual``, ``spend_a``, ``cpc_a`` and both predictions: ensemble,
    accuracy %, tier, and the flags of deviating weeks against the means of their series."""
    v = v.withColumn("pred_ensemble", (F.col("pred_rf") + F.col("pred_additive")) / 2.0)
    acc = F.when(F.col("actual") > 0, (F.lit(1.0) - F.abs(F.col("pred_ensemble") - F.col("actual"))
                                       / F.col("actual")) * 100.0)
    v = v.withColumn("accuracy_pct", acc)
    v = v.withColumn("tier", F.when(F.col("accuracy_pct") > 92, "excellent")
                     .when(F.col("accuracy_pct") > 85, "good")
                     .when(F.col("accuracy_pct").isNotNull(), "deviation"))
    ws = Window.partitionBy("series_id")
    mean = lambda c: F.sum(F.col(c).cast(SUM_TYPE)).over(ws).cast("double") / F.count(c).over(ws)
    dev = F.col("tier") == "deviation"
    return v.withColumns({
        "flag_low_spend_share": dev & (F.try_divide(F.col("spend_a"), F.col("actual")) < F.try_divide(mean("spend_a"), mean("actual")) * 0.8),
        "flag_cpc": dev & (F.col("cpc_a") > mean("cpc_a") * 1.3),
        "flag_unseen_factors": dev,
    })


def backtest_month_year(bt_scored: DataFrame, measure: str) -> DataFrame:
    """A15 in long form: mean of ``measure`` per (series, month, year) with its
    accuracy band (F13); :func:`accuracy_matrix` is the matrix form."""
    x = bt_scored.withColumns({"year": F.year("origin_week"), "month_num": F.month("origin_week"),
                               "month": F.date_format("origin_week", "MMM")})
    g = x.groupBy("series_id", "year", "month_num", "month").agg(xavg(measure).alias("value"))
    return g.withColumn("band", accuracy_band("value")) if measure.startswith("acc") else g
