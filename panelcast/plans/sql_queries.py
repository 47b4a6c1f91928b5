"""DuckDB SQL for each registered query (see :mod:`panelcast.plans.oracle`)."""

from __future__ import annotations

from .oracle import d, rnd, sessions_ctes, with_wf

SQL: dict[str, str] = {}

WF_COLS = "series_id, week_start, iso_year, iso_week, period_label, " + ", ".join(
    f"{rnd(c)} AS {c}" for c in (
        "spend_a", "spend_b", "total_sales", "gross_sales", "discounts", "returns", "orders", "items", "aov",
        "returning_rate_pct", "conv_value_a", "conv_value_b", "cpc_a", "cpc_b", "cpm_b", "impressions_a",
        "frequency_b", "sessions", "net_sales", "ad_spend", "mer", "return_rate_pct", "cost_of_sales_pct", "op_profit",
        "roas_a", "roas_b"))

SQL["weekly_fact"] = with_wf(f"SELECT {WF_COLS} FROM wf")
SQL["weekly_fact_nation"] = with_wf(f"SELECT {WF_COLS} FROM wf", grain="nation")

# -- shared LFL CTEs -------------------------------------------------------
DEC = "DECIMAL(28,6)"


def xs(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS {DEC})) AS DOUBLE)"


PAIRS = """pairs AS (
  SELECT series_id, year, prev_year FROM (
    SELECT series_id, year, lead(year) OVER (PARTITION BY series_id ORDER BY year DESC) AS prev_year
    FROM (SELECT DISTINCT series_id, iso_year AS year FROM wf) y) t
  WHERE prev_year IS NOT NULL
)"""

LFL_GROWTH = PAIRS + f""",
common AS (
  SELECT p.series_id, p.year, p.prev_year,
         coalesce({xs('c.net_sales')}, 0) AS sales_curr,
         coalesce({xs('v.net_sales')}, 0) AS sales_prev,
         CAST(count(*) AS INTEGER) AS n_common_weeks
  FROM pairs p
  JOIN wf c ON c.series_id = p.series_id AND c.iso_year = p.year
  JOIN wf v ON v.series_id = p.series_id AND v.iso_year = p.prev_year AND v.iso_week = c.iso_week
  GROUP BY p.series_id, p.year, p.prev_year
),
annual AS (
  SELECT series_id, iso_year, coalesce({xs('net_sales')}, 0) AS ns FROM wf GROUP BY series_id, iso_year
),
g AS (
  SELECT p.series_id, p.year, p.prev_year,
    CASE WHEN cm.n_common_weeks IS NULL THEN 'whole_year' ELSE 'lfl' END AS basis,
    coalesce(cm.n_common_weeks, 0) AS n_common_weeks,
    CASE WHEN cm.n_common_weeks IS NULL THEN ac.ns ELSE cm.sales_curr END AS sales_curr,
    CASE WHEN cm.n_common_weeks IS NULL THEN ap.ns ELSE cm.sales_prev END AS sales_prev
  FROM pairs p
  LEFT JOIN common cm ON cm.series_id = p.series_id AND cm.year = p.year AND cm.prev_year = p.prev_year
  LEFT JOIN annual ac ON ac.series_id = p.series_id AND ac.iso_year = p.year
  LEFT JOIN annual ap ON ap.series_id = p.series_id AND ap.iso_year = p.prev_year
)"""

LFL_GROWTH_SELECT = f"""SELECT series_id, year, prev_year, basis, n_common_weeks,
  {rnd('sales_curr')} AS sales_curr, {rnd('sales_prev')} AS sales_prev,
  {rnd('CASE WHEN sales_prev > 0 THEN (sales_curr - sales_prev) / sales_prev END')} AS growth,
  (basis = 'lfl' AND n_common_weeks < 48) AS is_partial
FROM g WHERE basis = 'lfl' OR sales_prev > 0"""

SQL["lfl_growth"] = with_wf(LFL_GROWTH_SELECT, extra_ctes=LFL_GROWTH)
SQL["lfl_growth_all"] = with_wf(LFL_GROWTH_SELECT, grain="all", extra_ctes=LFL_GROWTH)


# -- helpers -----------------------------------------------------------------
from .oracle import econ_sql  # noqa: E402

BE = econ_sql()["be_roas"]


def xa(expr: str) -> str:
    return f"({xs(expr)} / count({expr}))"


def r6(expr: str, name: str) -> str:
    return f"{rnd(expr)} AS {name}"


def body(select: str, ctes: str = "", grain: str = "segment") -> str:
    return with_wf(select, grain=grain, extra_ctes=ctes)


SQL["annual_totals"] = body(f"""SELECT series_id, iso_year,
  {r6(f"coalesce({xs('ad_spend')}, 0)", 'ad_spend')}, {r6(f"coalesce({xs('net_sales')}, 0)", 'net_sales')},
  min(week_start) AS first_week, count(*) AS n_weeks
FROM wf GROUP BY series_id, iso_year""")

PROFILE = f"""profile AS (
  SELECT series_id, iso_week, {xa('net_sales')} AS net_sales, {xa('spend_a')} AS spend_a,
         {xa('spend_b')} AS spend_b, {xa('orders')} AS orders, count(*) AS n_weeks
  FROM wf GROUP BY series_id, iso_week
)"""
SQL["seasonal_profile"] = body(f"""SELECT series_id, iso_week, {r6('net_sales', 'net_sales')},
  {r6('spend_a', 'spend_a')}, {r6('spend_b', 'spend_b')}, {r6('orders', 'orders')}, n_weeks FROM profile""", PROFILE)

TG = f"""tg0 AS (SELECT *, max(week_start) OVER (PARTITION BY series_id) AS lw FROM wf),
tg1 AS (
  SELECT series_id, max(lw) AS last_week,
    coalesce(CAST(sum(CASE WHEN week_start > lw - 364 AND week_start <= lw THEN CAST(net_sales AS {DEC}) END) AS DOUBLE), 0) AS sales_ly,
    coalesce(CAST(sum(CASE WHEN week_start > lw - 728 AND week_start <= lw - 364 THEN CAST(net_sales AS {DEC}) END) AS DOUBLE), 0) AS sales_py
  FROM tg0 GROUP BY series_id
),
tg AS (SELECT *, CASE WHEN sales_py > 0 THEN (sales_ly - sales_py) / sales_py ELSE {d(0.0)} END AS growth_rate FROM tg1)"""
SQL["trailing_growth"] = body(f"""SELECT series_id, last_week, {r6('sales_ly', 'sales_ly')}, {r6('sales_py', 'sales_py')},
  {r6('growth_rate', 'growth_rate')} FROM tg""", TG)


def side_sum(flag: str, c: str) -> str:
    return f"coalesce(CAST(sum(CASE WHEN {flag} THEN CAST({c} AS {DEC}) END) AS DOUBLE), 0)"


def side_avg(flag: str, c: str) -> str:
    return f"(CAST(sum(CASE WHEN {flag} THEN CAST({c} AS {DEC}) END) AS DOUBLE) / count(CASE WHEN {flag} THEN {c} END))"


def label(dcol: str) -> str:
    return (f"(strftime({dcol}, '%d %b') || ' - ' || strftime(CAST({dcol} + INTERVAL 6 DAY AS DATE), '%d %b %Y'))")


RK = f"""rk0 AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week_start DESC) AS rn,
         count(*) OVER (PARTITION BY series_id) AS n_rows FROM wf
),
rk1 AS (
  SELECT series_id, max(n_rows) AS n_rows,
    {side_sum('rn <= 4', 'net_sales')} AS sales, {side_sum('rn > 4 AND rn <= 8', 'net_sales')} AS p_sales,
    {side_sum('rn <= 4', 'ad_spend')} AS ad_spend, {side_sum('rn > 4 AND rn <= 8', 'ad_spend')} AS p_ad_spend,
    {side_sum('rn <= 4', 'op_profit')} AS profit, {side_sum('rn > 4 AND rn <= 8', 'op_profit')} AS p_profit,
    {side_sum('rn <= 4', 'orders')} AS orders, {side_sum('rn > 4 AND rn <= 8', 'orders')} AS p_orders,
    {side_sum('rn <= 4', 'discounts')} AS discounts, {side_sum('rn > 4 AND rn <= 8', 'discounts')} AS p_discounts,
    min(CASE WHEN rn <= 4 THEN week_start END) AS first_week,
    max(CASE WHEN rn <= 4 THEN week_start END) AS last_week,
    max(CASE WHEN rn <= 4 AND month(week_start) = 1 THEN 1 ELSE 0 END) AS has_jan,
    max(CASE WHEN rn <= 4 AND month(week_start) = 7 THEN 1 ELSE 0 END) AS has_jul,
    max(CASE WHEN rn <= 4 AND month(week_start) = 11 THEN 1 ELSE 0 END) AS has_nov
  FROM rk0 WHERE rn <= 8 GROUP BY series_id
),
rk2 AS (
  SELECT *, n_rows >= 8 AS full_,
    {BE} AS be_roas,
    CASE WHEN ad_spend > 0 THEN sales / ad_spend ELSE {d(0.0)} END AS mer,
    CASE WHEN p_ad_spend > 0 THEN p_sales / p_ad_spend ELSE {d(0.0)} END AS p_mer,
    CASE WHEN sales > 0 THEN ad_spend / sales * {d(100.0)} ELSE {d(0.0)} END AS cos,
    CASE WHEN p_sales > 0 THEN p_ad_spend / p_sales * {d(100.0)} ELSE {d(0.0)} END AS p_cos,
    CASE WHEN orders > 0 THEN sales / orders ELSE {d(0.0)} END AS aov,
    CASE WHEN p_orders > 0 THEN p_sales / p_orders ELSE {d(0.0)} END AS p_aov
  FROM rk1
),
rk AS (
  SELECT *,
    CASE WHEN full_ AND p_sales > 0 THEN (sales - p_sales) / p_sales END AS d_sales,
    CASE WHEN full_ AND p_ad_spend > 0 THEN (ad_spend - p_ad_spend) / p_ad_spend END AS d_ad_spend,
    CASE WHEN full_ AND abs(p_profit) > 0 THEN (profit - p_profit) / abs(p_profit) END AS d_profit,
    CASE WHEN full_ THEN mer - p_mer END AS d_mer,
    CASE WHEN full_ THEN cos - p_cos END AS d_cos,
    CASE WHEN full_ AND p_aov > 0 THEN (aov - p_aov) / p_aov END AS d_aov,
    CASE WHEN sales > 0 THEN abs(discounts) / sales ELSE {d(0.0)} END AS disc_share,
    CASE WHEN full_ THEN (CASE WHEN p_sales > 0 THEN abs(p_discounts) / p_sales ELSE {d(0.0)} END) ELSE {d(0.0)} END AS disc_share_prev
  FROM rk2
)"""
SQL["recent_kpis"] = body(f"""SELECT series_id, n_rows, {label('first_week')} AS period_first, {label('last_week')} AS period_last,
  {', '.join(r6(c, c) for c in ['sales', 'ad_spend', 'profit', 'orders', 'mer', 'cos', 'aov', 'be_roas'])},
  {r6('mer - be_roas', 'mer_vs_be')},
  {', '.join(r6(c, c) for c in ['d_sales', 'd_ad_spend', 'd_profit', 'd_mer', 'd_cos', 'd_aov', 'disc_share', 'disc_share_prev'])},
  CASE WHEN disc_share > {d(0.15)} THEN 'high' WHEN disc_share > disc_share_prev + {d(0.05)} THEN 'active' ELSE 'stable' END AS promo_pressure,
  CASE WHEN has_jan = 1 THEN 'winter_sales' WHEN has_jul = 1 THEN 'summer_sales' WHEN has_nov = 1 THEN 'black_friday' ELSE 'standard' END AS season_context,
  CASE WHEN mer < be_roas THEN 'critical' WHEN mer < be_roas * {d(1.25)} THEN 'caution' ELSE 'scalable' END AS margin_verdict,
  {r6(f'mer / be_roas - {d(1.0)}', 'cushion')}
FROM rk""", RK)

CS = f"""cs0 AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week_start DESC) AS rn,
         count(*) OVER (PARTITION BY series_id) AS n_rows FROM wf
),
cs1 AS (
  SELECT *, rn <= 4 AS is_last,
    CASE WHEN n_rows >= 8 THEN rn > 4 AND rn <= 8 ELSE rn <= 4 END AS is_ref
  FROM cs0 WHERE rn <= 8
),
cs2 AS (
  SELECT series_id,
    {side_sum('is_last', 'spend_a')} AS spend_a, {side_sum('is_last', 'spend_b')} AS spend_b,
    {side_sum('is_last', 'conv_value_a')} AS conv_value_a, {side_sum('is_last', 'conv_value_b')} AS conv_value_b,
    {side_sum('is_last', 'impressions_a')} AS impressions_a,
    {side_avg('is_last', 'cpm_b')} AS cpm_b, {side_avg('is_ref', 'cpm_b')} AS cpm_b_prev,
    {side_avg('is_last', 'frequency_b')} AS frequency_b,
    {side_avg('is_last', 'cpc_a')} AS cpc_a, {side_avg('is_ref', 'cpc_a')} AS cpc_a_prev,
    {side_avg('is_last', 'cpc_b')} AS cpc_b
  FROM cs1 GROUP BY series_id
),
cs3 AS (
  SELECT *, CASE WHEN spend_a > 0 THEN conv_value_a / spend_a ELSE {d(0.0)} END AS roas_a,
            CASE WHEN spend_b > 0 THEN conv_value_b / spend_b ELSE {d(0.0)} END AS roas_b
  FROM cs2
),
cs AS (
  SELECT *,
    CASE WHEN cpm_b_prev > 0 THEN (cpm_b - cpm_b_prev) / cpm_b_prev ELSE {d(0.0)} END AS cpm_change,
    CASE WHEN cpc_a_prev > 0 THEN (cpc_a - cpc_a_prev) / cpc_a_prev ELSE {d(0.0)} END AS cpc_change,
    CASE WHEN roas_a > roas_b THEN 'a' ELSE 'b' END AS best_channel,
    abs(roas_a - roas_b) / greatest(roas_a, roas_b, {d(0.01)}) AS performance_gap
  FROM cs3
)"""
SQL["channel_signals"] = body(f"""SELECT series_id,
  {', '.join(r6(c, c) for c in ['spend_a', 'spend_b', 'conv_value_a', 'conv_value_b', 'impressions_a', 'cpm_b', 'cpm_b_prev', 'frequency_b', 'cpc_a', 'cpc_a_prev', 'cpc_b', 'roas_a', 'roas_b', 'cpm_change', 'cpc_change'])},
  best_channel, {r6('performance_gap', 'performance_gap')},
  cpm_change > {d(0.15)} AS cpm_pressure, frequency_b > {d(1.4)} AS frequency_saturated
FROM cs""", CS)

LFL_JOIN = PAIRS + """,
lf AS (
  SELECT p.series_id, p.year, p.prev_year, c.iso_week,
    c.net_sales AS c_net_sales, v.net_sales AS v_net_sales, c.ad_spend AS c_ad_spend, v.ad_spend AS v_ad_spend,
    c.orders AS c_orders, v.orders AS v_orders, c.impressions_a AS c_impressions_a, v.impressions_a AS v_impressions_a,
    c.returning_rate_pct AS c_returning_rate_pct, v.returning_rate_pct AS v_returning_rate_pct,
    c.cpc_a AS c_cpc_a, v.cpc_a AS v_cpc_a, c.cpc_b AS c_cpc_b, v.cpc_b AS v_cpc_b,
    c.cpm_b AS c_cpm_b, v.cpm_b AS v_cpm_b, c.frequency_b AS c_frequency_b, v.frequency_b AS v_frequency_b,
    c.returns AS c_returns, v.returns AS v_returns
  FROM pairs p
  JOIN wf c ON c.series_id = p.series_id AND c.iso_year = p.year
  JOIN wf v ON v.series_id = p.series_id AND v.iso_year = p.prev_year AND v.iso_week = c.iso_week
)"""

EL = LFL_JOIN + f""",
el0 AS (
  SELECT series_id, year, prev_year, CAST(count(*) AS INTEGER) AS n_common_weeks,
    coalesce({xs('c_ad_spend')}, 0) AS spend_curr, coalesce({xs('v_ad_spend')}, 0) AS spend_prev,
    coalesce({xs('c_net_sales')}, 0) AS sales_curr, coalesce({xs('v_net_sales')}, 0) AS sales_prev
  FROM lf GROUP BY series_id, year, prev_year
),
el1 AS (
  SELECT *, CASE WHEN spend_prev > 0 THEN (spend_curr - spend_prev) / spend_prev ELSE {d(0.0)} END AS d_spend,
            CASE WHEN sales_prev > 0 THEN (sales_curr - sales_prev) / sales_prev ELSE {d(0.0)} END AS d_rev
  FROM el0
),
el AS (
  SELECT series_id, year, prev_year, n_common_weeks, spend_curr, spend_prev, sales_curr, sales_prev,
    d_spend * {d(100.0)} AS delta_spend_pct, d_rev * {d(100.0)} AS delta_sales_pct,
    CASE WHEN abs(d_spend) > {d(0.01)} THEN d_rev / d_spend ELSE {d(0.0)} END AS elasticity
  FROM el1
)"""
SQL["lfl_elasticity"] = body(f"""SELECT series_id, year, prev_year, n_common_weeks,
  {', '.join(r6(c, c) for c in ['spend_curr', 'spend_prev', 'sales_curr', 'sales_prev', 'delta_spend_pct', 'delta_sales_pct', 'elasticity'])}
FROM el""", EL)

SQL["elasticity_summary"] = body(f"""SELECT series_id, {rnd('avg_elasticity')} AS avg_elasticity, n_pairs,
  CASE WHEN avg_elasticity IS NULL THEN NULL WHEN avg_elasticity > {d(0.95)} THEN 'scalable'
       WHEN avg_elasticity > {d(0.75)} THEN 'standard' ELSE 'saturated' END AS verdict
FROM (SELECT series_id,
        CAST(sum(CASE WHEN elasticity > 0 THEN CAST(elasticity AS {DEC}) END) AS DOUBLE)
          / nullif(count(CASE WHEN elasticity > 0 THEN elasticity END), 0) AS avg_elasticity,
        count(*) AS n_pairs
      FROM el GROUP BY series_id) s""", EL, grain="nation")

ANNUAL = f"""annual AS (
  SELECT series_id, iso_year, coalesce({xs('ad_spend')}, 0) AS ad_spend, coalesce({xs('net_sales')}, 0) AS net_sales
  FROM wf GROUP BY series_id, iso_year
)"""
SAT = ANNUAL + f""",
ss0 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY iso_year DESC) AS rn FROM annual),
ss1 AS (
  SELECT series_id,
    max(CASE WHEN rn = 1 THEN iso_year END) AS last_year, max(CASE WHEN rn = 2 THEN iso_year END) AS prev_year,
    max(CASE WHEN rn = 1 THEN ad_spend END) AS spend_last, max(CASE WHEN rn = 2 THEN ad_spend END) AS spend_prev,
    max(CASE WHEN rn = 1 THEN net_sales END) AS sales_last, max(CASE WHEN rn = 2 THEN net_sales END) AS sales_prev
  FROM ss0 WHERE rn <= 2 GROUP BY series_id
),
ss2 AS (
  SELECT *, (spend_last - spend_prev) / nullif(spend_prev, 0) AS d_spend,
            (sales_last - sales_prev) / nullif(sales_prev, 0) AS d_rev FROM ss1
),
ss AS (
  SELECT series_id, last_year, prev_year, d_spend, d_rev,
    coalesce(CASE WHEN d_spend > {d(0.05)} THEN least(greatest(d_rev / nullif(d_spend, 0), {d(0.6)}), {d(1.0)}) END, {d(0.85)}) AS saturation
  FROM ss2
)"""
SQL["suggested_saturation"] = body(f"""SELECT series_id, last_year, prev_year, {r6('d_spend', 'd_spend')},
  {r6('d_rev', 'd_rev')}, {r6('saturation', 'saturation')} FROM ss""", SAT)

SQL["weekly_yoy_detail"] = body(f"""SELECT series_id, year, prev_year, iso_week, period_label,
  {', '.join(r6(c, c) for c in ['spend_curr', 'spend_prev', 'sales_curr', 'sales_prev', 'delta_spend_pct', 'delta_sales_pct', 'elasticity'])}
FROM (
  SELECT *, CASE WHEN delta_spend_pct <> 0 THEN delta_sales_pct / delta_spend_pct ELSE {d(0.0)} END AS elasticity
  FROM (
    SELECT *,
      CASE WHEN spend_prev > 0 THEN (spend_curr - spend_prev) / spend_prev * {d(100.0)} ELSE {d(0.0)} END AS delta_spend_pct,
      CASE WHEN sales_prev > 0 THEN (sales_curr - sales_prev) / sales_prev * {d(100.0)} ELSE {d(0.0)} END AS delta_sales_pct
    FROM (
      SELECT s.series_id, s.year, s.prev_year, s.iso_week, c.period_label,
        coalesce(c.ad_spend, 0) AS spend_curr, coalesce(c.net_sales, 0) AS sales_curr,
        coalesce(v.ad_spend, 0) AS spend_prev, coalesce(v.net_sales, 0) AS sales_prev
      FROM (SELECT series_id, year, prev_year, CAST(unnest(range(1, 54)) AS INTEGER) AS iso_week FROM el) s
      LEFT JOIN wf c ON c.series_id = s.series_id AND c.iso_year = s.year AND c.iso_week = s.iso_week
      LEFT JOIN wf v ON v.series_id = s.series_id AND v.iso_year = s.prev_year AND v.iso_week = s.iso_week
    ) a
  ) b
) c2 WHERE spend_curr > 0 OR spend_prev > 0""", EL)

SQL["common_weeks"] = body("SELECT series_id, year, prev_year, iso_week FROM lf", LFL_JOIN)


def _yh_side(p: str, sfx: str) -> str:
    sums = [f"coalesce({xs(f'{p}_{c}')}, 0) AS {c}_{sfx}" for c in ('net_sales', 'ad_spend', 'orders', 'impressions_a')]
    avgs = [f"coalesce({xa(f'{p}_{c}')}, 0) AS {c}_{sfx}" for c in ('returning_rate_pct', 'cpc_a', 'cpc_b', 'cpm_b', 'frequency_b')]
    return ",\n    ".join(sums + avgs + [f"coalesce({xs(f'abs({p}_returns)')}, 0) AS returns_abs_{sfx}"])


def _yh_metrics(s: str) -> str:
    return f"""CASE WHEN ad_spend_{s} > 0 THEN net_sales_{s} / ad_spend_{s} ELSE {d(0.0)} END AS mer_{s},
    CASE WHEN orders_{s} > 0 THEN net_sales_{s} / orders_{s} ELSE {d(0.0)} END AS aov_{s},
    CASE WHEN orders_{s} > 0 THEN ad_spend_{s} / orders_{s} ELSE {d(0.0)} END AS cpa_{s},
    CASE WHEN net_sales_{s} > 0 THEN returns_abs_{s} / net_sales_{s} * {d(100.0)} ELSE {d(0.0)} END AS returns_pct_{s}"""


def _ltv(s: str) -> str:
    return (f"CASE WHEN returning_rate_pct_{s} / {d(100.0)} < {d(0.99)} THEN aov_{s} / ({d(1.0)} - returning_rate_pct_{s} / {d(100.0)}) "
            f"ELSE aov_{s} END AS ltv_{s}")


def _rel(n: str) -> str:
    return f"CASE WHEN {n}_prev > 0 THEN ({n}_curr - {n}_prev) / {n}_prev * {d(100.0)} ELSE {d(0.0)} END"


YH = LFL_JOIN + f""",
yh0 AS (
  SELECT series_id, year, prev_year, CAST(count(*) AS INTEGER) AS n_common_weeks,
    string_agg(CAST(iso_week AS VARCHAR), ',' ORDER BY iso_week) AS week_list,
    {_yh_side('c', 'curr')},
    {_yh_side('v', 'prev')}
  FROM lf GROUP BY series_id, year, prev_year
),
yh1 AS (SELECT *, {_yh_metrics('curr')}, {_yh_metrics('prev')} FROM yh0),
yh2 AS (SELECT *, {_ltv('curr')}, {_ltv('prev')} FROM yh1),
yh3 AS (SELECT *, CASE WHEN cpa_curr > 0 THEN ltv_curr / cpa_curr ELSE {d(0.0)} END AS ltv_cpa_curr,
                  CASE WHEN cpa_prev > 0 THEN ltv_prev / cpa_prev ELSE {d(0.0)} END AS ltv_cpa_prev FROM yh2),
yh AS (
  SELECT *, {_rel('net_sales')} AS delta_sales_pct, mer_curr - mer_prev AS delta_mer,
    {_rel('cpa')} AS delta_cpa_pct, {_rel('aov')} AS delta_aov_pct, {_rel('cpm_b')} AS delta_cpm_pct,
    frequency_b_curr - frequency_b_prev AS delta_frequency, {_rel('cpc_a')} AS delta_cpc_a_pct,
    {_rel('cpc_b')} AS delta_cpc_b_pct, {_rel('impressions_a')} AS delta_impressions_pct,
    returning_rate_pct_curr - returning_rate_pct_prev AS delta_retention_pt,
    returns_pct_curr - returns_pct_prev AS delta_returns_pt, {_rel('ltv')} AS delta_ltv_pct,
    ltv_cpa_curr - ltv_cpa_prev AS delta_ltv_cpa
  FROM yh3
)"""
_YH_COLS = []
for _s in ("curr", "prev"):
    _YH_COLS += [f"{c}_{_s}" for c in ("net_sales", "ad_spend", "orders", "mer", "aov", "cpa", "cpc_a", "cpc_b",
                                       "cpm_b", "frequency_b", "impressions_a", "returning_rate_pct",
                                       "returns_pct", "ltv", "ltv_cpa")]
_YH_COLS += ["delta_sales_pct", "delta_mer", "delta_cpa_pct", "delta_aov_pct", "delta_cpm_pct", "delta_frequency",
             "delta_cpc_a_pct", "delta_cpc_b_pct", "delta_impressions_pct", "delta_retention_pt", "delta_returns_pt",
             "delta_ltv_pct", "delta_ltv_cpa"]
SQL["yoy_health"] = body(f"""SELECT series_id, year, prev_year, n_common_weeks, week_list,
  {', '.join(r6(c, c) for c in _YH_COLS)},
  frequency_b_curr > frequency_b_prev AS frequency_up, delta_cpm_pct > 5 AS cpm_rising,
  ltv_curr > ltv_prev AS ltv_up, ltv_cpa_curr > 3 AS ltv_cpa_strong
FROM yh""", YH)

SQL["rolling_return_rate"] = body(f"""SELECT series_id, week_start, {r6('ad_spend', 'ad_spend')},
  {r6('return_rate_pct', 'return_rate_pct')},
  {rnd(f'CASE WHEN count(return_rate_pct) OVER w = 4 THEN CAST(sum(CAST(return_rate_pct AS {DEC})) OVER w AS DOUBLE) / {d(4.0)} END')} AS return_rate_roll
FROM wf WINDOW w AS (PARTITION BY series_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")

TWO_PI = d(2 * 3.141592653589793)
SQL["lag_features"] = body(f"""SELECT series_id, week_start, iso_week, {r6('net_sales', 'net_sales')},
  {r6('lag(net_sales, 1) OVER w', 'lag_1')}, {r6('lag(net_sales, 4) OVER w', 'lag_4')},
  {r6('lag(net_sales, 1) OVER w', 'o_lag_1')},
  {r6('CASE WHEN row_number() OVER w - 1 > 4 THEN lag(net_sales, 4) OVER w ELSE lag(net_sales, 1) OVER w END', 'o_lag_4')},
  {r6(f'sin({TWO_PI} * iso_week / {d(53.0)})', 'week_sin')}, {r6(f'cos({TWO_PI} * iso_week / {d(53.0)})', 'week_cos')}
FROM wf WINDOW w AS (PARTITION BY series_id ORDER BY week_start)""")

MONTH_SUMS = ("ad_spend", "net_sales", "orders", "returns", "discounts", "spend_a", "spend_b",
              "conv_value_a", "conv_value_b", "gross_sales", "op_profit")
MONTH_MEANS = ("returning_rate_pct", "frequency_b", "cpm_b", "cpc_a", "cpc_b")
MF = f"""mf0 AS (
  SELECT series_id, CAST(date_trunc('month', week_start) AS DATE) AS month,
    {', '.join(f"coalesce({xs(c)}, 0) AS {c}" for c in MONTH_SUMS)},
    {', '.join(f"{xa(c)} AS {c}" for c in MONTH_MEANS)},
    count(*) AS n_weeks
  FROM wf GROUP BY series_id, CAST(date_trunc('month', week_start) AS DATE)
),
mf1 AS (
  SELECT *, net_sales / nullif(ad_spend, 0) AS mer, net_sales / nullif(orders, 0) AS aov,
    ad_spend / nullif(orders, 0) AS cpa, returning_rate_pct / {d(100.0)} AS ret_rate FROM mf0
),
mf2 AS (SELECT *, aov / ({d(1.0)} - least(ret_rate, {d(0.9)})) AS ltv FROM mf1),
mf AS (
  SELECT *, ltv / nullif(cpa, 0) AS ltv_cpa, abs(discounts) / nullif(gross_sales, 0) * {d(100.0)} AS discount_rate,
    conv_value_a / nullif(spend_a, 0) AS roas_a, conv_value_b / nullif(spend_b, 0) AS roas_b,
    net_sales / (CAST(sum(CAST(net_sales AS {DEC})) OVER (PARTITION BY series_id) AS DOUBLE)
                 / count(net_sales) OVER (PARTITION BY series_id)) AS seasonality
  FROM mf2
)"""
_MF_DOUBLES = list(MONTH_SUMS) + list(MONTH_MEANS) + ["mer", "aov", "cpa", "ret_rate", "ltv", "ltv_cpa",
                                                      "discount_rate", "roas_a", "roas_b", "seasonality"]
SQL["monthly_fact"] = body(f"""SELECT series_id, month, n_weeks, {', '.join(r6(c, c) for c in _MF_DOUBLES)} FROM mf""", MF)

HS = MF + f""",
hs0 AS (
  SELECT *, {BE} AS be_roas, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) AS rn FROM mf
),
hs1 AS (
  SELECT *, coalesce(mer >= be_roas, false) AS mer_ok, coalesce(ltv_cpa > {d(3.5)}, false) AS ltv_hi,
    coalesce(ltv_cpa < {d(2.0)}, false) AS ltv_lo, coalesce(discount_rate > 15, false) AS disc_hi,
    coalesce(roas_a > roas_b, false) AS a_top
  FROM hs0 WHERE rn <= 12
),
hs AS (
  SELECT *, 50 + CASE WHEN mer_ok THEN 15 ELSE -15 END + CASE WHEN ltv_hi THEN 20 WHEN ltv_lo THEN -10 ELSE 0 END
            + CASE WHEN disc_hi THEN -10 ELSE 0 END AS raw_score
  FROM hs1
)"""
SQL["health_score"] = body(f"""SELECT series_id, month,
  {', '.join(r6(c, c) for c in ['net_sales', 'ad_spend', 'orders', 'mer', 'aov', 'cpa', 'ltv', 'ltv_cpa', 'discount_rate', 'roas_a', 'roas_b', 'seasonality'])},
  CAST(least(raw_score, 100) AS INTEGER) AS score,
  CASE WHEN raw_score >= 70 THEN 'high' WHEN raw_score >= 50 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN seasonality > {d(1.2)} THEN 'high' WHEN seasonality < {d(0.8)} THEN 'low' ELSE 'standard' END AS season,
  CASE WHEN a_top THEN 'a' ELSE 'b' END AS best_channel,
  concat_ws(',', CASE WHEN mer_ok THEN 'mer_pro' END, CASE WHEN ltv_hi THEN 'high_ltv' END,
            CASE WHEN a_top THEN 'top_a' ELSE 'top_b' END) AS tags,
  concat_ws(',', CASE WHEN NOT mer_ok THEN 'low_margin' END, CASE WHEN ltv_lo THEN 'low_retention' END,
            CASE WHEN disc_hi THEN 'excess_discounts' END) AS alerts
FROM hs""", HS)

_E = econ_sql()
SQL["break_even"] = body(f"""SELECT series_id,
  {r6(d(188500.0), 'aov')}, {r6(d(22.0), 'vat_pct')}, {r6(d(13.0), 'return_pct')}, {r6(d(45.0), 'margin_pct')},
  {r6(d(6500.0), 'fulfilment')}, {r6(d(13.0), 'returning_pct')}, {r6(d(1.0), 'repeat_rate')},
  {r6(_E['net_aov'], 'net_aov')}, {r6(_E['profit_per_order'], 'profit_per_order')},
  {r6(_E['profit_per_customer'], 'profit_per_customer')}, {r6(_E['be_cpa'], 'be_cpa')}, {r6(_E['be_roas'], 'be_roas')}
FROM (SELECT DISTINCT series_id FROM wf) s""")

ST = RK + ",\n" + TG + f""",
st0 AS (SELECT rk.series_id, rk.mer, rk.be_roas, tg.growth_rate FROM rk JOIN tg ON tg.series_id = rk.series_id),
st AS (
  SELECT *, mer > be_roas * {d(1.3)} AS aggr, mer >= be_roas AS bal FROM st0
),
strat AS (
  SELECT series_id, mer, be_roas, growth_rate,
    CASE WHEN aggr THEN 'aggressive_scaling' WHEN bal THEN 'balanced_growth' ELSE 'defend_optimise' END AS strategy,
    CASE WHEN aggr THEN {d(1.25)} WHEN bal THEN {d(1.10)} ELSE {d(0.85)} END AS rec_scale,
    CASE WHEN aggr THEN growth_rate + {d(0.05)} WHEN bal THEN growth_rate ELSE growth_rate - {d(0.05)} END AS rec_trend,
    CASE WHEN aggr THEN {d(0.92)} WHEN bal THEN {d(0.85)} ELSE {d(0.80)} END AS rec_saturation
  FROM st
)"""
SQL["strategy"] = body(f"""SELECT series_id, strategy,
  {', '.join(r6(c, c) for c in ['mer', 'be_roas', 'growth_rate', 'rec_scale', 'rec_trend', 'rec_saturation'])}
FROM strat""", ST)

SCEN = f"""sc AS (
  SELECT scenario_id, CAST(trend AS DOUBLE) AS trend, CAST(scale_a AS DOUBLE) AS scale_a,
         CAST(scale_b AS DOUBLE) AS scale_b, CAST(saturation AS DOUBLE) AS saturation, CAST(months AS INTEGER) AS months
  FROM (VALUES ('base', 0.0, 1.0, 1.0, 0.85, 6), ('prudent', 0.0, 1.0, 1.0, 0.80, 6),
               ('aggressive', 0.15, 1.5, 1.5, 0.90, 6), ('stress', 0.0, 1.0, 1.0, 0.85, 6),
               ('auto', 0.0, 1.0, 1.0, NULL, 6)) t(scenario_id, trend, scale_a, scale_b, saturation, months)
)"""
PB = TG + ",\n" + SAT + ",\n" + PROFILE + ",\n" + SCEN + f""",
fb AS (SELECT series_id, {xa('net_sales')} AS fb_net_sales, {xa('spend_a')} AS fb_spend_a,
              {xa('spend_b')} AS fb_spend_b FROM profile GROUP BY series_id),
grid0 AS (
  SELECT tg.series_id, tg.last_week, tg.growth_rate, sc.scenario_id, sc.trend, sc.scale_a, sc.scale_b,
         coalesce(sc.saturation, ss.saturation) AS sat, CAST(floor(CAST(sc.months AS DOUBLE) * {d(4.34)}) AS INTEGER) AS horizon
  FROM tg LEFT JOIN ss ON ss.series_id = tg.series_id CROSS JOIN sc
),
grid AS (
  SELECT *, CAST(last_week + 7 * step AS DATE) AS week_start
  FROM (SELECT *, CAST(unnest(range(1, horizon + 1)) AS INTEGER) AS step FROM grid0) g
),
pb0 AS (
  SELECT g.*, CAST(week(g.week_start) AS INTEGER) AS iso_week,
    coalesce(p.net_sales, fb.fb_net_sales) AS b_sales, coalesce(p.spend_a, fb.fb_spend_a) AS b_a,
    coalesce(p.spend_b, fb.fb_spend_b) AS b_b
  FROM grid g
  LEFT JOIN profile p ON p.series_id = g.series_id AND p.iso_week = CAST(week(g.week_start) AS INTEGER)
  LEFT JOIN fb ON fb.series_id = g.series_id
),
pb1 AS (
  SELECT *, b_sales * (({d(1.0)} + growth_rate) * ({d(1.0)} + trend)) AS sales_base,
            b_a * (({d(1.0)} + growth_rate) * ({d(1.0)} + trend)) AS a_base,
            b_b * (({d(1.0)} + growth_rate) * ({d(1.0)} + trend)) AS b_base
  FROM pb0
),
pb2 AS (SELECT *, a_base * scale_a AS spend_a, b_base * scale_b AS spend_b FROM pb1),
pb3 AS (
  SELECT *, CASE WHEN a_base + b_base > 0 THEN (spend_a + spend_b) / (a_base + b_base) ELSE {d(1.0)} END AS ratio FROM pb2
),
pb4 AS (
  SELECT *, sales_base * CASE WHEN sat > 0 THEN ({d(1.0)} - exp(-sat * ratio)) / ({d(1.0)} - exp(-sat)) ELSE {d(1.0)} END AS sales,
         spend_a + spend_b AS spend_total
  FROM pb3
),
pb AS (
  SELECT series_id, scenario_id, step, week_start, {label('week_start')} AS period_label, iso_week,
    spend_a, spend_b, spend_total, sales, sales / {d(188500.0)} AS orders,
    sales / nullif(spend_total, 0) AS mer, coalesce(spend_total / nullif(sales, 0) * {d(100.0)}, 0) AS cos
  FROM pb4
)"""
SQL["project_baseline"] = body(f"""SELECT series_id, scenario_id, step, week_start, period_label, iso_week,
  {', '.join(r6(c, c) for c in ['spend_a', 'spend_b', 'spend_total', 'sales', 'orders', 'mer', 'cos'])}
FROM pb""", PB)

SQL["saturation_curve"] = body(f"""SELECT series_id, scenario_id, {r6('sat', 'saturation')}, i,
  {r6(f'{d(1.0)} + i * {d(3.0 / 19)}', 'x')}, {r6(f'pow({d(1.0)} + i * {d(3.0 / 19)}, sat)', 'y')}
FROM (
  SELECT ss.series_id, sc.scenario_id, coalesce(sc.saturation, ss.saturation) AS sat,
         CAST(unnest(range(0, 20)) AS INTEGER) AS i
  FROM ss CROSS JOIN sc
) t""", SAT + ",\n" + SCEN)

SQL["safe_budget"] = body(f"""SELECT series_id, strategy,
  {', '.join(r6(c, c) for c in ['rec_scale', 'be_roas', 'next_sales', 'safe_budget'])},
  {r6(f'safe_budget * (rec_scale / {d(1.1)})', 'target_budget')},
  {r6('next_sales * rec_scale - safe_budget * rec_scale', 'ebitda')}
FROM (
  SELECT h.series_id, s.strategy, s.rec_scale, s.be_roas, h.next_sales, h.next_sales / s.be_roas AS safe_budget
  FROM (SELECT series_id, {xs('sales')} AS next_sales FROM pb WHERE scenario_id = 'base' AND step <= 4 GROUP BY series_id) h
  JOIN strat s ON s.series_id = h.series_id
) t""", PB + ",\n" + ST.replace(TG + ",\n", "").replace(RK, RK))

_EV = "CASE month(month) WHEN 1 THEN 'Winter sales' WHEN 2 THEN 'Sanremo festival, Valentine''s Day' " \
      "WHEN 4 THEN 'Easter' WHEN 5 THEN 'Mother''s Day' WHEN 7 THEN 'Summer sales' WHEN 11 THEN 'Black Friday' " \
      "WHEN 12 THEN 'Christmas' ELSE 'none' END"
_MACRO = ("CASE WHEN year(month) = 2024 AND month(month) > 9 THEN '0.7% (deflation)' "
          "WHEN year(month) = 2025 THEN '1.0% (stable)' ELSE '1.2%' END")
LEDGER = f"""lg0 AS (SELECT *, max(week_start) OVER (PARTITION BY series_id) AS lw FROM wf),
lg1 AS (
  SELECT series_id, CAST(date_trunc('month', week_start) AS DATE) AS month,
    coalesce({xs('net_sales')}, 0) AS net_sales, coalesce({xs('ad_spend')}, 0) AS ad_spend, min(week_start) AS first_week
  FROM lg0 WHERE week_start > lw - 365 GROUP BY series_id, CAST(date_trunc('month', week_start) AS DATE)
),
lg AS (
  SELECT *, net_sales / nullif(ad_spend, 0) AS mer, {_EV} AS events, {_MACRO} AS macro FROM lg1
)"""
SQL["month_ledger"] = body(f"""SELECT series_id, month, strftime(month, '%Y-%m') AS month_label, first_week,
  {r6('net_sales', 'net_sales')}, {r6('ad_spend', 'ad_spend')}, {r6('mer', 'mer')},
  {r6(d(15.0), 'avg_temp')}, {r6(d(40.0), 'avg_daily_rain_mm')}, events, macro,
  events || ' | Infl. ' || macro AS context
FROM lg""", LEDGER)

SQL["best_worst_month"] = body(f"""SELECT b.series_id, b.month AS best_month, {rnd('b.mer')} AS best_mer,
  w.month AS worst_month, {rnd('w.mer')} AS worst_mer
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mer DESC, month) AS r FROM lg WHERE mer IS NOT NULL) b
JOIN (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mer, month) AS r FROM lg WHERE mer IS NOT NULL) w
  ON w.series_id = b.series_id AND w.r = 1
WHERE b.r = 1""", LEDGER)

ORIG = f"""og0 AS (
  SELECT series_id, week_start, iso_week, net_sales,
    CAST(row_number() OVER (PARTITION BY series_id ORDER BY week_start) - 1 AS INTEGER) AS n_train,
    max(week_start) OVER (PARTITION BY series_id) AS lw
  FROM wf
),
og AS (
  SELECT series_id, week_start AS origin_week, iso_week, net_sales AS actual, n_train
  FROM og0 WHERE week_start > CAST(lw - INTERVAL 12 MONTH AS DATE) AND n_train >= 20
)"""
SQL["origins"] = body(f"SELECT series_id, origin_week, iso_week, {r6('actual', 'actual')}, n_train FROM og", ORIG)

SP = f"""sp0 AS (
  SELECT series_id, week_start, iso_week, net_sales,
    sum(CAST(net_sales AS {DEC})) OVER wp AS p_sum, count(net_sales) OVER wp AS p_cnt,
    sum(CAST(net_sales AS {DEC})) OVER wu AS i_sum, count(net_sales) OVER wu AS i_cnt
  FROM wf
  WINDOW wp AS (PARTITION BY series_id, iso_week ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         wu AS (PARTITION BY series_id, iso_week ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
sp1 AS (SELECT *, CAST({rnd('CAST(i_sum AS DOUBLE) / i_cnt')} AS {DEC}) AS i_mean FROM sp0),
sp2 AS (
  SELECT *, i_mean - coalesce(lag(i_mean) OVER (PARTITION BY series_id, iso_week ORDER BY week_start), 0) AS delta,
         CASE WHEN p_cnt = 0 THEN 1 ELSE 0 END AS is_new
  FROM sp1
),
sp3 AS (
  SELECT *, sum(delta) OVER wr AS s_run, sum(is_new) OVER wr AS c_run
  FROM sp2 WINDOW wr AS (PARTITION BY series_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
sp AS (
  SELECT series_id, week_start,
    CASE WHEN p_cnt > 0 THEN CAST(p_sum AS DOUBLE) / p_cnt
         ELSE CAST(s_run - delta AS DOUBLE) / nullif(CAST(c_run - is_new AS DOUBLE), 0) END AS pred_seasonal
  FROM sp3
)"""
SQL["seasonal_backtest"] = body(f"""SELECT og.series_id, og.origin_week, og.n_train, {r6('og.actual', 'actual')},
  {r6('sp.pred_seasonal', 'pred_seasonal')}, {r6('abs(sp.pred_seasonal - og.actual)', 'err_seasonal')},
  {r6(f'CASE WHEN og.actual > 0 THEN greatest({d(0.0)}, {d(1.0)} - abs(sp.pred_seasonal - og.actual) / og.actual) ELSE {d(0.0)} END', 'acc_seasonal')}
FROM og JOIN sp ON sp.series_id = og.series_id AND sp.week_start = og.origin_week""", ORIG + ",\n" + SP)

SQL["weekly_history"] = body(f"""SELECT series_id, week_start, period_label,
  {', '.join(r6(c, c) for c in ['total_sales', 'spend_a', 'conv_value_a', 'cpc_a', 'impressions_a', 'spend_b', 'conv_value_b', 'cpc_b', 'cpm_b', 'frequency_b', 'cost_of_sales_pct', 'op_profit'])}
FROM wf""")

SQL["channel_history"] = body(f"""SELECT series_id, week_start, period_label, 'a' AS channel, {r6('spend_a', 'spend')},
  {r6('conv_value_a', 'conv_value')}, {r6('roas_a', 'roas')}, {r6('cpc_a', 'cpc')},
  CAST(NULL AS DOUBLE) AS cpm, CAST(NULL AS DOUBLE) AS frequency FROM wf
UNION ALL
SELECT series_id, week_start, period_label, 'b' AS channel, {r6('spend_b', 'spend')},
  {r6('conv_value_b', 'conv_value')}, {r6('roas_b', 'roas')}, {r6('cpc_b', 'cpc')},
  {r6('cpm_b', 'cpm')}, {r6('frequency_b', 'frequency')} FROM wf""")

# -- cleaning probes (raw text derived from the given tables) ---------------
_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _strip(e: str) -> str:
    codes = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
    return f"trim({e}, {' || '.join(f'chr({c})' for c in codes)})"


def _num(s: str) -> str:
    number = f"CASE WHEN regexp_full_match({s}, '{_NUM}') THEN TRY_CAST({s} AS DOUBLE) END"
    return f"coalesce(CASE WHEN isfinite({number}) THEN {number} END, {d(0.0)})"


def _cur_us(raw: str) -> str:
    return _num(f"replace({_strip(f'replace({raw}, chr(8364), {chr(39)}{chr(39)})')}, ',', '')")


def _cur_eu(raw: str) -> str:
    s = _strip(f"replace({raw}, chr(8364), '')")
    return _num(f"replace(replace({s}, '.', ''), ',', '.')")


_ISO = "CAST(isoyear(d) AS VARCHAR) || lpad(CAST(week(d) AS VARCHAR), 2, '0')"
_WEEK_TXT = f"""od AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders),
txt AS (
  SELECT 'iso' AS shape, {_ISO} AS raw FROM od
  UNION ALL SELECT 'calendar', CAST(year(d) AS VARCHAR) || lpad(CAST(CAST(ceil(dayofyear(d) / 7) AS BIGINT) AS VARCHAR), 2, '0') FROM od
  UNION ALL SELECT 'padded', ' ' || {_ISO} || ' ' FROM od
  UNION ALL SELECT 'nbsp', {_ISO} || chr(160) || chr(8201) FROM od
  UNION ALL SELECT 'float', {_ISO} || '.0' FROM od
  UNION ALL SELECT 'short', substr({_ISO}, 1, 5) FROM od
  UNION ALL SELECT 'dashed', CAST(year(d) AS VARCHAR) || '-' || lpad(CAST(week(d) AS VARCHAR), 2, '0') FROM od
  UNION ALL SELECT 'week0', CAST(year(d) AS VARCHAR) || '00' FROM od
),
p0 AS (SELECT shape, raw, count(*) AS n FROM txt GROUP BY shape, raw),
p1 AS (SELECT *, {_strip('raw')} AS s FROM p0),
p2 AS (
  SELECT *, length(s) >= 6 AND regexp_full_match(s, '[0-9]+') AS ok,
         TRY_CAST(substr(s, 1, 4) AS INTEGER) AS y, TRY_CAST(substr(s, 5) AS INTEGER) AS w FROM p1
),
p3 AS (
  SELECT *, CASE WHEN ok AND y >= 1 AND w >= 1 AND w <= 53
                 THEN CAST(CAST(date_trunc('week', make_date(y, 1, 4)) AS DATE) + 7 * (w - 1) AS DATE) END AS cand
  FROM p2
)"""
SQL["parse_iso_week"] = (f"WITH {_WEEK_TXT}\nSELECT shape, raw, n, CASE WHEN cand IS NOT NULL AND week(cand) = w "
                         f"AND isoyear(cand) = y THEN cand END AS week_start FROM p3")

_MONEY_TXT = """li AS (
  SELECT ext, whole, lpad(CAST(CAST((ext - whole) * 100 AS INTEGER) AS VARCHAR), 2, '0') AS cents,
         whole // 1000 AS th, lpad(CAST(whole % 1000 AS VARCHAR), 3, '0') AS rest, CAST(ext AS VARCHAR) AS plain
  FROM (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS ext,
               CAST(floor(CAST(l_extendedprice AS DECIMAL(18,2))) AS BIGINT) AS whole FROM lineitem) x
),
li2 AS (
  SELECT *, CASE WHEN th > 0 THEN CAST(th AS VARCHAR) || ',' || rest ELSE CAST(whole AS VARCHAR) END AS us,
            CASE WHEN th > 0 THEN CAST(th AS VARCHAR) || '.' || rest ELSE CAST(whole AS VARCHAR) END AS eu
  FROM li
),
txt AS (
  SELECT 'euro_us' AS shape, chr(8364) || ' ' || us || '.' || cents AS raw FROM li2
  UNION ALL SELECT 'padded', ' ' || plain || ' ' FROM li2
  UNION ALL SELECT 'signed', '+' || plain FROM li2
  UNION ALL SELECT 'euro_eu', chr(8364) || ' ' || eu || ',' || cents FROM li2
  UNION ALL SELECT 'suffix_d', plain || 'd' FROM li2
  UNION ALL SELECT 'spaced_sign', '- ' || plain FROM li2
  UNION ALL SELECT 'nbsp', chr(8364) || chr(160) || us || '.' || cents || chr(8201) FROM li2
  UNION ALL SELECT 'overflow', plain || 'e999' FROM li2
  UNION ALL SELECT 'percent', plain || '%' FROM li2
)"""


def _tot(e: str) -> str:
    return f"CAST(sum(CAST({e} AS {DEC})) AS DOUBLE)"


SQL["clean_currency"] = f"""WITH {_MONEY_TXT}
SELECT shape, count(*) AS n,
  {rnd(_tot(_cur_us('raw')))} AS total_us,
  {rnd(_tot(_cur_eu('raw')))} AS total_eu,
  {rnd(_tot(_num(_strip("replace(raw, '%', '')"))))} AS total_pct,
  {rnd(_tot(_num(_strip('raw'))))} AS total_num,
  count(CASE WHEN {_cur_us('raw')} = 0 THEN 1 END) AS n_zero
FROM txt GROUP BY shape"""

# -- scoring of a fixed prediction table -----------------------------------------
_MODELS = ("seasonal", "rf", "additive", "ensemble")
_ACC = "CASE WHEN actual > 0 THEN greatest({zero}, {one} - abs({p} - actual) / actual) ELSE {zero} END"
SCORED = f"""lg AS (
  SELECT series_id, week_start AS origin_week, net_sales AS actual, lag(net_sales, 52) OVER w AS pred_seasonal,
         lag(net_sales, 1) OVER w AS pred_rf, lag(net_sales, 4) OVER w AS pred_additive
  FROM wf WINDOW w AS (PARTITION BY series_id ORDER BY week_start)),
lg1 AS (SELECT *, (pred_rf + pred_additive) / {d(2.0)} AS pred_ensemble FROM lg WHERE pred_seasonal IS NOT NULL),
sc0 AS (
  SELECT series_id, origin_week, {r6('actual', 'actual')}, {', '.join(r6(f'pred_{m}', f'pred_{m}') for m in _MODELS)},
    {', '.join(r6(f'abs(pred_{m} - actual)', f'err_{m}') for m in _MODELS)},
    {', '.join(r6(_ACC.format(p=f'pred_{m}', zero=d(0.0), one=d(1.0)), f'acc_{m}') for m in _MODELS)}
  FROM lg1),
scored AS (
  SELECT *, CASE least({', '.join(f'err_{m}' for m in _MODELS)}) {' '.join(f"WHEN err_{m} THEN '{m}'" for m in _MODELS)} END AS winner
  FROM sc0)"""


def _band(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} > {d(0.9)} THEN 'high' WHEN {c} > {d(0.8)} THEN 'medium' ELSE 'low' END"


SQL["scored_weeks"] = body(f"SELECT *, {_band('acc_ensemble')} AS band FROM scored", SCORED)
SQL["scored_summary"] = body("\nUNION ALL ".join(
    f"SELECT series_id, '{m}' AS model, {r6(xa(f'acc_{m}'), 'mean_accuracy')}, {r6(xa(f'err_{m}'), 'mean_abs_error')} FROM scored GROUP BY series_id"
    for m in _MODELS), SCORED)
REL = SCORED + f""",
rel0 AS (SELECT series_id, {xa('acc_ensemble')} AS a, count(*) AS n_origins FROM scored GROUP BY series_id),
rel AS (SELECT series_id, {r6('a', 'avg_accuracy')}, n_origins,
  CASE WHEN a >= {d(0.85)} THEN 'high' WHEN a >= {d(0.70)} THEN 'medium' ELSE 'low' END AS reliability FROM rel0)"""
SQL["scored_reliability"] = body("SELECT * FROM rel", REL)
_MY = f"""my AS (SELECT series_id, CAST(year(origin_week) AS INTEGER) AS year, CAST(month(origin_week) AS INTEGER) AS month_num,
  strftime(origin_week, '%b') AS month, {xa('acc_ensemble')} AS v FROM scored GROUP BY ALL)"""
SQL["scored_month_year"] = body(f"SELECT series_id, year, month_num, month, {r6('v', 'value')}, {_band('v')} AS band FROM my", SCORED + ",\n" + _MY)
SQL["scored_accuracy_matrix"] = body(f"""SELECT series_id, year,
  {', '.join(r6(f'max(CASE WHEN month_num = {k} THEN v END)', f'm{k:02d}') for k in range(1, 13))}
FROM my GROUP BY series_id, year""", SCORED + ",\n" + _MY)
SQL["scored_winner_matrix"] = body(f"""SELECT series_id, year,
  {', '.join(f'max(CASE WHEN month_num = {k} THEN w END) AS m{k:02d}' for k in range(1, 13))}
FROM (SELECT series_id, CAST(year(origin_week) AS INTEGER) AS year, month(origin_week) AS month_num,
             first(winner ORDER BY origin_week) AS w FROM scored GROUP BY ALL) t
GROUP BY series_id, year""", SCORED)
SQL["scored_top_winner"] = body("""SELECT series_id, winner AS top_winner, n AS wins FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, winner) AS rk
  FROM (SELECT series_id, winner, count(*) AS n FROM scored GROUP BY series_id, winner) c) t WHERE rk = 1""", SCORED)
ARMS = f"""ar0 AS (
  SELECT series_id, week_start, spend_a + spend_b AS spend_total, lag(net_sales, 1) OVER w AS l1, lag(net_sales, 4) OVER w AS l4,
         row_number() OVER (PARTITION BY series_id ORDER BY week_start DESC) AS rn
  FROM wf WINDOW w AS (PARTITION BY series_id ORDER BY week_start)),
ar1 AS (
  SELECT ar0.*, s.scenario_id, s.m FROM ar0 CROSS JOIN (
    SELECT 'base' AS scenario_id, {d(1.0)} AS m UNION ALL
    SELECT 'stress', ({d(1.0)} / ({d(1.0)} + {d(20.0)} / {d(100.0)})) * ({d(1.0)} - {d(10.0)} / {d(100.0)})) s
  WHERE rn <= 26),
ens AS (
  SELECT *, {r6(f'(pred_rf + pred_additive) / {d(2.0)}', 'pred_ensemble')} FROM (
    SELECT series_id, scenario_id, week_start, CAST(27 - rn AS INTEGER) AS step, {r6('l1 * m', 'pred_rf')},
           {r6('spend_total', 'spend_total')}, {r6('l4 * m', 'pred_additive')}, {r6(f'l4 * m * {d(0.5)}', 'yhat_lower')},
           {r6(f'l4 * m * {d(1.5)}', 'yhat_upper')} FROM ar1) t)"""
SQL["scored_ensemble"] = body("SELECT * FROM ens", ARMS)
SQL["scored_consensus"] = body(f"""SELECT series_id, scenario_id, {r6('rf', 'rf_total')}, {r6('ad', 'additive_total')}, avg_accuracy,
  {r6(f'(rf + ad) / {d(2.0)}', 'ensemble_total')}, {r6('gap', 'gap')},
  CASE WHEN gap < {d(0.15)} THEN CASE WHEN avg_accuracy < {d(0.70)} THEN 'fragile' ELSE 'high' END
       WHEN gap < {d(0.35)} THEN 'moderate' ELSE 'divergent' END AS consensus,
  CASE WHEN rf > ad THEN 'rf' ELSE 'additive' END AS optimistic_model
FROM (SELECT *, CASE WHEN least(rf, ad) > 0 THEN abs(rf - ad) / least(rf, ad) END AS gap FROM (
  SELECT e.series_id, e.scenario_id, {xs('e.pred_rf')} AS rf, {xs('e.pred_additive')} AS ad, any_value(rel.avg_accuracy) AS avg_accuracy
  FROM ens e LEFT JOIN rel ON rel.series_id = e.series_id GROUP BY e.series_id, e.scenario_id) t) u""", ARMS + ",\n" + REL)
_SB = f"""sb AS (
  SELECT h.series_id, s.rec_scale, h.next_sales / s.be_roas AS safe_budget
  FROM (SELECT series_id, {xs('sales')} AS next_sales FROM pb WHERE scenario_id = 'base' AND step <= 4 GROUP BY series_id) h
  JOIN strat s ON s.series_id = h.series_id),
al AS (
  SELECT sb.*, cs.best_channel AS roas_channel, cs.best_channel = 'a' AS agree FROM sb JOIN cs ON cs.series_id = sb.series_id)"""
SQL["scored_allocation"] = body(f"""SELECT series_id, {r6('safe_budget', 'safe_budget')}, {r6('rec_scale', 'rec_scale')}, roas_channel,
  'a' AS engine_channel, CASE WHEN agree THEN {d(0.65)} ELSE {d(0.55)} END AS split_best, 'a' AS best_channel,
  {r6(f'safe_budget * rec_scale * CASE WHEN agree THEN {d(0.65)} ELSE {d(0.55)} END', 'budget_best')},
  {r6(f'safe_budget * rec_scale - safe_budget * rec_scale * CASE WHEN agree THEN {d(0.65)} ELSE {d(0.55)} END', 'budget_other')}
FROM al""", PB + ",\n" + ST.replace(TG + ",\n", "") + ",\n" + CS + ",\n" + _SB)

_DRIVERS = ("aov", "returning_rate_pct", "discounts", "cpc_a", "cpc_b", "cpm_b", "sessions", "frequency_b")
_FEATURES = ("week_sin", "week_cos", "spend_a", "spend_b", "lag_1", "lag_4", *_DRIVERS)
SQL["rf_features"] = body(f"""SELECT f.series_id, f.week_start,
  {', '.join(r6(f'coalesce(f.{c}, m.{c}, {d(0.0)})', c) for c in _FEATURES)}
FROM f JOIN (SELECT series_id, {', '.join(f'median({c}) AS {c}' for c in _FEATURES)} FROM f GROUP BY series_id) m
  ON m.series_id = f.series_id""", f"""f AS (
  SELECT *, lag(net_sales, 1) OVER w AS lag_1, lag(net_sales, 4) OVER w AS lag_4,
         sin({TWO_PI} * iso_week / {d(53.0)}) AS week_sin, cos({TWO_PI} * iso_week / {d(53.0)}) AS week_cos
  FROM wf WINDOW w AS (PARTITION BY series_id ORDER BY week_start))""")
SQL["driver_means"] = body(f"""SELECT series_id, {', '.join(r6(xa(c), c) for c in _DRIVERS)}
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week_start DESC) AS rn FROM wf) t WHERE rn <= 4 GROUP BY series_id""")
_STRESS = f"({d(1.0)} / ({d(1.0)} + cpm / {d(100.0)})) * ({d(1.0)} - cr / {d(100.0)})"
SQL["stressed_sales"] = body(f"""SELECT series_id, iso_year, scenario_id, {r6(_STRESS, 'stress')}, {r6(f'ns * ({_STRESS})', 'stressed_sales')}
FROM (SELECT series_id, iso_year, coalesce({xs('net_sales')}, 0) AS ns FROM wf GROUP BY series_id, iso_year) t
CROSS JOIN (SELECT scenario_id, CAST(cpm AS DOUBLE) AS cpm, CAST(cr AS DOUBLE) AS cr
  FROM (VALUES ('base', 0, 0), ('prudent', 0, 0), ('aggressive', 0, 0), ('stress', 20, 10), ('auto', 0, 0)) v(scenario_id, cpm, cr)) s""")

# -- economics of each series ------------------------------------------------------
SERIES_ECON = f"""ec0 AS (
  SELECT series_id, {r6(f"coalesce({xs('total_sales')} / nullif({xs('orders')}, 0), 0)", 'aov')}, {d(22.0)} AS vat_pct,
         {r6(f"coalesce({xs('abs(returns)')} * {d(50.0)} / nullif({xs('total_sales')}, 0), 0)", 'return_pct')}, {d(45.0)} AS margin_pct,
         {d(6500.0)} AS fulfilment, {r6(xa('returning_rate_pct'), 'returning_pct')}, {d(1.0)} AS repeat_rate
  FROM wf GROUP BY series_id),
ec1 AS (SELECT *, aov * ({d(1.0)} - return_pct / {d(100.0)}) / ({d(1.0)} + vat_pct / {d(100.0)}) AS net_aov FROM ec0),
ec2 AS (SELECT *, net_aov * (margin_pct / {d(100.0)}) - fulfilment AS profit_per_order FROM ec1),
ec3 AS (SELECT *, profit_per_order + profit_per_order * (returning_pct / {d(100.0)}) * repeat_rate AS profit_per_customer FROM ec2),
ec AS (SELECT *, profit_per_customer AS be_cpa,
  CASE WHEN profit_per_customer > 0 THEN aov / profit_per_customer ELSE {d(99.9)} END AS be_roas FROM ec3)"""
_ECON_COLS = ("aov", "vat_pct", "return_pct", "margin_pct", "fulfilment", "returning_pct", "repeat_rate", "net_aov",
              "profit_per_order", "profit_per_customer", "be_cpa", "be_roas")
SQL["series_break_even"] = body(f"SELECT series_id, {', '.join(r6(c, c) for c in _ECON_COLS)} FROM ec", SERIES_ECON)
SQL["series_health_score"] = SQL["health_score"].replace(
    f"SELECT *, {BE} AS be_roas, row_number()", "SELECT mf.*, ec.be_roas, row_number()").replace(
    "OVER (PARTITION BY series_id ORDER BY month DESC) AS rn FROM mf", "OVER (PARTITION BY mf.series_id ORDER BY month DESC) AS rn "
    "FROM mf JOIN ec ON ec.series_id = mf.series_id").replace("mf0 AS (", SERIES_ECON + ",\nmf0 AS (")

# -- the weekly text file ------------------------------------------------------------
SQL["weekly_text"] = SQL["weekly_fact"]
_FALLBACK = f"(greatest(total_sales, {d(0.0)}) / {d(188500.0)})"
SQL["weekly_csv"] = SQL["weekly_fact_incremental"] = SQL["weekly_fact"]
SQL["weekly_csv_rejects"] = body("""SELECT series_id AS first_field, series_id || ',half a line' AS line FROM (SELECT DISTINCT series_id FROM wf) s
UNION ALL SELECT series_id, series_id || repeat(',x', 39) FROM (SELECT DISTINCT series_id FROM wf) s""")
SQL["weekly_sessions"] = f"WITH {sessions_ctes()}\nSELECT series_id, week_start, sessions, users, events, {r6('minutes', 'minutes')} FROM se"
SQL["lag_features_customer"] = body(f"""SELECT series_id, week_start, {r6('net_sales', 'net_sales')}, {r6('l1', 'lag_1')}, {r6('l4', 'lag_4')}
FROM (SELECT *, lag(net_sales, 1) OVER w AS l1, lag(net_sales, 4) OVER w AS l4 FROM wf
      WINDOW w AS (PARTITION BY series_id ORDER BY week_start)) t""", grain="customer")
SQL["weekly_text_no_orders"] = body(f"""SELECT series_id, week_start, {r6(_FALLBACK, 'orders')}, {r6('net_sales', 'net_sales')},
  {r6('ad_spend', 'ad_spend')}, {r6('mer', 'mer')},
  {r6(f"{_FALLBACK} * {_E['profit_per_order']} - ad_spend", 'op_profit')}, CAST(NULL AS DOUBLE) AS aov FROM wf""")
SQL["first_week_of_year"] = body(f"""SELECT series_id, iso_year, min(week_start) AS week_start,
  {r6('first(net_sales ORDER BY week_start)', 'net_sales')} FROM wf GROUP BY series_id, iso_year""")

# -- weather ---------------------------------------------------------------------------
WEATHER = f"""we0 AS (
  SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS city, CAST(n_nationkey AS BIGINT) AS k, dt.date,
         CAST(dt.date - DATE '1970-01-01' AS BIGINT) AS day
  FROM nation CROSS JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) dt),
we AS (
  SELECT city, date, CASE WHEN (k + day) % 19 <> 0 THEN CAST((37 * k + 13 * day) % 430 - 60 AS DOUBLE) / {d(10.0)} END AS temp,
         CASE WHEN (k + 2 * day) % 23 <> 0 THEN CAST((11 * k + 7 * day) % 90 AS DOUBLE) / {d(10.0)} END AS rain FROM we0),
hot AS (SELECT date, city FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY temp DESC, city) AS r FROM we WHERE temp IS NOT NULL) t
  WHERE r = 1),
wd AS (
  SELECT w.date, {xa('temp')} AS avg_temp, max(rain) AS max_rain, {xs('rain')} AS total_rain, any_value(hot.city) AS hottest_city,
         count(temp) AS n_cities
  FROM we w LEFT JOIN hot ON hot.date = w.date GROUP BY w.date),
wm AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, {xa('temp')} AS avg_temp, {xa('rain')} AS avg_daily_rain_mm FROM we GROUP BY 1)"""
SQL["weather_cities"] = f"""WITH {WEATHER}
SELECT city, CASE WHEN temp < 5 THEN 'freezing' WHEN temp < 12 THEN 'cold' WHEN temp < 20 THEN 'mild' WHEN temp < 28 THEN 'warm'
  WHEN temp >= 28 THEN 'hot' END AS band, count(*) AS days,
  {r6(xa(f'({d(6000.0)} + coalesce(rain, 0) * {d(400.0)})'), 'mean_marker_size')}, min(date) AS first_day, max(date) AS last_day
FROM we GROUP BY 1, 2"""
_WD = ", ".join(r6(c, c) for c in ("avg_temp", "max_rain", "total_rain"))
SQL["weather_days"] = f"WITH {WEATHER}\nSELECT date, {_WD}, hottest_city, n_cities FROM wd"
SQL["weather_months"] = f"WITH {WEATHER}\nSELECT month, {r6('avg_temp', 'avg_temp')}, {r6('avg_daily_rain_mm', 'avg_daily_rain_mm')} FROM wm"
SQL["business_on_day"] = body(f"""SELECT wf.week_start, series_id, {r6('net_sales', 'net_sales')}, {r6('ad_spend', 'ad_spend')}, {_WD}, hottest_city,
  n_cities, {r6(f'CASE WHEN ad_spend > 0 THEN net_sales / ad_spend ELSE {d(0.0)} END', 'mer')}
FROM wf JOIN wd ON wd.date = wf.week_start""", WEATHER)
SQL["month_ledger_weather"] = body(f"""SELECT series_id, lg.month, strftime(lg.month, '%Y-%m') AS month_label, first_week,
  {r6('net_sales', 'net_sales')}, {r6('ad_spend', 'ad_spend')}, {r6('mer', 'mer')},
  {r6(f'coalesce(avg_temp, {d(15.0)})', 'avg_temp')}, {r6(f'coalesce(avg_daily_rain_mm, {d(40.0)})', 'avg_daily_rain_mm')}, events, macro,
  events || ' | Infl. ' || macro AS context
FROM lg LEFT JOIN wm ON wm.month = lg.month AND month(lg.month) % 4 <> 0""", LEDGER.replace("month(month)", "month(lg1.month)") + ",\n" + WEATHER)

# -- validation and timeline of fixed predictions -----------------------------------------
_VAL = f"""va0 AS (
  SELECT *, lag(net_sales, 1) OVER w AS pred_rf, lag(net_sales, 4) OVER w AS pred_additive
  FROM wf WINDOW w AS (PARTITION BY series_id ORDER BY week_start)),
va1 AS (
  SELECT series_id, week_start, CASE WHEN iso_week % 10 = 0 THEN net_sales * {d(1.5)} ELSE net_sales END AS actual,
    CASE WHEN iso_week % 10 = 0 THEN spend_a * {d(0.5)} ELSE spend_a END AS spend_a, spend_b, cpc_a, pred_rf, pred_additive,
    (pred_rf + pred_additive) / {d(2.0)} AS pred_ensemble FROM va0 WHERE pred_additive IS NOT NULL),
va2 AS (
  SELECT *, CASE WHEN actual > 0 THEN ({d(1.0)} - abs(pred_ensemble - actual) / actual) * {d(100.0)} END AS accuracy_pct FROM va1),
va3 AS (SELECT series_id, {xa('spend_a')} AS m_a, {xa('actual')} AS m_y, {xa('cpc_a')} AS m_c FROM va1 GROUP BY series_id),
va4 AS (
  SELECT va2.*, m_a / nullif(m_y, 0) AS share, m_c, CASE WHEN accuracy_pct > 92 THEN 'excellent' WHEN accuracy_pct > 85 THEN 'good'
    WHEN accuracy_pct IS NOT NULL THEN 'deviation' END AS tier
  FROM va2 JOIN va3 ON va3.series_id = va2.series_id)"""
SQL["scored_validation"] = body(f"""SELECT series_id, week_start,
  {', '.join(r6(c, c) for c in ('actual', 'spend_a', 'spend_b', 'cpc_a', 'pred_rf', 'pred_additive', 'pred_ensemble', 'accuracy_pct'))}, tier,
  tier = 'deviation' AND spend_a / nullif(actual, 0) < share * {d(0.8)} AS flag_low_spend_share,
  tier = 'deviation' AND cpc_a > m_c * {d(1.3)} AS flag_cpc, tier = 'deviation' AS flag_unseen_factors FROM va4""", _VAL)
_LABEL = f"""CASE WHEN value >= 1000000 THEN printf('€ %.1fM', value / {d(1e6)}) ELSE printf('€ %.0fk', value / {d(1e3)}) END"""
_TL = """tl AS (
  SELECT series_id, week_start, 'actual' AS measure, net_sales AS value FROM wf
  UNION ALL SELECT series_id, week_start, 'heuristic', sales FROM pb WHERE scenario_id = 'base'
  UNION ALL SELECT series_id, week_start, 'rf', pred_rf FROM ens WHERE scenario_id = 'base'
  UNION ALL SELECT series_id, week_start, 'additive_yhat', pred_additive FROM ens WHERE scenario_id = 'base'
  UNION ALL SELECT series_id, week_start, 'additive_yhat_lower', yhat_lower FROM ens WHERE scenario_id = 'base'
  UNION ALL SELECT series_id, week_start, 'additive_yhat_upper', yhat_upper FROM ens WHERE scenario_id = 'base')"""
SQL["scored_timeline"] = body(f"SELECT *, {_LABEL} AS label FROM (SELECT series_id, week_start, measure, {r6('value', 'value')} FROM tl) t",
                              PB + ",\n" + ARMS + ",\n" + _TL)
