"""Reference SQL (DuckDB dialect) for every registered query.

Each statement recomputes the weekly fact from the raw tables with the same
arithmetic contract as the Spark plans: decimals until totals are final, one
double conversion, explicit DOUBLE literals (DuckDB reads ``0.6`` as a
DECIMAL), ``nullif`` on every divisor, and :func:`rnd` (Spark's half-up
rounding of the shortest decimal form) on every double output column.
"""

from __future__ import annotations

from ..functions.economics import TABLE_ECONOMICS, Economics
from ..sources.tables import DISCOUNT_FACTOR, RETURNING_PRIORITY, SEGMENT_K


def d(x: float) -> str:
    """DOUBLE literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def rnd(expr: str, scale: int = 6) -> str:
    """Round half-up on the shortest decimal form of a double (Spark's
    ``round`` semantics); DuckDB's own ``round`` works on the binary value."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {scale}) AS DOUBLE)"


def econ_sql(e: Economics = TABLE_ECONOMICS) -> dict[str, str]:
    """Break-even expressions with the same operation order as P10."""
    net_aov = f"({d(e.aov)} * ({d(1.0)} - {d(e.return_pct)} / {d(100.0)}) / ({d(1.0)} + {d(e.vat_pct)} / {d(100.0)}))"
    ppo = f"({net_aov} * ({d(e.margin_pct)} / {d(100.0)}) - {d(e.fulfilment)})"
    ppc = f"({ppo} + {ppo} * ({d(e.returning_pct)} / {d(100.0)}) * {d(e.repeat_rate)})"
    be_roas = f"(CASE WHEN {ppc} > 0 THEN {d(e.aov)} / {ppc} ELSE {d(99.9)} END)"
    return {"net_aov": net_aov, "profit_per_order": ppo, "profit_per_customer": ppc,
            "be_cpa": ppc, "be_roas": be_roas}


def sessions_ctes(grain: str = "segment") -> str:
    """CTEs ``se_ev, se_no, se_one, se``: sessions by the event before, event by event."""
    series, nation_join = _series_expr(grain)
    return f"""
se_ev AS (
  SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_id
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
),
se_no AS (
  SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM se_ev
),
se_one AS (SELECT user_id, no, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM se_no GROUP BY user_id, no),
se AS (
  SELECT {series} AS series_id, CAST(date_trunc('week', t0) AS DATE) AS week_start, count(*) AS sessions,
    count(DISTINCT user_id) AS users, CAST(sum(n) AS BIGINT) AS events,
    CAST(sum(epoch_us(t1) - epoch_us(t0)) AS DOUBLE) / count(*) / {d(60e6)} AS minutes
  FROM se_one JOIN customer c ON c.c_custkey = user_id {nation_join}
  GROUP BY ALL
)"""


def _series_expr(grain: str) -> tuple[str, str]:
    if grain == "all":
        return "'ALL'", ""
    if grain == "customer":
        return "CAST(c.c_custkey AS VARCHAR)", ""
    if grain == "segment":
        return "c.c_mktsegment", ""
    return "n.n_name", "JOIN nation n ON n.n_nationkey = c.c_nationkey"


def weekly_fact_ctes(grain: str = "segment", econ: Economics = TABLE_ECONOMICS) -> str:
    """CTEs ``wf_lines, wf_week, wf_raw, wf`` - ``wf`` is the prepared fact."""
    series, nation_join = _series_expr(grain)
    k_case = "CASE c.c_mktsegment " + " ".join(
        f"WHEN '{s}' THEN {k}" for s, k in SEGMENT_K.items()) + " END"
    ppo = econ_sql(econ)["profit_per_order"]
    money = "DECIMAL(18,2)"
    return f"""
wf_lines AS (
  SELECT {series} AS series_id,
         CAST(date_trunc('week', CAST(o.o_orderdate AS DATE)) AS DATE) AS week_start,
         l.l_orderkey AS orderkey, o.o_custkey AS custkey,
         o.o_orderpriority = '{RETURNING_PRIORITY}' AS urgent,
         {k_case} AS k,
         CAST(l.l_extendedprice AS {money}) AS ext,
         CAST({DISCOUNT_FACTOR} AS DECIMAL(2,1)) * CAST(l.l_extendedprice AS {money})
           * CAST(l.l_discount AS DECIMAL(9,6)) AS disc,
         CAST(l.l_tax AS DECIMAL(9,6)) AS tax,
         l.l_quantity AS qty, l.l_returnflag AS rf, l.l_linestatus AS ls
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  {nation_join}
),
wf_week AS (
  SELECT series_id, week_start,
    CAST(CAST(sum(ext) AS {money}) AS DOUBLE) AS gross_sales,
    CAST(CAST(sum(ext - disc) AS {money}) AS DOUBLE) AS total_sales,
    CAST(CAST(-sum(disc) AS {money}) AS DOUBLE) AS discounts,
    CAST(CAST(-sum(CASE WHEN rf = 'R' THEN ext - disc END) AS {money}) AS DOUBLE) AS returns,
    CAST(count(DISTINCT orderkey) AS DOUBLE) AS orders,
    sum(qty) AS items,
    CAST(CAST(sum(CASE WHEN ls = 'O' THEN k * ext * tax END) AS {money}) AS DOUBLE) AS spend_a,
    CAST(CAST(sum(CASE WHEN ls = 'F' THEN k * ext * tax END) AS {money}) AS DOUBLE) AS spend_b,
    CAST(CAST(sum(CASE WHEN ls = 'O' THEN ext - disc END) AS {money}) AS DOUBLE) AS conv_value_a,
    CAST(CAST(sum(CASE WHEN ls = 'F' THEN ext - disc END) AS {money}) AS DOUBLE) AS conv_value_b,
    count(CASE WHEN ls = 'O' THEN 1 END) AS lines_a,
    count(CASE WHEN ls = 'F' THEN 1 END) AS lines_b,
    sum(CASE WHEN ls = 'O' THEN qty END) AS impressions_a,
    sum(CASE WHEN ls = 'F' THEN qty END) AS qty_b,
    count(DISTINCT CASE WHEN ls = 'F' THEN custkey END) AS cust_b,
    count(DISTINCT CASE WHEN urgent THEN orderkey END) AS n_urgent
  FROM wf_lines GROUP BY series_id, week_start
),
{sessions_ctes(grain)},
wf_raw AS (
  SELECT series_id, week_start,
    CAST(isoyear(week_start) AS INTEGER) AS iso_year,
    CAST(week(week_start) AS INTEGER) AS iso_week,
    strftime(week_start, '%d %b') || ' - ' || strftime(CAST(week_start + INTERVAL 6 DAY AS DATE), '%d %b %Y') AS period_label,
    coalesce(spend_a, 0) AS spend_a, coalesce(spend_b, 0) AS spend_b,
    coalesce(total_sales, 0) AS total_sales, coalesce(gross_sales, 0) AS gross_sales,
    coalesce(discounts, 0) AS discounts, coalesce(returns, 0) AS returns,
    coalesce(orders, 0) AS orders, coalesce(CAST(items AS DOUBLE), 0) AS items,
    coalesce({rnd("total_sales / nullif(orders, 0)")}, 0) AS aov,
    coalesce({rnd(f"CAST(n_urgent AS DOUBLE) * {d(100.0)} / nullif(orders, 0)")}, 0) AS returning_rate_pct,
    coalesce(conv_value_a, 0) AS conv_value_a, coalesce(conv_value_b, 0) AS conv_value_b,
    coalesce({rnd("spend_a / nullif(CAST(lines_a AS DOUBLE), 0)")}, 0) AS cpc_a,
    coalesce({rnd("spend_b / nullif(CAST(lines_b AS DOUBLE), 0)")}, 0) AS cpc_b,
    coalesce({rnd(f"spend_b * {d(1000.0)} / nullif(qty_b, 0)")}, 0) AS cpm_b,
    coalesce(CAST(impressions_a AS DOUBLE), 0) AS impressions_a,
    coalesce({rnd(f"CAST(lines_b AS DOUBLE) * {d(0.6)} / nullif(CAST(cust_b AS DOUBLE), 0)")}, 0) AS frequency_b,
    coalesce(CAST(se.sessions AS DOUBLE), 0) AS sessions
  FROM wf_week LEFT JOIN se USING (series_id, week_start)
),
wf AS (
  SELECT *,
    greatest(total_sales, {d(0.0)}) AS net_sales,
    nullif(spend_a + spend_b, {d(0.0)}) AS ad_spend,
    {rnd(f"coalesce(total_sales / nullif(spend_a + spend_b, {d(0.0)}), 0)")} AS mer,
    {rnd(f"coalesce(abs(returns) / nullif(total_sales, 0) * {d(100.0)}, 0)")} AS return_rate_pct,
    {rnd(f"coalesce(nullif(spend_a + spend_b, {d(0.0)}) / nullif(greatest(total_sales, {d(0.0)}), 0) * {d(100.0)}, 0)")} AS cost_of_sales_pct,
    {rnd(f"orders * {ppo} - nullif(spend_a + spend_b, {d(0.0)})")} AS op_profit,
    {rnd("conv_value_a / nullif(spend_a, 0)")} AS roas_a,
    {rnd("conv_value_b / nullif(spend_b, 0)")} AS roas_b
  FROM wf_raw
)"""


def with_wf(body: str, grain: str = "segment", extra_ctes: str = "") -> str:
    ctes = weekly_fact_ctes(grain)
    if extra_ctes:
        ctes = ctes + ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"
