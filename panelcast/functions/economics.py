"""Unit economics (P10), stress multiplier (P11) and the parameter records.

Economics and scenarios are small configuration records.  They reach the
plan as literal columns or as a literal array that is exploded, so applying
them never needs a join, let alone a cross join.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Economics:
    """Per-shop unit economics (F-3).  Percentages are 0..100."""

    aov: float = 145.0
    vat_pct: float = 22.0
    return_pct: float = 13.0
    margin_pct: float = 45.0
    fulfilment: float = 5.0
    returning_pct: float = 13.0
    repeat_rate: float = 1.0


# Economics used with the given tables (order values there are
# about 1,300 times a typical shop, so both euro amounts are scaled by 1,300;
# the break-even ROAS stays 3.09).
TABLE_ECONOMICS = Economics(aov=188500.0, fulfilment=6500.0)


@dataclass(frozen=True)
class Scenario:
    """Planning scenario (F-4).  ``saturation=None`` means: use the series'
    suggested saturation (the 'auto' preset)."""

    scenario_id: str
    trend: float = 0.0
    scale_a: float = 1.0
    scale_b: float = 1.0
    saturation: float | None = 0.85
    months: int = 6
    cpm_stress_pct: float = 0.0
    cr_stress_pct: float = 0.0


# Scenario presets (D3 / F-4).
PRESETS = (
    Scenario("base", 0.0, 1.0, 1.0, 0.85, 6, 0.0, 0.0),
    Scenario("prudent", 0.0, 1.0, 1.0, 0.80, 6, 0.0, 0.0),
    Scenario("aggressive", 0.15, 1.5, 1.5, 0.90, 6, 0.0, 0.0),
    Scenario("stress", 0.0, 1.0, 1.0, 0.85, 6, 20.0, 10.0),
)
AUTO = Scenario("auto", 0.0, 1.0, 1.0, None, 6, 0.0, 0.0)


def break_even_columns(aov: Column, vat_pct: Column, return_pct: Column, margin_pct: Column,
                       fulfilment: Column, returning_pct: Column, repeat_rate: Column) -> dict[str, Column]:
    """P10: net AOV, profit per order / customer, break-even CPA and ROAS."""
    net_aov = aov * (F.lit(1.0) - return_pct / 100.0) / (F.lit(1.0) + vat_pct / 100.0)
    ppo = net_aov * (margin_pct / 100.0) - fulfilment
    ppc = ppo + ppo * (returning_pct / 100.0) * repeat_rate
    be_roas = F.when(ppc > 0, aov / ppc).otherwise(F.lit(99.9))
    return {
        "net_aov": net_aov,
        "profit_per_order": ppo,
        "profit_per_customer": ppc,
        "be_cpa": ppc,
        "be_roas": be_roas,
    }


def economics_columns(econ: Economics) -> dict[str, Column]:
    """Literal columns for ``econ`` plus its derived break-even values."""
    lits = {f.name: F.lit(float(getattr(econ, f.name))) for f in fields(econ)}
    derived = break_even_columns(lits["aov"], lits["vat_pct"], lits["return_pct"], lits["margin_pct"],
                                 lits["fulfilment"], lits["returning_pct"], lits["repeat_rate"])
    return {**lits, **derived}


def with_economics(df, econ=TABLE_ECONOMICS, keep: tuple[str, ...] | None = None):
    """Attach economics and their break-even values: the same literals for every
    series, or, if ``econ`` is a table keyed by ``series_id``, each series' own."""
    if not isinstance(econ, Economics):
        out = join_economics(df, econ)
        added = [*(f.name for f in fields(Economics)), *economics_columns(TABLE_ECONOMICS)]
        return out if keep is None else out.drop(*[c for c in added if c not in keep])
    cols = economics_columns(econ)
    return df.withColumns({k: v for k, v in cols.items() if keep is None or k in keep})


def join_economics(df, econ_df, default: Economics = TABLE_ECONOMICS):
    """Attach a per-series economics table (keyed by ``series_id``).

    Series missing from the table fall back to ``default``.  The table has one
    row per series, so the equi-join is left to the planner (broadcast when
    AQE sees it is small, sort-merge otherwise).
    """
    names = [f.name for f in fields(Economics)]
    e = econ_df.select("series_id", *[F.col(n).alias(f"__e_{n}") for n in names])
    out = df.join(e, "series_id", "left")
    base = {n: F.coalesce(F.col(f"__e_{n}"), F.lit(float(getattr(default, n)))) for n in names}
    out = out.withColumns(base).drop(*[f"__e_{n}" for n in names])
    derived = break_even_columns(*[F.col(n) for n in names])
    return out.withColumns(derived)


def stress_multiplier(cpm_stress_pct: Column, cr_stress_pct: Column) -> Column:
    """1/(1+cpm%) * (1-cr%)."""
    return (F.lit(1.0) / (F.lit(1.0) + cpm_stress_pct / 100.0)) * (F.lit(1.0) - cr_stress_pct / 100.0)


def scenario_struct_array(scenarios) -> Column:
    """Literal array of scenario structs; exploding it applies every scenario
    to every row without a join."""
    structs = []
    for s in scenarios:
        structs.append(F.struct(
            F.lit(s.scenario_id).alias("scenario_id"),
            F.lit(float(s.trend)).alias("trend"),
            F.lit(float(s.scale_a)).alias("scale_a"),
            F.lit(float(s.scale_b)).alias("scale_b"),
            F.lit(None if s.saturation is None else float(s.saturation)).cast("double").alias("saturation"),
            F.lit(int(s.months)).alias("months"),
            F.lit(float(s.cpm_stress_pct)).alias("cpm_stress_pct"),
            F.lit(float(s.cr_stress_pct)).alias("cr_stress_pct"),
        ))
    return F.array(*structs)
