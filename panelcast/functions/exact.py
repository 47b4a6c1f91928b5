"""Deterministic arithmetic helpers.

Double sums depend on the order rows arrive in, which changes with the
partitioning.  Every aggregate in the library therefore sums an exact
``decimal`` and converts to double once; ratios are then one IEEE operation
on those doubles.  Results are identical for any partitioning, any cluster
size and any engine that follows the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale used when a double measure is summed exactly.
SUM_TYPE = "decimal(28,6)"
MONEY_TYPE = "decimal(18,2)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def xsum(c) -> Column:
    """Exact sum of a double measure, returned as double (NULL if no value)."""
    return F.sum(_c(c).cast(SUM_TYPE)).cast("double")


def xsum_cells(name: str) -> Column:
    """:func:`xsum` for a column with very many values, of the same result.

    A value that a whole number of millionths below 10^15 stands for has that number as its decimal form
    (no two decimals of 15 digits are one double).  Those are added as longs, in two parts that do not
    overflow; any other value is added as the decimal it is.
    """
    v = f"`{name}`"
    plain = f"abs(rint({v} * 1e6)) < 1e15 AND rint({v} * 1e6) / 1e6 = {v}"
    part = lambda x: F.coalesce(F.expr(f"sum({x}) FILTER (WHERE {plain})"), F.lit(0)).cast("decimal(20,0)")
    # what both parts share may be worked out before the filter, so it holds for any value
    whole = f"cast(CASE WHEN {plain} THEN rint({v} * 1e6) ELSE 0e0 END AS bigint)"
    high, low = part(f"shiftright({whole}, 25)"), part(f"{whole} & {(1 << 25) - 1}L")
    rest = F.expr(f"sum(cast({v} AS {SUM_TYPE})) FILTER (WHERE NOT ({plain}))")
    total = (high * F.lit(1 << 25).cast("decimal(8,0)") + low) * F.lit("0.000001").cast("decimal(6,6)")
    return F.when(F.count(F.col(name)) > 0, (total + F.coalesce(rest, F.lit(0).cast(SUM_TYPE))).cast("double"))


def xavg(c) -> Column:
    """Mean of non-NULL values from the exact sum."""
    return F.try_divide(xsum(c), F.count(_c(c)))


def sdiv(a, b) -> Column:
    """``a / b`` with NULL for a zero or NULL divisor (ANSI-safe)."""
    return F.try_divide(_c(a), _c(b))


def r6(c) -> Column:
    return F.round(_c(c), 6)


def round_doubles(df, scale: int = 6):
    """Round every double column of ``df`` to ``scale`` decimals, keep order."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            out.append(F.round(F.col(f.name), scale).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
