"""Column expressions for cleaning raw weekly files and calendar maths.

All functions return Spark ``Column`` expressions (JVM side, codegen'd); none
is a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of a plain number accepted by the cleaners (sign, digits, one dot,
# optional exponent).  Anything else - '1.0d', '1_000', '- 5', '1.200.50' -
# is treated as unparseable and becomes 0.
NUMBER_PATTERN = r"^[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters removed at both ends of a cell (Python's whitespace).
STRIP_CHARS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def _strip(c: Column) -> Column:
    """Without white space at both ends.

    Trimming any kinds of white space counts every character, so it is done only where a cell,
    without spaces, still begins or ends with one of them.
    """
    t = F.trim(c)
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    # as products, not conjunctions, both tests are always evaluated: generated code then works the text out once
    visible = lambda x: (x >= "!").cast("int") * (x <= "~").cast("int")
    blank = lambda x: F.lit(STRIP_CHARS).contains(x)
    return (F.when(visible(first) * visible(last) == 1, t).when(~blank(first) & ~blank(last), t)
            .otherwise(F.trim(t, F.lit(STRIP_CHARS))))


def _to_number(s: Column) -> Column:
    """The text as a double, 0 where it is none.  Only numbers are cast, as a cast that fails throws
    and catches an exception per cell; only what ends as a number does is matched."""
    last = F.substring(s, -1, 1)
    ends = (F.length(s) > 0).cast("int") * (last >= ".").cast("int") * (last <= "9").cast("int")
    v = F.coalesce(F.when((ends == 1) & s.rlike(NUMBER_PATTERN), s.try_cast("double")), F.lit(0.0))
    # a number too large for a double is unparseable, not infinite: infinite less itself is not a number
    return F.nanvl(v + (v - v), F.lit(0.0))


def clean_currency(c, decimal: str = ".") -> Column:
    """Money text -> double; euro sign and thousands separators removed.

    ``decimal='.'`` (default) drops every comma; ``decimal=','`` reads
    ``1.200,50`` as 1200.5.  Missing or unparseable -> 0.
    """
    s = _strip(F.replace(_c(c).cast("string"), F.lit("€"), F.lit("")))
    if decimal == ",":
        s = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    else:
        s = F.replace(s, F.lit(","), F.lit(""))
    return _to_number(s)


def clean_percentage(c) -> Column:
    """P2: '15%' -> 15.0; '0.15' stays 0.15; unparseable or NULL -> 0."""
    s = _strip(F.replace(_c(c).cast("string"), F.lit("%"), F.lit("")))
    return _to_number(s)


def clean_number(c) -> Column:
    """Numeric text -> double, unparseable or NULL -> 0."""
    return _to_number(_strip(_c(c).cast("string")))


def iso_week_monday(year: Column, week: Column) -> Column:
    """Monday of ISO (year, week) without validation."""
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(F.date_trunc("week", jan4).cast("date"), (week - 1) * 7)


def parse_iso_week(c) -> Column:
    """P4: 'YYYYWW' -> Monday of that ISO week; invalid -> NULL.

    Text shorter than six characters, non-digits, week 0 or a week 53 the
    year does not have all give NULL.
    """
    s = _strip(_c(c).cast("string"))
    ok_shape = (F.length(s) >= 6) & s.rlike(r"^[0-9]+$")
    y = F.substring(s, 1, 4).try_cast("int")
    w = F.substr(s, F.lit(5)).try_cast("int")
    cand = iso_week_monday(y, w)
    valid = (ok_shape & (y >= 1) & (w >= 1) & (w <= 53))
    d = F.when(valid, cand)
    return F.when(
        valid & (F.weekofyear(d) == w) & (F.extract(F.lit("YEAROFWEEK"), d) == y), d
    ).cast("date")


def iso_year(d) -> Column:
    """ISO week-numbering year."""
    return F.extract(F.lit("YEAROFWEEK"), _c(d)).cast("int")


def iso_week(d) -> Column:
    """ISO week number 1..53."""
    return F.weekofyear(_c(d)).cast("int")


def week_range_label(d) -> Column:
    """P6: 'dd Mon - dd Mon YYYY' for the week starting at ``d``; NULL -> ''."""
    d = _c(d)
    return F.coalesce(
        F.concat(F.date_format(d, "dd MMM"), F.lit(" - "),
                 F.date_format(F.date_add(d, 6), "dd MMM yyyy")),
        F.lit(""))


def week_sin(w) -> Column:
    """sin(2*pi*week/53)."""
    return F.sin(F.lit(2 * math.pi) * _c(w) / F.lit(53.0))


def week_cos(w) -> Column:
    """cos(2*pi*week/53)."""
    return F.cos(F.lit(2 * math.pi) * _c(w) / F.lit(53.0))


def weather_band(temp) -> Column:
    """Temperature band; thresholds 5 / 12 / 20 / 28 degrees."""
    t = _c(temp)
    return (F.when(t.isNull(), F.lit(None).cast("string"))
            .when(t < 5, "freezing").when(t < 12, "cold").when(t < 20, "mild")
            .when(t < 28, "warm").otherwise("hot"))


def weather_marker_size(rain) -> Column:
    """6000 + 400 * rain (map marker size)."""
    return F.lit(6000.0) + F.coalesce(_c(rain), F.lit(0.0)) * 400.0


def compact_money(c) -> Column:
    """P14: '€ x.xM' from one million up, else '€ xk'."""
    v = _c(c)
    return F.when(v >= 1e6, F.format_string("€ %.1fM", v / 1e6)).otherwise(
        F.format_string("€ %.0fk", v / 1e3))
