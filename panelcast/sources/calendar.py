"""Literal dimensions: S4 event calendar, the weather city list and the
national holiday calendar used by the additive model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commercial / cultural events by month, in calendar order.
# Events match on month only.
EVENTS = (
    (1, "Winter sales"), (2, "Sanremo festival"), (2, "Valentine's Day"), (4, "Easter"), (5, "Mother's Day"),
    (7, "Summer sales"), (11, "Black Friday"), (12, "Christmas"),
)

# Weather cities in payload order.
CITIES = (
    "Milano", "Torino", "Venezia", "Bologna", "Genova", "Firenze", "Ancona", "Perugia", "Roma", "Pescara", "Napoli",
    "Bari", "Potenza", "Catanzaro", "Palermo", "Catania", "Cagliari", "Sassari", "Trento", "Trieste",
)

# National public holidays on fixed dates (month, day, name);
# Easter Sunday and Monday are computed per year.
FIXED_HOLIDAYS = (
    (1, 1, "New Year"), (1, 6, "Epiphany"), (4, 25, "Liberation Day"), (5, 1, "Labour Day"),
    (6, 2, "Republic Day"), (8, 15, "Assumption"), (11, 1, "All Saints"),
    (12, 8, "Immaculate Conception"), (12, 25, "Christmas Day"), (12, 26, "St Stephen"),
)


def city_rank_map():
    kv = []
    for i, name in enumerate(CITIES):
        kv += [F.lit(name), F.lit(i)]
    return F.create_map(*kv)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter Sunday of a year (anonymous Gregorian computus), as a Column."""
    div = lambda x, n: F.floor(x / F.lit(n)).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    ell = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    month_day = h + ell - 7 * div(a + 11 * h + 22 * ell, 451) + 114
    return F.make_date(year, div(month_day, 31), month_day % 31 + 1)


def holidays(year: Column) -> dict[str, Column]:
    """Date of each named holiday in a year."""
    fixed = {name: F.make_date(year, F.lit(month), F.lit(day)) for month, day, name in FIXED_HOLIDAYS}
    easter = easter_sunday(year)
    return {**fixed, "Easter Sunday": easter, "Easter Monday": F.date_add(easter, 1)}


HOLIDAYS = tuple(name for _, _, name in FIXED_HOLIDAYS) + ("Easter Sunday", "Easter Monday")
HOLIDAY_COLS = tuple("holiday_" + name.lower().replace(" ", "_") for name in HOLIDAYS)


def holidays_in_week(week_start: Column) -> dict[str, Column]:
    """For each named holiday, 1.0 if it falls in the seven days from ``week_start``, else 0.0."""
    last = F.date_add(week_start, 6)
    first_year, last_year = holidays(F.year(week_start)), holidays(F.year(last))
    return {c: F.when(first_year[n].between(week_start, last) | last_year[n].between(week_start, last), 1.0).otherwise(0.0)
            for c, n in zip(HOLIDAY_COLS, HOLIDAYS)}
