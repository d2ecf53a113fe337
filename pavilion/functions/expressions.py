"""Small column expressions shared by the operators.

All are built-in expressions: no Python runs per row.  A projection with a higher-order function (``mean_of``) is
planned outside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import HOME_CITIES, REPORT_PHASES, TEAM_RENAMES, VENUE_RENAMES


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or cannot be decided."""
    return F.when(condition, 1).otherwise(0)


def whole(text: Column) -> Column:
    """A whole number carried as text, "20.0" included; anything else is NULL."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number), number).try_cast("int")


def safe_div(a: Column | str, b: Column | str, fill: float | None = 0.0) -> Column:
    """a / b, or ``fill`` where b is zero.  NULL stays NULL."""
    a, b = _c(a).cast("double"), _c(b)
    return F.when(b == 0, F.lit(fill).cast("double")).otherwise(a / F.nullif(b, F.lit(0)))


def round_even(c: Column | str, digits: int) -> Column:
    """Round half to even at ``digits`` decimals."""
    scale = float(10**digits)
    return F.rint(_c(c).cast("double") * scale) / scale


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(c: Column | str, table: Mapping[str, str]) -> Column:
    """Translate through a fixed table; names not listed pass through unchanged."""
    c = _c(c)
    pairs = ", ".join(f"{_text(k)}, {_text(v)}" for k, v in table.items())
    return F.coalesce(F.expr(f"map({pairs})")[c], c)


def canonical_team(c: Column | str) -> Column:
    return lookup(c, TEAM_RENAMES)


def canonical_venue(c: Column | str) -> Column:
    return lookup(c, VENUE_RENAMES)


def is_home(team: Column | str, city: Column | str,
            homes: Mapping[str, Sequence[str]] = HOME_CITIES) -> Column:
    """1 when ``city`` is a home city of ``team``; unknown team or NULL city gives 0."""
    pairs = ", ".join(
        f"{_text(name)}, array({', '.join(map(_text, cities))})" for name, cities in homes.items()
    )
    return flag(F.array_contains(F.expr(f"map({pairs})")[_c(team)], _c(city)))


def season_year(season: Column | str) -> Column:
    """First four-digit run of the season label, as a number."""
    year = F.regexp_extract(_c(season), r"(\d{4})", 1)
    return F.when(year != "", year.cast("int"))


def phase_name(over: Column | str, phases=REPORT_PHASES) -> Column:
    """Phase of an over: the first phase whose last over is not exceeded."""
    over = _c(over)
    *head, last = phases
    out = F
    for name, _, until in head:
        out = out.when(over <= until, name)
    return F.when(over.isNotNull(), out.otherwise(last[0]))


def left_closed_band(x: Column | str, bands) -> Column:
    """Label of the band with low <= x < high, NULL outside every band."""
    x, out = _c(x), F
    for name, low, high in bands:
        out = out.when((x >= low) & (x < high), name)
    return out


def right_closed_band(x: Column | str, bands) -> Column:
    """Label of the band with low < x <= high, NULL outside every band."""
    x, out = _c(x), F
    for name, low, high in bands:
        out = out.when((x > low) & (x <= high), name)
    return out


def clip(x: Column | str, low: int, high: int) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def decade(x: Column | str) -> Column:
    """Start of the ten-run bucket a total falls in."""
    return (F.floor(_c(x) / 10) * 10).cast("int")


def mean_of(items: Column, default: float) -> Column:
    """Mean of a short array of numbers, ``default`` when it is empty or NULL."""
    total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(F.lit(default))


def first_seen(c: Column) -> Column:
    """First element of an array, NULL when there is none."""
    return F.get(c, F.lit(0))
