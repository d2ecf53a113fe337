"""Everything that looks back in time.

Most features of this engine are "state of a key strictly before this row".
The plain way is a window partitioned by the key, and it breaks as soon as one
key (a team, a season, NULL venues) owns a large share of the rows, since one
task then has to sort and walk all of them.  Here the walk has two levels:

1. ``placed`` puts all rows in one total order and cuts that order into slots of
   about equal size, whatever the keys or dates look like;
2. ``state_before`` runs the window inside (key, slot), reduces each (key, slot)
   to one small summary, walks the summaries of a key, and adds the state that
   each slot starts with.

So a task never holds more of one key than one slot does, and the walk over
summaries has at most one row per slot and key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

ROWS_PER_SLOT = 250_000
LEAST_ROWS_PER_SLOT = 5_000  # layout only: results do not depend on the number of slots
_POSITION_BITS = 33  # monotonically_increasing_id: partition above, row in partition below


def by_date(date: str = "date", match_id: str = "match_id") -> list[Column]:
    """The match order: date with unknown dates last, then match id as text."""
    return [F.col(date).asc_nulls_last(), F.col(match_id).cast("string").asc()]


def placed(df: DataFrame, order: Sequence[Column], slots: int | None = None,
           rows: int | None = None, label: str = "timeline") -> DataFrame:
    """Add ``seq`` (increasing along ``order``) and ``slot`` (a contiguous run of it).

    One range shuffle.  The result is written, because a position must not
    change when a lost task is run again.  The number of slots grows with the
    table, so their size does not; ``rows`` may give the size (or a bound of it)
    where counting ``df`` would be dear, ``slots`` the number itself.
    """
    if slots is None:
        slots = _slots_for(df.count() if rows is None else rows, df.sparkSession.sparkContext.defaultParallelism)
    ordered = df.repartitionByRange(slots, *order).sortWithinPartitions(*order)
    return with_slot(written(ordered.withColumn("seq", F.monotonically_increasing_id()), label))


def _slots_for(rows: int, cores: int) -> int:
    """Slots of at most about ROWS_PER_SLOT rows; a small table still feeds the cores."""
    return max(1, math.ceil(rows / ROWS_PER_SLOT), min(cores, rows // LEAST_ROWS_PER_SLOT))


def with_slot(df: DataFrame) -> DataFrame:
    return df.withColumn("slot", F.shiftright("seq", _POSITION_BITS).cast("int"))


@dataclass(frozen=True)
class Tail:
    """The last ``n`` values of a column, oldest first; rows where it is NULL do not count."""

    value: Column
    n: int


def state_before(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column] | None = None,
    tails: dict[str, Tail] | None = None,
    order: Sequence[str] = ("seq",),
    slot: str = "slot",
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """State of each key strictly before each row.

    Adds one column per entry: for ``sums`` the sum so far (0 at the start), for
    ``tails`` an array of at most n values.  ``totals`` names columns for the
    sum over the whole key, later rows included: new column -> name in ``sums``.
    ``order`` must be total within a key, ``slot`` must be non-decreasing along
    it, and keys must not be NULL.
    """
    keys, sums, tails, totals = list(keys), sums or {}, tails or {}, totals or {}
    values = df.select(
        "*",
        *[F.coalesce(c, F.lit(0)).alias(f"_s_{name}") for name, c in sums.items()],
        *[t.value.alias(f"_t_{name}") for name, t in tails.items()],
    )
    here = Window.partitionBy(*keys, slot).orderBy(*order)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    # Of a tail, rows that count lie in a window of their own, where the last n are a frame; what they hold is carried to all
    # rows behind them.  The rows are dealt by (key, slot) first: every window lies on it, so they are sorted anew but do not move.
    if tails:
        values = values.repartition(*keys, slot)
    for name, t in tails.items():
        counts = Window.partitionBy(*keys, slot, F.col(f"_t_{name}").isNotNull()).orderBy(*order).rowsBetween(1 - t.n, 0)
        values = values.withColumn(f"_e_{name}", F.when(F.col(f"_t_{name}").isNotNull(), F.collect_list(f"_t_{name}").over(counts)))

    local = values.select(
        "*",
        *[F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_ls_{name}") for name in sums],
        *[F.coalesce(F.last(f"_e_{name}", ignorenulls=True).over(earlier), F.array()).alias(f"_lt_{name}") for name in tails],
    )
    # One summary per (key, slot): the sums, and what the tails are after its last row.
    # Both come from the windowed rows, which lie on (key, slot) already.
    summaries = local.groupBy(*keys, slot).agg(
        *[F.sum(f"_s_{name}").alias(f"_s_{name}") for name in sums],
        *[F.max_by(f"_e_{name}", F.when(F.col(f"_e_{name}").isNotNull(), F.struct(*order))).alias(f"_t_{name}") for name in tails],
    )

    # The walk over a key's slots.  An empty slot has no array, and offsets skip it.
    walk = f"OVER (PARTITION BY {_names(keys)} ORDER BY {_names([slot])}"
    starts = summaries.select(
        *keys, slot, *[f"_s_{name}" for name in sums],
        *[F.when(F.size(f"_t_{name}") > 0, F.col(f"_t_{name}")).alias(f"_t_{name}") for name in tails],
    ).selectExpr(
        *[_names([k]) for k in (*keys, slot)],
        *[
            f"coalesce(sum(_s_{name}) {walk} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _cs_{name}"
            for name in sums
        ],
        *[f"sum(_s_{name}) OVER (PARTITION BY {_names(keys)}) AS _all_{new}" for new, name in totals.items()],
        *[f"{_earlier_arrays(f'_t_{name}', t.n, walk + ')')} AS _ct_{name}" for name, t in tails.items()],
    )

    # The rows lie on (keys, slot) already, so only the summaries move.
    return local.join(starts, [*keys, slot]).select(
        *df.columns,
        *[(F.col(f"_ls_{name}") + F.col(f"_cs_{name}")).alias(name) for name in sums],
        *[
            _last(F.concat(f"_ct_{name}", f"_lt_{name}"), t.n).alias(name)
            for name, t in tails.items()
        ],
        *[F.col(f"_all_{new}").alias(new) for new in totals],
    )


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def _earlier_arrays(c: str, n: int, over: str) -> str:
    """The last n arrays before the row, oldest first, as one array."""
    return f"flatten(array_compact(array({_lags(c, n, over)})))"


def _lags(c: str, n: int, over: str) -> str:
    return ", ".join(f"lag({c}, {i}) IGNORE NULLS {over}" for i in range(n, 0, -1))


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - (n - 1), F.lit(1)), F.lit(n))
