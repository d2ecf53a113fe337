"""Per-innings and per-ball results of the delivery table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import flag
from ..functions.fixed_values import FEATURE_PHASES
from .timeline import state_before


def running_totals(deliveries: DataFrame, wickets: str = "is_wicket",
                   order: Sequence[str] = ("over", "ball"), slot: str | None = None) -> DataFrame:
    """Cumulative runs, wickets and legal balls in an innings, this ball included.

    For delivery tables that come without them (the document reader already
    has them).  The rules of the game bound an innings to some hundred balls, so
    this is one window over it; balls without match or innings are left out.
    Where the key may be no real innings, place the deliveries
    (``timeline.placed``) and pass ``order=["seq"], slot="slot"``.
    """
    legal = flag((F.col("wides") == 0) & (F.col("noballs") == 0))
    balls = deliveries.drop("cumulative_runs", "cumulative_wickets", "legal_balls")
    if slot is None:
        so_far = Window.partitionBy("match_id", "innings").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        total = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
        return balls.where("match_id IS NOT NULL AND innings IS NOT NULL").select(
            "*", total("total_runs").alias("cumulative_runs"), total(wickets).alias("cumulative_wickets"),
            total(legal).alias("legal_balls"))
    before = state_before(
        balls,
        ["match_id", "innings"],
        sums={"_runs": F.col("total_runs"), "_wickets": F.col(wickets), "_legal": legal},
        order=order, slot=slot,
    )
    return before.select(
        "*",
        (F.col("_runs") + F.col("total_runs")).alias("cumulative_runs"),
        (F.col("_wickets") + F.col(wickets)).alias("cumulative_wickets"),
        (F.col("_legal") + legal).alias("legal_balls"),
    ).drop("_runs", "_wickets", "_legal")


def innings_scores(deliveries: DataFrame) -> DataFrame:
    """Runs and wickets of innings 1 and 2 side by side, one row per match."""
    of = lambda i, c: F.sum(F.when(F.col("innings") == i, F.col(c)))
    return deliveries.groupBy("match_id").agg(*[
        of(i, c).alias(f"innings{i}_{name}")
        for i in (1, 2) for name, c in (("runs", "total_runs"), ("wickets", "is_wicket"))
    ])


def phase_totals(deliveries: DataFrame, phases: dict[str, tuple[int, int]] = FEATURE_PHASES) -> DataFrame:
    """Runs and wickets by phase plus boundary counts, for innings 1 and 2 of every match.

    One conditional aggregation over one scan, with map-side combine.  A phase
    or an innings without any ball gives NULL, not 0.
    """
    over = F.col("over")
    parts: dict[str, Column] = {"pp": F.col("in_powerplay") == 1}
    parts.update({name: over.between(lo, hi) for name, (lo, hi) in phases.items()})
    out = []
    for i in (1, 2):
        here = F.col("innings") == i
        for name, part in parts.items():
            out.append(_total(here & part, "total_runs").alias(f"{name}_runs_inn{i}"))
            out.append(_total(here & part, "is_wicket").alias(f"{name}_wickets_inn{i}"))
        for name, runs in (("fours", 4), ("sixes", 6), ("dot_balls", 0)):
            n = F.count_if(here & (F.col("batter_runs") == runs))
            out.append(F.when(F.count_if(here) > 0, n).alias(f"{name}_inn{i}"))
    return deliveries.groupBy("match_id").agg(*out)


def _total(condition: Column, c: str) -> Column:
    return F.sum(F.when(condition, F.coalesce(F.col(c), F.lit(0))))
