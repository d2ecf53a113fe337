"""One pass over the balls for all reports.

``ball_cube`` adds the balls up by several sets of keys at once: a row of the result belongs to one set (column ``by``), holds that
set's keys, and carries every measure.  Partial sums are taken before anything moves, so what is shuffled is bounded by the keys of
each set and partition, not by the balls; the largest sets have a row per match.  Written once, the cube answers each
report from a few of its rows: ``parts_of`` gives a report the aggregate it would otherwise take from the balls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clip, phase_name, right_closed_band
from ..functions.fixed_values import REPORT_PHASES, SCORING_ZONES

#: The sets of keys, by name.
SETS = {
    "batter": ["batter"],
    "bowler": ["bowler", "over"],
    "over": ["innings", "over", "wickets_before"],
    "kind": ["wicket_kind"],
    "zone": ["over", "zone"],
    "match": ["match_id"],
    "side": ["match_id", "bowling_team"],
}
KEYS = ["batter", "bowler", "innings", "over", "wickets_before", "wicket_kind", "zone", "match_id", "bowling_team"]
DEATH_FROM = 17


def wickets_before() -> Column:
    """Wickets lost before the ball, 0..9."""
    return clip(F.col("cumulative_wickets") - F.col("is_wicket"), 0, 9).cast("int")


def measures(death_from: int = DEATH_FROM) -> list[Column]:
    legal = F.col("wides") == 0
    bat, runs = F.col("batter_runs"), F.col("total_runs")
    first = F.col("innings") == 1
    powerplay = first & (F.col("in_powerplay") == 1)
    known = F.coalesce(runs, F.lit(0))
    return [
        F.sum(runs).alias("runs"), F.count(runs).alias("balls"), F.sum("is_wicket").alias("wickets"),
        F.count_if(F.col("is_wicket") == 1).alias("fallen"),
        F.count_if(legal).alias("legal"), F.sum(F.when(legal, bat)).alias("bat_runs"), F.count(F.when(legal, bat)).alias("bat_balls"),
        F.count_if(legal & (bat == 4)).alias("fours"), F.count_if(legal & (bat == 6)).alias("sixes"),
        F.sum("wides").alias("wides"), F.sum("noballs").alias("noballs"),
        F.count_if(first).alias("first_balls"), F.count_if(powerplay).alias("pp_balls"),
        F.sum(F.when(powerplay, known)).alias("pp_runs"), F.sum(F.when(first & (F.col("over") >= death_from), known)).alias("death_runs"),
    ]


def ball_cube(deliveries: DataFrame, zones=SCORING_ZONES, death_from: int = DEATH_FROM) -> DataFrame:
    """``by``, the keys, and the measures; a key that is NULL in the balls is a group of its own set."""
    rows = deliveries.withColumns({"wickets_before": wickets_before(), "zone": right_closed_band("batter_runs", zones)}).select(
        *KEYS, "total_runs", "batter_runs", "is_wicket", "wides", "noballs", "in_powerplay", "cumulative_wickets")
    # Which set a row belongs to follows from the keys that are left out of it.
    level = {sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys): name for name, keys in SETS.items()}
    by = F
    for bits, name in level.items():
        by = by.when(F.col("_set") == bits, name)
    out = rows.groupingSets([[F.col(k) for k in keys] for keys in SETS.values()], *[F.col(k) for k in KEYS]).agg(F.grouping_id().alias("_set"), *measures(death_from))
    return out.select(by.alias("by"), *[c for c in out.columns if c != "_set"])


def parts_of(cube: DataFrame, phases=REPORT_PHASES, zones=SCORING_ZONES) -> dict[str, DataFrame]:
    """What each report of ``operators.reports`` takes as ``parts``."""
    of = lambda name: cube.where(F.col("by") == name)
    overs = of("over").where(F.col("innings").isin(1, 2)).groupBy("innings", "over").agg(
        F.sum("runs").alias("runs"), F.sum("balls").alias("balls"), F.sum("fallen").alias("wickets"))
    matches = of("match").agg(F.count("match_id").alias("matches"))
    phased = of("bowler").where("bowler IS NOT NULL").groupBy("bowler", phase_name("over", phases).alias("phase")).agg(
        F.sum("runs").alias("runs"), F.sum("balls").alias("balls"))
    shares = of("zone").where("zone IS NOT NULL AND legal > 0").groupBy(phase_name("over", phases).alias("phase")).agg(
        *[F.sum(F.when(F.col("zone") == z[0], F.col("legal")).otherwise(0)).alias(z[0]) for z in zones], F.sum("legal").alias("balls"))
    first = of("match").where("first_balls > 0")
    return {
        "top_batters": of("batter").where("batter IS NOT NULL AND legal > 0").select("batter", F.col("bat_runs").alias("runs"), F.col("bat_balls").alias("balls"), "fours", "sixes"),
        "top_bowlers": of("bowler").where("bowler IS NOT NULL").groupBy("bowler").agg(*[F.sum(c).alias(c) for c in ("wickets", "balls", "runs")]),
        "runs_by_over": overs, "wickets_by_over": overs, "score_acceleration": overs, "matches": matches,
        "dismissal_mix": of("kind").where("wicket_kind IS NOT NULL AND fallen > 0").select("wicket_kind", F.col("fallen").alias("wickets")),
        "powerplay_points": of("match").where("pp_balls > 0").select("match_id", F.coalesce("pp_runs", F.lit(0)).alias("pp_runs")),
        "correlation_input": first.select("match_id", F.col("pp_runs").alias("pp_runs_inn1"), F.col("death_runs").alias("death_runs_inn1")),
        "pressure_grid": of("over").where("innings = 1").select("wickets_before", "over", "runs", "balls"),
        "economy_by_phase": phased,
        "extras_leakage": of("side").where("match_id IS NOT NULL AND bowling_team IS NOT NULL").select(
            "match_id", "bowling_team", (F.coalesce("wides", F.lit(0)) + F.coalesce("noballs", F.lit(0))).alias("extras")),
        "scoring_zones": shares,
    }
