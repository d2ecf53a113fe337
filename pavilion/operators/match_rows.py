"""Columns that follow from a match row alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import flag, is_home, safe_div, season_year
from ..functions.fixed_values import HOME_CITIES, TWELVE_PLAYER_ERA_FROM


def with_toss_flags(matches: DataFrame) -> DataFrame:
    won_by = F.col("toss_winner")
    bat, field = F.col("toss_decision") == "bat", F.col("toss_decision") == "field"
    return matches.withColumns({
        "toss_winner_is_team1": flag(won_by == F.col("team1")),
        "toss_bat_first": flag(bat),
        "toss_winner_batted": flag(
            (bat & (won_by == F.col("innings1_team"))) | (field & (won_by == F.col("innings2_team")))
        ),
    })


def with_result(matches: DataFrame) -> DataFrame:
    """Run rates over the scheduled overs, margin, target, winner flag and method."""
    overs = F.coalesce(F.col("overs"), F.lit(20))
    return matches.withColumns({
        "run_rate_inn1": safe_div("innings1_runs", overs),
        "run_rate_inn2": safe_div("innings2_runs", overs),
        "score_diff": F.col("innings1_runs") - F.col("innings2_runs"),
        "target": F.col("innings1_runs") + 1,
        # A tie or no result names neither team, so it stays NULL.
        "team1_won": F.when(F.col("winner") == F.col("team1"), 1)
        .when(F.col("winner") == F.col("team2"), 0),
        "win_method": F.when(F.col("win_by_runs").isNotNull(), "runs")
        .when(F.col("win_by_wickets").isNotNull(), "wickets").otherwise("other"),
    })


def with_setting(matches: DataFrame, homes: Mapping[str, Sequence[str]] = HOME_CITIES) -> DataFrame:
    """Home flags, season year and era flag."""
    return matches.withColumns({
        "is_home_team1": is_home("team1", "city", homes),
        "is_home_team2": is_home("team2", "city", homes),
        "season_year": season_year("season"),
    }).withColumn("is_impact_player_era", flag(F.col("season_year") >= TWELVE_PLAYER_ERA_FROM))
