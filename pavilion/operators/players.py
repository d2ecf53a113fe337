"""Batting and bowling rows per player, career averages, team strength."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import flag, safe_div
from ..session import written
from .timeline import state_before


def batting_features(deliveries: DataFrame) -> DataFrame:
    """One row per (match, innings, team, batter) over the balls faced.

    A batter out without facing a legal ball has no row.
    """
    keys = ["match_id", "innings", "batting_team", "batter"]
    runs = F.col("batter_runs")
    faced = deliveries.filter(F.col("wides") == 0).dropna(subset=keys).groupBy(*keys).agg(
        F.coalesce(F.sum(runs), F.lit(0)).alias("runs"),
        F.count(runs).alias("balls_faced"),
        F.count_if(runs == 4).alias("fours"),
        F.count_if(runs == 6).alias("sixes"),
        F.count_if(runs == 0).alias("dot_balls"),
    )
    out = (
        deliveries.filter(F.col("is_wicket") == 1)
        .select("match_id", "innings", F.col("player_out").alias("batter"))
        .dropna().distinct().withColumn("out", F.lit(1))
    )
    return faced.join(out, ["match_id", "innings", "batter"], "left").select(
        *keys, "runs", "balls_faced", "fours", "sixes", "dot_balls",
        safe_div(F.col("runs") * 100, "balls_faced").alias("strike_rate"),
        safe_div((F.col("fours") + F.col("sixes")) * 100, "balls_faced").alias("boundary_pct"),
        F.coalesce("out", F.lit(0)).alias("dismissed"),
    )


def bowling_features(deliveries: DataFrame) -> DataFrame:
    """One row per (match, innings, team, bowler); every ball and every wicket counts."""
    keys = ["match_id", "innings", "bowling_team", "bowler"]
    runs, total = F.col("batter_runs"), F.col("total_runs")
    spell = deliveries.dropna(subset=keys).groupBy(*keys).agg(
        F.coalesce(F.sum(total), F.lit(0)).alias("runs_conceded"),
        F.count(total).alias("balls_bowled"),
        F.coalesce(F.sum("is_wicket"), F.lit(0)).alias("wickets"),
        F.coalesce(F.sum("wides"), F.lit(0)).alias("wides"),
        F.coalesce(F.sum("noballs"), F.lit(0)).alias("no_balls"),
        F.count_if(total == 0).alias("dot_balls"),
        F.count_if(runs == 4).alias("fours_conceded"),
        F.count_if(runs == 6).alias("sixes_conceded"),
    )
    return spell.select(
        "*",
        (F.col("balls_bowled") / 6).alias("overs_bowled"),
        safe_div(F.col("runs_conceded") * 6, "balls_bowled").alias("economy"),
        safe_div("runs_conceded", "wickets", fill=None).alias("bowling_avg"),
        safe_div(F.col("dot_balls") * 100, "balls_bowled").alias("dot_ball_pct"),
    )


def career_before(rows: DataFrame, placed: DataFrame, player: str, team: str,
                  metrics: dict[str, str]) -> DataFrame:
    """Mean of a player's earlier rows, for each row; ``metrics``: new column -> source column.

    A player without earlier values gets the mean of the whole column.  That
    mean is taken over all matches, later ones included.
    """
    dated = rows.join(placed.select("match_id", "seq", "slot"), "match_id").select(
        "match_id", "seq", "slot", "innings", F.col(team).alias("team"), F.col(player).alias("player"),
        *[F.col(source).cast("double").alias(f"_{name}") for name, source in metrics.items()],
    )
    # Read three times below; written, the players meet their matches only once.
    dated = written(dated, "career")
    sums = {}
    for name in metrics:
        sums[f"sum_{name}"] = F.col(f"_{name}")
        sums[f"n_{name}"] = flag(F.col(f"_{name}").isNotNull())
    past = state_before(
        dated.filter(F.col("player").isNotNull()), ["player"], sums=sums, order=["seq", "innings", "team"]
    )
    overall = dated.agg(*[F.avg(f"_{name}").alias(f"mean_{name}") for name in metrics])
    return past.crossJoin(F.broadcast(overall)).select(  # one row
        "match_id", "innings", "team", "player",
        *[
            F.coalesce(safe_div(f"sum_{name}", f"n_{name}", fill=None), F.col(f"mean_{name}")).alias(name)
            for name in metrics
        ],
    )


BATTING_CAREER = {"pre_match_sr": "strike_rate", "pre_match_avg": "runs"}
BOWLING_CAREER = {"pre_match_econ": "economy", "pre_match_bowl_wkts": "wickets"}


def team_strength(batting: DataFrame, bowling: DataFrame, placed: DataFrame) -> DataFrame:
    """Means of the pre-match player values per (match, team).

    Batters and bowlers are averaged and written one after the other, so that
    the disk never holds the shuffled rows of both.
    """
    careers = [(batting, "batter", "batting_team", BATTING_CAREER, _BATTING_STRENGTH),
               (bowling, "bowler", "bowling_team", BOWLING_CAREER, _BOWLING_STRENGTH)]
    means = None
    for rows, player, team, metrics, names in careers:
        players = career_before(rows, placed, player, team, metrics).filter(F.col("team").isNotNull())
        part = written(players.groupBy("match_id", "team").agg(*[F.avg(c).alias(name) for name, c in names.items()]), "strength")
        means = part if means is None else means.unionByName(part, allowMissingColumns=True)
    # A match and team has one row of either kind, so there is one value to take.
    return means.groupBy("match_id", "team").agg(*[F.max(c).alias(c) for c in STRENGTH])


_BATTING_STRENGTH = {"team_batting_sr": "pre_match_sr", "team_batting_avg": "pre_match_avg"}
_BOWLING_STRENGTH = {"team_bowling_econ": "pre_match_econ", "team_bowling_wkts": "pre_match_bowl_wkts"}
STRENGTH = [*_BATTING_STRENGTH, *_BOWLING_STRENGTH]


def with_strength(matches: DataFrame, strength: DataFrame, sides: dict[str, dict[str, str]]) -> DataFrame:
    """Attach team strength to named sides of a match.

    ``sides``: team column -> {strength column: new column}.  Strength rows are
    first gathered per match (one entry per team that played), so any number of
    sides costs one join.
    """
    entry = F.struct(F.col("team"), F.struct(*STRENGTH))
    per_match = strength.groupBy("match_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_strength")
    )
    joined = matches.join(per_match, "match_id", "left")
    return joined.select(*matches.columns, *[
        F.col("_strength")[F.col(side)][source].alias(name)
        for side, names in sides.items() for source, name in names.items()
    ])
