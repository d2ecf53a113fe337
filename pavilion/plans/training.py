"""Training tables of the two models, the hold-out split, and fold numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import HOLD_OUT_FROM
from ..operators.players import team_strength, with_strength
from ..operators.timeline import by_date, placed, state_before

# Model inputs.
WINNER_CATEGORICAL = ["team1", "team2"]
WINNER_NUMERIC = [
    "toss_winner_is_team1", "toss_bat_first",
    "h2h_team1_win_rate", "h2h_matches",
    "team1_venue_win_rate", "team2_venue_win_rate",
    "team1_recent_form", "team2_recent_form",
    "team1_batting_sr", "team2_batting_sr", "team1_batting_avg", "team2_batting_avg",
    "team1_bowling_econ", "team2_bowling_econ", "team1_bowling_wkts", "team2_bowling_wkts",
    "team1_win_after_batting_first", "team2_win_after_batting_first",
    "team1_avg_pp_runs", "team2_avg_pp_runs", "team1_avg_death_wkts", "team2_avg_death_wkts",
    "is_home_team1", "is_home_team2", "season_progress",
    "form_diff", "batting_sr_diff", "batting_avg_diff", "bowling_econ_diff", "bowling_wkts_diff",
    "venue_wr_diff", "pp_runs_diff", "death_wkts_diff",
    "is_impact_player_era",
]
SCORE_CATEGORICAL = ["innings1_team", "innings2_team", "venue"]
SCORE_NUMERIC = [
    "bat_team_sr", "bat_team_avg", "bowl_team_econ", "bowl_team_wkts",
    "team1_avg_pp_runs", "team2_avg_pp_runs", "team1_avg_death_wkts", "team2_avg_death_wkts",
    "team1_win_after_batting_first", "team2_win_after_batting_first",
    "toss_bat_first", "is_home_team1", "is_home_team2", "season_progress", "is_impact_player_era",
]

_SIDE = {
    "team_batting_sr": "{}_batting_sr", "team_batting_avg": "{}_batting_avg",
    "team_bowling_econ": "{}_bowling_econ", "team_bowling_wkts": "{}_bowling_wkts",
}
WINNER_SIDES = {t: {k: v.format(t) for k, v in _SIDE.items()} for t in ("team1", "team2")}
SCORE_SIDES = {
    "innings1_team": {
        "team_batting_sr": "bat_team_sr", "team_batting_avg": "bat_team_avg",
        "team_bowling_econ": "bat_team_bowl_econ", "team_bowling_wkts": "bat_team_bowl_wkts",
    },
    "innings2_team": {
        "team_batting_sr": "bowl_team_bat_sr", "team_batting_avg": "bowl_team_bat_avg",
        "team_bowling_econ": "bowl_team_econ", "team_bowling_wkts": "bowl_team_wkts",
    },
}
KEYS = ["match_id", "date", "seq", "slot"]


def with_differences(df: DataFrame) -> DataFrame:
    """Advantage of team1 over team2; for economy the lower value is the better one."""
    gap = lambda c: F.col(f"team1_{c}") - F.col(f"team2_{c}")
    return df.withColumns({
        "form_diff": gap("recent_form"),
        "batting_sr_diff": gap("batting_sr"),
        "batting_avg_diff": gap("batting_avg"),
        "bowling_econ_diff": -gap("bowling_econ"),
        "bowling_wkts_diff": gap("bowling_wkts"),
        "venue_wr_diff": gap("venue_win_rate"),
        "pp_runs_diff": gap("avg_pp_runs"),
        "death_wkts_diff": gap("avg_death_wkts"),
    })


def _in_order(features: DataFrame) -> DataFrame:
    return features if "seq" in features.columns else placed(features, by_date(), label="training")


def winner_table(features: DataFrame, batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """One row per decided match: keys, ``label`` and the model inputs."""
    decided = _in_order(features).filter(F.col("team1_won").isNotNull())
    strong = with_strength(decided, team_strength(batting, bowling, decided), WINNER_SIDES)
    return with_differences(strong).select(
        *KEYS, F.col("team1_won").cast("double").alias("label"), *WINNER_CATEGORICAL, *WINNER_NUMERIC
    )


def score_table(features: DataFrame, batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """One row per match with a first innings: keys, ``label`` and the model inputs.

    The four strength values that no input list names are kept at the end.
    """
    scored = _in_order(features).filter(F.col("innings1_runs").isNotNull())
    strong = with_strength(scored, team_strength(batting, bowling, scored), SCORE_SIDES)
    spare = ["bat_team_bowl_econ", "bat_team_bowl_wkts", "bowl_team_bat_sr", "bowl_team_bat_avg"]
    return strong.select(
        *KEYS, F.col("innings1_runs").cast("double").alias("label"),
        *SCORE_CATEGORICAL, *SCORE_NUMERIC, *spare,
    )


def held_out(date: str = "date", start: str = HOLD_OUT_FROM) -> Column:
    """True from ``start`` on; a match without a date is held out too."""
    return ~F.coalesce(F.col(date) < F.lit(start).cast("date"), F.lit(False))


def split(table: DataFrame, start: str = HOLD_OUT_FROM) -> tuple[DataFrame, DataFrame]:
    return table.filter(~held_out(start=start)), table.filter(held_out(start=start))


# ---------------------------------------------------------------- folds


def _ranked(table: DataFrame, key: Column) -> DataFrame:
    """0-based rank of each row among the rows of its key, in match order."""
    rows = table.withColumn("_key", key)
    return state_before(rows, ["_key"], sums={"_rank": F.lit(1)})


def contiguous_folds(table: DataFrame, k: int = 5) -> DataFrame:
    """Fold 0..k-1 in match order; the first ``n mod k`` folds have one row more."""
    n = table.agg(F.count(F.lit(1)).alias("_n"))
    ranked = _ranked(table, F.lit(0)).crossJoin(F.broadcast(n))  # one row
    small, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    starts = [i * small + F.least(F.lit(i), extra) for i in range(1, k)]
    return ranked.withColumn("fold", _count_reached(starts)).drop("_key", "_rank", "_n")


def stratified_folds(table: DataFrame, k: int = 5, label: str = "label") -> DataFrame:
    """Fold 0..k-1 with every class spread evenly, unshuffled.

    Classes are numbered by first appearance and laid end to end; fold i takes
    every k-th place of that line.  So the line fixes how many rows of a class
    go to a fold, and the rows go there in match order.
    """
    classes = table.groupBy(F.col(label).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first")
    )
    line = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # a row per class
    classes = classes.withColumn("_start", F.coalesce(F.sum("_n").over(line), F.lit(0))).drop("_first")
    ranked = _ranked(table, F.col(label)).join(F.broadcast(classes), "_key")
    until = lambda x, i: F.floor((x + (k - 1 - i)) / k)  # noqa: E731  places of fold i below x
    share = [
        until(F.col("_start") + F.col("_n"), i) - until(F.col("_start"), i) for i in range(k)
    ]
    ends, so_far = [], F.lit(0)
    for s in share[:-1]:
        so_far = so_far + s
        ends.append(so_far)
    return ranked.withColumn("fold", _count_reached(ends)).drop("_key", "_rank", "_n", "_start")


def _count_reached(limits: list[Column]) -> Column:
    total = F.lit(0)
    for limit in limits:
        total = total + F.when(F.col("_rank") >= limit, 1).otherwise(0)
    return total.cast("int")
