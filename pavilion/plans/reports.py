"""All reports of a match and a delivery table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports
from ..operators.cube import ball_cube, parts_of
from ..session import written
from ..sources.tables import with_season_year


def all_reports(matches: DataFrame, deliveries: DataFrame) -> dict[str, DataFrame]:
    """Name -> table, in the order the charts are usually shown.

    The deliveries are scanned twice: for the cube, which is written and answers the reports, and for the partnerships, which
    need the order of the balls.
    """
    matches = with_season_year(matches)
    cube = parts_of(written(ball_cube(deliveries), "ball-cube"))
    overs = cube["matches"].join(F.broadcast(cube["wickets_by_over"]), F.lit(True), "left")  # one row, and one per over of the game
    points = reports.powerplay_points(matches, deliveries, cube["powerplay_points"])
    correlated = reports.correlation_input(matches, deliveries, parts=cube["correlation_input"])
    return {
        "matches_per_season": reports.matches_per_season(matches),
        "toss_effect": reports.toss_effect(matches),
        "top_batters": reports.top_batters(deliveries, parts=cube["top_batters"]),
        "top_bowlers": reports.top_bowlers(deliveries, parts=cube["top_bowlers"]),
        "runs_by_over": reports.runs_by_over(deliveries, parts=cube["runs_by_over"]),
        "wickets_by_over": reports.wickets_by_over(deliveries, parts=overs),
        "score_distribution": reports.score_distribution(matches),
        "team_wins": reports.team_wins(matches),
        "dismissal_mix": reports.dismissal_mix(deliveries, parts=cube["dismissal_mix"]),
        "powerplay_points": points,
        "powerplay_trend": reports.powerplay_trend(points),
        "correlation_matrix": reports.correlation_matrix(correlated, reports.CORRELATED),
        "chase_success": reports.chase_success(matches),
        "pressure_grid": reports.pressure_grid(deliveries, parts=cube["pressure_grid"]),
        "economy_by_phase": reports.economy_by_phase(deliveries, parts=cube["economy_by_phase"]),
        "partnership_summary": reports.partnership_summary(deliveries),
        "extras_leakage": reports.extras_leakage(deliveries, matches, cube["extras_leakage"]),
        "score_acceleration": reports.score_acceleration(deliveries, parts=overs),
        "scoring_zones": reports.scoring_zones(deliveries, parts=cube["scoring_zones"]),
        "win_margins": reports.win_margins(matches),
    }
