import pytest
from pyspark.sql import functions as F

from pavilion.operators.innings import innings_scores, phase_totals, running_totals
from pavilion.operators.match_rows import with_result, with_setting, with_toss_flags
from pavilion.operators.players import (
    BATTING_CAREER, batting_features, bowling_features, career_before, team_strength, with_strength,
)
from pavilion.operators.timeline import by_date, placed

BALLS = ("match_id string, innings int, batting_team string, bowling_team string, over int, ball int, batter string, "
         "bowler string, batter_runs int, total_runs int, wides int, noballs int, is_wicket int, player_out string, in_powerplay int")


def ball(over, n, runs, batter="A", bowler="Z", wides=0, noballs=0, out=None, innings=1, match="m"):
    sides = ("X", "Y") if innings % 2 else ("Y", "X")
    return dict(match_id=match, innings=innings, batting_team=sides[0], bowling_team=sides[1], over=over, ball=n,
                batter=batter, bowler=bowler, batter_runs=runs, total_runs=runs + wides + noballs, wides=wides,
                noballs=noballs, is_wicket=int(out is not None), player_out=out, in_powerplay=int(over <= 6))


DATA = [
    ball(1, 1, 4), ball(1, 2, 0, wides=1), ball(1, 3, 6, batter="B"), ball(7, 1, 0, out="B"),
    ball(17, 1, 2, batter="C", out="A"), ball(20, 1, 0, batter="D", wides=1, out="D"),
    ball(8, 1, 1, batter="Q", bowler="W", noballs=1, innings=2), ball(1, 1, 6, innings=3),
    dict(ball(1, 4, 1), batter=None),
]


@pytest.fixture(scope="module")
def balls(rows):
    return rows(DATA, BALLS).cache()


def test_batting_rows(balls):
    got = {(r.innings, r.batter): r for r in batting_features(balls).collect()}
    # D is out without a legal ball and Null batters are no group.
    assert set(got) == {(1, "A"), (1, "B"), (1, "C"), (2, "Q"), (3, "A")}
    a, b, c = got[1, "A"], got[1, "B"], got[1, "C"]
    assert (a.runs, a.balls_faced, a.fours, a.dot_balls, a.strike_rate, a.boundary_pct, a.dismissed) == (4, 2, 1, 1, 200.0, 50.0, 1)
    assert (b.sixes, b.dismissed, c.dismissed) == (1, 1, 0)


def test_bowling_rows(balls):
    got = {(r.innings, r.bowler): r for r in bowling_features(balls).collect()}
    z = got[1, "Z"]
    assert (z.runs_conceded, z.balls_bowled, z.wickets, z.wides, z.dot_balls, z.fours_conceded, z.sixes_conceded) == (15, 7, 3, 2, 1, 1, 1)
    assert z.economy == pytest.approx(15 * 6 / 7) and z.bowling_avg == 5.0
    assert got[2, "W"].bowling_avg is None and got[2, "W"].no_balls == 1


def test_phase_totals(balls):
    r = phase_totals(balls).first()
    assert (r.pp_runs_inn1, r.mid_runs_inn1, r.death_runs_inn1, r.death_wickets_inn1) == (12, 0, 3, 2)
    assert r.pp_runs_inn2 is None and r.mid_runs_inn2 == 2  # no ball in that phase is NULL, not 0
    assert (r.fours_inn1, r.sixes_inn1, r.dot_balls_inn1, r.sixes_inn2) == (1, 1, 3, 0)


def test_innings_without_balls_is_null(rows):
    r = phase_totals(rows([ball(1, 1, 4)], BALLS)).first()
    assert r.fours_inn1 == 1 and r.fours_inn2 is None


def test_running_totals(balls):
    got = sorted(running_totals(balls.filter("innings = 1 and batter is not null")).collect(), key=lambda r: (r.over, r.ball))
    assert [r.cumulative_runs for r in got] == [4, 5, 11, 11, 13, 14]
    assert [r.cumulative_wickets for r in got] == [0, 0, 0, 1, 2, 3]
    assert [r.legal_balls for r in got] == [1, 1, 2, 3, 4, 4]


def test_running_totals_of_placed_deliveries(balls):
    known = balls.filter("batter is not null")
    ordered = placed(known, [F.col(c) for c in ("match_id", "innings", "over", "ball")], 3)
    a = running_totals(ordered, order=["seq"], slot="slot").drop("seq", "slot")
    b = running_totals(known)
    assert ordered.select("slot").distinct().count() == 3
    assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


def test_super_overs_stay_out_of_the_score(balls):
    r = innings_scores(balls).first()
    assert (r.innings1_runs, r.innings2_runs, r.innings1_wickets) == (15, 2, 3)


MATCHES = ("match_id string, date string, season string, city string, team1 string, team2 string, toss_winner string, toss_decision string, "
           "innings1_team string, innings2_team string, innings1_runs int, innings2_runs int, overs int, winner string, "
           "win_by_runs int, win_by_wickets int")


def test_match_columns(rows):
    base = dict(season="2023", city="Mohali", team1="Punjab Kings", team2="Y", toss_winner="Y", toss_decision="field",
                innings1_team="Punjab Kings", innings2_team="Y", innings1_runs=160, innings2_runs=150)
    data = [dict(base, match_id="a", overs=None, winner="Punjab Kings", win_by_runs=10),
            dict(base, match_id="b", overs=0, winner="tie", season="2022/23"),
            dict(base, match_id="c", overs=20, winner="Y", win_by_wickets=3, city=None, toss_winner=None, season=None),
            dict(base, match_id="d", winner=None, toss_decision=None, innings2_runs=None)]
    df = with_setting(with_result(with_toss_flags(rows(data, MATCHES))))
    a, b, c, d = (r for r in df.orderBy("match_id").collect())
    assert (a.toss_winner_is_team1, a.toss_bat_first, a.toss_winner_batted) == (0, 0, 1)
    assert (a.run_rate_inn1, a.score_diff, a.target, a.team1_won, a.win_method) == (8.0, 10, 161, 1, "runs")
    assert (a.is_home_team1, a.is_home_team2, a.season_year, a.is_impact_player_era) == (1, 0, 2023, 1)
    assert (b.run_rate_inn1, b.team1_won, b.win_method, b.is_impact_player_era) == (0.0, None, "other", 0)
    assert (c.team1_won, c.win_method, c.is_home_team1, c.toss_winner_batted, c.season_year, c.is_impact_player_era) == (0, "wickets", 0, 0, None, 0)
    assert (d.team1_won, d.score_diff, d.run_rate_inn2) == (None, None, None)


def test_career_means_and_strength(rows):
    table = placed(rows([dict(match_id=str(i), date=f"2020-01-0{i}") for i in (1, 2, 3)], "match_id string, date string"), by_date(), 2)
    bat = rows([
        dict(match_id="1", innings=1, batting_team="X", batter="A", strike_rate=100.0, runs=10),
        dict(match_id="1", innings=3, batting_team="X", batter="A", strike_rate=200.0, runs=2),
        dict(match_id="2", innings=1, batting_team="X", batter="A", strike_rate=None, runs=30),
        dict(match_id="3", innings=2, batting_team="X", batter="A", strike_rate=150.0, runs=0),
        dict(match_id="3", innings=2, batting_team="X", batter="B", strike_rate=50.0, runs=8),
        dict(match_id="9", innings=2, batting_team="X", batter="B", strike_rate=999.0, runs=999),
    ], "match_id string, innings int, batting_team string, batter string, strike_rate double, runs int")
    out = career_before(bat, table, "batter", "batting_team", BATTING_CAREER)
    got = {(r.match_id, r.innings, r.player): (r.pre_match_sr, r.pre_match_avg) for r in out.collect()}
    overall = (125.0, 10.0)  # the unknown match 9 counts nowhere
    assert got["1", 1, "A"] == overall and got["3", 2, "B"] == overall
    assert got["1", 3, "A"] == (100.0, 10.0) and got["2", 1, "A"] == (150.0, 6.0)
    assert got["3", 2, "A"] == (150.0, 14.0)

    bowl = rows([dict(match_id="3", innings=1, bowling_team="X", bowler="Z", economy=6.0, wickets=2)],
                "match_id string, innings int, bowling_team string, bowler string, economy double, wickets int")
    strength = team_strength(bat, bowl, table)
    r = {x.match_id: x for x in strength.collect()}["3"]
    assert (r.team_batting_sr, r.team_batting_avg, r.team_bowling_econ, r.team_bowling_wkts) == (137.5, 12.0, 6.0, 2.0)
    matches = table.select("match_id", F.lit("X").alias("team1"))
    sides = {"team1": {"team_batting_sr": "sr", "team_bowling_econ": "econ"}}
    got = {x.match_id: (x.sr, x.econ) for x in with_strength(matches, strength, sides).collect()}
    assert got["3"] == (137.5, 6.0) and got["2"][1] is None


def _count(df, node):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return plan.count(node)


def test_an_innings_is_one_scan_and_one_shuffle(spark, tmp_path):
    from pavilion.operators.innings import running_totals
    from pavilion.operators.reports import partnerships
    from pavilion.schemas import DELIVERIES, ddl

    path = f"{tmp_path}/deliveries"
    spark.createDataFrame([], ddl(DELIVERIES)).write.parquet(path)
    balls = spark.read.parquet(path)
    totals = running_totals(balls)
    assert (_count(totals, "FileScan"), _count(totals, "Exchange")) == (1, 1)
    assert (_count(partnerships(balls), "FileScan"), _count(partnerships(balls), "Exchange")) == (1, 1)
