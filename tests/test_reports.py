import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pavilion.operators import reports

BALLS = ("match_id string, innings int, bowling_team string, over int, ball int, bowler string, batter string, "
         "total_runs int, batter_runs int, wides int, noballs int, is_wicket int, cumulative_wickets int, in_powerplay int, wicket_kind string")


def balls(n=900, seed=1):
    r = random.Random(seed)
    out = []
    for m in range(6):
        for inn in (1, 2):
            down = 0
            for i in range(n // 12):
                w = int(r.random() < 0.12)
                down += w
                runs = r.choice([0, 0, 1, 1, 2, 3, 4, 5, 6, 7])
                out.append(dict(match_id=str(m), innings=inn, bowling_team=f"T{(m + inn) % 3}", over=1 + i // 6, ball=1 + i % 6,
                                bowler=f"b{r.randint(0, 6)}", batter=f"p{r.randint(0, 5)}", total_runs=runs, batter_runs=runs,
                                wides=int(r.random() < 0.1), noballs=int(r.random() < 0.05), is_wicket=w,
                                cumulative_wickets=down, in_powerplay=int(i < 36), wicket_kind=r.choice(["caught", "bowled", None]) if w else None))
    return out


@pytest.fixture(scope="module")
def data():
    return balls()


@pytest.fixture(scope="module")
def deliveries(rows, data):
    return rows(data, BALLS).cache()


def stands_by_loop(data):
    out = []
    for m in sorted({b["match_id"] for b in data}):
        number, runs = 1, 0
        for b in sorted((x for x in data if x["match_id"] == m and x["innings"] == 1), key=lambda x: (x["over"], x["ball"])):
            runs += b["total_runs"]
            if b["is_wicket"]:
                out.append((m, number, runs))
                number, runs = number + 1, 0
        if runs > 0:
            out.append((m, number, runs))
    return sorted(x for x in out if x[1] <= 10)


def test_partnerships(deliveries, data):
    got = sorted((r.match_id, r.wicket_num, r.runs) for r in reports.partnerships(deliveries).collect())
    assert got == stands_by_loop(data)
    summary = {r.wicket_num: r for r in reports.partnership_summary(deliveries).collect()}
    by_number = pd.DataFrame(stands_by_loop(data), columns=["m", "n", "r"]).groupby("n")["r"]
    for n, g in by_number:
        assert (summary[n].mean_runs, summary[n].median_runs, summary[n].partnerships) == (
            pytest.approx(g.mean()), g.median(), len(g))


def test_unfinished_stand_needs_runs(rows):
    def one(over, runs, wicket):
        return dict(match_id="m", innings=1, over=over, ball=1, total_runs=runs, is_wicket=wicket)
    duck = [one(1, 0, 1), one(2, 0, 0)]
    got = [(r.wicket_num, r.runs) for r in reports.partnerships(rows(duck, BALLS)).collect()]
    assert got == [(1, 0)]


@pytest.mark.parametrize("values,bins", [([80, 100, 100, 233, 120, 121, 199], 25), ([5], 20), (list(range(1, 11)), 20), ([], 5)])
def test_histogram_equals_numpy(rows, values, bins):
    df = rows([dict(x=v) for v in [*values, None]], "x int")
    got = sorted(reports.histogram(df, "x", bins).collect(), key=lambda r: r.bin)
    if not values:
        assert got == []
        return
    counts, edges = np.histogram(values, bins=bins)
    assert [r.frequency for r in got] == list(counts)
    assert [r.bin_from for r in got] == pytest.approx(list(edges[:-1]))
    assert got[0].mean == pytest.approx(np.mean(values)) and got[0].median == np.median(values)


def test_correlation_is_pairwise_complete(rows):
    r = random.Random(2)
    data = [dict(a=r.choice([None, r.randint(0, 9)]), b=r.choice([None, r.randint(0, 9)]), c=r.randint(0, 9), d=4) for _ in range(60)]
    got = {(x.row, x.col): x.r for x in reports.correlation_matrix(rows(data, "a int, b int, c int, d int"), list("abcd")).collect()}
    want = pd.DataFrame(data).astype(float).corr()
    for i in "abcd":
        for j in "abcd":
            w = want.loc[i, j]
            assert (got[i, j] is None) if math.isnan(w) else got[i, j] == pytest.approx(w)


def test_dense_grids(deliveries):
    assert reports.wickets_by_over(deliveries).count() == 40
    assert reports.score_acceleration(deliveries).count() == 40
    grid = reports.pressure_grid(deliveries).collect()
    assert [r.wickets_before for r in grid] == list(range(10)) and len(grid[0]) == 21
    assert grid[0].over_20 is None and grid[0].over_1 is not None


def test_zone_shares_sum_to_100(deliveries):
    got = reports.scoring_zones(deliveries).collect()
    assert [r.phase for r in got] == ["Powerplay", "Middle", "Death"]
    for r in got[:2]:
        assert r.dot_pct + r.running_pct + r.boundary_pct == pytest.approx(100)
    assert got[2].dot_pct is None  # no ball after over 13


def test_economy_shows_every_phase(deliveries):
    got = reports.economy_by_phase(deliveries, 3).collect()
    assert len(got) == 9 and [r.phase_order for r in got[:3]] == [1, 2, 3]
    overall = [r.overall_economy for r in got[::3]]
    assert overall == sorted(overall) and got[2].economy is None


def test_leaderboard_ties_go_by_name(rows):
    data = [dict(bowler=b, is_wicket=w, total_runs=3, batter=b, batter_runs=4, wides=0) for b, w in (("y", 1), ("x", 1), ("z", 2), ("a", 0))]
    df = rows(data, BALLS)
    assert [r.bowler for r in reports.top_bowlers(df, 3).collect()] == ["z", "x", "y"]
    top = reports.top_batters(df, 2).collect()
    assert [r.batter for r in top] == ["a", "x"] and top[0].strike_rate == 400.0


MATCHES = ("match_id string, season_year int, toss_decision string, toss_winner string, winner string, team1 string, team2 string, "
           "innings1_runs int, innings2_team string")


def test_match_reports(rows):
    def m(**k):
        return dict(dict(team1="A", team2="B", innings2_team="B", toss_winner="A", toss_decision="bat", innings1_runs=150), **k)
    df = rows([m(winner="A"), m(winner="tie"), m(winner="B", toss_decision=None), m(winner=None), m(winner="B", innings1_runs=99),
               m(winner="B", innings1_runs=98), m(winner="A", innings1_runs=299, season_year=2020)], MATCHES)
    toss = {r.decision: (r.win_pct, r.matches) for r in reports.toss_effect(df).collect()}
    assert toss == {"Bat": (pytest.approx(40.0), 5), "Overall": (pytest.approx(100 * 2 / 6), 6)}
    assert [(r.team, r.wins) for r in reports.team_wins(df).collect()] == [("A", 2), ("B", 3)]
    bands = {r.band: (r.win_pct, r.matches) for r in reports.chase_success(df).collect()}
    assert bands == {"140-159": (pytest.approx(100 / 3), 3), "100-119": (100.0, 1)}
    assert [(r.season_year, r.matches) for r in reports.matches_per_season(df).collect()] == [(2020, 1)]


def test_extras_only_of_franchises(deliveries, rows, data):
    known = rows([dict(team1="T0", team2="T1")], MATCHES)
    got = {r.team: r for r in reports.extras_leakage(deliveries, known).collect()}
    frame = pd.DataFrame(data)
    frame["x"] = frame.wides + frame.noballs
    want = frame.groupby(["bowling_team", "match_id"]).x.sum().groupby("bowling_team").agg(["mean", "sum", "count"])
    assert set(got) == {"T0", "T1"}
    for t, r in got.items():
        assert (r.avg_per_match, r.total, r.matches) == (pytest.approx(want.loc[t, "mean"]), want.loc[t, "sum"], want.loc[t, "count"])


def test_reports_from_the_cube_are_those_of_the_balls(spark, rows, tmp_path):
    """Every report that has parts, with NULL keys, super overs and an empty table; the balls are scanned twice."""
    from pavilion.operators import cube
    from pavilion.plans.reports import all_reports

    odd = [dict(match_id=None, innings=1, over=3, ball=1, total_runs=4, batter_runs=4, wides=0, noballs=0, is_wicket=0, cumulative_wickets=0, in_powerplay=1),
           dict(match_id="9", innings=3, bowling_team="T0", over=1, ball=1, bowler="b1", batter="p1", total_runs=6, batter_runs=6, wides=0, noballs=0, is_wicket=1,
                cumulative_wickets=1, in_powerplay=0, wicket_kind="caught"),
           dict(match_id="9", innings=1, bowling_team=None, over=None, ball=1, bowler=None, batter="p9", total_runs=None, batter_runs=None, wides=1, noballs=None,
                is_wicket=0, cumulative_wickets=0, in_powerplay=None)]
    names = "match_id string, winner string, toss_winner string, toss_decision string, team1 string, team2 string, season string, " \
            "innings1_runs int, innings2_runs int, innings1_wickets int, innings2_wickets int, innings2_team string, win_by_runs int, win_by_wickets int"
    matches = rows([dict(match_id=str(m), winner="T0", toss_winner="T0", toss_decision="bat", team1=f"T{m % 3}", team2=f"T{(m + 1) % 3}", season="2020",
                         innings1_runs=100 + m * 7 % 5, innings2_runs=90, innings1_wickets=m, innings2_wickets=3, innings2_team="T1", win_by_runs=m) for m in range(10)], names)
    place = str(tmp_path / "balls")
    rows([*balls(), *odd], BALLS).write.parquet(place)
    whole = spark.read.parquet(place)
    for df, some in ((whole, None), (whole.where("innings = 3"), {"wickets_by_over", "score_acceleration", "scoring_zones"})):
        got = all_reports(matches, df)
        with_year = matches.withColumn("season_year", F.lit(2020))
        want = {
            **{n: getattr(reports, n)(df) for n in ("top_batters", "top_bowlers", "runs_by_over", "wickets_by_over", "score_acceleration", "dismissal_mix",
                                                    "pressure_grid", "economy_by_phase", "scoring_zones")},
            "powerplay_points": reports.powerplay_points(with_year, df), "extras_leakage": reports.extras_leakage(df, matches),
            "correlation_matrix": reports.correlation_matrix(reports.correlation_input(matches, df), reports.CORRELATED),
        }
        for name, table in want.items():
            if some and name not in some:
                continue
            a, b = (sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()), key=str) for t in (got[name].select(table.columns), table))
            assert a == b, name
    scans = [name for name, t in all_reports(matches, whole).items() if any(place in f for f in t.inputFiles())]
    assert scans == ["partnership_summary"]  # the cube itself is the other scan
    assert set(cube.parts_of(cube.ball_cube(whole))) >= {"top_batters", "scoring_zones"}
