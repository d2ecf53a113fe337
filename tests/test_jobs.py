"""From JSON files to predictions, every job once."""

import json
import os
import random

import pytest

from pavilion.operators.par import par_scores
from pavilion.plans import jobs, models
from pavilion.plans.serving import team_options, venue_options
from pavilion.session import shared_folder

TEAMS = ["Mumbai Indians", "Chennai Super Kings", "Delhi Daredevils", "Kings XI Punjab"]
PRESENT = ["Mumbai Indians", "Chennai Super Kings", "Delhi Capitals", "Punjab Kings"]


def card(i, r):
    a, b = r.sample(TEAMS, 2)
    totals, innings = [], []
    for team in (a, b):
        overs = []
        for o in (0, 1, 3, 5, 8, 10, 13, 17, 19):
            balls = []
            for _ in range(6):
                runs = r.choice([0, 1, 1, 2, 4, 6])
                d = {"batter": f"{team[0]}{r.randint(1, 4)}", "non_striker": f"{team[0]}9", "bowler": f"w{team[1]}{r.randint(1, 3)}",
                     "runs": {"batter": runs, "extras": 0, "total": runs}}
                if r.random() < 0.1:
                    d["wickets"] = [{"kind": "bowled", "player_out": d["batter"]}]
                balls.append(d)
            overs.append({"over": o, "deliveries": balls})
        totals.append(sum(d["runs"]["total"] for o in overs for d in o["deliveries"]))
        innings.append({"team": team, "overs": overs, "powerplays": [{"from": 0.1, "to": 5.6, "type": "mandatory"}]})
    if totals[0] == totals[1]:
        outcome = {"result": "tie"}
    elif totals[0] > totals[1]:
        outcome = {"winner": a, "by": {"runs": totals[0] - totals[1]}}
    else:
        outcome = {"winner": b, "by": {"wickets": r.randint(1, 9)}}
    year = 2021 + i // 24
    return {"meta": {"data_version": "1.0.0"}, "innings": innings, "info": {
        "season": year if i % 2 else str(year), "dates": [f"{year}-04-{1 + i % 24:02d}"], "venue": r.choice(["Eden Gardens", "Wankhede Stadium, Mumbai"]),
        "city": r.choice(["Kolkata", "Mumbai"]), "teams": [b, a] if i % 3 else [a, b], "toss": {"winner": a, "decision": "bat"},
        "outcome": outcome, "overs": 20, "balls_per_over": 6, "event": {"name": "Cup", "match_number": i}}}


written_before = set()


def files(spark):
    """What lies in the application's part of the shared folder."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def left_over(spark):
    return files(spark) - written_before


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    docs = root / "docs"
    docs.mkdir()
    written_before.update(files(spark))  # of other tests in this session
    r = random.Random(11)
    for i in range(72):
        (docs / f"{1000 + i}.json").write_text(json.dumps(card(i, r)))
    assert tuple(jobs.ingest(spark, str(docs), f"{root}/tables").first()) == (72, 0, 72 * 108)
    assert not left_over(spark)
    summary = jobs.build_features(spark, f"{root}/tables", f"{root}/features")
    counts = {x.feature: (x.rows, x.not_null) for x in summary.collect()}
    assert len(counts) == 45 and counts["team1_recent_form"] == (72, 72) and counts["target"] == (72, 72)
    return root


def test_reports(spark, place):
    names = jobs.build_reports(spark, f"{place}/tables", f"{place}/reports")
    assert len(names) == 20
    for name in names:
        assert spark.read.parquet(f"{place}/reports/{name}").count() > 0, name
    assert not left_over(spark)


def test_a_failed_job_leaves_nothing(spark, place):
    with pytest.raises(Exception):  # noqa: B017
        jobs.ingest(spark, f"{place}/docs", "/proc/nowhere/tables")
    assert not left_over(spark)


def test_train_and_predict(spark, place):
    tiny = models.Sizes(trees=1, rounds=1)
    winner = jobs.train_winner(spark, f"{place}/features", f"{place}/models", tiny, folds=2)
    assert winner["cv"].count() == 2 and 0 <= winner["auc"].first().auc <= 1
    assert {r["class"] for r in winner["report"].collect()} >= {"0", "1", "accuracy"}
    assert winner["overfit"].count() == 1 and winner["importances"].count() == 20
    score = jobs.train_score(spark, f"{place}/features", f"{place}/models", tiny, folds=2)
    meta = score["metadata"].first()
    assert meta.residual_std_impact_era == pytest.approx(meta.residual_std)  # the hold-out is all new era
    assert score["report"].first().mae == pytest.approx(meta.test_mae)

    match = jobs.read_features(spark, f"{place}/features")[0]
    assert [r.team for r in team_options(match).collect()] == sorted(PRESENT)
    assert [r.venue for r in venue_options(match).collect()] == ["Eden Gardens", "Wankhede Stadium"]
    ask = spark.createDataFrame([(a, b, v, a) for a in PRESENT for b in PRESENT if a != b for v in ("Eden Gardens", "Wankhede Stadium")],
                                "team1 string, team2 string, venue string, bat_first string")
    got = jobs.predict(spark, ask, f"{place}/features", f"{place}/models", f"{place}/predictions").collect()
    assert not left_over(spark)
    pars = {r.venue: r.par_score for r in par_scores(match).collect()}
    assert len(got) == 24
    for r in got:
        assert r.winner in (r.team1, r.team2) and 50 <= r.win_pct <= 100
        assert r.score_low <= r.predicted_score <= r.score_high and r.par_score == pars[r.venue]
