import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from pavilion.operators import metrics
from pavilion.operators.timeline import by_date, placed
from pavilion.plans import models, serving, training

TINY = models.Sizes(trees=4, rounds=2)


def contiguous(n, k):
    sizes = [n // k + (i < n % k) for i in range(k)]
    return [i for i, s in enumerate(sizes) for _ in range(s)]


def stratified(y, k):
    """Unshuffled stratified folds, spelled out with arrays."""
    _, first, inverse = np.unique(y, return_index=True, return_inverse=True)
    codes = np.argsort(np.argsort(first))[inverse]
    line = np.sort(codes)
    out = np.empty(len(y), dtype=int)
    for c in range(codes.max() + 1):
        share = [int(np.sum(line[i::k] == c)) for i in range(k)]
        out[codes == c] = np.repeat(np.arange(k), share)
    return list(out)


@pytest.mark.parametrize("n,slots", [(23, 3), (40, 1), (7, 2)])
def test_folds(rows, n, slots):
    r = random.Random(n)
    y = [float(r.random() < 0.3) for _ in range(n)]
    data = [dict(match_id=f"{i:03d}", date="2020-01-01", label=v) for i, v in enumerate(y)]
    table = placed(rows(data, "match_id string, date string, label double"), by_date(), slots)
    for fn, want in ((training.contiguous_folds, contiguous(n, 5)), (training.stratified_folds, stratified(y, 5))):
        got = [x.fold for x in fn(table).orderBy("match_id").collect()]
        assert got == want


def test_split_holds_out_missing_dates(rows):
    df = rows([dict(match_id=a, date=b) for a, b in (("a", "2022-12-31"), ("b", "2023-01-01"), ("c", None))], "match_id string, date string")
    train, test = training.split(df.withColumn("date", F.col("date").cast("date")))
    assert [r.match_id for r in train.collect()] == ["a"] and {r.match_id for r in test.collect()} == {"b", "c"}


def table(spark, spec, n=240):
    """A training table with some signal, gaps, and a rare category."""
    x = F.rand(7)
    df = spark.range(n).withColumn("seq", F.col("id")).withColumn("slot", (F.col("id") / 100).cast("int"))
    df = df.withColumns({"match_id": F.col("id").cast("string"), "date": F.lit("2020-01-01").cast("date")})
    for i, c in enumerate(spec.numeric):
        v = F.rand(i) * 10
        df = df.withColumn(c, F.when(F.rand(100 + i) < 0.05, None).otherwise(v))
    for i, c in enumerate(spec.categorical):
        df = df.withColumn(c, F.when(F.rand(50 + i) < 0.1, None).otherwise(F.concat(F.lit("t"), (F.rand(60 + i) * 4).cast("int"))))
    signal = F.coalesce(spec.numeric[2], F.lit(5.0)) + F.coalesce(spec.numeric[3], F.lit(5.0))
    label = F.when(signal + x > 10.5, 1.0).otherwise(0.0) if spec.classifies else signal * 10 + x
    return df.withColumn("label", label).drop("id").cache()


def test_winner_model(spark, tmp_path):
    df = table(spark, models.WINNER)
    model = models.fit(models.WINNER, df, TINY)
    scored = model.transform(df).cache()
    assert scored.columns == [*df.columns, "prediction", "probability"]
    r = scored.agg(F.min("probability"), F.max("probability"), F.count_if((F.col("probability") > 0.5) != (F.col("prediction") == 1)).alias("odd")).first()
    assert 0 <= r[0] <= r[1] <= 1 and r.odd == 0
    assert metrics.accuracy(scored).first().accuracy > 0.7
    # An unseen team is no error.
    assert model.transform(df.withColumn("team1", F.lit("stranger"))).count() == 240
    # Area under the curve agrees with the evaluator.
    raw = scored.withColumn("raw", F.col("probability"))
    want = BinaryClassificationEvaluator(rawPredictionCol="raw", numBins=0).evaluate(raw)
    assert metrics.auc(scored).first().auc == pytest.approx(want)
    # Saved and loaded it predicts the same.
    model.save(str(tmp_path))
    again = models.StackedModel.load("winner", str(tmp_path)).transform(df)
    a = {x.match_id: x.probability for x in scored.collect()}
    assert {x.match_id: x.probability for x in again.collect()} == a
    top = model.importances(df, 5).collect()
    assert len(top) == 5 and {top[0].feature, top[1].feature} & set(models.WINNER.numeric[2:4])
    whole = model.importances(df)
    assert whole.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert {"team1_t0", "team2_missing"} <= {x.feature for x in whole.collect()}


def test_out_of_fold_covers_each_row_once(spark):
    df = table(spark, models.SCORE, 60)
    inputs = models.as_inputs(df, models.SCORE.categorical, models.SCORE.numeric)
    prepared = models.prepare(inputs, models.SCORE.categorical, models.SCORE.numeric)
    ready = prepared.transform(training.contiguous_folds(inputs))
    out = models.out_of_fold(models.SCORE, ready.select("label", "features", "fold"), TINY)
    assert sorted(x.label for x in out.collect()) == sorted(x.label for x in df.collect())
    assert out.filter("base_rf is null or base_gb is null or base_et is null").count() == 0


def test_score_model_and_cross_validation(spark):
    df = table(spark, models.SCORE, 120)
    scored = models.fit(models.SCORE, df, TINY).transform(df)
    report = metrics.regression_report(scored).first()
    assert 0 < report.r2 <= 1 and report.mae <= report.rmse
    cv = models.cross_validate(models.SCORE, df, models.Sizes(trees=1, rounds=1), folds=2)
    assert [r.fold for r in cv.orderBy("fold").collect()] == [0, 1]
    s = models.cv_summary(cv).first()
    assert s.cv_mean > 0 and s.cv_std >= 0


def test_reports_on_odd_inputs(spark, rows):
    one = rows([dict(label=1.0, prediction=0.0)] * 2 + [dict(label=0.0, prediction=0.0)], "label double, prediction double")
    got = {r["class"]: r for r in metrics.classification_report(one).collect()}
    assert (got["1"].precision, got["1"].recall, got["1"].f1, got["1"].support) == (0.0, 0.0, 0.0, 2)
    assert got["0"].f1 == 0.5 and got["accuracy"].f1 == pytest.approx(1 / 3) and got["macro avg"].f1 == 0.25
    flat = rows([dict(label=1.0, prediction=2.0), dict(label=1.0, prediction=1.0)], "label double, prediction double")
    assert metrics.regression_report(flat).first().r2 is None


def test_metadata_without_old_or_new_era(spark, rows):
    ddl = "label double, prediction double, is_impact_player_era int"
    cv = spark.createDataFrame([(12.0,)], "cv_mean double")
    data = [dict(label=10.0, prediction=8.0, is_impact_player_era=0), dict(label=10.0, prediction=12.0, is_impact_player_era=0),
            dict(label=14.0, prediction=11.0, is_impact_player_era=0)]
    r = metrics.residual_metadata(rows(data, ddl), rows(data, ddl), cv).first()
    assert r.residual_std_impact_era == r.residual_std == r.residual_std_pre_impact
    assert (r.impact_era_bias, r.impact_era_avg_score, r.cv_mae) == (pytest.approx(1.0), None, 12.0)


# ---------------------------------------------------------------- snapshots

SIDE = ["recent_form", "venue_win_rate", "win_after_batting_first", "avg_pp_runs", "avg_death_wkts"]
FEATURES = ("match_id string, date string, team1 string, team2 string, venue string, city string, h2h_matches int, h2h_team1_win_rate double, "
            "winner string, innings1_team string, innings1_runs int, innings2_runs int, "
            + ", ".join(f"team{i}_{c} double" for i in (1, 2) for c in SIDE))


def feature_rows():
    def m(i, date, a, b, **k):
        base = dict(match_id=str(i), date=date, team1=a, team2=b, venue="v", city="c", h2h_matches=i, h2h_team1_win_rate=0.25,
                    winner=a, innings1_team=a, innings1_runs=150 + i, innings2_runs=140)
        base.update({f"team{s}_{c}": i + s / 10 for s in (1, 2) for c in SIDE})
        return dict(base, **k)
    return [m(i, f"2020-01-0{i}", "A", "B") for i in range(1, 7)] + [
        m(7, "2020-01-07", "B", "A", city="d"), m(8, None, "A", "C", city=None), m(9, "2020-01-01", "C", "D", venue="w", city="e")]


@pytest.fixture(scope="module")
def state(rows):
    f = rows(feature_rows(), FEATURES)
    bat = rows([dict(match_id=str(i), batting_team="A", strike_rate=100.0 + i, runs=i) for i in range(1, 9)],
               "match_id string, batting_team string, strike_rate double, runs int")
    bowl = rows([dict(match_id="7", bowling_team="B", economy=6.0, wickets=2)],
                "match_id string, bowling_team string, economy double, wickets int")
    return f, bat, bowl


def test_team_snapshot(state):
    got = {r.team: r for r in serving.team_snapshot(*state).collect()}
    a = got["A"]
    assert a.form == 7.2  # second side of match 7; the undated match is the oldest
    assert a.bat_avg == (7 + 6 + 5 + 4 + 3) / 5 and a.bowl_econ == 8.5
    assert (got["B"].form, got["B"].bowl_econ, got["B"].bat_sr) == (7.1, 6.0, 130.0)


def test_fixture_inputs(spark, state):
    ask = spark.createDataFrame([("A", "B", "v", "A"), ("B", "A", "v", "A"), ("A", "new", "w", "new")],
                                "team1 string, team2 string, venue string, bat_first string")
    homes = {"A": ["c"], "B": ["d"]}
    got = {(r.team1, r.team2): r for r in serving.fixture_inputs(ask, *state, homes=homes).collect()}
    ab, ba, new = got["A", "B"], got["B", "A"], got["A", "new"]
    assert (ab.h2h_team1_win_rate, ba.h2h_team1_win_rate, ab.h2h_matches) == (0.75, 0.25, 7)
    assert (ab.is_home_team1, ab.is_home_team2) == (1, 0)  # c is the usual city of v
    assert ab.form_diff == pytest.approx(7.2 - 7.1) and ab.bowling_econ_diff == pytest.approx(6.0 - 8.5)
    assert (new.h2h_team1_win_rate, new.h2h_matches, new.team2_avg_pp_runs, new.team2_batting_sr) == (0.5, 0, 45.0, 130.0)
    assert set(training.WINNER_NUMERIC) <= set(serving.fixture_inputs(ask, *state).columns)
    score = {(r.innings1_team, r.innings2_team): r for r in serving.score_inputs(serving.fixture_inputs(ask, *state, homes=homes)).collect()}
    assert score["A", "B"].team1_avg_pp_runs == 7.2 and score["new", "A"].team1_avg_pp_runs == 45.0
    assert score["A", "B"].is_home_team1 == 1


def test_prediction_without_score_model(spark, state):
    class Half:
        def transform(self, df):
            return df.withColumns({"probability": F.lit(0.3), "prediction": F.lit(0.0)})

    class Flat:
        def transform(self, df):
            return df.withColumn("prediction", F.lit(150.5))

    ask = spark.createDataFrame([("A", "B", "v", "A"), ("A", "B", "nowhere", "B")], "team1 string, team2 string, venue string, bat_first string")
    bare = serving.predict(ask, *state, Half()).collect()
    assert [(r.winner, r.win_pct, r.predicted_score, r.verdict) for r in bare] == [("B", 70.0, None, None)] * 2
    full = {r.venue: r for r in serving.predict(ask, *state, Half(), Flat()).collect()}
    v = full["v"]
    assert (v.predicted_score, v.score_low, v.score_high) == (150, 130, 170)
    assert v.verdict == ("above par" if 150 > v.par_score else "below par" if 150 < v.par_score else "at par")
    assert len(full) == 2 and not full["nowhere"].is_venue_specific


def test_medians_are_exact(spark):
    import statistics

    values = [(float(k * k % 97), None if k % 5 else float(k), float("nan"), 1.0) for k in range(101)] + [(5.0, 3.0, None, 2.0)]
    table = spark.createDataFrame(values, "a double, b double, c double, d double")
    got = models.medians(table, ["a", "b", "c", "d"]).first()
    want = [statistics.median(v for v in col if v is not None and v == v) for col in list(zip(*values))[:2]]
    assert list(got) == [*want, 0.0, 1.0]


@pytest.mark.parametrize("missed", [False, True])
def test_medians_walk_only_what_lies_around_them(spark, monkeypatch, missed):
    r = np.random.default_rng(6)
    values = np.column_stack([r.normal(size=4_001), r.integers(0, 2, 4_001), r.permutation(4_001) * 3.0])
    table = spark.createDataFrame([(*map(float, v), None) for v in values], "a double, b double, c double, d double").repartition(3)
    walked = []
    monkeypatch.setattr(models, "placed", lambda counts, *a, **k: walked.append(counts.count()) or placed(counts, *a, **k))
    if missed:  # bounds that are wrong cost time, not the result
        monkeypatch.setattr(F, "percentile_approx", lambda c, *_: F.when(F.max(c).isNotNull(), F.array(F.max(c), F.max(c))))
    assert list(models.medians(table, ["a", "b", "c", "d"]).first()) == [*np.median(values, axis=0), 0.0]
    assert walked[0] > 8_000 if missed else walked[0] < 1_000


def test_medians_of_nothing(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert list(models.medians(none, ["a", "b"]).first()) == [0.0, 0.0]
    assert models.medians(spark.createDataFrame([(2.0,), (5.0,)], "a double"), ["a"]).first()[0] == 3.5
