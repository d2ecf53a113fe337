"""Training tables, metrics, models, snapshots and predictions."""

from __future__ import annotations

from dataclasses import replace
from functools import partial, reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, par
from ..operators.match_rows import with_result
from ..operators.players import batting_features, bowling_features
from ..operators.timeline import by_date, placed
from ..plans import models, serving, training
from ..session import written
from . import tables
from .history_queries import CAREER_CTES, FEATURE_CTES, FEATURES_SQL, STRENGTH_SQL, features
from .ingest_queries import BATTING_SQL, BOWLING_SQL, written_path
from .registry import register, rounded
from .report_queries import VENUE_STATS_SQL, par_ctes
from .sql_views import near, query


def _features(spark, sf_dir):
    """All three feature tables of the fixtures, written once, values as the SQL twins see them."""
    balls = tables.balls(spark, sf_dir)
    match = written(rounded(features(spark, sf_dir), dates_as_text=False), "features")
    return match, written(batting_features(balls), "batting"), written(bowling_features(balls), "bowling")


_CTES = {**FEATURE_CTES, "ft": FEATURES_SQL}


def _strength_ctes(condition: str) -> dict[str, str]:
    """Career means over the matches of one training table only."""
    ctes = dict(CAREER_CTES)
    ctes["dated"] = f"SELECT match_id, row_number() OVER (ORDER BY date ASC NULLS LAST, match_id ASC) AS seq FROM ft WHERE {condition}"
    return {**_CTES, **ctes, "st": STRENGTH_SQL}


_HELD = "(date IS NULL OR date >= DATE '2023-01-01') AS is_held_out"

# ---------------------------------------------------------------- training tables

_OWN = ("team_batting_sr", "team_batting_avg", "team_bowling_econ", "team_bowling_wkts")
_NAMES = ("batting_sr", "batting_avg", "bowling_econ", "bowling_wkts")
_SIDE_COLUMNS = ", ".join(
    f"s{i}.{a} AS team{i}_{b}" for i in (1, 2) for a, b in zip(_OWN, _NAMES))
_DIFFS = ", ".join([
    "team1_recent_form - team2_recent_form AS form_diff",
    "team1_batting_sr - team2_batting_sr AS batting_sr_diff",
    "team1_batting_avg - team2_batting_avg AS batting_avg_diff",
    "team2_bowling_econ - team1_bowling_econ AS bowling_econ_diff",
    "team1_bowling_wkts - team2_bowling_wkts AS bowling_wkts_diff",
    "team1_venue_win_rate - team2_venue_win_rate AS venue_wr_diff",
    "team1_avg_pp_runs - team2_avg_pp_runs AS pp_runs_diff",
    "team1_avg_death_wkts - team2_avg_death_wkts AS death_wkts_diff",
])
_FLAGS = ("toss_winner_is_team1", "toss_bat_first", "h2h_matches", "is_home_team1", "is_home_team2", "is_impact_player_era")


def _near_all(columns) -> str:
    return ", ".join(c if c in _FLAGS else f"{near(c)} AS {c}" for c in columns)


_WINNER_WIDE = f"SELECT *, {_DIFFS} FROM (SELECT ft.*, {_SIDE_COLUMNS} FROM ft " + " ".join(
    f"LEFT JOIN st s{i} ON s{i}.match_id = ft.match_id AND s{i}.team = ft.team{i}" for i in (1, 2)
) + " WHERE team1_won IS NOT NULL)"


@register(query(["fixtures"], f"""
SELECT match_id, {_HELD}, team1_won::DOUBLE AS label, team1, team2, {_near_all(training.WINNER_NUMERIC)} FROM ({_WINNER_WIDE})""",
                **_strength_ctes("team1_won IS NOT NULL")))
def winner_training_table(spark, sf_dir):
    table = training.winner_table(*_features(spark, sf_dir))
    return rounded(table.withColumn("is_held_out", training.held_out()).drop("date", "seq", "slot"))


_SCORE_SIDE = ", ".join(
    f"s{i}.{a} AS {b}" for i, names in ((1, training.SCORE_SIDES["innings1_team"]), (2, training.SCORE_SIDES["innings2_team"]))
    for a, b in names.items())
_SPARE = ["bat_team_bowl_econ", "bat_team_bowl_wkts", "bowl_team_bat_sr", "bowl_team_bat_avg"]


@register(query(["fixtures"], f"""
SELECT match_id, {_HELD}, innings1_runs::DOUBLE AS label, innings1_team, innings2_team, venue,
  {_near_all(training.SCORE_NUMERIC + _SPARE)}
FROM (SELECT ft.*, {_SCORE_SIDE} FROM ft
  LEFT JOIN st s1 ON s1.match_id = ft.match_id AND s1.team = ft.innings1_team
  LEFT JOIN st s2 ON s2.match_id = ft.match_id AND s2.team = ft.innings2_team WHERE innings1_runs IS NOT NULL)""",
                **_strength_ctes("innings1_runs IS NOT NULL")))
def score_training_table(spark, sf_dir):
    table = training.score_table(*_features(spark, sf_dir))
    return rounded(table.withColumn("is_held_out", training.held_out()).drop("date", "seq", "slot"))


_DECIDED = """SELECT match_id, CASE WHEN winner = team1 THEN 1 ELSE 0 END AS label,
  row_number() OVER (ORDER BY date ASC NULLS LAST, match_id ASC) - 1 AS pos FROM duels WHERE winner IN (team1, team2)"""


def _decided(spark, sf_dir):
    rows = placed(with_result(tables.duels(spark, sf_dir)), by_date(), label="duels")
    return rows.filter(F.col("team1_won").isNotNull()).select(
        "match_id", "seq", "slot", F.col("team1_won").cast("double").alias("label"))


@register(query(["duels"], "SELECT match_id, CAST(ntile(5) OVER (ORDER BY pos) - 1 AS INTEGER) AS fold FROM decided", decided=_DECIDED))
def contiguous_folds(spark, sf_dir):
    return training.contiguous_folds(_decided(spark, sf_dir)).select("match_id", "fold")


# Places in the line of classes, counted one by one instead of by formula.
_LINE = f"""
SELECT match_id, CAST((SELECT count(*) FROM ends e WHERE e.label = r.label AND e.until <= r.rank) AS INTEGER) AS fold
FROM (SELECT match_id, label, row_number() OVER (PARTITION BY label ORDER BY pos) - 1 AS rank FROM decided) r"""


@register(query(["duels"], _LINE, decided=_DECIDED,
                line="""SELECT label, (row_number() OVER (ORDER BY first_pos, pos) - 1) % 5 AS fold
                        FROM (SELECT *, min(pos) OVER (PARTITION BY label) AS first_pos FROM decided)""",
                ends="""SELECT label, fold, sum(n) OVER (PARTITION BY label ORDER BY fold) AS until
                        FROM (SELECT label, fold, count(*) AS n FROM line GROUP BY ALL)"""))
def stratified_folds(spark, sf_dir):
    return training.stratified_folds(_decided(spark, sf_dir)).select("match_id", "fold")


# ---------------------------------------------------------------- metrics on made predictions

_SCORED = """SELECT match_id, CASE WHEN winner = team1 THEN 1 ELSE 0 END AS label,
  (CAST(match_id AS BIGINT) * 7919 % 500) / 500.0::DOUBLE AS probability,
  CASE WHEN CAST(match_id AS BIGINT) * 7919 % 500 > 250 THEN 1 ELSE 0 END AS prediction
FROM duels WHERE winner IN (team1, team2)"""


def _scored(spark, sf_dir):
    x = F.col("match_id").cast("bigint") * 7919 % 500
    rows = with_result(tables.duels(spark, sf_dir)).filter(F.col("team1_won").isNotNull())
    return rows.select(
        "match_id", F.col("team1_won").alias("label"), (x / 500).alias("probability"),
        F.when(x > 250, 1.0).otherwise(0.0).alias("prediction"))


_PER_CLASS = """SELECT CAST(c AS VARCHAR) AS class, tp / predicted::DOUBLE AS precision, tp / support::DOUBLE AS recall,
  2 * tp / (predicted + support)::DOUBLE AS f1, support, tp FROM (
  SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS support,
    count(*) FILTER (prediction = c) AS predicted FROM scored, (SELECT unnest([0, 1]) AS c) GROUP BY c)"""
_REPORT = """SELECT class, precision, recall, f1, support FROM pc
UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT sum(tp) / sum(support)::DOUBLE AS a, sum(support) AS n FROM pc)
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pc
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM pc"""


@register(query(["duels"], f"""SELECT class, {', '.join(f'{near(c)} AS {c}' for c in ('precision', 'recall', 'f1'))},
  CAST(support AS BIGINT) AS support FROM ({_REPORT})""", scored=_SCORED, pc=_PER_CLASS))
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(_scored(spark, sf_dir)))


_ROC = """SELECT probability AS threshold, sum(sum(1 - label)) OVER w / (SELECT sum(1 - label) FROM scored)::DOUBLE AS fpr,
  sum(sum(label)) OVER w / (SELECT sum(label) FROM scored)::DOUBLE AS tpr
FROM scored GROUP BY probability WINDOW w AS (ORDER BY probability DESC)"""


@register(query(["duels"], f"""SELECT {near('threshold')} AS threshold, {near('fpr')} AS fpr, {near('tpr')} AS tpr FROM ({_ROC})
UNION ALL SELECT NULL, 0.0, 0.0""", scored=_SCORED))
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(_scored(spark, sf_dir)))


@register(query(["duels"], f"""SELECT {near('''sum(CASE WHEN p.probability > n.probability THEN p.n * n.n * 1.0
  WHEN p.probability = n.probability THEN p.n * n.n * 0.5 ELSE 0 END)::DOUBLE / (sum(p.n * n.n))''')} AS auc
FROM (SELECT probability, count(*) AS n FROM scored WHERE label = 1 GROUP BY 1) p,
     (SELECT probability, count(*) AS n FROM scored WHERE label = 0 GROUP BY 1) n""", scored=_SCORED))
def roc_auc(spark, sf_dir):
    return rounded(metrics.auc(_scored(spark, sf_dir)))


@register(query(["duels"], f"SELECT 0.55::DOUBLE AS cv_mean, {near('a')} AS accuracy, {near('abs(0.55 - a)')} AS gap, abs(0.55 - a) < 0.05 AS good "
                "FROM (SELECT avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS a FROM scored)", scored=_SCORED))
def overfit_gap(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    cv = scored.agg(F.lit(0.55).alias("cv_mean"))
    return rounded(metrics.overfit_check(cv, metrics.accuracy(scored)))


_FORECAST = """SELECT match_id, innings1_runs AS label, innings1_runs + CAST(match_id AS BIGINT) * 31 % 61 - 28 AS prediction,
  CASE WHEN CAST(season[1:4] AS INTEGER) >= 2023 THEN 1 ELSE 0 END AS is_impact_player_era FROM duels"""


def _forecast(spark, sf_dir):
    rows = tables.duels(spark, sf_dir)
    off = F.col("match_id").cast("bigint") * 31 % 61 - 28
    era = F.when(F.substring("season", 1, 4).cast("int") >= 2023, 1).otherwise(0)
    return rows.select("match_id", F.col("innings1_runs").cast("double").alias("label"),
                       (F.col("innings1_runs") + off).cast("double").alias("prediction"),
                       era.alias("is_impact_player_era"))


@register(query(["duels"], f"""
SELECT {near('avg(abs(r))')} AS mae, {near('sqrt(avg(r * r))')} AS rmse,
  {near('1 - sum(r * r) / (var_pop(label) * count(*))')} AS r2, {near('avg(r)')} AS mean_residual,
  {near('stddev_pop(r)')} AS residual_std, {near('avg(CASE WHEN abs(r) <= 15 THEN 1 ELSE 0 END) * 100')} AS within_15_pct,
  {near('avg(CASE WHEN abs(r) <= 25 THEN 1 ELSE 0 END) * 100')} AS within_25_pct
FROM (SELECT *, label - prediction AS r FROM forecast)""", forecast=_FORECAST))
def regression_report(spark, sf_dir):
    return rounded(metrics.regression_report(_forecast(spark, sf_dir)))


_META = f"""
SELECT {near('stddev_pop(r)')} AS residual_std, {near('stddev_pop(r) FILTER (era = 1)')} AS residual_std_impact_era,
  {near('stddev_pop(r) FILTER (era = 0)')} AS residual_std_pre_impact, {near('avg(r) FILTER (era = 1)')} AS impact_era_bias,
  {near('avg(abs(r))')} AS test_mae, 15.5::DOUBLE AS cv_mae, {near('avg(label) FILTER (era = 1)')} AS impact_era_avg_score,
  {near('avg(label) FILTER (era = 0)')} AS pre_impact_avg_score
FROM (SELECT *, label - prediction AS r, is_impact_player_era AS era FROM forecast)"""


@register(query(["duels"], _META, forecast=_FORECAST))
def residual_metadata(spark, sf_dir):
    rows = _forecast(spark, sf_dir)
    return rounded(metrics.residual_metadata(rows, rows, rows.agg(F.lit(15.5).alias("cv_mean"))))


@register(query(["duels"], """SELECT match_id, label::DOUBLE AS actual, prediction::DOUBLE AS predicted,
  (label - prediction)::DOUBLE AS residual FROM forecast""", forecast=_FORECAST))
def residual_rows(spark, sf_dir):
    return metrics.residuals(_forecast(spark, sf_dir)).select("match_id", "actual", "predicted", "residual")


# ---------------------------------------------------------------- snapshots

_SIDE_ROWS = " UNION ALL ".join(f"""SELECT team{i} AS team, date, match_id, {i} AS side, team{i}_recent_form AS form,
  team{i}_venue_win_rate AS venue_wr, team{i}_win_after_batting_first AS bat_first_wr, team{i}_avg_pp_runs AS avg_pp_runs,
  team{i}_avg_death_wkts AS avg_death_wkts FROM ft""" for i in (1, 2))
_RANKED = """SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC NULLS LAST, match_id DESC) AS rn FROM side_rows"""
_TEAMS = f"""SELECT * FROM (SELECT * FROM ranked WHERE rn = 1) LEFT JOIN
  (SELECT batting_team AS team, avg(strike_rate) AS bat_sr, avg(runs) AS bat_avg FROM ({BATTING_SQL}) b
     SEMI JOIN (SELECT * FROM ranked WHERE rn <= 5) r ON r.team = b.batting_team AND r.match_id = b.match_id GROUP BY 1) USING (team) LEFT JOIN
  (SELECT bowling_team AS team, avg(economy) AS bowl_econ, avg(wickets) AS bowl_wkts FROM ({BOWLING_SQL}) b
     SEMI JOIN (SELECT * FROM ranked WHERE rn <= 5) r ON r.team = b.bowling_team AND r.match_id = b.match_id GROUP BY 1) USING (team)"""
_SNAP = {**_CTES, "side_rows": _SIDE_ROWS, "ranked": _RANKED, "teams": _TEAMS}
_TEAM_VALUES = ["form", "venue_wr", "bat_first_wr", "avg_pp_runs", "avg_death_wkts", "bat_sr", "bat_avg", "bowl_econ", "bowl_wkts"]
_TEAM_DEFAULTS = dict(zip(_TEAM_VALUES, [0.5, 0.5, 0.5, 45.0, 2.0, 130.0, 25.0, 8.5, 1.5]))


@register(query(["fixtures"], "SELECT team, " + ", ".join(f"{near(c)} AS {c}" for c in _TEAM_VALUES) + " FROM teams", **_SNAP))
def team_snapshot(spark, sf_dir):
    return rounded(serving.team_snapshot(*_features(spark, sf_dir)))


_PAIRS = """SELECT least(team1, team2) AS lo, greatest(team1, team2) AS hi, team1 AS listed_first, h2h_matches, h2h_team1_win_rate
FROM ft QUALIFY row_number() OVER (PARTITION BY least(team1, team2), greatest(team1, team2)
  ORDER BY date DESC NULLS LAST, match_id DESC) = 1"""


@register(query(["fixtures"], _PAIRS, **_CTES))
def pair_snapshot(spark, sf_dir):
    return rounded(serving.pair_snapshot(_features(spark, sf_dir)[0]))


_CITY = """SELECT venue, city FROM (SELECT venue, city, count(*) AS n FROM {0} WHERE venue IS NOT NULL AND city IS NOT NULL GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY venue ORDER BY n DESC, city) = 1"""


@register(query(["fixtures"], _CITY.format("fixtures")))
def venue_city(spark, sf_dir):
    return serving.venue_city(tables.fixtures(spark, sf_dir))


@register(query(["duels"], "SELECT DISTINCT team1 AS team FROM duels"))
def team_options(spark, sf_dir):
    return serving.team_options(tables.duels(spark, sf_dir))


@register(query(["duels"], "SELECT DISTINCT venue FROM duels"))
def venue_options(spark, sf_dir):
    return serving.venue_options(tables.duels(spark, sf_dir))


# ---------------------------------------------------------------- fixtures to predict

# Every pairing that was ever played, at each of its venues, and against a team nobody knows.
_ASKED = """SELECT DISTINCT team1, team2, venue, innings1_team AS bat_first FROM fixtures
UNION ALL SELECT DISTINCT 'newcomers', team2, venue, team2 FROM fixtures"""


def _asked(spark, sf_dir, match=None):
    played = tables.fixtures(spark, sf_dir) if match is None else match
    known = played.select("team1", "team2", "venue", F.col("innings1_team").alias("bat_first")).distinct()
    new = played.select(F.lit("newcomers").alias("team1"), "team2", "venue", F.col("team2").alias("bat_first")).distinct()
    return known.unionByName(new)


_TEAM_NAMES = {
    "venue_win_rate": "venue_wr", "recent_form": "form", "batting_sr": "bat_sr", "batting_avg": "bat_avg",
    "bowling_econ": "bowl_econ", "bowling_wkts": "bowl_wkts", "win_after_batting_first": "bat_first_wr",
    "avg_pp_runs": "avg_pp_runs", "avg_death_wkts": "avg_death_wkts",
}
_HOME = "CASE WHEN 'c' || CASE WHEN a.team{0} = 'newcomers' THEN 'x' ELSE CAST(CAST(a.team{0}[2:] AS INTEGER) % 7 AS VARCHAR) END = city THEN 1 ELSE 0 END"
_INPUT = f"""SELECT a.*, 1 AS toss_winner_is_team1, 0 AS toss_bat_first,
  CASE WHEN listed_first IS NULL THEN 0.5 WHEN listed_first = a.team1 THEN h2h_team1_win_rate ELSE 1 - h2h_team1_win_rate END AS h2h_team1_win_rate,
  coalesce(h2h_matches, 0) AS h2h_matches, 0.5::DOUBLE AS season_progress, 1 AS is_impact_player_era,
  {', '.join(f"{_HOME.format(i)} AS is_home_team{i}" for i in (1, 2))},
  {', '.join(f"coalesce(t{i}.{c}, {_TEAM_DEFAULTS[c]}) AS team{i}_{n}" for i in (1, 2) for n, c in _TEAM_NAMES.items())}
FROM asked a LEFT JOIN teams t1 ON t1.team = a.team1 LEFT JOIN teams t2 ON t2.team = a.team2
LEFT JOIN pairs p ON p.lo = least(a.team1, a.team2) AND p.hi = greatest(a.team1, a.team2)
LEFT JOIN cities c ON c.venue = a.venue"""
_ASK_CTES = {**_SNAP, "asked": _ASKED, "pairs": _PAIRS, "cities": _CITY.format("fixtures"),
             "inputs": f"SELECT *, {_DIFFS} FROM ({_INPUT})"}


def _inputs(spark, sf_dir):
    tabs = _features(spark, sf_dir)
    return serving.fixture_inputs(_asked(spark, sf_dir, tabs[0]), *tabs, homes=tables.FIXTURE_HOMES)


@register(query(["fixtures"], f"SELECT team1, team2, venue, bat_first, {_near_all(training.WINNER_NUMERIC)} FROM inputs", **_ASK_CTES))
def fixture_inputs(spark, sf_dir):
    return rounded(_inputs(spark, sf_dir))


_BAT1 = "CASE WHEN bat_first = team1 THEN team1_{0} ELSE team2_{0} END"
_BOWL1 = "CASE WHEN bat_first = team1 THEN team2_{0} ELSE team1_{0} END"
_SCORE_INPUT = ", ".join(
    [f"{near(_BAT1.format(a))} AS bat_team_{b}" for a, b in (("batting_sr", "sr"), ("batting_avg", "avg"))]
    + [f"{near(_BOWL1.format(a))} AS bowl_team_{b}" for a, b in (("bowling_econ", "econ"), ("bowling_wkts", "wkts"))]
    + [f"{near(x.format(c))} AS team{i}_{c}" for c in ("avg_pp_runs", "avg_death_wkts", "win_after_batting_first")
       for i, x in ((1, _BAT1), (2, _BOWL1))])


@register(query(["fixtures"], f"""
SELECT venue, bat_first AS innings1_team, CASE WHEN bat_first = team1 THEN team2 ELSE team1 END AS innings2_team,
  {_SCORE_INPUT}, 1 AS toss_bat_first,
  CASE WHEN bat_first = team1 THEN is_home_team1 ELSE is_home_team2 END AS is_home_team1,
  CASE WHEN bat_first = team1 THEN is_home_team2 ELSE is_home_team1 END AS is_home_team2,
  0.5::DOUBLE AS season_progress, 1 AS is_impact_player_era FROM inputs""", **_ASK_CTES))
def score_model_inputs(spark, sf_dir):
    return rounded(serving.score_inputs(_inputs(spark, sf_dir)))


# Verdicts on a made forecast: the batting side's powerplay mean, doubled and more.
_MADE = "round(team1_avg_pp_runs) * 4 + 20"


@register(query(["fixtures"], f"""
SELECT team1, team2, venue, bat_first, predicted_score, score_low, score_high, par_score, venue_matches,
  CASE WHEN predicted_score > par_score THEN 'above par' WHEN predicted_score < par_score THEN 'below par' ELSE 'at par' END AS verdict,
  CASE WHEN predicted_score > par_score THEN bat_first WHEN predicted_score < par_score THEN
    CASE WHEN bat_first = team1 THEN team2 ELSE team1 END END AS favours
FROM (SELECT team1, team2, venue, bat_first, CAST({_MADE} + 1 AS INTEGER) AS predicted_score,
        CAST({_MADE} - 9 AS INTEGER) AS score_low, CAST({_MADE} + 11 AS INTEGER) AS score_high FROM inputs)
JOIN ({VENUE_STATS_SQL.format('(SELECT DISTINCT venue FROM fixtures)')}) USING (venue)""",
                **_ASK_CTES, **par_ctes("fixtures")))
def score_verdicts(spark, sf_dir):
    made = _inputs(spark, sf_dir).withColumn("prediction", F.round("team1_avg_pp_runs") * 4 + 20)
    metadata = spark.range(1).select(
        F.lit(1.0).alias("impact_era_bias"), F.lit(10.0).alias("residual_std_impact_era"), F.lit(9.0).alias("residual_std"))
    stats = par.venue_stats(tables.fixtures(spark, sf_dir))
    return serving.verdict_columns(serving.score_columns(made, metadata), stats).select(
        "team1", "team2", "venue", "bat_first", "predicted_score", "score_low", "score_high",
        "par_score", "venue_matches", "verdict", "favours")


# ---------------------------------------------------------------- parts of the models with an SQL twin

_NUMBERS = ["pp_runs_inn1", "pp_runs_inn2", "innings2_runs", "overs"]
_FILLED = {c: f"coalesce({c}, (SELECT median({c}) FROM duels))::DOUBLE" for c in _NUMBERS}


@register(query(["duels"], f"""
SELECT match_id, {', '.join(f'{near(f"{c}_filled")} AS {c}_filled' for c in _NUMBERS)},
  {', '.join(f'{near(f"({c}_filled - avg({c}_filled) OVER ()) / stddev_samp({c}_filled) OVER ()")} AS {c}_scaled' for c in _NUMBERS)},
  CAST(dense_rank() OVER (ORDER BY coalesce(venue, 'missing')) - 1 AS DOUBLE) AS venue_index,
  CAST(dense_rank() OVER (ORDER BY coalesce(city, 'missing')) - 1 AS DOUBLE) AS city_index
FROM (SELECT match_id, venue, city, {', '.join(f'{x} AS {c}_filled' for c, x in _FILLED.items())} FROM duels)"""))
def prepared_inputs(spark, sf_dir):
    """Median, mean and deviation of numbers and places of categories, as the models see them."""
    kinds = ["venue", "city"]
    rows = models.as_inputs(tables.duels(spark, sf_dir).select("match_id", *kinds, *_NUMBERS), kinds, _NUMBERS)
    out = models.prepare(rows, kinds, _NUMBERS).transform(rows).withColumn("s", vector_to_array("scaled"))
    return rounded(out.select("match_id", *[f"{c}_filled" for c in _NUMBERS],
                              *[F.col("s")[i].alias(f"{c}_scaled") for i, c in enumerate(_NUMBERS)], "venue_index", "city_index"))


def _vectors(rows):
    """Made inputs of a model: two numbers of the match id."""
    n = F.col("match_id").cast("bigint")
    return rows.withColumn("features", array_to_vector(F.array((n % 17).cast("double"), (n % 5).cast("double"))))


@register(query(["duels"], _LINE.replace("AS fold", "AS fold, CAST(1 AS BIGINT) AS predictions"), decided=_DECIDED,
                line="""SELECT label, (row_number() OVER (ORDER BY first_pos, pos) - 1) % 5 AS fold
                        FROM (SELECT *, min(pos) OVER (PARTITION BY label) AS first_pos FROM decided)""",
                ends="""SELECT label, fold, sum(n) OVER (PARTITION BY label ORDER BY fold) AS until
                        FROM (SELECT label, fold, count(*) AS n FROM line GROUP BY ALL)"""))
def out_of_fold_cover(spark, sf_dir):
    """Every row is predicted once, by models that have not seen its fold; linear base learners."""
    spec = replace(models.WINNER, learners=lambda _: {"rf": LogisticRegression(), "gb": LogisticRegression(regParam=0.1)})
    ready = written(_vectors(training.stratified_folds(_decided(spark, sf_dir))).select("match_id", "label", "features", "fold"), "cover")
    rows = models.out_of_fold(spec, ready, models.Sizes())
    return rows.where("base_rf IS NOT NULL AND base_gb IS NOT NULL").groupBy("match_id", "fold").agg(F.count(F.lit(1)).alias("predictions"))


_BASE_SQL = """SELECT innings1_runs::DOUBLE AS y, (CAST(match_id AS BIGINT) % 83)::DOUBLE AS a,
  (innings1_runs + CAST(match_id AS BIGINT) % 31)::DOUBLE AS b FROM duels"""
# The closed form of two centred columns: (C + I / n) w = c, with C and c covariances over the rows.
_RIDGE = """SELECT (va + 1.0::DOUBLE / n) AS p, vab AS q, (vb + 1.0::DOUBLE / n) AS r, cy_a AS s, cy_b AS t, ma, mb, my FROM (
  SELECT count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS vab, covar_pop(a, y) AS cy_a, covar_pop(b, y) AS cy_b,
    avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM base)"""


@register(query(["duels"], f"""
SELECT {near('wa')} AS weight_rf, {near('wb')} AS weight_gb, {near('my - wa * ma - wb * mb')} AS intercept
FROM (SELECT *, (s * r - t * q) / (p * r - q * q) AS wa, (t * p - s * q) / (p * r - q * q) AS wb FROM ridge)""",
                base=_BASE_SQL, ridge=_RIDGE))
def stacking_meta(spark, sf_dir):
    """The ridge regression above made base predictions."""
    n = F.col("match_id").cast("bigint")
    rows = tables.duels(spark, sf_dir).select(
        F.col("innings1_runs").cast("double").alias("label"), (n % 83).cast("double").alias("base_rf"),
        (F.col("innings1_runs") + n % 31).cast("double").alias("base_gb"))
    meta = models.fit_meta(rows, ["rf", "gb"], classifies=False)
    a, b = meta.coefficients.toArray().tolist()
    return rounded(spark.range(1).select(F.lit(a).alias("weight_rf"), F.lit(b).alias("weight_gb"), F.lit(float(meta.intercept)).alias("intercept")))


# ---------------------------------------------------------------- models

def _table(spark, sf_dir, which, tabs=None):
    make = training.winner_table if which is models.WINNER else training.score_table
    return written(make(*(tabs or _features(spark, sf_dir))), f"{which.name}-table")


_fitted: dict[tuple[str, str, str], str] = {}


def _trained(spark, sf_dir, spec, table):
    """The model fitted on everything before the hold-out: trained once a session, then read from where it was saved."""
    key = (spark.sparkContext.applicationId, sf_dir, spec.name)
    if key not in _fitted:
        path = written_path(spark, f"{spec.name}-model")
        models.fit(spec, training.split(table)[0]).save(path)
        _fitted[key] = path
    return models.StackedModel.load(spec.name, _fitted[key])


def _held(spark, sf_dir, spec, tabs=None):
    """The training table, and the model's predictions of its hold-out."""
    table = _table(spark, sf_dir, spec, tabs)
    return table, written(_trained(spark, sf_dir, spec, table).transform(training.split(table)[1]), f"{spec.name}-test")


@register()
def winner_model(spark, sf_dir):
    """The stacked winner model on the hold-out."""
    return _held(spark, sf_dir, models.WINNER)[1].select("match_id", "label", "probability", "prediction")


@register()
def score_model(spark, sf_dir):
    return _held(spark, sf_dir, models.SCORE)[1].select("match_id", "label", "prediction")


@register()
def model_importances(spark, sf_dir):
    table = _table(spark, sf_dir, models.WINNER)
    return models.fit_base(models.WINNER, training.split(table)[0]).importances(table, 20)


@register()
def score_importances(spark, sf_dir):
    table = _table(spark, sf_dir, models.SCORE)
    return models.fit_base(models.SCORE, training.split(table)[0]).importances(table, 15)


@register(query(["fixtures"], """
SELECT 34 + count(DISTINCT team1) + count(DISTINCT team2) AS features, true AS names_differ, true AS sum_is_one, true AS none_is_negative
FROM ft WHERE team1_won IS NOT NULL AND date < DATE '2023-01-01'""", **_CTES))
def importance_names(spark, sf_dir):
    """The full list of importances: a name per number and per known team, and the shape of the weights."""
    table = _table(spark, sf_dir, models.WINNER)
    weights = models.fit_base(models.WINNER, training.split(table)[0]).importances(table)
    return weights.agg(
        F.count(F.lit(1)).alias("features"), (F.count_distinct("feature") == F.count(F.lit(1))).alias("names_differ"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("sum_is_one"), (F.min("importance") >= 0).alias("none_is_negative"))


@register(query(["fixtures"], f"""
SELECT match_id, innings1_runs::DOUBLE AS label, true AS agree FROM fixtures WHERE innings1_runs IS NOT NULL AND {_HELD.split(' AS ')[0]}"""))
def model_round_trip(spark, sf_dir):
    """A model saved, read, saved and read again predicts the same for every match of the hold-out."""
    table = _table(spark, sf_dir, models.SCORE)
    test = training.split(table)[1]
    first = _trained(spark, sf_dir, models.SCORE, table)
    path = written_path(spark, "score-model-again")
    first.save(path)
    again = models.StackedModel.load("score", path)
    both = first.transform(test).withColumnRenamed("prediction", "before").select("match_id", "label", "before")
    both = both.join(again.transform(test).select("match_id", "prediction"), "match_id")
    return both.select("match_id", "label", (F.col("before") == F.col("prediction")).alias("agree"))


def _validated(spark, sf_dir, spec):
    """The training table, predictions of its hold-out, and the cross-validated scores."""
    table = _table(spark, sf_dir, spec)
    train, test = training.split(table)
    model, cv = models.fit_and_validate(spec, train)
    return table, written(model.transform(test), f"{spec.name}-test"), models.cv_summary(cv)


@register()
def winner_cross_validation(spark, sf_dir):
    """Accuracy of the stacked winner model on each fold of the rows before the hold-out."""
    return models.cross_validate(models.WINNER, training.split(_table(spark, sf_dir, models.WINNER))[0])


@register()
def score_cross_validation(spark, sf_dir):
    return models.cross_validate(models.SCORE, training.split(_table(spark, sf_dir, models.SCORE))[0])


@register()
def winner_evaluation(spark, sf_dir):
    """Classification report, area under the curve and the gap to cross-validation, all of real predictions, one value a row."""
    table, scored, summary = _validated(spark, sf_dir, models.WINNER)
    gap = metrics.overfit_check(summary, metrics.accuracy(scored))
    report = metrics.classification_report(scored)
    rows = [report.select(F.lit("report").alias("part"), F.concat_ws(" ", "class", F.lit(c)).alias("name"), F.col(c).cast("double").alias("value"))
            for c in ("precision", "recall", "f1", "support")]
    rows.append(metrics.auc(scored).select(F.lit("roc").alias("part"), F.lit("auc").alias("name"), F.col("auc").alias("value")))
    rows += [gap.select(F.lit("overfit").alias("part"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in gap.columns]
    return reduce(DataFrame.unionByName, rows)


@register()
def score_evaluation(spark, sf_dir):
    """Regression report and residual metadata of real predictions, with the cross-validated error, one value a row."""
    table, scored, summary = _validated(spark, sf_dir, models.SCORE)
    parts = {"report": metrics.regression_report(scored), "metadata": metrics.residual_metadata(scored, table, summary)}
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(part).alias("part"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for part, df in parts.items() for c in df.columns])


def _predictions(spark, sf_dir):
    tabs = _features(spark, sf_dir)
    (table, scored), winner = models.side_by_side(spark, [  # the two models do not wait for each other
        partial(_held, spark, sf_dir, models.SCORE, tabs),
        lambda: _trained(spark, sf_dir, models.WINNER, _table(spark, sf_dir, models.WINNER, tabs))], 2)
    unknown = spark.range(1).select(F.lit(None).cast("double").alias("cv_mean"))  # no cross-validation is run here
    metadata = metrics.residual_metadata(scored, table, unknown)
    score = _trained(spark, sf_dir, models.SCORE, table)
    return serving.predict(_asked(spark, sf_dir, tabs[0]), *tabs, winner, score, metadata, homes=tables.FIXTURE_HOMES)


@register()
def fixture_predictions(spark, sf_dir):
    """Both models, trained on everything before the hold-out, applied to all asked fixtures."""
    return _predictions(spark, sf_dir)


@register(query(["fixtures"], f"""
SELECT team1, team2, venue, bat_first, par_score, true AS winner_plays, true AS in_range, true AS percent, true AS verdict_fits
FROM asked JOIN ({VENUE_STATS_SQL.format('(SELECT DISTINCT venue FROM fixtures)')}) USING (venue)""", **_ASK_CTES, **par_ctes("fixtures")))
def prediction_invariants(spark, sf_dir):
    """What holds for every prediction whatever the models say; teams, venue and par exactly."""
    p = _predictions(spark, sf_dir)
    verdict = F.when(F.col("predicted_score") > F.col("par_score"), "above par").when(F.col("predicted_score") < F.col("par_score"), "below par").otherwise("at par")
    return p.select(
        "team1", "team2", "venue", "bat_first", "par_score", F.col("winner").isin(F.col("team1"), F.col("team2")).alias("winner_plays"),
        F.col("predicted_score").between(F.col("score_low"), F.col("score_high")).alias("in_range"),
        F.col("win_pct").between(50, 100).alias("percent"), (F.col("verdict") == verdict).alias("verdict_fits"))
