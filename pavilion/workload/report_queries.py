"""Reports and par scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import TARGET_BANDS
from ..operators import cube, par, reports
from ..operators.innings import running_totals
from ..sources.tables import with_season_year
from ..session import written
from . import tables
from .registry import register, rounded
from .sql_views import even, near, query

_YEAR = "CAST(season[1:4] AS INTEGER)"
_PHASE = "CASE WHEN over <= 6 THEN 'Powerplay' WHEN over <= 15 THEN 'Middle' ELSE 'Death' END"
_KNOWN = "SELECT team1 AS team FROM {0} UNION SELECT team2 FROM {0}"


def _seasons(spark, sf_dir):
    return with_season_year(tables.duels(spark, sf_dir))


@register(query(["duels"], f"SELECT {_YEAR} AS season_year, count(*) AS matches FROM duels WHERE season IS NOT NULL GROUP BY 1"))
def matches_per_season(spark, sf_dir):
    return reports.matches_per_season(_seasons(spark, sf_dir))


@register(query(["duels"], f"""
SELECT CASE WHEN grouping(toss_decision) = 1 THEN 'Overall' WHEN toss_decision = 'bat' THEN 'Bat' ELSE 'Field' END AS decision,
  {near("avg(CASE WHEN toss_winner = winner THEN 1 ELSE 0 END) * 100")} AS win_pct, count(*) AS matches
FROM duels WHERE winner IS NOT NULL AND toss_winner IS NOT NULL GROUP BY ROLLUP (toss_decision)"""))
def toss_effect(spark, sf_dir):
    return rounded(reports.toss_effect(tables.duels(spark, sf_dir)))


@register(query(["balls"], f"""
SELECT batter, CAST(sum(batter_runs) AS BIGINT) AS runs, count(*) AS balls, count(*) FILTER (batter_runs = 4) AS fours,
  count(*) FILTER (batter_runs = 6) AS sixes, {even('sum(batter_runs) / count(*)::DOUBLE * 100', 1)} AS strike_rate
FROM balls WHERE wides = 0 GROUP BY batter ORDER BY runs DESC, batter LIMIT 15"""))
def top_batters(spark, sf_dir):
    return reports.top_batters(tables.balls(spark, sf_dir))


@register(query(["balls"], f"""
SELECT bowler, CAST(sum(is_wicket) AS BIGINT) AS wickets, count(*) AS balls, CAST(sum(total_runs) AS BIGINT) AS runs,
  {even('sum(total_runs) / (count(*) / 6.0::DOUBLE)', 2)} AS economy
FROM balls GROUP BY bowler ORDER BY wickets DESC, bowler LIMIT 15"""))
def top_bowlers(spark, sf_dir):
    return reports.top_bowlers(tables.balls(spark, sf_dir))


@register(query(["balls"], f"SELECT innings, over, {near('avg(total_runs)')} AS avg_runs FROM balls GROUP BY ALL"))
def runs_by_over(spark, sf_dir):
    return rounded(reports.runs_by_over(tables.balls(spark, sf_dir)))

_GRID = "(SELECT unnest([1, 2]) AS innings) CROSS JOIN (SELECT unnest(generate_series(1, 20)) AS over)"


@register(query(["balls"], f"""
SELECT innings, over, coalesce(w, 0) AS wickets,
  {near('coalesce(w, 0) / (SELECT count(DISTINCT match_id) FROM balls)::DOUBLE')} AS wickets_per_match
FROM {_GRID} LEFT JOIN (SELECT innings, over, count(*) AS w FROM balls WHERE is_wicket = 1 GROUP BY ALL) USING (innings, over)"""))
def wickets_by_over(spark, sf_dir):
    return rounded(reports.wickets_by_over(tables.balls(spark, sf_dir)))


@register(query(["balls"], f"""
SELECT innings, over, CAST(runs AS BIGINT) AS runs, {near('''avg(runs) OVER (PARTITION BY innings ORDER BY over ROWS 1 PRECEDING)
  / (SELECT count(DISTINCT match_id) FROM balls)::DOUBLE''')} AS rolling_rate
FROM (SELECT innings, over, coalesce(r, 0) AS runs FROM {_GRID}
  LEFT JOIN (SELECT innings, over, sum(total_runs) AS r FROM balls GROUP BY ALL) USING (innings, over))"""))
def score_acceleration(spark, sf_dir):
    return rounded(reports.score_acceleration(tables.balls(spark, sf_dir)))


@register(query(["balls"], "SELECT count(DISTINCT match_id) AS matches FROM balls"))
def distinct_matches(spark, sf_dir):
    return reports.match_count(tables.balls(spark, sf_dir))

def _histogram_sql(table: str, series: dict[str, str], bins: int) -> str:
    part = """SELECT '{s}' AS series, CAST(bin AS INTEGER) AS bin, {lo} AS bin_from, {hi} AS bin_to,
  (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL AND
     ({c} >= lo + (bin - 1) * (hi - lo) / {n} OR bin = 1) AND ({c} < lo + bin * (hi - lo) / {n} OR bin = {n})) AS frequency,
  {mean} AS mean, {median} AS median, total
FROM (SELECT unnest(generate_series(1, {n})) AS bin), st_{s}"""
    return " UNION ALL ".join(
        part.format(s=s, c=c, t=table, n=bins, lo=near(f"lo + (bin - 1) * ((hi - lo) / {bins})"),
                    hi=near(f"lo + bin * ((hi - lo) / {bins})"), mean=near("mean"), median=near("median"))
        for s, c in series.items())


def _histogram_ctes(table: str, series: dict[str, str]) -> dict[str, str]:
    return {
        f"st_{s}": f"""SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, avg({c}) AS mean,
  median({c}) AS median, count({c}) AS total FROM {table}""" for s, c in series.items()}


_SCORES = {"innings1": "innings1_runs", "innings2": "innings2_runs"}
_MARGINS = {"runs": "win_by_runs", "wickets": "win_by_wickets"}


@register(query(["duels"], _histogram_sql("duels", _SCORES, 25), **_histogram_ctes("duels", _SCORES)))
def score_distribution(spark, sf_dir):
    return rounded(reports.score_distribution(tables.duels(spark, sf_dir)))


@register(query(["duels"], _histogram_sql("duels", _MARGINS, 20), **_histogram_ctes("duels", _MARGINS)))
def win_margins(spark, sf_dir):
    return rounded(reports.win_margins(tables.duels(spark, sf_dir)))


@register(query(["duels"], f"""
SELECT winner AS team, count(*) AS wins FROM duels WHERE winner IN ({_KNOWN.format('duels')}) GROUP BY 1"""))
def team_wins(spark, sf_dir):
    return reports.team_wins(tables.duels(spark, sf_dir))


@register(query(["duels"], f"SELECT team FROM ({_KNOWN.format('duels')}) WHERE team IS NOT NULL"))
def franchise_list(spark, sf_dir):
    return reports.franchises(tables.duels(spark, sf_dir))


@register(query(["balls"], f"""
SELECT wicket_kind, count(*) AS wickets, {near('count(*) / sum(count(*)) OVER ()::DOUBLE * 100')} AS share_pct
FROM balls WHERE is_wicket = 1 AND wicket_kind IS NOT NULL GROUP BY 1"""))
def dismissal_mix(spark, sf_dir):
    return rounded(reports.dismissal_mix(tables.balls(spark, sf_dir)))

_POINTS = f"""SELECT match_id, innings1_runs, {_YEAR} AS season_year, pp_runs FROM fixtures JOIN
  (SELECT match_id, sum(total_runs) AS pp_runs FROM balls WHERE in_powerplay = 1 AND innings = 1 GROUP BY 1) USING (match_id)
  WHERE innings1_runs IS NOT NULL AND season IS NOT NULL"""


def _points(spark, sf_dir):
    matches = with_season_year(tables.fixtures(spark, sf_dir))
    return reports.powerplay_points(matches, tables.balls(spark, sf_dir))


@register(query(["fixtures"], f"""SELECT * REPLACE (CAST(pp_runs AS BIGINT) AS pp_runs,
  CAST(innings1_runs AS BIGINT) AS innings1_runs) FROM ({_POINTS})"""))
def powerplay_points(spark, sf_dir):
    return _points(spark, sf_dir)


@register(query(["fixtures"], f"""
SELECT {near('regr_slope(innings1_runs, pp_runs)')} AS slope, {near('regr_intercept(innings1_runs, pp_runs)')} AS intercept,
  CAST(min(pp_runs) AS BIGINT) AS pp_from, CAST(max(pp_runs) AS BIGINT) AS pp_to, count(*) AS matches FROM ({_POINTS})"""))
def powerplay_trend(spark, sf_dir):
    return rounded(reports.powerplay_trend(_points(spark, sf_dir)))

_CORR_INPUT = """SELECT match_id, innings1_runs, innings2_runs, innings1_wickets, innings2_wickets, pp_runs_inn1, death_runs_inn1,
  CASE WHEN toss_decision = 'bat' THEN 1 ELSE 0 END AS toss_bat_first,
  CASE WHEN winner = team1 THEN 1 ELSE 0 END AS team1_won
FROM fixtures LEFT JOIN (SELECT match_id, sum(total_runs) FILTER (in_powerplay = 1) AS pp_runs_inn1,
  sum(total_runs) FILTER (over >= 17) AS death_runs_inn1 FROM balls WHERE innings = 1 GROUP BY 1) USING (match_id)"""


@register(query(["fixtures"], " UNION ALL ".join(
    f"SELECT '{a}' AS row, '{b}' AS col, {near(f'corr({a}, {b})')} AS r FROM ci"
    for a in reports.CORRELATED for b in reports.CORRELATED), ci=_CORR_INPUT))
def correlation_matrix(spark, sf_dir):
    df = reports.correlation_input(tables.fixtures(spark, sf_dir), tables.balls(spark, sf_dir))
    return rounded(reports.correlation_matrix(df, reports.CORRELATED))

# The same over duels: many NULLs, so every pair has its own rows.
_NULLY = ["innings1_runs", "innings2_runs", "innings2_wickets", "pp_runs_inn1", "death_wickets_inn2", "win_by_runs"]


@register(query(["duels"], " UNION ALL ".join(
    f"SELECT '{a}' AS row, '{b}' AS col, {near(f'corr({a}, {b})')} AS r FROM duels" for a in _NULLY for b in _NULLY)))
def correlation_with_gaps(spark, sf_dir):
    return rounded(reports.correlation_matrix(tables.duels(spark, sf_dir), _NULLY))

_BAND = "CASE " + " ".join(f"WHEN target >= {lo} AND target < {hi} THEN '{n}'" for n, lo, hi in TARGET_BANDS) + " END"
_BAND_ORDER = "CASE band " + " ".join(f"WHEN '{b[0]}' THEN {i}" for i, b in enumerate(TARGET_BANDS, 1)) + " END"


@register(query(["duels"], f"""
SELECT band, {near('avg(won) * 100')} AS win_pct, count(*) AS matches, {_BAND_ORDER} AS band_order FROM (
  SELECT {_BAND} AS band, won FROM (SELECT innings1_runs + 1 AS target,
    CASE WHEN winner = innings2_team THEN 1 ELSE 0 END AS won FROM duels
    WHERE winner IS NOT NULL AND innings2_team IS NOT NULL)) WHERE band IS NOT NULL GROUP BY band"""))
def chase_success(spark, sf_dir):
    return rounded(reports.chase_success(tables.duels(spark, sf_dir)))


@register(query(["running_balls"], f"""
SELECT CAST(wickets_before AS INTEGER) AS wickets_before, {', '.join(f"{near(f'avg(total_runs) FILTER (over = {o})')} AS over_{o}" for o in range(1, 21))}
FROM (SELECT unnest(generate_series(0, 9)) AS wickets_before) LEFT JOIN
  (SELECT *, least(greatest(cumulative_wickets - is_wicket, 0), 9) AS wb FROM running_balls WHERE innings = 1) ON wb = wickets_before
GROUP BY 1"""))
def pressure_grid(spark, sf_dir):
    return rounded(reports.pressure_grid(running_totals(tables.balls(spark, sf_dir))))


@register(query(["balls"], f"""
SELECT bowler, phase, CAST(phase_order AS INTEGER) AS phase_order, {near('runs / balls::DOUBLE * 6')} AS economy, {near('all_runs / all_balls::DOUBLE * 6')} AS overall_economy
FROM (SELECT bowler, sum(total_runs) AS all_runs, count(*) AS all_balls FROM balls GROUP BY 1 ORDER BY all_balls DESC, bowler LIMIT 20)
CROSS JOIN (VALUES ('Powerplay', 1), ('Middle', 2), ('Death', 3)) p(phase, phase_order)
LEFT JOIN (SELECT bowler, {_PHASE} AS phase, sum(total_runs) AS runs, count(*) AS balls FROM balls GROUP BY ALL) USING (bowler, phase)"""))
def economy_by_phase(spark, sf_dir):
    return rounded(reports.economy_by_phase(tables.balls(spark, sf_dir)))

_STANDS = """SELECT match_id, wicket_num, sum(total_runs) AS runs, max(is_wicket) AS ended FROM (
  SELECT *, 1 + coalesce(sum(is_wicket) OVER (PARTITION BY match_id ORDER BY over, ball
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wicket_num FROM balls WHERE innings = 1)
  GROUP BY ALL HAVING (max(is_wicket) = 1 OR sum(total_runs) > 0) AND wicket_num <= 10"""


@register(query(["balls"], f"""SELECT match_id, CAST(wicket_num AS INTEGER) AS wicket_num, CAST(runs AS BIGINT) AS runs, ended
FROM ({_STANDS})"""))
def partnership_rows(spark, sf_dir):
    return reports.partnerships(tables.balls(spark, sf_dir))


@register(query(["balls"], f"""
SELECT CAST(wicket_num AS INTEGER) AS wicket_num, {near('avg(runs)')} AS mean_runs, {near('median(runs)')} AS median_runs,
  count(*) AS partnerships FROM ({_STANDS}) GROUP BY 1"""))
def partnership_summary(spark, sf_dir):
    return rounded(reports.partnership_summary(tables.balls(spark, sf_dir)))


@register(query(["fixtures"], f"""
SELECT bowling_team AS team, {near('avg(extras)')} AS avg_per_match, CAST(sum(extras) AS BIGINT) AS total, count(*) AS matches
FROM (SELECT match_id, bowling_team, sum(wides) + sum(noballs) AS extras FROM balls GROUP BY ALL)
WHERE bowling_team IN ({_KNOWN.format('fixtures')}) GROUP BY 1"""))
def extras_leakage(spark, sf_dir):
    return rounded(reports.extras_leakage(tables.balls(spark, sf_dir), tables.fixtures(spark, sf_dir)))


@register(query(["balls"], f"""
SELECT phase, CAST(CASE phase WHEN 'Powerplay' THEN 1 WHEN 'Middle' THEN 2 ELSE 3 END AS INTEGER) AS phase_order,
  {near('count(*) FILTER (batter_runs = 0) / count(*)::DOUBLE * 100')} AS dot_pct,
  {near('count(*) FILTER (batter_runs BETWEEN 1 AND 3) / count(*)::DOUBLE * 100')} AS running_pct,
  {near('count(*) FILTER (batter_runs BETWEEN 4 AND 6) / count(*)::DOUBLE * 100')} AS boundary_pct
FROM (SELECT {_PHASE} AS phase, batter_runs FROM balls WHERE wides = 0 AND batter_runs <= 6) GROUP BY phase"""))
def scoring_zones(spark, sf_dir):
    return rounded(reports.scoring_zones(tables.balls(spark, sf_dir)))

# ---------------------------------------------------------------- par scores

_PAR_CTES = {
    "decided": """SELECT *, CASE WHEN innings1_team = winner THEN 1 ELSE 0 END AS bfw FROM {0}
  WHERE innings1_runs IS NOT NULL AND winner IS NOT NULL""",
    # A scope is one venue, or NULL for all matches.
    "scoped": "SELECT venue AS scope, * FROM decided WHERE venue IS NOT NULL UNION ALL SELECT NULL, * FROM decided",
    "buckets": """SELECT scope, innings1_runs // 10 * 10 AS bucket, avg(bfw) AS rate FROM scoped GROUP BY ALL""",
    "steps": "SELECT *, lead(rate) OVER (PARTITION BY scope ORDER BY bucket) AS nxt FROM buckets",
    "crossings": """SELECT scope, arg_min(round_even(bucket + 10 * CASE WHEN nxt = rate THEN 0.5::DOUBLE
  ELSE (0.5::DOUBLE - rate) / (nxt - rate) END, 0), bucket) AS crossing
  FROM steps WHERE rate <= 0.5 AND nxt >= 0.5 GROUP BY scope""",
    "pars": """SELECT s.scope, count(*) AS n, CAST(coalesce(max(crossing),
    round_even(median(innings1_runs) FILTER (bfw = 1), 0), 167) AS INTEGER) AS par,
  avg(innings1_runs) AS avg_first, avg(innings2_runs) AS avg_second, avg(bfw) * 100 AS bat_first
  FROM scoped s LEFT JOIN crossings c ON c.scope IS NOT DISTINCT FROM s.scope GROUP BY s.scope""",
}


def par_ctes(source: str) -> dict[str, str]:
    return {k: v.format(source) for k, v in _PAR_CTES.items()}

_ALL = "(SELECT * FROM pars WHERE scope IS NULL)"
_PAR_SCORES = f"""SELECT p.scope AS venue, p.n AS venue_matches, CASE WHEN p.n >= 10 THEN p.par ELSE g.par END AS par_score,
  p.n >= 10 AS is_venue_specific FROM pars p, {_ALL} g WHERE p.scope IS NOT NULL"""


@register(query(["duels"], _PAR_SCORES, **par_ctes("duels")))
def par_scores(spark, sf_dir):
    return par.par_scores(tables.duels(spark, sf_dir))

# Fixtures split by side and season: many venues, some below ten matches.
_SPARSE = "SELECT * REPLACE (venue || '-' || team1 AS venue) FROM fixtures"


@register(query(["fixtures"], _PAR_SCORES, sparse=_SPARSE, **par_ctes("sparse")))
def par_scores_sparse(spark, sf_dir):
    return par.par_scores(_sparse(spark, sf_dir))

def _sparse(spark, sf_dir):
    return tables.fixtures(spark, sf_dir).withColumn("venue", F.concat_ws("-", "venue", "team1"))


@register(query(["duels"], f"SELECT par AS par_score FROM {_ALL}", **par_ctes("duels")))
def global_par(spark, sf_dir):
    return par.global_par(tables.duels(spark, sf_dir))

VENUE_STATS_SQL = f"""SELECT v.venue, CASE WHEN coalesce(p.n, 0) >= 10 THEN p.par ELSE g.par END AS par_score,
  coalesce(p.n, 0) >= 10 AS is_venue_specific, coalesce(p.n, 0) AS venue_matches,
  {even('CASE WHEN coalesce(p.n, 0) >= 10 THEN p.avg_first ELSE g.avg_first END', 1)} AS avg_first_innings,
  {even('CASE WHEN coalesce(p.n, 0) >= 10 THEN p.avg_second ELSE g.avg_second END', 1)} AS avg_second_innings,
  {even('CASE WHEN coalesce(p.n, 0) >= 10 THEN p.bat_first ELSE g.bat_first END', 1)} AS bat_first_win_pct
FROM {{0}} v LEFT JOIN pars p ON p.scope = v.venue CROSS JOIN {_ALL} g"""


@register(query(["fixtures"], VENUE_STATS_SQL.format("(SELECT DISTINCT venue FROM sparse UNION ALL SELECT 'nowhere')"),
                sparse=_SPARSE, **par_ctes("sparse")))
def venue_batting_stats(spark, sf_dir):
    matches = _sparse(spark, sf_dir)
    asked = matches.select("venue").union(matches.select(F.lit("nowhere")))
    return par.venue_stats(matches, asked)


@register(query(["fixtures"], f"""
SELECT venue, par_score, CASE WHEN all_matches >= 10 THEN '' ELSE '(global)' END AS note, all_matches
FROM ({_PAR_SCORES}) JOIN (SELECT venue, count(*) AS all_matches FROM sparse GROUP BY 1) USING (venue)""",
                sparse=_SPARSE, **par_ctes("sparse")))
def par_listing(spark, sf_dir):
    return par.par_listing(_sparse(spark, sf_dir))


# The same sets of keys in SQL; a set is told by the keys that are left out of it.
_CUBE_KEYS = ", ".join(cube.KEYS)
_CUBE_SETS = ", ".join(f"({', '.join(keys)})" for keys in cube.SETS.values())
_CUBE_BY = " ".join(
    f"WHEN {sum(1 << (len(cube.KEYS) - 1 - i) for i, k in enumerate(cube.KEYS) if k not in keys)} THEN '{name}'" for name, keys in cube.SETS.items())
_COUNTS = {
    "balls": "count(total_runs)", "fallen": "count(*) FILTER (is_wicket = 1)", "legal": "count(*) FILTER (wides = 0)",
    "bat_balls": "count(batter_runs) FILTER (wides = 0)", "fours": "count(*) FILTER (wides = 0 AND batter_runs = 4)",
    "sixes": "count(*) FILTER (wides = 0 AND batter_runs = 6)", "first_balls": "count(*) FILTER (innings = 1)",
    "pp_balls": "count(*) FILTER (innings = 1 AND in_powerplay = 1)",
    "runs": "sum(total_runs)", "wickets": "sum(is_wicket)", "bat_runs": "sum(batter_runs) FILTER (wides = 0)", "wides": "sum(wides)",
    "noballs": "sum(noballs)", "pp_runs": "sum(total_runs) FILTER (innings = 1 AND in_powerplay = 1)",
    "death_runs": "sum(total_runs) FILTER (innings = 1 AND over >= 17)",
}


@register(query(["running_balls"], f"""
SELECT CASE grouping({_CUBE_KEYS}) {_CUBE_BY} END AS by, {_CUBE_KEYS}, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in _COUNTS.items())}
FROM (SELECT *, CAST(least(greatest(cumulative_wickets - is_wicket, 0), 9) AS INTEGER) AS wickets_before,
        CASE WHEN batter_runs = 0 THEN 'dot' WHEN batter_runs BETWEEN 1 AND 3 THEN 'running' WHEN batter_runs BETWEEN 4 AND 6 THEN 'boundary' END AS zone
      FROM running_balls)
GROUP BY GROUPING SETS ({_CUBE_SETS})"""))
def ball_cube(spark, sf_dir):
    """Everything the reports need of the balls, in one pass."""
    return cube.ball_cube(running_totals(tables.balls(spark, sf_dir)))


@register(query(["running_balls"], f"""
SELECT innings, over, {near('runs_for_mean / n::DOUBLE')} AS avg_runs, w AS wickets, {near('w / m::DOUBLE')} AS wickets_per_match
FROM (SELECT innings, over, sum(total_runs) AS runs_for_mean, count(*) AS n, count(*) FILTER (is_wicket = 1) AS w,
        (SELECT count(DISTINCT match_id) FROM running_balls) AS m FROM running_balls WHERE innings IN (1, 2) GROUP BY ALL)"""))
def overs_from_cube(spark, sf_dir):
    """Two reports answered by the written cube alone."""
    balls = running_totals(tables.balls(spark, sf_dir))
    parts = cube.parts_of(written(cube.ball_cube(balls), "ball-cube"))
    overs = parts["matches"].join(F.broadcast(parts["wickets_by_over"]), F.lit(True), "left")  # one row, and one per over of the game
    both = reports.runs_by_over(balls, parts["runs_by_over"]).join(reports.wickets_by_over(balls, overs), ["innings", "over"])
    return rounded(both)
