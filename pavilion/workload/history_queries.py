"""Look-back features; the SQL twins are plain joins with all earlier rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from ..operators.match_rows import with_result
from ..operators.players import BATTING_CAREER, BOWLING_CAREER, batting_features, bowling_features, career_before, team_strength
from ..operators.timeline import by_date, placed
from ..plans import jobs
from ..plans.features import match_features
from ..schemas import DELIVERIES, MATCHES
from ..session import written
from ..sources.tables import write_table
from . import tables
from .ingest_queries import BATTING_SQL, BOWLING_SQL, PHASE_SQL, written_path
from .registry import register, rounded
from .sql_views import near, query


def _duels(spark, sf_dir):
    return placed(with_result(tables.duels(spark, sf_dir)), by_date(), label="duels")


def _with_id(rows, features):
    return rounded(rows.select("seq", "match_id").join(features, "seq").drop("seq"))


# h: matches with their position; every twin below reads it.
_H = """SELECT *, CASE WHEN winner = team1 THEN 1 WHEN winner = team2 THEN 0 END AS team1_won,
  row_number() OVER (ORDER BY date ASC NULLS LAST, match_id ASC) AS seq FROM {0}"""
_SIDES = "SELECT seq, 1 AS side, team1 AS team FROM h UNION ALL SELECT seq, 2, team2 FROM h"
_WON = "CASE WHEN {0}.team1 = {1} AND {0}.team1_won = 1 THEN 1 WHEN {0}.team2 = {1} AND {0}.team1_won = 0 THEN 1 ELSE 0 END"

_H2H = f"""SELECT a.seq, count(b.seq) AS met, coalesce(sum({_WON.format('b', 'a.team1')}) FILTER (b.seq IS NOT NULL), 0) AS won
FROM h a LEFT JOIN h b ON b.seq < a.seq AND least(b.team1, b.team2) = least(a.team1, a.team2)
  AND greatest(b.team1, b.team2) = greatest(a.team1, a.team2) GROUP BY a.seq"""
_H2H_COLUMNS = f"""met AS h2h_matches, CAST(won AS BIGINT) AS h2h_team1_wins,
  CASE WHEN met = 0 THEN 0.5 ELSE {near('won / met::DOUBLE')} END AS h2h_team1_win_rate"""

_VENUE = f"""SELECT s.seq, s.side, avg({_WON.format('b', 's.team')}) AS rate
FROM sides s JOIN h a ON a.seq = s.seq
JOIN h b ON b.venue = a.venue AND b.seq < s.seq AND (b.team1 = s.team OR b.team2 = s.team) GROUP BY ALL"""


def _latest(events: str, n: int, order: str) -> str:
    """Mean of a side's last n events before each match."""
    return f"""SELECT seq, side, avg(v) AS v FROM (
      SELECT s.seq, s.side, e.v, row_number() OVER (PARTITION BY s.seq, s.side ORDER BY {order}) AS rn
      FROM sides s JOIN ({events}) e ON e.team = s.team AND e.seq < s.seq) WHERE rn <= {n} GROUP BY ALL"""


_FORM_EVENTS = f"""SELECT seq, team1 AS team, {_WON.format('h', 'team1')} AS v FROM h
  UNION ALL SELECT seq, team2, {_WON.format('h', 'team2')} FROM h"""
_BF_EVENTS = f"SELECT seq, innings1_team AS team, {_WON.format('h', 'innings1_team')} AS v FROM h"
_PP_EVENTS = """SELECT seq, innings1_team AS team, 1 AS kind, pp_runs_inn1 AS v FROM h WHERE pp_runs_inn1 IS NOT NULL
  UNION ALL SELECT seq, innings2_team, 2, pp_runs_inn2 FROM h WHERE pp_runs_inn2 IS NOT NULL"""
_DW_EVENTS = """SELECT seq, innings2_team AS team, 1 AS kind, death_wickets_inn1 AS v FROM h WHERE death_wickets_inn1 IS NOT NULL
  UNION ALL SELECT seq, innings1_team, 2, death_wickets_inn2 FROM h WHERE death_wickets_inn2 IS NOT NULL"""
_SEASON = """SELECT seq, row_number() OVER (PARTITION BY season ORDER BY seq) AS number,
  count(*) OVER (PARTITION BY season) AS size FROM h WHERE season IS NOT NULL"""


def history_ctes(source: str, chronological: bool = False) -> dict[str, str]:
    order = "e.seq DESC" if chronological else "e.kind DESC, e.seq DESC"
    return {
        "h": _H.format(source), "sides": _SIDES, "met": _H2H, "at_venue": _VENUE,
        "form": _latest(_FORM_EVENTS, 5, "e.seq DESC"), "bat_first": _latest(_BF_EVENTS, 10, "e.seq DESC"),
        "pp": _latest(_PP_EVENTS, 10, order), "dw": _latest(_DW_EVENTS, 10, order), "in_season": _SEASON,
    }


def _value(cte: str, side: int, default: float, column: str = "v") -> str:
    return f"(SELECT coalesce({near(f'max({column})')}, {default}) FROM {cte} x WHERE x.seq = h.seq AND x.side = {side})"


_RECORD_COLUMNS = ", ".join(
    f"{_value(cte, side, default)} AS team{side}_{name}"
    for cte, name, default in (("form", "recent_form", 0.5), ("bat_first", "win_after_batting_first", 0.5),
                               ("pp", "avg_pp_runs", 45.0), ("dw", "avg_death_wkts", 2.0))
    for side in (1, 2))
_VENUE_COLUMNS = ", ".join(
    f"{_value('at_venue', side, 0.5, 'rate')} AS team{side}_venue_win_rate" for side in (1, 2))
_SEASON_COLUMNS = f"""CAST(number AS INTEGER) AS season_match_number, {near('number / size::DOUBLE')} AS season_progress"""


def _only(*names: str, source: str = "duels", **kw) -> dict[str, str]:
    return {k: v for k, v in history_ctes(source, **kw).items() if k in ("h", "sides", *names)}


@register(query(["duels"], f"SELECT match_id, {_H2H_COLUMNS} FROM h JOIN met USING (seq)", **_only("met")))
def head_to_head(spark, sf_dir):
    rows = _duels(spark, sf_dir)
    return _with_id(rows, history.head_to_head(rows))


@register(query(["duels"], f"SELECT match_id, {_VENUE_COLUMNS} FROM h", **_only("at_venue")))
def venue_win_rate(spark, sf_dir):
    rows = _duels(spark, sf_dir)
    return _with_id(rows, history.venue_record(rows))


@register(query(["duels"], f"SELECT match_id, {_RECORD_COLUMNS} FROM h", **_only("form", "bat_first", "pp", "dw")))
def team_form(spark, sf_dir):
    rows = _duels(spark, sf_dir)
    return _with_id(rows, history.team_record(rows))


@register(query(["duels"], f"SELECT match_id, {_RECORD_COLUMNS} FROM h",
                **_only("form", "bat_first", "pp", "dw", chronological=True)))
def team_form_chronological(spark, sf_dir):
    rows = _duels(spark, sf_dir)
    return _with_id(rows, history.team_record(rows, chronological=True))


@register(query(["duels"], f"SELECT match_id, {_SEASON_COLUMNS} FROM h LEFT JOIN in_season USING (seq)",
                **_only("in_season")))
def season_position(spark, sf_dir):
    rows = _duels(spark, sf_dir)
    return _with_id(rows, history.season_position(rows))


# ---------------------------------------------------------------- all match features

FEATURE_SOURCE = f"SELECT * FROM fixtures JOIN (SELECT match_id, {PHASE_SQL} FROM balls GROUP BY match_id) USING (match_id)"
_FHOME = "CASE WHEN 'c' || (CAST(team{0}[2:] AS INTEGER) % 7) = city THEN 1 ELSE 0 END AS is_home_team{0}"

# All features of the fixtures, unrounded order of columns does not matter.
FEATURES_SQL = f"""
SELECT h.* EXCLUDE (seq, date), date,
  CASE WHEN toss_winner = team1 THEN 1 ELSE 0 END AS toss_winner_is_team1,
  CASE WHEN toss_decision = 'bat' THEN 1 ELSE 0 END AS toss_bat_first,
  CASE WHEN (toss_decision = 'bat' AND toss_winner = innings1_team)
         OR (toss_decision = 'field' AND toss_winner = innings2_team) THEN 1 ELSE 0 END AS toss_winner_batted,
  {near('innings1_runs / overs::DOUBLE')} AS run_rate_inn1, {near('innings2_runs / overs::DOUBLE')} AS run_rate_inn2,
  CAST(innings1_runs - innings2_runs AS BIGINT) AS score_diff, CAST(innings1_runs + 1 AS BIGINT) AS target,
  CASE WHEN win_by_runs IS NOT NULL THEN 'runs' WHEN win_by_wickets IS NOT NULL THEN 'wickets' ELSE 'other' END AS win_method,
  {_FHOME.format(1)}, {_FHOME.format(2)}, CAST(season AS INTEGER) AS season_year,
  CASE WHEN CAST(season AS INTEGER) >= 2023 THEN 1 ELSE 0 END AS is_impact_player_era,
  {_H2H_COLUMNS}, {_VENUE_COLUMNS}, {_RECORD_COLUMNS}, {_SEASON_COLUMNS}
FROM h JOIN met USING (seq) LEFT JOIN in_season USING (seq)"""
FEATURE_CTES = {"feature_source": FEATURE_SOURCE, **history_ctes("feature_source")}

_BIG = ["innings1_runs", "innings1_wickets", "innings2_runs", "innings2_wickets", "win_by_runs", "win_by_wickets"]


@register(query(["fixtures"], f"""
SELECT * REPLACE (CAST(date AS VARCHAR) AS date, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _BIG)})
FROM ({FEATURES_SQL})""", **FEATURE_CTES))
def match_feature_table(spark, sf_dir):
    return rounded(features(spark, sf_dir))


@register(query(["fixtures"], f"""
SELECT * REPLACE (CAST(date AS VARCHAR) AS date, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _BIG)})
FROM ({FEATURES_SQL})""", **FEATURE_CTES))
def built_match_features(spark, sf_dir):
    """Base tables on disk through the feature job, its match table read back."""
    base, out = written_path(spark, "tables"), written_path(spark, "features")
    for name, table, kinds in (("matches", tables.fixtures(spark, sf_dir), MATCHES), ("deliveries", tables.balls(spark, sf_dir), DELIVERIES)):
        columns = [(F.col(c) if c in table.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
        write_table(table.select(*columns), f"{base}/{name}")
    jobs.build_features(spark, base, out, homes=tables.FIXTURE_HOMES)
    return rounded(spark.read.parquet(f"{out}/match").select(*features(spark, sf_dir).columns))


def features(spark, sf_dir):
    matches = written(tables.fixtures(spark, sf_dir), "fixtures")  # counted, and then placed
    return match_features(matches, tables.balls(spark, sf_dir), tables.FIXTURE_HOMES)


# ---------------------------------------------------------------- players

_DATED = "SELECT match_id, row_number() OVER (ORDER BY date ASC NULLS LAST, match_id ASC) AS seq FROM fixtures"


def _career(body: str, player: str, team: str, metrics: dict[str, str]) -> str:
    means = ", ".join(
        f"coalesce(avg({c}) OVER w, avg({c}) OVER ()) AS {n}" for n, c in metrics.items())
    return f"""SELECT match_id, innings, {team} AS team, {player} AS player, {means}
FROM ({body}) JOIN dated USING (match_id)
WINDOW w AS (PARTITION BY {player} ORDER BY seq, innings, {team} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


CAREER_CTES = {
    "dated": _DATED,
    "bat": _career(BATTING_SQL, "batter", "batting_team", BATTING_CAREER),
    "bowl": _career(BOWLING_SQL, "bowler", "bowling_team", BOWLING_CAREER),
}
STRENGTH_SQL = """SELECT * FROM
  (SELECT match_id, team, avg(pre_match_sr) AS team_batting_sr, avg(pre_match_avg) AS team_batting_avg FROM bat GROUP BY ALL)
  FULL JOIN
  (SELECT match_id, team, avg(pre_match_econ) AS team_bowling_econ, avg(pre_match_bowl_wkts) AS team_bowling_wkts FROM bowl GROUP BY ALL)
  USING (match_id, team)"""


def rounded_sql(body: str, columns: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{near(c)} AS {c}' for c in columns)}) FROM ({body})"


def _fixtures(spark, sf_dir):
    return placed(tables.fixtures(spark, sf_dir).select("match_id", "date"), by_date(), label="fixtures")


@register(query(["fixtures"], rounded_sql("SELECT * FROM bat", list(BATTING_CAREER)), **CAREER_CTES))
def batting_career(spark, sf_dir):
    rows = batting_features(tables.balls(spark, sf_dir))
    return rounded(career_before(rows, _fixtures(spark, sf_dir), "batter", "batting_team", BATTING_CAREER))


@register(query(["fixtures"], rounded_sql("SELECT * FROM bowl", list(BOWLING_CAREER)), **CAREER_CTES))
def bowling_career(spark, sf_dir):
    rows = bowling_features(tables.balls(spark, sf_dir))
    return rounded(career_before(rows, _fixtures(spark, sf_dir), "bowler", "bowling_team", BOWLING_CAREER))


@register(query(["fixtures"], rounded_sql(STRENGTH_SQL, [
    "team_batting_sr", "team_batting_avg", "team_bowling_econ", "team_bowling_wkts"]), **CAREER_CTES))
def pre_match_team_strength(spark, sf_dir):
    balls = tables.balls(spark, sf_dir)
    return rounded(team_strength(batting_features(balls), bowling_features(balls), _fixtures(spark, sf_dir)))
