"""The views of ``tables`` as DuckDB common table expressions."""

from __future__ import annotations

from ..functions.fixed_values import TEAM_RENAMES, VENUE_RENAMES
from .tables import BALL_ORDER, CARD_TEAMS_A, CARD_TEAMS_B, CARD_VENUES

CHRONO = "date ASC NULLS LAST, match_id ASC"


def even(x: str, digits: int) -> str:
    """Round half to even, by the same double arithmetic as on the Spark side."""
    return f"round_even(({x}) * {10.0**digits:.1f}, 0) / {10.0**digits:.1f}"


def near(x: str) -> str:
    """Six decimals for comparison, the twin of ``registry.near``."""
    return f"round_even(({x}) * 1000000.0 + 0.001, 0) / 1000000.0"


def _list(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def _renamed(c: str, table: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {c} END"


_VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, needs: list[str], body: str) -> None:
    _VIEWS[name] = (needs, body)


def query(needs: list[str], body: str, **ctes: str) -> str:
    """A complete statement: the views it needs, extra CTEs, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in _VIEWS[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({_VIEWS[n][1]})" for n in order] + [f"{n} AS ({b})" for n, b in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---------------------------------------------------------------- duels

_view("duel_base", [], """
SELECT event_id AS e, CAST(ts AS DATE) AS date, event_type AS kind,
  abs(CAST(floor(value) AS BIGINT)) AS f,
  't' || (user_id % 40) AS team1, 't' || ((user_id % 40 + 1 + event_id % 39) % 40) AS team2
FROM events""")
_view("duel_sides", ["duel_base"], """
SELECT *, CASE WHEN f % 2 = 0 THEN team1 ELSE team2 END AS innings1_team,
  CASE WHEN kind = 'error' THEN NULL WHEN f % 2 = 0 THEN team2 ELSE team1 END AS innings2_team
FROM duel_base""")
_view("duel_won", ["duel_sides"], """
SELECT *, CASE kind WHEN 'view' THEN team1 WHEN 'click' THEN team2
  WHEN 'purchase' THEN innings1_team WHEN 'signup' THEN 'no result' END AS winner FROM duel_sides""")
_view("duels", ["duel_won"], """
SELECT CAST(e AS VARCHAR) AS match_id,
  CASE WHEN e % 101 = 0 THEN NULL ELSE (2018 + day(date) // 4) || '/x' END AS season, date,
  CASE WHEN e % 97 = 0 THEN NULL ELSE 'v' || (e % 25) END AS venue,
  CASE WHEN e % 89 = 0 THEN NULL ELSE 'c' || ((e % 25) % 7) END AS city,
  team1, team2,
  CASE WHEN e % 83 = 0 THEN NULL WHEN e % 3 = 0 THEN team1 ELSE team2 END AS toss_winner,
  CASE WHEN e % 2 = 0 THEN 'bat' ELSE 'field' END AS toss_decision,
  innings1_team, 80 + f % 140 AS innings1_runs, e % 11 AS innings1_wickets, innings2_team,
  CASE WHEN kind <> 'error' THEN 80 + e * 7 % 140 END AS innings2_runs,
  CASE WHEN kind <> 'error' THEN e * 3 % 11 END AS innings2_wickets,
  winner,
  CASE WHEN winner = innings1_team THEN 1 + e % 60 END AS win_by_runs,
  CASE WHEN winner = innings2_team THEN 1 + e % 10 END AS win_by_wickets,
  CASE WHEN e % 211 = 0 THEN 0 WHEN e % 13 = 0 THEN NULL ELSE 20 END AS overs,
  CASE WHEN e % 17 <> 0 THEN 30 + e % 37 END AS pp_runs_inn1,
  CASE WHEN e % 19 <> 0 AND kind <> 'error' THEN 30 + e * 5 % 37 END AS pp_runs_inn2,
  CASE WHEN e % 17 <> 0 THEN e % 5 END AS death_wickets_inn1,
  CASE WHEN kind <> 'error' THEN e * 3 % 5 END AS death_wickets_inn2
FROM duel_won""")

# ---------------------------------------------------------------- balls and fixtures

_view("ball_base", [], f"""
SELECT *, l_orderkey // 32 AS m, 1 + l_partkey % 2 AS innings, 1 + (l_partkey // 2) % 20 AS over,
  CAST(l_quantity AS INTEGER) AS q FROM lineitem""")
_view("ball_marks", ["ball_base"], f"""
SELECT *, row_number() OVER (PARTITION BY m, innings, over ORDER BY {', '.join(BALL_ORDER)}) AS ball,
  's' || (m % 10) AS side_a, 's' || ((m + 1 + (m // 10) % 9) % 10) AS side_b,
  'p' || (l_partkey % 200) AS batter, 'p' || ((l_partkey + 1) % 200) AS non_striker,
  q % 7 AS batter_runs,
  CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS wides,
  CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END AS noballs,
  CASE WHEN l_returnflag = 'R' AND q % 5 = 0 THEN 1 ELSE 0 END AS is_wicket
FROM ball_base""")
_view("balls", ["ball_marks"], """
SELECT CAST(m AS VARCHAR) AS match_id, innings,
  CASE WHEN innings = 1 THEN side_a ELSE side_b END AS batting_team,
  CASE WHEN innings = 1 THEN side_b ELSE side_a END AS bowling_team,
  over, ball, batter, non_striker, 'b' || (l_suppkey % 150) AS bowler,
  batter_runs, wides + noballs AS extras, batter_runs + wides + noballs AS total_runs,
  wides, noballs, 0 AS legbyes, 0 AS byes, 0 AS penalty, is_wicket,
  CASE WHEN is_wicket = 1 THEN CASE WHEN l_linestatus = 'F' THEN 'bowled' ELSE 'caught' END END AS wicket_kind,
  CASE WHEN is_wicket = 1 THEN CASE WHEN l_linenumber = 7 THEN non_striker ELSE batter END END AS player_out,
  CASE WHEN over <= 6 THEN 1 ELSE 0 END AS in_powerplay
FROM ball_marks""")
_view("fixture_totals", ["balls"], """
SELECT CAST(match_id AS BIGINT) AS m,
  sum(total_runs) FILTER (innings = 1) AS innings1_runs, sum(is_wicket) FILTER (innings = 1) AS innings1_wickets,
  sum(total_runs) FILTER (innings = 2) AS innings2_runs, sum(is_wicket) FILTER (innings = 2) AS innings2_wickets
FROM balls GROUP BY match_id""")
_view("fixture_sides", ["fixture_totals"], """
SELECT *, 's' || (m % 10) AS side_a, 's' || ((m + 1 + (m // 10) % 9) % 10) AS side_b,
  DATE '2018-01-01' + CAST(m * 7 % 2500 AS INTEGER) AS date FROM fixture_totals""")
_view("fixture_won", ["fixture_sides"], """
SELECT *, CASE WHEN m % 43 = 0 THEN NULL WHEN m % 41 = 0 THEN 'no result'
  WHEN innings1_runs > innings2_runs THEN side_a WHEN innings1_runs < innings2_runs THEN side_b
  WHEN innings1_runs = innings2_runs THEN 'tie' END AS winner FROM fixture_sides""")
_view("fixtures", ["fixture_won"], """
SELECT CAST(m AS VARCHAR) AS match_id, CAST(year(date) AS VARCHAR) AS season, date,
  'v' || (m % 15) AS venue, 'c' || (m % 7) AS city,
  CASE WHEN m % 3 = 0 THEN side_b ELSE side_a END AS team1,
  CASE WHEN m % 3 = 0 THEN side_a ELSE side_b END AS team2,
  CASE WHEN m % 2 = 0 THEN side_a ELSE side_b END AS toss_winner,
  CASE WHEN m % 4 < 2 THEN 'bat' ELSE 'field' END AS toss_decision,
  side_a AS innings1_team, innings1_runs, innings1_wickets,
  side_b AS innings2_team, innings2_runs, innings2_wickets, winner,
  CASE WHEN winner = side_a THEN innings1_runs - innings2_runs END AS win_by_runs,
  CASE WHEN winner = side_b THEN 10 - innings2_wickets END AS win_by_wickets, 20 AS overs
FROM fixture_won""")
_view("running_balls", ["balls"], """
SELECT *, sum(total_runs) OVER w AS cumulative_runs, sum(is_wicket) OVER w AS cumulative_wickets,
  sum(CASE WHEN wides = 0 AND noballs = 0 THEN 1 ELSE 0 END) OVER w AS legal_balls
FROM balls WINDOW w AS (PARTITION BY match_id, innings ORDER BY over, ball)""")

# ---------------------------------------------------------------- scorecards

_view("card_base", [], f"""
SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day,
  {_list(CARD_TEAMS_A)}[o_orderkey % 5 + 1] AS a, {_list(CARD_TEAMS_B)}[o_custkey % 3 + 1] AS b,
  {_list(CARD_VENUES)}[o_orderkey % 4 + 1] AS venue,
  CASE o_orderkey % 3 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 1.1::DOUBLE END AS pp_to
FROM orders""")
_view("card_state", ["card_base"], """
SELECT *, CASE WHEN k % 50 IN (0, 1, 2, 3, 8) THEN 'malformed json' WHEN k % 53 = 0 THEN 'delivery without over'
  WHEN k % 59 = 0 AND k % 7 <> 0 THEN 'powerplay without from or to' END AS reason FROM card_base""")
_view("cards", ["card_state"], "SELECT * FROM card_state WHERE reason IS NULL")
_view("card_innings", ["cards"], "SELECT *, unnest(generate_series(0, k % 3)) AS i FROM cards")
_view("card_overs", ["card_innings"], "SELECT *, unnest(generate_series(0, (k // 3) % 2)) AS v FROM card_innings")
_view("card_balls", ["card_overs"], """
SELECT *, c * 31 + k * 7 + i * 5 + v * 3 + j * 11 AS x
FROM (SELECT *, unnest(generate_series(0, 1 + (k + v) % 3)) AS j FROM card_overs)""")
_view("card_marks", ["card_balls"], f"""
SELECT *, CASE WHEN x % 11 = 0 THEN 1 ELSE 0 END AS wides, CASE WHEN x % 13 = 0 THEN 1 ELSE 0 END AS noballs,
  CASE WHEN x % 18 = 0 THEN 2 WHEN x % 9 = 0 THEN 1 ELSE 0 END AS wickets,
  {_renamed('a', TEAM_RENAMES)} AS team_a, {_renamed('b', TEAM_RENAMES)} AS team_b
FROM card_balls""")
_view("card_deliveries", ["card_marks"], """
SELECT CAST(k AS VARCHAR) AS match_id, i + 1 AS innings,
  CASE WHEN i % 2 = 0 THEN team_a ELSE team_b END AS batting_team,
  CASE WHEN i % 2 = 0 THEN team_b ELSE team_a END AS bowling_team,
  v + 1 AS over, j + 1 AS ball, 'p' || (x % 200) AS batter, 'p' || ((x + 1) % 200) AS non_striker,
  'b' || ((c + v) % 150) AS bowler, x % 7 AS batter_runs, wides + noballs AS extras,
  x % 7 + wides + noballs AS total_runs, wides, noballs, 0 AS legbyes, 0 AS byes, 0 AS penalty,
  CASE WHEN wickets > 0 THEN 1 ELSE 0 END AS is_wicket,
  CASE WHEN wickets > 0 THEN 'caught' END AS wicket_kind,
  CASE WHEN wickets > 0 THEN 'p' || (x % 200) END AS player_out,
  CASE WHEN wickets > 0 AND x % 27 <> 0 THEN 'f' || (x % 50) END AS fielder,
  sum(x % 7 + wides + noballs) OVER w AS cumulative_runs, sum(wickets) OVER w AS cumulative_wickets,
  CASE WHEN k % 7 <> 0 AND 0.1::DOUBLE <= v + (j + 1) / 10.0::DOUBLE
        AND v + (j + 1) / 10.0::DOUBLE <= pp_to THEN 1 ELSE 0 END AS in_powerplay,
  sum(CASE WHEN wides = 0 AND noballs = 0 THEN 1 ELSE 0 END) OVER w AS legal_balls
FROM card_marks WINDOW w AS (PARTITION BY k, i ORDER BY v, j)""")
_view("card_matches", ["cards", "card_marks"], f"""
SELECT CAST(k AS VARCHAR) AS match_id, year(day) || '/x' AS season, day AS date,
  {_renamed('venue', VENUE_RENAMES)} AS venue, CASE WHEN k % 4 <> 3 THEN 'c' || (k % 4) END AS city,
  team1, team2, CASE WHEN c % 2 = 0 THEN team1 ELSE team2 END AS toss_winner,
  CASE WHEN k % 2 = 0 THEN 'bat' ELSE 'field' END AS toss_decision,
  team1 AS innings1_team, innings1_runs, innings1_wickets,
  CASE WHEN k % 3 > 0 THEN team2 END AS innings2_team, innings2_runs, innings2_wickets,
  CASE status WHEN 'F' THEN team1 WHEN 'O' THEN team2
    ELSE CASE WHEN c % 2 = 0 THEN 'tie' ELSE 'no result' END END AS winner,
  CASE WHEN status = 'F' THEN 1 + c % 50 END AS win_by_runs,
  CASE WHEN status = 'O' THEN 1 + c % 10 END AS win_by_wickets,
  CASE WHEN status IN ('F', 'O') THEN ['p0', 'p0, p1', 'p0, p1, p2'][c % 3 + 1] END AS player_of_match,
  'u0' AS umpire1, CASE WHEN c % 3 > 0 THEN 'u1' END AS umpire2,
  CASE WHEN k % 10 <> 0 AND k % 50 <> 4 THEN k % 74 END AS match_number, 'League' AS event_name, 'T20' AS match_type,
  20 AS overs, 6 AS balls_per_over, CASE WHEN k % 2 = 0 THEN '1.0.0' ELSE '1.1.0' END AS data_version
FROM (SELECT *, {_renamed('a', TEAM_RENAMES)} AS team1, {_renamed('b', TEAM_RENAMES)} AS team2 FROM cards)
JOIN (SELECT k, sum(x % 7 + wides + noballs) FILTER (i = 0) AS innings1_runs,
        sum(wickets) FILTER (i = 0) AS innings1_wickets,
        sum(x % 7 + wides + noballs) FILTER (i = 1) AS innings2_runs,
        sum(wickets) FILTER (i = 1) AS innings2_wickets FROM card_marks GROUP BY k) USING (k)""")
