"""Cricket-shaped views of the driver tables.

The driver tables hold no cricket, so matches, balls and match documents are
derived from them by integer arithmetic.  Each view exists twice, here for
Spark and in ``sql_views`` for DuckDB.

* ``duels``: a match per event, rich in history, ties on date and NULLs
* ``balls``: a delivery per order line
* ``fixtures``: the matches that belong to ``balls``
* ``scorecards``: a JSON match document per order
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Home city of the made-up teams: team i of a league plays in city i mod 7.
DUEL_HOMES = {f"t{i}": [f"c{i % 7}"] for i in range(40)}
FIXTURE_HOMES = {f"s{i}": [f"c{i % 7}"] for i in range(10)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task of work that is dear by the row.
SPREAD_ROWS = 50_000


def _spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly: to all cores, and to more tasks as the table grows, so that no task does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // SPREAD_ROWS)))  # the count of a table is in its footers


def duels(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id AS e", "to_date(ts) AS date", "event_type AS kind",
        "abs(cast(floor(value) AS bigint)) AS f",
        "user_id % 40 AS t", "(user_id % 40 + 1 + event_id % 39) % 40 AS u",
    ).selectExpr(
        "*", "concat('t', t) AS team1", "concat('t', u) AS team2",
        "if(f % 2 = 0, concat('t', t), concat('t', u)) AS innings1_team",
        "CASE WHEN kind = 'error' THEN NULL WHEN f % 2 = 0 THEN concat('t', u) ELSE concat('t', t) END AS innings2_team",
    ).selectExpr(
        "*",
        """CASE kind WHEN 'view' THEN team1 WHEN 'click' THEN team2
                     WHEN 'purchase' THEN innings1_team WHEN 'signup' THEN 'no result' END AS winner""",
    )
    return base.selectExpr(
        "cast(e AS string) AS match_id",
        "if(e % 101 = 0, NULL, concat(2018 + day(date) div 4, '/x')) AS season",
        "date",
        "if(e % 97 = 0, NULL, concat('v', e % 25)) AS venue",
        "if(e % 89 = 0, NULL, concat('c', (e % 25) % 7)) AS city",
        "team1", "team2",
        "CASE WHEN e % 83 = 0 THEN NULL WHEN e % 3 = 0 THEN team1 ELSE team2 END AS toss_winner",
        "if(e % 2 = 0, 'bat', 'field') AS toss_decision",
        "innings1_team", "cast(80 + f % 140 AS int) AS innings1_runs", "cast(e % 11 AS int) AS innings1_wickets",
        "innings2_team",
        "if(kind = 'error', NULL, cast(80 + e * 7 % 140 AS int)) AS innings2_runs",
        "if(kind = 'error', NULL, cast(e * 3 % 11 AS int)) AS innings2_wickets",
        "winner",
        "if(winner = innings1_team, cast(1 + e % 60 AS int), NULL) AS win_by_runs",
        "if(winner = innings2_team, cast(1 + e % 10 AS int), NULL) AS win_by_wickets",
        "CASE WHEN e % 211 = 0 THEN 0 WHEN e % 13 = 0 THEN NULL ELSE 20 END AS overs",
        "if(e % 17 = 0, NULL, cast(30 + e % 37 AS int)) AS pp_runs_inn1",
        "if(e % 19 = 0 OR kind = 'error', NULL, cast(30 + e * 5 % 37 AS int)) AS pp_runs_inn2",
        "if(e % 17 = 0, NULL, cast(e % 5 AS int)) AS death_wickets_inn1",
        "if(kind = 'error', NULL, cast(e * 3 % 5 AS int)) AS death_wickets_inn2",
    )


BALL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries without running totals; ``ball`` costs nothing unless it is used."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "*", "l_orderkey div 32 AS m", "cast(1 + l_partkey % 2 AS int) AS innings",
        "cast(1 + (l_partkey div 2) % 20 AS int) AS over", "cast(l_quantity AS int) AS q",
    ).selectExpr(
        "*", "concat('s', m % 10) AS side_a", "concat('s', (m + 1 + (m div 10) % 9) % 10) AS side_b",
        "concat('p', l_partkey % 200) AS batter", "concat('p', (l_partkey + 1) % 200) AS non_striker",
        "q % 7 AS batter_runs", "if(l_suppkey % 11 = 0, 1, 0) AS wides", "if(l_suppkey % 13 = 0, 1, 0) AS noballs",
        "if(l_returnflag = 'R' AND q % 5 = 0, 1, 0) AS is_wicket",
    )
    number = F.row_number().over(Window.partitionBy("m", "innings", "over").orderBy(*BALL_ORDER))
    return rows.withColumn("ball", number).selectExpr(
        "cast(m AS string) AS match_id", "innings",
        "if(innings = 1, side_a, side_b) AS batting_team", "if(innings = 1, side_b, side_a) AS bowling_team",
        "over", "ball", "batter", "non_striker", "concat('b', l_suppkey % 150) AS bowler",
        "batter_runs", "wides + noballs AS extras", "batter_runs + wides + noballs AS total_runs",
        "wides", "noballs", "0 AS legbyes", "0 AS byes", "0 AS penalty", "is_wicket",
        "if(is_wicket = 1, if(l_linestatus = 'F', 'bowled', 'caught'), NULL) AS wicket_kind",
        "if(is_wicket = 1, if(l_linenumber = 7, non_striker, batter), NULL) AS player_out",
        "cast(NULL AS string) AS fielder",
        "if(over <= 6, 1, 0) AS in_powerplay",
    )


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda i, c: F.sum(F.when(F.col("innings") == i, F.col(c))).cast("int")
    totals = balls(spark, sf_dir).groupBy("match_id").agg(
        of(1, "total_runs").alias("innings1_runs"), of(1, "is_wicket").alias("innings1_wickets"),
        of(2, "total_runs").alias("innings2_runs"), of(2, "is_wicket").alias("innings2_wickets"),
    ).selectExpr("*", "cast(match_id AS bigint) AS m").selectExpr(
        "*", "concat('s', m % 10) AS side_a", "concat('s', (m + 1 + (m div 10) % 9) % 10) AS side_b",
        "date_add(DATE'2018-01-01', cast(m * 7 % 2500 AS int)) AS date",
    ).selectExpr(
        "*",
        """CASE WHEN m % 43 = 0 THEN NULL WHEN m % 41 = 0 THEN 'no result'
                WHEN innings1_runs > innings2_runs THEN side_a
                WHEN innings1_runs < innings2_runs THEN side_b
                WHEN innings1_runs = innings2_runs THEN 'tie' END AS winner""",
    )
    return totals.selectExpr(
        "match_id", "cast(year(date) AS string) AS season", "date",
        "concat('v', m % 15) AS venue", "concat('c', m % 7) AS city",
        "if(m % 3 = 0, side_b, side_a) AS team1", "if(m % 3 = 0, side_a, side_b) AS team2",
        "if(m % 2 = 0, side_a, side_b) AS toss_winner", "if(m % 4 < 2, 'bat', 'field') AS toss_decision",
        "side_a AS innings1_team", "innings1_runs", "innings1_wickets",
        "side_b AS innings2_team", "innings2_runs", "innings2_wickets", "winner",
        "if(winner = side_a, innings1_runs - innings2_runs, NULL) AS win_by_runs",
        "if(winner = side_b, 10 - innings2_wickets, NULL) AS win_by_wickets",
        "20 AS overs",
    )


def fixture_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, text): the matches of ``balls`` as nested documents."""
    wicket = "if(is_wicket = 1, array(named_struct('kind', wicket_kind, 'player_out', player_out)), NULL)"
    balls_ = balls(spark, sf_dir).selectExpr("match_id", "innings", "batting_team", "over", "ball", f"""named_struct(
      'batter', batter, 'bowler', bowler, 'non_striker', non_striker,
      'runs', named_struct('batter', batter_runs, 'extras', extras, 'total', total_runs),
      'extras', named_struct('wides', wides, 'noballs', noballs), 'wickets', {wicket}) AS d""")
    overs = balls_.groupBy("match_id", "innings", "batting_team", "over").agg(F.sort_array(F.collect_list(F.struct("ball", "d"))).alias("balls"))
    innings = overs.selectExpr("match_id", "innings", "batting_team", "named_struct('over', over - 1, 'deliveries', balls.d) AS o")
    innings = innings.groupBy("match_id", "innings", "batting_team").agg(F.sort_array(F.collect_list("o")).alias("overs"))
    innings = innings.selectExpr("match_id", "innings", """named_struct(
      'team', batting_team, 'powerplays', array(named_struct('from', 0.1D, 'to', 5.9D)), 'overs', overs) AS i""")
    played = innings.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("innings", "i"))).alias("innings"))
    return fixtures(spark, sf_dir).join(played, "match_id").selectExpr("match_id", """to_json(named_struct('info', named_struct(
      'season', season, 'dates', array(cast(date AS string)), 'venue', venue, 'city', city, 'teams', array(team1, team2),
      'toss', named_struct('winner', toss_winner, 'decision', toss_decision),
      'outcome', named_struct('winner', if(winner IN (team1, team2), winner, NULL), 'result', if(winner IN (team1, team2), NULL, winner),
        'by', named_struct('runs', win_by_runs, 'wickets', win_by_wickets)), 'overs', overs), 'innings', innings.i)) AS text""")


# Names that exercise the rename tables, in cyclic use.
CARD_TEAMS_A = ["Kings XI Punjab", "Mumbai Indians", "Delhi Daredevils", "Chennai Super Kings",
                "Rising Pune Supergiant"]
CARD_TEAMS_B = ["Rajasthan Royals", "Royal Challengers Bangalore", "Kolkata Knight Riders"]
CARD_VENUES = ["Feroz Shah Kotla", "Eden Gardens, Kolkata", "Wankhede Stadium", "M.Chinnaswamy Stadium"]

_BALL = """named_struct(
  'batter', concat('p', x % 200), 'bowler', concat('b', (c + v) % 150), 'non_striker', concat('p', (x + 1) % 200),
  'runs', named_struct('batter', x % 7, 'extras', if(x % 11 = 0, 1, 0) + if(x % 13 = 0, 1, 0),
                       'total', x % 7 + if(x % 11 = 0, 1, 0) + if(x % 13 = 0, 1, 0)),
  'extras', if(x % 11 = 0 OR x % 13 = 0,
               named_struct('wides', if(x % 11 = 0, 1, NULL), 'noballs', if(x % 13 = 0, 1, NULL)), NULL),
  'wickets', if(x % 9 = 0, transform(sequence(0, if(x % 18 = 0, 1, 0)), w -> named_struct(
      'kind', if(w = 0, 'caught', 'run out'),
      'player_out', if(w = 0, concat('p', x % 200), concat('p', (x + 1) % 200)),
      'fielders', if(x % 27 = 0, NULL, array(named_struct('name', concat('f', x % 50)))))), NULL))"""

_INNINGS = f"""transform(sequence(0, cast(k % 3 AS int)), i -> named_struct(
  'team', if(i % 2 = 0, a, b),
  'powerplays', if(k % 7 = 0, NULL, array(named_struct(
      'from', 0.1D, 'to', if(k % 59 = 0, NULL, pp_to), 'type', 'mandatory'))),
  'overs', transform(sequence(0, cast((k div 3) % 2 AS int)), v -> named_struct(
      'over', if(k % 53 = 0, NULL, v),
      'deliveries', transform(
          transform(sequence(0, cast(1 + (k + v) % 3 AS int)), j -> c * 31 + k * 7 + i * 5 + v * 3 + j * 11),
          x -> {_BALL})))))"""


def scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, text): match documents as JSON, some of them broken, some odd where nothing is read."""
    pick = lambda names, n: f"element_at(array({', '.join(repr(x) for x in names)}), cast({n} + 1 AS int))"
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_custkey AS c", "o_orderstatus AS status", "to_date(o_orderdate) AS day",
    )
    base = _spread(orders).selectExpr(
        "*", f"{pick(CARD_TEAMS_A, 'k % 5')} AS a", f"{pick(CARD_TEAMS_B, 'c % 3')} AS b",
        f"{pick(CARD_VENUES, 'k % 4')} AS venue",
        "CASE k % 3 WHEN 0 THEN 0.2D WHEN 1 THEN 0.3D ELSE 1.1D END AS pp_to",
    )
    names = lambda prefix: f"transform(sequence(0, cast(c % 3 AS int)), n -> concat('{prefix}', n))"
    info = f"""named_struct(
      'season', concat(year(day), '/x'), 'dates', array(cast(day AS string)), 'venue', venue,
      'city', if(k % 4 = 3, NULL, concat('c', k % 4)), 'teams', array(a, b),
      'toss', named_struct('winner', if(c % 2 = 0, a, b), 'decision', if(k % 2 = 0, 'bat', 'field')),
      'outcome', CASE status
          WHEN 'F' THEN named_struct('winner', a, 'result', NULL, 'by', named_struct('runs', 1 + c % 50, 'wickets', NULL))
          WHEN 'O' THEN named_struct('winner', b, 'result', NULL, 'by', named_struct('runs', NULL, 'wickets', 1 + c % 10))
          ELSE named_struct('winner', NULL, 'result', if(c % 2 = 0, 'tie', 'no result'), 'by', NULL) END,
      'event', named_struct('name', 'League', 'match_number', if(k % 10 = 0, NULL, k % 74)),
      'officials', named_struct('umpires', {names('u')}),
      'player_of_match', if(status = 'P', NULL, {names('p')}),
      'match_type', 'T20', 'overs', 20, 'balls_per_over', 6)"""
    document = f"""to_json(named_struct(
      'meta', named_struct('data_version', if(k % 2 = 0, '1.0.0', '1.1.0')),
      'info', {info}, 'innings', {_INNINGS}))"""
    return base.selectExpr("cast(k AS string) AS match_id", "k", f"{document} AS text").selectExpr(
        "match_id", """CASE k % 50
          WHEN 0 THEN left(text, length(text) - 10)
          WHEN 1 THEN concat(text, ' trailing')
          WHEN 2 THEN concat(text, chr(10), text)
          WHEN 3 THEN replace(text, '"', "'")
          WHEN 4 THEN regexp_replace(text, '"match_number":[0-9]+', '"match_number":"Final"')
          WHEN 5 THEN replace(text, '"overs":20,', '"overs":20.0,')
          WHEN 6 THEN replace(text, '"info":{', '"info":{"players":["x"],')
          WHEN 7 THEN replace(text, '"meta":{', '"meta":{"revision":"r1",')
          WHEN 8 THEN concat('[', text, ']')
          ELSE text END AS text"""
    )
