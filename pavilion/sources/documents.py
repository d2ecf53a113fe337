"""Match documents: scan, quarantine, and the two flat tables.

A document is one row from scan to delivery rows, and everything an innings
needs (running totals included) is inside that row.  So the whole ingest is a
map: no shuffle, and a lost executor costs only the documents it held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import canonical_team, canonical_venue, first_seen, flag, whole
from ..schemas import DELIVERIES, DOCUMENTS_WITH_ERRORS, MATCHES


# ---------------------------------------------------------------- scan


def read_documents(spark: SparkSession, path: str, single: str | None = None,
                   files: str = "*.json", key: str = r"([^/]+)\.json$", nested: bool = False, compacted: bool = False) -> DataFrame:
    """One row per file under ``path`` whose name matches ``files`` (or only the file ``single``).

    The first group of ``key`` in a file's path is its match id; a folder per match
    is read by ``files="*", key=r"/match_id=([^/]+)/", nested=True``.  ``compacted`` files are
    Parquet and hold many documents each, as columns match_id and text; ``single`` is a match id then.
    """
    if compacted:
        texts = spark.read.schema("match_id string, text string").parquet(path)
        return parse_documents(texts if single is None else texts.where(F.col("match_id") == single))
    reader = spark.read.option("pathGlobFilter", single or files).option("recursiveFileLookup", nested)
    texts = reader.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), key, 1).alias("match_id"), F.col("value").alias("text"))
    return parse_documents(texts)


def parse_documents(texts: DataFrame, match_id: str = "match_id", text: str = "text") -> DataFrame:
    """Parse JSON texts held in a column, e.g. many documents compacted into Parquet.

    Returns (match_id, doc, reason): ``reason`` is NULL for a usable document.
    The parser stops after the first value of a text; that the text is one object
    and nothing else is seen by reading it, once, as the only element of a list with a mark behind it.
    """
    listed = F.concat(F.lit('{"documents":['), F.col(text), F.lit('],"read_to_here":true}'))
    read = F.from_json(
        listed, DOCUMENTS_WITH_ERRORS,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "allowSingleQuotes": "false"},
    )
    only = F.filter(F.array(read), lambda r: r["_corrupt_record"].isNull() & r["read_to_here"] & (F.size(r["documents"]) == 1))
    doc = F.when(F.col(text).rlike(r"^\s*\{"), F.get(F.get(only, F.lit(0))["documents"], F.lit(0)))
    # Opening a one-element array keeps the parse in one place: a plain projection
    # would be copied into every later filter and column, and each copy parses again.
    parsed = texts.select(F.col(match_id).alias("match_id"), F.explode(F.array(doc)).alias("doc"))
    return parsed.withColumn("reason", _reason(F.col("doc")))


def _reason(doc: Column) -> Column:
    has_balls = lambda i: F.exists(i["overs"], lambda o: F.size(o["deliveries"]) > 0)
    no_over = F.exists(
        doc["innings"],
        lambda i: F.exists(i["overs"], lambda o: o["over"].isNull() & (F.size(o["deliveries"]) > 0)),
    )
    open_powerplay = F.exists(
        doc["innings"],
        lambda i: F.exists(i["powerplays"], lambda p: p["from"].isNull() | p["to"].isNull())
        & has_balls(i),
    )
    return (
        F.when(doc.isNull(), "malformed json")
        .when(no_over, "delivery without over")
        .when(open_powerplay, "powerplay without from or to")
    )


def usable(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("reason").isNull()).drop("reason")


def quarantined(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("reason").isNotNull()).select("match_id", "reason")


# ---------------------------------------------------------------- match rows


def _sum_over(items: Column, value) -> Column:
    """Sum of a value over an array; 0 for an array that is empty or missing."""
    total = F.aggregate(items, F.lit(0), lambda acc, x: acc + value(x))
    return F.coalesce(total, F.lit(0))


def _over_total(value):
    return lambda o: _sum_over(o["deliveries"], value)


def _ball_total(d: Column) -> Column:
    return F.coalesce(d["runs"]["total"], F.lit(0))


def _ball_wickets(d: Column) -> Column:
    return F.coalesce(F.array_size(d["wickets"]), F.lit(0))


def _innings_total(innings: Column, value) -> Column:
    """Sum of a per-ball value over a whole innings; an innings without overs scores 0."""
    return F.when(innings.isNotNull(), _sum_over(innings["overs"], _over_total(value)))


def match_rows(documents: DataFrame) -> DataFrame:
    """The ``matches`` table: one row of 27 columns per document."""
    info, meta = F.col("doc.info"), F.col("doc.meta")
    at = lambda c, i: F.get(c, F.lit(i))
    innings = [F.get(F.col("doc.innings"), F.lit(i)) for i in (0, 1)]
    named = F.array_join(info["player_of_match"], ", ")
    columns = {
        "match_id": F.col("match_id"),
        "season": info["season"],
        "date": F.expr("try_cast(get(doc.info.dates, 0) AS date)"),
        "venue": canonical_venue(info["venue"]),
        "city": info["city"],
        "team1": canonical_team(at(info["teams"], 0)),
        "team2": canonical_team(at(info["teams"], 1)),
        "toss_winner": canonical_team(info["toss"]["winner"]),
        "toss_decision": info["toss"]["decision"],
        "winner": canonical_team(F.coalesce(info["outcome"]["winner"], info["outcome"]["result"])),
        "win_by_runs": whole(info["outcome"]["by"]["runs"]),
        "win_by_wickets": whole(info["outcome"]["by"]["wickets"]),
        "player_of_match": F.when(F.size(info["player_of_match"]) > 0, named),
        "umpire1": at(info["officials"]["umpires"], 0),
        "umpire2": at(info["officials"]["umpires"], 1),
        "match_number": whole(info["event"]["match_number"]),
        "event_name": info["event"]["name"],
        "match_type": info["match_type"],
        "overs": whole(info["overs"]),
        "balls_per_over": whole(info["balls_per_over"]),
        "data_version": meta["data_version"],
    }
    for i, inn in enumerate(innings, start=1):
        columns[f"innings{i}_team"] = canonical_team(inn["team"])
        columns[f"innings{i}_runs"] = _innings_total(inn, _ball_total)
        columns[f"innings{i}_wickets"] = _innings_total(inn, _ball_wickets)
    return documents.select(
        *[columns[name].cast(kind).alias(name) for name, kind in MATCHES.items()]
    )


# ---------------------------------------------------------------- delivery rows


def _before(items: Column, i: Column) -> Column:
    """Sum of the first ``i`` numbers of a short array."""
    return F.aggregate(F.slice(items, F.lit(1), i), F.lit(0), lambda acc, x: acc + x)


def delivery_rows(documents: DataFrame, legal_balls: bool = False) -> DataFrame:
    """The ``deliveries`` table: one row of 24 columns per ball.

    Running totals are prefix sums of two short arrays, overs in an innings and
    balls in an over, taken before the arrays are opened; that is what keeps a
    sort and a shuffle of all balls out of the plan.  ``legal_balls`` adds the
    running count of balls that are neither wide nor no-ball.
    """
    counters = {"runs": _ball_total, "wkts": _ball_wickets}
    if legal_balls:
        counters["legal"] = lambda d: flag(
            (F.coalesce(d["extras"]["wides"], F.lit(0)) == 0)
            & (F.coalesce(d["extras"]["noballs"], F.lit(0)) == 0)
        )

    innings = documents.select(
        "match_id",
        F.col("doc.info.teams").alias("teams"),
        F.posexplode("doc.innings").alias("inn_pos", "inn"),
    )
    innings = innings.select(
        "match_id",
        (F.col("inn_pos") + 1).alias("innings"),
        canonical_team(F.col("inn.team")).alias("batting_team"),
        _other_side(F.col("teams"), F.col("inn.team")).alias("bowling_team"),
        F.col("inn.powerplays").alias("powerplays"),
        F.col("inn.overs").alias("overs"),
        *[
            F.transform("inn.overs", _over_total(f)).alias(f"{n}_by_over")
            for n, f in counters.items()
        ],
    )
    keys = ["match_id", "innings", "batting_team", "bowling_team", "powerplays"]
    overs = innings.select(
        *keys, *[f"{n}_by_over" for n in counters],
        F.posexplode("overs").alias("over_pos", "o"),
    ).select(
        *keys,
        F.col("o.over").alias("over0"),
        F.col("o.deliveries").alias("deliveries"),
        *[_before(F.col(f"{n}_by_over"), F.col("over_pos")).alias(f"{n}_start") for n in counters],
        *[F.transform("o.deliveries", f).alias(f"{n}_by_ball") for n, f in counters.items()],
    )
    balls = overs.select(
        *keys, "over0",
        *[f"{n}_start" for n in counters], *[f"{n}_by_ball" for n in counters],
        F.posexplode("deliveries").alias("ball_pos", "d"),
    ).withColumn("ball", F.col("ball_pos") + 1)

    d, wicket = F.col("d"), first_seen(F.col("d.wickets"))
    number = F.col("over0") + F.col("ball") / F.lit(10.0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = lambda n: F.col(f"{n}_start") + _before(F.col(f"{n}_by_ball"), F.col("ball"))
    columns = {
        **{k: F.col(k) for k in keys[:-1]},
        "over": F.col("over0") + 1,
        "ball": F.col("ball"),
        "batter": d["batter"],
        "non_striker": d["non_striker"],
        "bowler": d["bowler"],
        "batter_runs": zero(d["runs"]["batter"]),
        "extras": zero(d["runs"]["extras"]),
        "total_runs": zero(d["runs"]["total"]),
        **{x: zero(d["extras"][x]) for x in ("wides", "noballs", "legbyes", "byes", "penalty")},
        "is_wicket": flag(_ball_wickets(d) > 0),
        "wicket_kind": wicket["kind"],
        "player_out": wicket["player_out"],
        "fielder": first_seen(wicket["fielders"])["name"],
        "cumulative_runs": total("runs"),
        "cumulative_wickets": total("wkts"),
        "in_powerplay": flag(
            F.exists("powerplays", lambda p: (p["from"] <= number) & (number <= p["to"]))
        ),
    }
    out = [columns[name].cast(kind).alias(name) for name, kind in DELIVERIES.items()]
    if legal_balls:
        out.append(total("legal").alias("legal_balls"))
    return balls.select(*out)


def _other_side(teams: Column, batting: Column) -> Column:
    """First listed team whose recorded name is not the batting side's."""
    others = F.filter(teams, lambda t: ~t.eqNullSafe(batting))
    return canonical_team(first_seen(others))
