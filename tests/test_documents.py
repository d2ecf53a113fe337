import json

import pytest
from pyspark.sql import functions as F

from pavilion.plans import jobs
from pavilion.schemas import DELIVERIES, MATCHES
from pavilion.sources.documents import delivery_rows, match_rows, parse_documents, quarantined, read_documents, usable
from pavilion.sources.tables import read_deliveries, read_matches


def ball(total, wickets=None, **extras):
    d = {"batter": "A", "bowler": "Z", "non_striker": "B",
         "runs": {"batter": total - sum(extras.values()), "extras": sum(extras.values()), "total": total}}
    if extras:
        d["extras"] = extras
    if wickets is not None:
        d["wickets"] = wickets
    return d


def innings(team, overs, powerplays=None):
    out = {"team": team, "overs": [{"over": n, "deliveries": b} for n, b in overs]}
    if powerplays is not None:
        out["powerplays"] = powerplays
    return out


def document(innings_list, **info):
    base = {"season": "2012", "dates": ["2012-04-05"], "venue": "Feroz Shah Kotla", "city": "Delhi",
            "teams": ["Delhi Daredevils", "Kings XI Punjab"], "toss": {"winner": "Kings XI Punjab", "decision": "field"},
            "outcome": {"winner": "Delhi Daredevils", "by": {"runs": 7}}, "overs": 20, "balls_per_over": 6,
            "players": {"Delhi Daredevils": ["A", "B"]}}
    base.update(info)
    return {"meta": {"data_version": "1.0.0"}, "info": base, "innings": innings_list}


OUT = [{"kind": "run out", "player_out": "B", "fielders": [{"name": "F"}]}, {"kind": "obstructing", "player_out": "A"}]
DOCS = {
    "runs": document([
        innings("Delhi Daredevils", [
            (0, [ball(1), ball(2, wides=1), ball(0, OUT), ball(0, [{"kind": "bowled", "player_out": "A"}])] + [ball(1)] * 6),
            (1, [ball(4)])], [{"from": 0.1, "to": 0.7, "type": "mandatory"}]),
        innings("Kings XI Punjab", [(0, [ball(6, noballs=1)])]),
        innings("Delhi Daredevils", [(0, [ball(3)])]),
    ], player_of_match=["A", "B"], officials={"umpires": ["U"]}, event={"name": "Cup", "match_number": 3}),
    "wickets": document([], outcome={"winner": "Kings XI Punjab", "by": {"wickets": 4}}, season=2011),
    "tie": document([{"team": "Kings XI Punjab"}], outcome={"result": "tie", "eliminator": "Delhi Daredevils"}),
    "none": document([], outcome={"result": "no result"}, dates=[], teams=[], toss={}),
    "nover": document([{"team": "X", "overs": [{"deliveries": [ball(1)]}]}]),
    "opened": document([innings("X", [(0, [ball(1)])], [{"from": 0.1, "type": "mandatory"}])]),
    "idle": document([innings("X", [], [{"from": 0.1}])]),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("documents")
    for name, doc in DOCS.items():
        (path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (path / "broken.json").write_text(json.dumps(DOCS["runs"])[:-30])
    (path / "notes.txt").write_text("not a document")
    return str(path)


@pytest.fixture(scope="module")
def parsed(spark, folder):
    return read_documents(spark, folder).cache()


def test_quarantine(parsed):
    got = {r.match_id: r.reason for r in quarantined(parsed).collect()}
    assert got == {"broken": "malformed json", "nover": "delivery without over",
                   "opened": "powerplay without from or to"}


def test_match_rows(parsed):
    df = match_rows(usable(parsed))
    assert df.columns == list(MATCHES)
    got = {r.match_id: r for r in df.collect()}
    r = got["runs"]
    assert (r.team1, r.team2, r.toss_winner, r.winner) == ("Delhi Capitals", "Punjab Kings", "Punjab Kings", "Delhi Capitals")
    assert r.venue == "Arun Jaitley Stadium" and str(r.date) == "2012-04-05"
    # Two wickets on one ball count twice at match level; super overs do not count.
    assert (r.innings1_runs, r.innings1_wickets, r.innings2_runs, r.innings2_wickets) == (13, 3, 6, 0)
    assert (r.win_by_runs, r.win_by_wickets, r.player_of_match, r.umpire1, r.umpire2) == (7, None, "A, B", "U", None)
    assert (r.match_number, r.event_name, r.data_version) == (3, "Cup", "1.0.0")
    assert (got["wickets"].win_by_wickets, got["wickets"].season, got["wickets"].innings1_runs) == (4, "2011", None)
    assert (got["tie"].winner, got["tie"].innings1_team, got["tie"].innings1_runs) == ("tie", "Punjab Kings", 0)
    n = got["none"]
    assert (n.winner, n.team1, n.team2, n.date, n.toss_winner) == ("no result", None, None, None, None)


def test_delivery_rows(parsed):
    df = delivery_rows(usable(parsed), legal_balls=True)
    assert df.columns == [*DELIVERIES, "legal_balls"]
    got = sorted(df.collect(), key=lambda r: (r.match_id, r.innings, r.over, r.ball))
    assert {r.match_id for r in got} == {"runs"}
    first = [r for r in got if r.innings == 1]
    assert [r.cumulative_runs for r in first] == [1, 3, 3, 3, 4, 5, 6, 7, 8, 9, 13]
    assert [r.cumulative_wickets for r in first] == [0, 0, 2, 3, 3, 3, 3, 3, 3, 3, 3]
    assert [r.legal_balls for r in first] == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [(r.over, r.ball) for r in first] == [(1, i) for i in range(1, 11)] + [(2, 1)]
    # 0.7 closes the powerplay; the tenth ball is numbered 1.0.
    assert [r.in_powerplay for r in first] == [1] * 7 + [0] * 4
    w = first[2]
    assert (w.is_wicket, w.wicket_kind, w.player_out, w.fielder) == (1, "run out", "B", "F")
    assert (first[3].wicket_kind, first[3].fielder) == ("bowled", None)
    assert (first[0].batting_team, first[0].bowling_team) == ("Delhi Capitals", "Punjab Kings")
    second = [r for r in got if r.innings == 2]
    assert (second[0].noballs, second[0].batter_runs, second[0].in_powerplay, second[0].bowling_team) == (1, 5, 0, "Delhi Capitals")
    assert [r.cumulative_runs for r in got if r.innings == 3] == [3]


def test_single_document(spark, folder):
    assert [r.match_id for r in read_documents(spark, folder, "tie.json").collect()] == ["tie"]


def test_texts_in_a_column_parse_alike(spark, parsed):
    texts = spark.createDataFrame([(k, json.dumps(d)) for k, d in DOCS.items()], "match_id string, text string")
    a = {tuple(r) for r in delivery_rows(usable(parse_documents(texts))).collect()}
    assert a == {tuple(r) for r in delivery_rows(usable(parsed)).collect()}


def test_ingest_never_shuffles(spark, parsed):
    texts = spark.createDataFrame([("a", "{}")], "match_id string, text string")
    docs = usable(parse_documents(texts))
    for df in (match_rows(docs), delivery_rows(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_ingest_job(spark, folder, tmp_path, form):
    summary = jobs.ingest(spark, folder, str(tmp_path), form=form).first()
    assert (summary.matches, summary.errors, summary.deliveries) == (5, 3, 13)
    m = {r.match_id: r for r in read_matches(spark, f"{tmp_path}/matches", form).collect()}
    assert m["runs"].player_of_match == "A, B" and str(m["runs"].date) == "2012-04-05"
    assert m["none"].win_by_runs is None and len(m) == 5
    d = read_deliveries(spark, f"{tmp_path}/deliveries", form)
    assert d.columns == list(DELIVERIES) and d.agg({"total_runs": "sum"}).first()[0] == 22


GOOD = json.dumps(DOCS["runs"])
KEPT = {
    "number": GOOD.replace('"match_number": 3', '"match_number": "Final"'),
    "overs": GOOD.replace('"overs": 20', '"overs": 20.0'),
    "revision": GOOD.replace('{"meta": {', '{"meta": {"revision": "r1", "created": 5, '),
    "players": GOOD.replace('"players": {"Delhi Daredevils": ["A", "B"]}', '"players": ["A", "B"]'),
    "padded": f" \n{GOOD}\n ",
}
REFUSED = {
    "trailing": GOOD + " trailing", "comma": GOOD + ",", "two": GOOD + "\n" + GOOD, "quotes": GOOD.replace('"', "'"),
    "list": f"[{GOOD}]", "empty": "", "number": "7", "null": "null", "nothing": None,
}


def test_odd_values_that_are_only_carried_keep_the_document(spark):
    docs = parse_documents(spark.createDataFrame(list(KEPT.items()), "match_id string, text string"))
    assert quarantined(docs).count() == 0
    got = {r.match_id: r for r in match_rows(usable(docs)).collect()}
    assert {k: (r.match_number, r.overs, r.innings1_runs) for k, r in got.items()} == {
        k: (None if k == "number" else 3, 20, got["padded"].innings1_runs) for k in KEPT}
    assert delivery_rows(usable(docs)).groupBy("match_id").count().select("count").distinct().count() == 1


def test_a_text_that_is_not_one_object_is_refused(spark):
    docs = parse_documents(spark.createDataFrame(list(REFUSED.items()), "match_id string, text string"))
    assert {r.match_id: r.reason for r in quarantined(docs).collect()} == dict.fromkeys(REFUSED, "malformed json")


def test_compacted_files_hold_many_documents(spark, folder, tmp_path):
    """The number of files need not be that of matches; one match may be asked for."""
    each = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).selectExpr("regexp_extract(_metadata.file_path, '([^/]+)[.]json$', 1) AS match_id", "value AS text")
    each.coalesce(1).write.parquet(f"{tmp_path}/compacted")
    got, want = (sorted(map(str, d.collect())) for d in (read_documents(spark, f"{tmp_path}/compacted", compacted=True), read_documents(spark, folder)))
    assert got == want and len(want) > 1
    assert [r.match_id for r in read_documents(spark, f"{tmp_path}/compacted", "tie", compacted=True).collect()] == ["tie"]


def test_texts_are_parsed_once_and_whole(spark):
    texts = ['{"info":{}}', ' {"info":{}}\n', '{"info":{}},{"info":{}}', '{"info":{}}]', '{"info":{}}}', '{"info":{}},', '[{"info":{}}]', "null", "", None, '{"info":{}}],"x":[{}', '{"innings":[{"overs":[{"over":"a"}]}]}']
    df = parse_documents(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "match_id string, text string"))
    assert [r.match_id for r in usable(df).orderBy(F.col("match_id").cast("int")).collect()] == ["0", "1", "10"]
    assert "json_array_length" not in df._jdf.queryExecution().toString()


def test_dear_rows_are_dealt_to_more_tasks_as_tables_grow(spark, monkeypatch):
    from pavilion.workload import tables
    monkeypatch.setattr(tables, "SPREAD_ROWS", 50)
    assert tables._spread(spark.range(1000, numPartitions=2)).rdd.getNumPartitions() == 20


def test_documents_of_fixtures_are_compacted(spark):
    from pathlib import Path
    from pavilion.workload import ingest_queries
    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("driver tables are not here")
    path = ingest_queries._document_files(spark, sf)
    assert spark.read.parquet(path).count() > 2 * len(list(Path(path).glob("part-*")))
    assert [p.name for p in Path(ingest_queries._document_file(spark, path, "7")).glob("part-*.txt")]
