"""Look-back features against a loop over earlier rows."""

import random

import pytest
from pyspark.sql import functions as F

from pavilion.operators import history
from pavilion.operators.timeline import ROWS_PER_SLOT, Tail, _slots_for, by_date, placed, state_before

DDL = ("match_id string, date string, season string, venue string, team1 string, team2 string, team1_won int, "
       "innings1_team string, innings2_team string, pp_runs_inn1 int, pp_runs_inn2 int, "
       "death_wickets_inn1 int, death_wickets_inn2 int")


def make(n=160, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b = r.sample("ABCDE", 2)
        # A takes part in far more matches than the others.
        if r.random() < 0.5:
            a, b = ("A", b if b != "A" else "B")
        if r.random() < 0.5:
            a, b = b, a
        first = r.choice([a, b])
        second = b if first == a else a
        odd = r.random()
        out.append(dict(
            match_id=str(i), date=None if odd < 0.05 else f"2020-01-{r.randint(1, 9):02d}",
            season=r.choice(["2020", "2021", None]), venue=r.choice(["v", "w", None]),
            team1=None if odd > 0.97 else a, team2=b, team1_won=r.choice([0, 1, 1, None]),
            innings1_team=first, innings2_team=r.choice([second, second, None]),
            pp_runs_inn1=r.choice([None, 30, 41, 55]), pp_runs_inn2=r.choice([None, 33, 47]),
            death_wickets_inn1=r.choice([None, 0, 1, 3]), death_wickets_inn2=r.choice([None, 2, 4])))
    return out


def ordered(matches):
    return sorted(matches, key=lambda m: (m["date"] is None, m["date"] or "", m["match_id"]))


def won(m, t):
    return int(m["team1"] == t and m["team1_won"] == 1) + int(m["team2"] == t and m["team1_won"] == 0)


def mean(xs, default):
    return sum(xs) / len(xs) if xs else default


def expected(matches, chronological=False):
    out = {}
    for i, m in enumerate(ordered(matches)):
        past, e = ordered(matches)[:i], {}
        if m["team1"] and m["team2"]:
            met = [p for p in past if {p["team1"], p["team2"]} == {m["team1"], m["team2"]}]
        else:
            met = []
        e["h2h_matches"], e["h2h_team1_wins"] = len(met), sum(won(p, m["team1"]) for p in met)
        e["h2h_team1_win_rate"] = mean([won(p, m["team1"]) for p in met], 0.5)
        for s in (1, 2):
            t = m[f"team{s}"]
            mine = [p for p in past if t and t in (p["team1"], p["team2"])]
            at = [p for p in mine if p["venue"] and p["venue"] == m["venue"]]
            e[f"team{s}_venue_win_rate"] = mean([won(p, t) for p in at], 0.5)
            e[f"team{s}_recent_form"] = mean([won(p, t) for p in mine[-5:]], 0.5)
            bat = [p for p in past if t and p["innings1_team"] == t][-10:]
            e[f"team{s}_win_after_batting_first"] = mean([won(p, t) for p in bat], 0.5)
            for name, kinds, default in (
                ("avg_pp_runs", (("innings1_team", "pp_runs_inn1"), ("innings2_team", "pp_runs_inn2")), 45.0),
                ("avg_death_wkts", (("innings2_team", "death_wickets_inn1"), ("innings1_team", "death_wickets_inn2")), 2.0),
            ):
                if chronological:
                    got = [p[v] for p in past for c, v in kinds if t and p[c] == t and p[v] is not None]
                else:
                    got = [p[v] for c, v in kinds for p in past if t and p[c] == t and p[v] is not None]
                e[f"team{s}_{name}"] = mean(got[-10:], default)
        same = [p for p in matches if m["season"] and p["season"] == m["season"]]
        before = [p for p in past if m["season"] and p["season"] == m["season"]]
        e["season_match_number"] = len(before) + 1 if m["season"] else None
        e["season_progress"] = (len(before) + 1) / len(same) if m["season"] else None
        out[m["match_id"]] = e
    return out


def computed(rows, matches, slots, chronological=False):
    table = placed(rows(matches, DDL), by_date(), slots)
    df = history.with_history(table, chronological)
    return {r.match_id: r for r in df.collect()}


@pytest.mark.parametrize("slots,chronological", [(6, False), (None, True)])
def test_against_loop_over_earlier_rows(rows, slots, chronological):
    matches = make()
    got, want = computed(rows, matches, slots, chronological), expected(matches, chronological)
    assert len(got) == len(want)
    for k, e in want.items():
        for c, v in e.items():
            assert (got[k][c] is None and v is None) or got[k][c] == pytest.approx(v), (k, c)


def test_later_matches_change_nothing_earlier(rows):
    matches = ordered(make(80, 9))
    known = computed(rows, matches, 3)
    cut = computed(rows, matches[:50], 3)
    for k, r in cut.items():
        for c in r.asDict():
            # The share of the season needs the season's final size by design.
            if c not in ("seq", "slot", "season_progress"):
                assert r[c] == known[k][c], (k, c)


def test_position_follows_date_then_id_as_text(rows):
    data = [dict(match_id=i, date=d) for i, d in (("10", "2020-01-01"), ("9", "2020-01-01"), ("1", None), ("2", "2019-01-01"))]
    table = placed(rows(data, DDL), by_date(), 2)
    assert [r.match_id for r in table.orderBy("seq").collect()] == ["2", "10", "9", "1"]
    assert table.select("slot").distinct().count() == 2


@pytest.mark.parametrize("slots", [1, 7])
def test_state_before_matches_a_plain_walk(spark, slots):
    r = random.Random(slots)
    data = [(str(i), r.choice("aaab"), r.choice([None, 1, 2, 3])) for i in range(300)]
    table = placed(spark.createDataFrame(data, "id string, k string, v int"), [F.col("id").cast("int")], slots)
    out = state_before(table, ["k"], {"s": F.col("v"), "n": F.lit(1)}, {"t": Tail(F.col("v"), 5)})
    got = {x.id: (x.s, x.n, list(x.t)) for x in out.collect()}
    for i, (key, k, _) in enumerate(data):
        past = [v for _, kk, v in data[:i] if kk == k]
        known = [v for v in past if v is not None]
        assert got[key] == (sum(known), len(past), known[-5:])


def test_slots_grow_with_the_table():
    assert [_slots_for(n, 8) for n in (0, 4_999, 10_000, 10**6)] == [1, 1, 2, 8]
    assert _slots_for(250 * ROWS_PER_SLOT, 8) == 250


def test_rows_move_once_for_all_tails(spark):
    values = spark.range(100).selectExpr("id AS seq", "CAST(id % 3 AS STRING) AS team", "CAST(id DIV 50 AS INT) AS slot", "id AS v")

    def moves(n):
        tails = {f"t{k}": Tail(F.when(F.col("v") % (k + 2) == 0, F.col("v")), 3) for k in range(n)}
        return state_before(values, ["team"], tails=tails)._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert moves(4) == moves(1)
