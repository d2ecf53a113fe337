"""What was known before each match.

All functions take a *placed* match table (see ``timeline.placed``) and look
only at earlier rows.  They return one row per ``seq``, or, given ``onto``, add
their columns to that table (which has ``seq``, ``team1`` and ``team2``) with
one join.  Undecided matches count as played but not as won.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import flag, mean_of, safe_div
from ..functions.fixed_values import DEFAULT_DEATH_WICKETS, DEFAULT_POWERPLAY_RUNS, DEFAULT_RATE
from .timeline import Tail, state_before, with_slot

FORM_MATCHES = 5
EVENT_MATCHES = 10


def _won(team: Column) -> Column:
    t1 = flag((F.col("team1") == team) & (F.col("team1_won") == 1))
    t2 = flag((F.col("team2") == team) & (F.col("team1_won") == 0))
    return t1 + t2


def _by_side(rows: DataFrame, values: list[str]) -> DataFrame:
    """(seq, team, values...) -> one map per match, team -> values; two or so entries each."""
    entry = F.struct(F.col("team"), F.struct(*values))
    return rows.groupBy("seq").agg(F.map_from_entries(F.collect_list(entry)).alias("by_team"))


def _attach(placed: DataFrame, onto: DataFrame | None, past: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Left join by ``seq``; the columns fill in what a match without history gets."""
    rows = placed.select("seq", "team1", "team2") if onto is None else onto
    keep = ["seq"] if onto is None else onto.columns
    return rows.join(past, "seq", "left").select(*keep, *[c.alias(n) for n, c in columns.items()])


def _for_both(columns: dict[str, tuple[str, Column]], by_team: str = "by_team") -> dict[str, Column]:
    """Read each side's value out of the map; ``columns``: pattern -> (value, default)."""
    return {
        pattern.format(i): F.coalesce(F.col(by_team)[F.col(f"team{i}")][value], default)
        for pattern, (value, default) in columns.items() for i in (1, 2)
    }


# ---------------------------------------------------------------- rows of each kind, and what is read from them


def _pairs(placed: DataFrame) -> DataFrame:
    return placed.filter(F.col("team1").isNotNull() & F.col("team2").isNotNull()).select(
        "seq",
        F.least("team1", "team2").alias("lo"), F.greatest("team1", "team2").alias("hi"),
        (F.col("team1") <= F.col("team2")).alias("team1_is_lo"),
        _won(F.least("team1", "team2")).alias("lo_won"),
        _won(F.greatest("team1", "team2")).alias("hi_won"),
    )


def _meetings() -> dict[str, Column]:
    """From ``met`` and ``wins`` of team1."""
    met, wins = F.coalesce("met", F.lit(0)), F.coalesce("wins", F.lit(0))
    return {
        "h2h_matches": met.cast("bigint"),
        "h2h_team1_wins": wins.cast("bigint"),
        "h2h_team1_win_rate": safe_div(wins, met, fill=DEFAULT_RATE),
    }


def _at_venues(placed: DataFrame) -> DataFrame:
    team = F.col("team")
    return placed.filter(F.col("venue").isNotNull()).select(
        "seq", "venue", "team1", "team2", "team1_won",
        F.explode(F.array_distinct(F.array_compact(F.array("team1", "team2")))).alias("team"),
    ).select("seq", "venue", "team", _won(team).alias("won"))


def _venue_rates(by_team: str = "by_team") -> dict[str, Column]:
    return _for_both({"team{}_venue_win_rate": ("rate", F.lit(DEFAULT_RATE))}, by_team)


def _of_teams(placed: DataFrame) -> DataFrame:
    team = F.col("team")
    first, second = F.col("innings1_team") == team, F.col("innings2_team") == team
    return placed.select(
        "seq", "team1", "team2", "team1_won", "innings1_team", "innings2_team",
        "pp_runs_inn1", "pp_runs_inn2", "death_wickets_inn1", "death_wickets_inn2",
        F.explode(F.array_distinct(F.array_compact(
            F.array("team1", "team2", "innings1_team", "innings2_team")
        ))).alias("team"),
    ).select(
        "seq", "team",
        F.when((F.col("team1") == team) | (F.col("team2") == team), _won(team)).alias("result"),
        F.when(first, _won(team)).alias("bat_first"),
        F.when(first, F.col("pp_runs_inn1")).alias("pp_a"),
        F.when(second, F.col("pp_runs_inn2")).alias("pp_b"),
        F.when(second, F.col("death_wickets_inn1")).alias("dw_a"),
        F.when(first, F.col("death_wickets_inn2")).alias("dw_b"),
    )


def _latest_values(form: int, events: int, chronological: bool) -> dict[str, Tail]:
    tails = {"form": Tail(F.col("result"), form), "bf": Tail(F.col("bat_first"), events)}
    for kind in ("pp", "dw"):
        a, b = F.col(f"{kind}_a"), F.col(f"{kind}_b")
        if chronological:
            tails[kind] = Tail(F.coalesce(a, b), events)
        else:
            tails[f"{kind}_first"], tails[f"{kind}_second"] = Tail(a, events), Tail(b, events)
    return tails


def _rates(events: int, chronological: bool) -> list[Column]:
    """Means of a team's latest values, from the tails."""
    def latest(kind: str) -> Column:
        if chronological:
            return F.col(kind)
        both = F.concat(f"{kind}_first", f"{kind}_second")
        return F.slice(both, F.greatest(F.size(both) - (events - 1), F.lit(1)), F.lit(events))

    return [
        mean_of(F.col("form"), DEFAULT_RATE).alias("form"),
        mean_of(F.col("bf"), DEFAULT_RATE).alias("bf"),
        mean_of(latest("pp"), DEFAULT_POWERPLAY_RUNS).alias("pp"),
        mean_of(latest("dw"), DEFAULT_DEATH_WICKETS).alias("dw"),
    ]


def _team_rates(by_team: str = "by_team") -> dict[str, Column]:
    return _for_both({
        "team{}_recent_form": ("form", F.lit(DEFAULT_RATE)),
        "team{}_win_after_batting_first": ("bf", F.lit(DEFAULT_RATE)),
        "team{}_avg_pp_runs": ("pp", F.lit(DEFAULT_POWERPLAY_RUNS)),
        "team{}_avg_death_wkts": ("dw", F.lit(DEFAULT_DEATH_WICKETS)),
    }, by_team)


def _in_seasons(placed: DataFrame) -> DataFrame:
    return placed.filter(F.col("season").isNotNull()).select("seq", "season")


def _season_columns() -> dict[str, Column]:
    """From ``earlier`` matches and the ``size`` of the season."""
    return {
        "season_match_number": (F.col("earlier") + 1).cast("int"),
        "season_progress": (F.col("earlier") + 1) / F.col("size"),
    }


# ---------------------------------------------------------------- one kind at a time


def head_to_head(placed: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """Earlier meetings of the two teams, whoever was listed first: count, team1 wins, rate."""
    past = state_before(
        with_slot(_pairs(placed)), ["lo", "hi"],
        sums={"met": F.lit(1), "lo_wins": F.col("lo_won"), "hi_wins": F.col("hi_won")},
    ).select(
        "seq", "met",
        F.when(F.col("team1_is_lo"), F.col("lo_wins")).otherwise(F.col("hi_wins")).alias("wins"),
    )
    return _attach(placed, onto, past, _meetings())


def venue_record(placed: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """Each side's win rate in its earlier matches at this venue."""
    past = state_before(
        with_slot(_at_venues(placed)), ["venue", "team"], sums={"played": F.lit(1), "wins": F.col("won")}
    ).select("seq", "team", safe_div("wins", "played", fill=DEFAULT_RATE).alias("rate"))
    return _attach(placed, onto, _by_side(past, ["rate"]), _venue_rates())


def team_record(placed: DataFrame, onto: DataFrame | None = None, form: int = FORM_MATCHES,
                events: int = EVENT_MATCHES, chronological: bool = False) -> DataFrame:
    """Recent form, bat-first win rate, powerplay runs and death wickets of both sides.

    The last two average a team's latest values as first side and as second
    side.  The default takes second-side values first and tops them up with
    first-side ones; ``chronological`` takes the latest of either kind.
    """
    past = state_before(with_slot(_of_teams(placed)), ["team"], tails=_latest_values(form, events, chronological))
    rates = past.select("seq", "team", *_rates(events, chronological))
    return _attach(placed, onto, _by_side(rates, ["form", "bf", "pp", "dw"]), _team_rates())


def season_position(placed: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """Number of the match in its season and its share of the whole season's matches.

    The share needs the season's final size, so it is known only afterwards.
    """
    numbered = state_before(
        with_slot(_in_seasons(placed)), ["season"], sums={"earlier": F.lit(1)}, totals={"size": "earlier"}
    )
    return _attach(placed, onto, numbered.select("seq", "earlier", "size"), _season_columns())


# ---------------------------------------------------------------- all kinds in one walk


def with_history(placed: DataFrame, chronological: bool = False) -> DataFrame:
    """All of the above next to the match row.

    The rows of all kinds are one long table, walked once by (kind, key): one shuffle by key, one back by ``seq``, one join.
    """
    kinds = {
        "pair": _pairs(placed).select("seq", F.col("lo").alias("key"), F.col("hi").alias("other"), F.col("lo_won").alias("a"), F.col("hi_won").alias("b"),
                                      F.col("team1_is_lo").alias("flip")),
        "venue": _at_venues(placed).select("seq", F.col("venue").alias("key"), F.col("team").alias("other"), F.col("won").alias("a")),
        "team": _of_teams(placed).select("seq", F.col("team").alias("key"), "result", "bat_first", "pp_a", "pp_b", "dw_a", "dw_b"),
        "season": _in_seasons(placed).select("seq", F.col("season").alias("key")),
    }
    rows = None
    for kind, part in kinds.items():
        other = F.col("other").cast("string") if "other" in part.columns else F.lit("")
        part = part.withColumns({"kind": F.lit(kind), "key": F.col("key").cast("string"), "other": other})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    past = state_before(with_slot(rows), ["kind", "key", "other"], sums={"n": F.lit(1), "a_wins": F.col("a"), "b_wins": F.col("b")},
                        tails=_latest_values(FORM_MATCHES, EVENT_MATCHES, chronological), totals={"size": "n"})
    only = lambda kind, c: F.when(F.col("kind") == kind, c)
    entry = lambda kind, team, *values: F.map_from_entries(F.collect_list(only(kind, F.struct(team, F.struct(*values)))))
    by_match = past.groupBy("seq").agg(  # a match has some seven rows
        F.max(only("pair", F.col("n"))).alias("met"),
        F.max(only("pair", F.when(F.col("flip"), F.col("a_wins")).otherwise(F.col("b_wins")))).alias("wins"),
        entry("venue", F.col("other"), safe_div("a_wins", "n", fill=DEFAULT_RATE).alias("rate")).alias("at_venue"),
        entry("team", F.col("key"), *_rates(EVENT_MATCHES, chronological)).alias("by_team"),
        F.max(only("season", F.col("n"))).alias("earlier"),
        F.max(only("season", F.col("size"))).alias("size"),
    )
    return _attach(placed, placed, by_match, _meetings() | _venue_rates("at_venue") | _team_rates() | _season_columns())
