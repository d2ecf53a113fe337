"""The aggregates behind the nineteen charts, each as a DataFrame.

All combine on the map side and do whatever follows (shares, top lists, dense grids, windows) on the aggregate.  Each
scans the deliveries once, or not at all if it is given that aggregate as ``parts`` (see ``cube``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import (
    clip, flag, left_closed_band, phase_name, right_closed_band, round_even, safe_div,
)
from ..functions.fixed_values import REPORT_PHASES, SCORING_ZONES, TARGET_BANDS
from .timeline import state_before

OVERS = 20


def _spine(spark: SparkSession, **columns: range) -> DataFrame:
    """Every combination of a few short integer ranges."""
    out = None
    for name, values in columns.items():
        part = spark.range(values.start, values.stop, 1, 1).select(F.col("id").cast("int").alias(name))
        out = part if out is None else out.crossJoin(F.broadcast(part))  # fixed, a few rows
    return out


def _balls(c: str = "total_runs") -> Column:
    return F.count(c)


def match_count(deliveries: DataFrame) -> DataFrame:
    """Exact number of distinct matches, one row."""
    return deliveries.select("match_id").distinct().agg(F.count("match_id").alias("matches"))


def franchises(matches: DataFrame) -> DataFrame:
    """Every team that was listed as a side of a match."""
    sides = matches.select(F.explode(F.array("team1", "team2")).alias("team"))
    return sides.filter(F.col("team").isNotNull()).distinct()


# ---------------------------------------------------------------- matches


def matches_per_season(matches: DataFrame) -> DataFrame:
    return (
        matches.filter(F.col("season_year").isNotNull()).groupBy("season_year")
        .agg(F.count(F.lit(1)).alias("matches")).orderBy("season_year")
    )


def toss_effect(matches: DataFrame) -> DataFrame:
    """How often the toss winner won, by decision and overall.

    A missing decision counts overall but has no row of its own.
    """
    valid = matches.dropna(subset=["winner", "toss_winner"])
    won = flag(F.col("toss_winner") == F.col("winner"))
    rows = valid.rollup("toss_decision").agg(
        F.grouping("toss_decision").alias("overall"),
        F.avg(won).alias("rate"), F.count(F.lit(1)).alias("matches"),
    )
    return rows.filter((F.col("overall") == 1) | F.col("toss_decision").isNotNull()).select(
        F.when(F.col("overall") == 1, "Overall").otherwise(F.initcap("toss_decision")).alias("decision"),
        (F.col("rate") * 100).alias("win_pct"), "matches",
    ).orderBy("decision")


def team_wins(matches: DataFrame) -> DataFrame:
    """Wins of real teams; "tie" and "no result" are none."""
    wins = (
        matches.filter(F.col("winner").isNotNull()).groupBy(F.col("winner").alias("team"))
        .agg(F.count(F.lit(1)).alias("wins"))
    )
    return wins.join(franchises(matches), "team", "left_semi").orderBy("wins", "team")


def chase_success(matches: DataFrame, bands=TARGET_BANDS) -> DataFrame:
    valid = matches.dropna(subset=["winner", "innings1_runs", "innings2_team"])
    target = F.col("innings1_runs") + 1
    order = F
    for i, b in enumerate(bands, start=1):
        order = order.when(F.col("band") == b[0], i)
    return (
        valid.select(
            left_closed_band(target, bands).alias("band"),
            flag(F.col("winner") == F.col("innings2_team")).alias("won"),
        )
        .filter(F.col("band").isNotNull()).groupBy("band")
        .agg((F.avg("won") * 100).alias("win_pct"), F.count(F.lit(1)).alias("matches"))
        .withColumn("band_order", order).orderBy("band_order")
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram with mean, median and total, one row per bin, empty bins included.

    Counts of distinct values come first; they carry everything else, so the
    input is scanned once and the exact median works on value counts.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(
        F.count(F.lit(1)).alias("n")
    )
    stats = counts.agg(
        F.min("x").alias("_min"), F.max("x").alias("_max"), F.sum("n").alias("total"),
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("x", 0.5, F.col("n")).alias("median"),
    )
    flat = F.col("_min") == F.col("_max")  # one single value: half a unit either side
    stats = stats.filter(F.col("total") > 0).select(
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).cast("double").alias("lo"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).cast("double").alias("hi"),
        "total", "mean", "median",
    )
    binned = counts.crossJoin(F.broadcast(stats.select("lo", "hi"))).select(  # one row
        # The last bin is closed on the right.
        F.least(
            F.width_bucket(F.col("x").cast("double"), "lo", "hi", F.lit(bins)), F.lit(bins)
        ).cast("int").alias("bin"), "n",
    ).groupBy("bin").agg(F.sum("n").alias("frequency"))
    step = (F.col("hi") - F.col("lo")) / bins
    return (
        _spine(df.sparkSession, bin=range(1, bins + 1)).crossJoin(F.broadcast(stats))
        .join(binned, "bin", "left")
        .select(
            "bin",
            (F.col("lo") + (F.col("bin") - 1) * step).alias("bin_from"),
            (F.col("lo") + F.col("bin") * step).alias("bin_to"),
            F.coalesce("frequency", F.lit(0)).alias("frequency"),
            "mean", "median", "total",
        ).orderBy("bin")
    )


def score_distribution(matches: DataFrame, bins: int = 25) -> DataFrame:
    return _both(matches, {"innings1": "innings1_runs", "innings2": "innings2_runs"}, bins)


def win_margins(matches: DataFrame, bins: int = 20) -> DataFrame:
    return _both(matches, {"runs": "win_by_runs", "wickets": "win_by_wickets"}, bins)


def _both(matches: DataFrame, series: dict[str, str], bins: int) -> DataFrame:
    parts = [histogram(matches, c, bins).withColumn("series", F.lit(s)) for s, c in series.items()]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- deliveries


def top_batters(deliveries: DataFrame, n: int = 15, parts: DataFrame | None = None) -> DataFrame:
    runs = F.col("batter_runs")
    table = parts if parts is not None else (
        deliveries.filter((F.col("wides") == 0) & F.col("batter").isNotNull()).groupBy("batter").agg(
            F.sum(runs).alias("runs"), F.count(runs).alias("balls"),
            F.count_if(runs == 4).alias("fours"), F.count_if(runs == 6).alias("sixes"),
        )
    )
    rate = round_even(safe_div("runs", "balls", fill=None) * 100, 1)
    return table.withColumn("strike_rate", rate).orderBy(F.desc("runs"), "batter").limit(n)


def top_bowlers(deliveries: DataFrame, n: int = 15, parts: DataFrame | None = None) -> DataFrame:
    table = parts if parts is not None else deliveries.filter(F.col("bowler").isNotNull()).groupBy("bowler").agg(
        F.sum("is_wicket").alias("wickets"), _balls().alias("balls"), F.sum("total_runs").alias("runs"),
    )
    economy = round_even(safe_div("runs", F.col("balls") / 6, fill=None), 2)
    return table.withColumn("economy", economy).orderBy(F.desc("wickets"), "bowler").limit(n)


def _by_over(deliveries: DataFrame) -> DataFrame:
    """Runs, balls and wickets of each over, and ``matches``, the number of matches, in every row; one scan.

    Balls are added up by over and, beside that, by match; a row per match is then only counted.
    """
    sets = deliveries.groupingSets([[F.col("innings"), F.col("over")], [F.col("match_id")]], F.col("innings"), F.col("over"), F.col("match_id")).agg(
        F.grouping("match_id").alias("_over"), F.sum("total_runs").alias("runs"), F.count("total_runs").alias("balls"),
        F.count_if(F.col("is_wicket") == 1).alias("wickets"))
    few = sets.groupBy("_over", "innings", "over").agg(
        *[F.sum(c).alias(c) for c in ("runs", "balls", "wickets")], F.count("match_id").alias("_matches"))
    every = Window.partitionBy()  # a row per over of the game and one for all matches
    return few.withColumn("matches", F.sum("_matches").over(every)).filter(F.col("_over") == 1).drop("_over", "_matches")


def _dense_overs(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """Every over 1..20 of both innings, with ``matches`` also where nothing was bowled."""
    known = parts.select("innings", "over", "runs", "wickets", F.struct("matches").alias("of"))
    rows = _spine(spark, innings=range(1, 3), over=range(1, OVERS + 1)).join(known, ["innings", "over"], "left")
    return rows.withColumn("matches", F.coalesce(F.max("of.matches").over(Window.partitionBy()), F.lit(0))).drop("of")  # forty rows


def runs_by_over(deliveries: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Mean runs per ball of each over."""
    if parts is None:
        parts = deliveries.groupBy("innings", "over").agg(F.sum("total_runs").alias("runs"), F.count("total_runs").alias("balls"))
    return parts.filter(F.col("innings").isin(1, 2)).select(
        "innings", "over", safe_div("runs", "balls", fill=None).alias("avg_runs")).orderBy("innings", "over")


def wickets_by_over(deliveries: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Wickets per match in every over 1..20 of both innings."""
    return _dense_overs(deliveries.sparkSession, _by_over(deliveries) if parts is None else parts).select(
        "innings", "over", F.coalesce("wickets", F.lit(0)).alias("wickets"),
        safe_div(F.coalesce("wickets", F.lit(0)), "matches", fill=None).alias("wickets_per_match"),
    ).orderBy("innings", "over")


def score_acceleration(deliveries: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Two-over rolling mean of an over's runs, per match, dense over 1..20."""
    # Forty spine rows: the window never sees more.
    two = Window.partitionBy("innings").orderBy("over").rowsBetween(-1, 0)
    return (
        _dense_overs(deliveries.sparkSession, _by_over(deliveries) if parts is None else parts)
        .withColumn("runs", F.coalesce("runs", F.lit(0)))
        .withColumn("rolling", F.avg("runs").over(two))
        .select("innings", "over", "runs", safe_div("rolling", "matches", fill=None).alias("rolling_rate"))
        .orderBy("innings", "over")
    )


def dismissal_mix(deliveries: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    kinds = parts if parts is not None else (
        deliveries.filter((F.col("is_wicket") == 1) & F.col("wicket_kind").isNotNull())
        .groupBy("wicket_kind").agg(F.count(F.lit(1)).alias("wickets"))
    )
    total = kinds.agg(F.sum("wickets").alias("total"))
    return kinds.crossJoin(F.broadcast(total)).select(  # one row
        "wicket_kind", "wickets", (F.col("wickets") / F.col("total") * 100).alias("share_pct"),
    ).orderBy(F.desc("wickets"), "wicket_kind")


def powerplay_points(matches: DataFrame, deliveries: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(powerplay runs, innings total, season) of every first innings with both known."""
    pp = parts if parts is not None else (
        deliveries.filter((F.col("in_powerplay") == 1) & (F.col("innings") == 1))
        .groupBy("match_id").agg(F.coalesce(F.sum("total_runs"), F.lit(0)).alias("pp_runs"))
    )
    return matches.select("match_id", "innings1_runs", "season_year").join(pp, "match_id").dropna()


def powerplay_trend(points: DataFrame) -> DataFrame:
    """Least-squares line through the points, with the range to draw it over."""
    return points.agg(
        F.regr_slope("innings1_runs", "pp_runs").alias("slope"),
        F.regr_intercept("innings1_runs", "pp_runs").alias("intercept"),
        F.min("pp_runs").alias("pp_from"), F.max("pp_runs").alias("pp_to"),
        F.count(F.lit(1)).alias("matches"),
    )


# The columns of the correlation matrix.
CORRELATED = [
    "innings1_runs", "innings2_runs", "innings1_wickets", "innings2_wickets",
    "pp_runs_inn1", "death_runs_inn1", "toss_bat_first", "team1_won",
]


def correlation_input(matches: DataFrame, deliveries: DataFrame, death_from: int = 17, parts: DataFrame | None = None) -> DataFrame:
    """One row per match with the eight correlated columns.

    Here an undecided match counts as not won by team1.
    """
    first = deliveries.filter(F.col("innings") == 1)
    runs = F.coalesce("total_runs", F.lit(0))
    totals = parts if parts is not None else first.groupBy("match_id").agg(
        F.sum(F.when(F.col("in_powerplay") == 1, runs)).alias("pp_runs_inn1"),
        F.sum(F.when(F.col("over") >= death_from, runs)).alias("death_runs_inn1"),
    )
    return matches.select(
        "match_id", *CORRELATED[:4],
        flag(F.col("toss_decision") == "bat").alias("toss_bat_first"),
        flag(F.col("winner") == F.col("team1")).alias("team1_won"),
    ).join(totals, "match_id", "left")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every pair over the rows where both are known, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[_pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(x).alias("row"), F.lit(y).alias("col"), F.col(f"`{a}|{b}`").alias("r"))
        for a, b in pairs for x, y in ({(a, b), (b, a)})
    ]
    return wide.select(F.inline(F.array(*cells)))


def _pearson(a: str, b: str) -> Column:
    """Pearson r over the rows where both are known; NULL when one side never varies there."""
    both = f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL"
    x, y = (f"CASE WHEN {both} THEN CAST(`{c}` AS double) END" for c in (a, b))
    varies = f"min({x}) < max({x}) AND min({y}) < max({y})"
    r = "1.0D" if a == b else (
        f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0.0D)"
    )
    return F.expr(f"CASE WHEN {varies} THEN {r} END")


def pressure_grid(deliveries: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Mean runs per ball in innings 1 by wickets lost before the ball, one column per over."""
    if parts is None:
        before = clip(F.col("cumulative_wickets") - F.col("is_wicket"), 0, 9).cast("int").alias("wickets_before")
        parts = deliveries.filter(F.col("innings") == 1).groupBy(before, "over").agg(F.sum("total_runs").alias("runs"), F.count("total_runs").alias("balls"))
    at = lambda o, c: F.sum(F.when(F.col("over") == o, F.col(c)))
    grid = parts.groupBy("wickets_before").agg(*[
        F.when(at(o, "balls") > 0, at(o, "runs") / at(o, "balls")).alias(f"over_{o}") for o in range(1, OVERS + 1)
    ])
    return _spine(deliveries.sparkSession, wickets_before=range(0, 10)).join(
        grid, "wickets_before", "left"
    ).orderBy("wickets_before")


def economy_by_phase(deliveries: DataFrame, n: int = 20, phases=REPORT_PHASES, parts: DataFrame | None = None) -> DataFrame:
    """Economy by phase of the ``n`` bowlers with most balls, NULL where one never bowled.

    One scan: the totals per (bowler, phase) also give the overall figures.
    """
    parts = parts if parts is not None else (
        deliveries.filter(F.col("bowler").isNotNull())
        .groupBy("bowler", phase_name("over", phases).alias("phase"))
        .agg(F.sum("total_runs").alias("runs"), _balls().alias("balls"))
    )
    top = (
        parts.groupBy("bowler").agg(F.sum("runs").alias("all_runs"), F.sum("balls").alias("all_balls"))
        .orderBy(F.desc("all_balls"), "bowler").limit(n)
    )
    # At most n bowlers are left before anything else moves.
    kept = parts.join(F.broadcast(top), "bowler").groupBy("bowler", "all_runs", "all_balls").agg(*[
        F.max(F.when(F.col("phase") == p[0], safe_div("runs", "balls", fill=None) * 6)).alias(f"p{i}")
        for i, p in enumerate(phases, start=1)
    ])
    cells = [
        F.struct(F.lit(p[0]).alias("phase"), F.lit(i).alias("phase_order"), F.col(f"p{i}").alias("economy"))
        for i, p in enumerate(phases, start=1)
    ]
    overall = (safe_div("all_runs", "all_balls", fill=None) * 6).alias("overall_economy")
    return kept.select("bowler", overall, F.inline(F.array(*cells))).orderBy(
        "overall_economy", "bowler", "phase_order"
    )


def partnerships(deliveries: DataFrame, order: Sequence[str] = ("over", "ball"), slot: str | None = None) -> DataFrame:
    """Runs of every first-innings partnership, numbered by the wicket that ends it.

    A stand that ends in a wicket counts even without runs, the unfinished last
    one only with runs.  ``order`` and ``slot`` as in ``innings.running_totals``.
    """
    needed = dict.fromkeys(["match_id", *order, *([slot] if slot else []), "total_runs", "is_wicket"])
    first = deliveries.filter((F.col("innings") == 1) & F.col("match_id").isNotNull()).select(*needed)
    if slot is None:
        earlier = Window.partitionBy("match_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        numbered = first.withColumn("down", F.coalesce(F.sum("is_wicket").over(earlier), F.lit(0)))
    else:
        numbered = state_before(first, ["match_id"], sums={"down": F.col("is_wicket")}, order=order, slot=slot)
    stands = numbered.groupBy("match_id", (F.col("down") + 1).cast("int").alias("wicket_num")).agg(
        F.sum("total_runs").alias("runs"), F.max("is_wicket").alias("ended")
    )
    return stands.filter(((F.col("ended") == 1) | (F.col("runs") > 0)) & (F.col("wicket_num") <= 10))


def partnership_summary(deliveries: DataFrame) -> DataFrame:
    """Mean, median and number of partnerships by wicket; the median works on counts per total."""
    counts = partnerships(deliveries).groupBy("wicket_num", "runs").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("wicket_num").agg(
        (F.sum(F.col("runs") * F.col("n")) / F.sum("n")).alias("mean_runs"),
        F.percentile("runs", 0.5, F.col("n")).alias("median_runs"),
        F.sum("n").alias("partnerships"),
    ).orderBy("wicket_num")


def extras_leakage(deliveries: DataFrame, matches: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Wides and no-balls conceded per match by each franchise."""
    per_match = parts if parts is not None else (
        deliveries.dropna(subset=["match_id", "bowling_team"]).groupBy("match_id", "bowling_team")
        .agg((F.coalesce(F.sum("wides"), F.lit(0)) + F.coalesce(F.sum("noballs"), F.lit(0))).alias("extras"))
    )
    teams = per_match.groupBy(F.col("bowling_team").alias("team")).agg(
        F.avg("extras").alias("avg_per_match"), F.sum("extras").alias("total"),
        F.count(F.lit(1)).alias("matches"),
    )
    return teams.join(franchises(matches), "team", "left_semi").orderBy("avg_per_match", "team")


def scoring_zones(deliveries: DataFrame, phases=REPORT_PHASES, zones=SCORING_ZONES, parts: DataFrame | None = None) -> DataFrame:
    """Share of dots, run-scoring balls and boundaries in each phase, in percent.

    Balls outside every zone (more than six off the bat) count nowhere.  A
    phase without balls has NULL shares.
    """
    zone = right_closed_band("batter_runs", zones)
    parts = parts if parts is not None else (
        deliveries.filter(F.col("wides") == 0)
        .select(phase_name("over", phases).alias("phase"), zone.alias("zone"))
        .filter(F.col("zone").isNotNull()).groupBy("phase")
        .agg(*[F.count_if(F.col("zone") == z[0]).alias(z[0]) for z in zones], F.count(F.lit(1)).alias("balls"))
    )
    names = deliveries.sparkSession.range(1, len(phases) + 1).select(
        F.col("id").cast("int").alias("phase_order"),
        F.element_at(F.array(*[F.lit(p[0]) for p in phases]), F.col("id").cast("int")).alias("phase"),
    )
    return names.join(parts, "phase", "left").select(
        "phase", "phase_order",
        *[(F.col(z[0]) / F.col("balls") * 100).alias(f"{z[0]}_pct") for z in zones],
    ).orderBy("phase_order")
