"""Base tables to feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions.fixed_values import HOME_CITIES
from ..operators.history import with_history
from ..operators.innings import phase_totals
from ..operators.match_rows import with_result, with_setting, with_toss_flags
from ..operators.players import batting_features, bowling_features
from ..operators.timeline import by_date, placed


def match_features(matches: DataFrame, deliveries: DataFrame,
                   homes: Mapping[str, Sequence[str]] = HOME_CITIES,
                   slots: int | None = None, chronological: bool = False,
                   keep_position: bool = False) -> DataFrame:
    """One row per match: the match columns plus everything derived from them and before them.

    ``keep_position`` leaves ``seq`` and ``slot`` in, so a training table built
    next in the same session need not order the matches again.
    """
    rows = with_setting(with_result(with_toss_flags(matches)), homes)
    rows = rows.join(phase_totals(deliveries), "match_id", "left")
    # The join keeps one row per match, so the matches say how many there are.
    ordered = placed(rows, by_date(), slots, rows=matches.count(), label="matches")
    out = with_history(ordered, chronological)
    return out if keep_position else out.drop("seq", "slot")


def feature_tables(matches: DataFrame, deliveries: DataFrame, **options) -> dict[str, DataFrame]:
    return {
        "match": match_features(matches, deliveries, **options),
        "batting": batting_features(deliveries),
        "bowling": bowling_features(deliveries),
    }
