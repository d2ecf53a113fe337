"""Where the queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries that fit full stacked models, minutes each.
FITTING = ("winner_model", "score_model", "model_round_trip", "fixture_predictions", "prediction_invariants", "winner_cross_validation",
           "score_cross_validation", "winner_evaluation", "score_evaluation")


def register(sql: str | None = None):
    """Register a query under its function name, with the SQL it has to agree with."""

    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def near(c) -> Column:
    """Six decimals for comparison.

    Sums taken in another order differ in their last bits; the small shift keeps
    such a difference from deciding an exact tie.
    """
    return F.rint(c * 1000000.0 + 0.001) / 1000000.0


def rounded(df: DataFrame, dates_as_text: bool = True) -> DataFrame:
    """Round every double for comparison and show dates as text."""
    kinds = dict(df.dtypes)
    return df.select(*[
        near(F.col(c)).alias(c) if kinds[c] == "double"
        else F.col(c).cast("string").alias(c) if kinds[c] == "date" and dates_as_text else F.col(c)
        for c in df.columns
    ])
