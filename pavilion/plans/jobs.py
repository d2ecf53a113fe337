"""The jobs a user runs, from folder to folder; none leaves anything in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics
from ..session import leaving_nothing, written
from ..sources.documents import delivery_rows, match_rows, quarantined, read_documents, usable
from ..sources.tables import feature_summary, read_deliveries, read_matches, run_summary, write_table
from . import models, serving, training
from .features import feature_tables
from .reports import all_reports


def ingest(spark: SparkSession, documents: str, out: str, single: str | None = None,
           form: str = "parquet", **layout) -> DataFrame:
    """Match documents -> ``matches``, ``deliveries`` and ``quarantine``; returns the run summary.

    ``layout`` goes to ``read_documents``.
    """
    with leaving_nothing(spark):
        parsed = written(read_documents(spark, documents, single, **layout), "documents")  # parse each text once
        good = usable(parsed)
        write_table(match_rows(good), f"{out}/matches", form)
        write_table(delivery_rows(good), f"{out}/deliveries", form)
        write_table(quarantined(parsed), f"{out}/quarantine", form)
        # Counting a Parquet table reads its footers only.  Observations are no way here: a session that has used one
        # can no longer serialize the transformers of Spark ML, which a later job of the same session needs.
        summary = run_summary(parsed, read_deliveries(spark, f"{out}/deliveries", form))
        return spark.createDataFrame(summary.collect(), summary.schema)  # one row


def build_features(spark: SparkSession, tables: str, out: str, form: str = "parquet", **options) -> DataFrame:
    """``matches`` and ``deliveries`` -> three feature tables; returns the feature summary."""
    matches = read_matches(spark, f"{tables}/matches", form)
    deliveries = read_deliveries(spark, f"{tables}/deliveries", form)
    with leaving_nothing(spark):
        for name, table in feature_tables(matches, deliveries, **options).items():
            write_table(table, f"{out}/{name}")
    return feature_summary(spark.read.parquet(f"{out}/match"))


def build_reports(spark: SparkSession, tables: str, out: str, form: str = "parquet") -> list[str]:
    """Write every report of the two base tables; returns their names."""
    with leaving_nothing(spark):
        reports = all_reports(
            read_matches(spark, f"{tables}/matches", form), read_deliveries(spark, f"{tables}/deliveries", form)
        )
        for name, table in reports.items():
            write_table(table, f"{out}/{name}")
        return list(reports)


def _stored(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    for name, table in tables.items():
        write_table(table, f"{out}/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in tables}


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("match", "batting", "bowling"))


def train_winner(spark: SparkSession, features: str, out: str,
                 sizes: models.Sizes = models.Sizes(), folds: int = models.FOLDS) -> dict[str, DataFrame]:
    """Cross-validate, fit, save the winner model and its evaluation tables; returns the latter."""
    with leaving_nothing(spark):
        return _train_winner(spark, features, out, sizes, folds)


def _train_winner(spark, features, out, sizes, folds):
    table = written(training.winner_table(*read_features(spark, features)), "winner-table")
    train, test = training.split(table)
    model, cv = models.fit_and_validate(models.WINNER, train, sizes, folds)
    cv = written(cv, "winner-cv")
    model.save(f"{out}/winner_model")
    scored = written(model.transform(test), "winner-test")
    summary = models.cv_summary(cv)
    return _stored(spark, {
        "cv": cv, "cv_summary": summary, "report": metrics.classification_report(scored),
        "roc": metrics.roc_curve(scored), "auc": metrics.auc(scored),
        "importances": model.importances(table, 20),
        "overfit": metrics.overfit_check(summary, metrics.accuracy(scored)),
    }, f"{out}/winner_evaluation")


def train_score(spark: SparkSession, features: str, out: str,
                sizes: models.Sizes = models.Sizes(), folds: int = models.FOLDS) -> dict[str, DataFrame]:
    """Cross-validate, fit, save the score model, its metadata and its evaluation tables; returns the latter."""
    with leaving_nothing(spark):
        return _train_score(spark, features, out, sizes, folds)


def _train_score(spark, features, out, sizes, folds):
    table = written(training.score_table(*read_features(spark, features)), "score-table")
    train, test = training.split(table)
    model, cv = models.fit_and_validate(models.SCORE, train, sizes, folds)
    cv = written(cv, "score-cv")
    model.save(f"{out}/score_model")
    scored = written(model.transform(test), "score-test")
    summary = models.cv_summary(cv)
    write_table(metrics.residual_metadata(scored, table, summary), f"{out}/score_metadata")
    return _stored(spark, {
        "cv": cv, "cv_summary": summary, "report": metrics.regression_report(scored),
        "residuals": metrics.residuals(scored), "importances": model.importances(table, 15),
    }, f"{out}/score_evaluation") | {"metadata": spark.read.parquet(f"{out}/score_metadata")}


def predict(spark: SparkSession, fixtures: DataFrame, features: str, trained: str, out: str,
            with_score: bool = True, **options) -> DataFrame:
    """Predictions for a fixture table with models saved by the two training jobs, written to ``out``."""
    winner = models.StackedModel.load("winner", f"{trained}/winner_model")
    score = models.StackedModel.load("score", f"{trained}/score_model") if with_score else None
    metadata = spark.read.parquet(f"{trained}/score_metadata") if with_score else None
    with leaving_nothing(spark):
        write_table(serving.predict(fixtures, *read_features(spark, features), winner, score, metadata, **options), out)
    return spark.read.parquet(out)
