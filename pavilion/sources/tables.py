"""The base tables and feature tables on disk."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import season_year
from ..functions.fixed_values import FEATURE_GROUPS
from ..schemas import DELIVERIES, MATCHES, ddl


def coerce(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Give string columns their declared types; a value that does not fit is NULL.

    Whole numbers may arrive as "157.0", so integers go through double.
    """
    out = []
    for name, kind in schema.items():
        if kind in ("int", "bigint"):
            number = f"try_cast(`{name}` AS double)"
            out.append(F.expr(f"try_cast(nanvl({number}, NULL) AS {kind})").alias(name))
        else:
            out.append(F.expr(f"try_cast(`{name}` AS {kind})").alias(name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: dict[str, str], multi_line: bool = False) -> DataFrame:
    """Scan a CSV export: read as text, take columns by header name, then coerce.

    The header line gives the order; a column that is not there is NULL, one that
    is not asked for is not parsed.  All files of a folder need the same header.
    ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    """
    first = spark.read.text(path).first()
    header = next(csv.reader([first[0]])) if first else []
    # Quotes inside a quoted field are doubled.
    raw = (
        spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).option("multiLine", multi_line)
        .schema(ddl(dict.fromkeys(header, "string"))).csv(path)
    ) if header else spark.createDataFrame([], ddl(dict.fromkeys(schema, "string")))
    return coerce(raw.withColumns({c: F.lit(None).cast("string") for c in schema if c not in raw.columns}), schema)


def read_matches(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(ddl(MATCHES)).parquet(path) if form == "parquet" else read_csv(spark, path, MATCHES)


def read_deliveries(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    if form == "parquet":
        return spark.read.schema(ddl(DELIVERIES)).parquet(path)
    return read_csv(spark, path, DELIVERIES)


def with_season_year(matches: DataFrame) -> DataFrame:
    return matches.withColumn("season_year", season_year("season"))


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: str | None = None) -> None:
    """Write a table as Parquet, or as CSV with a header for exchange.

    Rows leave as the plan holds them: no repartition, hence no shuffle for a sink.
    A line break inside a field is quoted; such a file is read with ``multi_line``.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if form == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).option("escape", '"').csv(path)


def write_clustered(df: DataFrame, name: str, path: str, buckets: int, key: str = "match_id", order: Sequence[str] = ("innings", "over", "ball")) -> DataFrame:
    """Write a table whose rows lie by ``key``, as table ``name`` of the catalog with its files under ``path``; returns it read back.

    The rows move once, here: a grouping or a window by ``key`` (and further columns) and a join with another table of as many
    buckets then reads them where they lie.  One file a bucket; ``order`` holds inside a key.
    """
    by = [c for c in order if c in df.columns]
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def run_summary(documents: DataFrame, deliveries: DataFrame) -> DataFrame:
    """How many matches and deliveries came through and how many documents did not."""
    docs = documents.agg(
        F.count_if(F.col("reason").isNull()).alias("matches"),
        F.count_if(F.col("reason").isNotNull()).alias("errors"),
    )
    balls = deliveries.agg(F.count(F.lit(1)).alias("deliveries"))
    return docs.crossJoin(F.broadcast(balls))  # one row each


def feature_summary(features: DataFrame) -> DataFrame:
    """Which feature columns exist, by group, with the rows and values behind each."""
    present = [(g, c) for g, cols in FEATURE_GROUPS.items() for c in cols if c in features.columns]
    counts = features.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for _, c in present]
    )
    entries = F.array(*[
        F.struct(F.lit(g).alias("feature_group"), F.lit(c).alias("feature"),
                 F.col(f"n_{c}").alias("not_null"))
        for g, c in present
    ])
    return counts.select("rows", F.inline(entries)).select("feature_group", "feature", "rows", "not_null")
