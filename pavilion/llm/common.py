"""Helpers that the text operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pavilion.session import shared_folder, shuffles_released

#: Bytes of text that a Python worker takes at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the cluster's shared folder; what it shuffled is deleted with its end."""
    shared_folder(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint()  # a query that begins here


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; NULL for a NULL id."""
    return F.crc32(col.cast("string").cast("binary")) % n


def worker_table(name: str, make):
    """A table that a Python worker keeps from task to task, such as a loaded vocabulary; one at a time, so that operators that run after one another do not add up."""
    held = sys.modules.setdefault("_pavilion_worker", types.ModuleType("_pavilion_worker"))
    if getattr(held, "name", None) != name:
        held.table = None
        held.name, held.table = name, make()
    return held.table


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        slot = np.cumsum(size.astype(np.int64)) // limit
        starts = np.flatnonzero(np.diff(slot, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(size)], strict=True):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts, NULL as the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def map_texts(df: DataFrame, columns: list, fn, schema: str, limit: int = BATCH_BYTES) -> DataFrame:
    """Apply ``fn(record batch) -> dict of arrays`` to slices of the named columns; extra columns are dropped first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in text_slices(batches, limit=limit):
            got = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [a.cast(f.type) if isinstance(a := got[f.name], pa.Array) else pa.array(a, f.type) for f in target], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, where: Column, max_rows: int) -> DataFrame:
    """doc_id, text, label (0/1) of at most ``max_rows`` labelled ids that satisfy ``where``, chosen by a hash of the id.

    Ids whose labels disagree are left out; of rows that repeat an id the smallest text stands.  The broadcast ids are
    bounded by ``max_rows``.
    """
    ids = labels.where(where & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(target).alias("label"), F.max(target).alias("most"))
    ids = ids.where((F.col("label") == F.col("most")) & F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
