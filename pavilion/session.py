"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pavilion")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        # Building a column expression otherwise walks the Python stack every time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Small inputs: still give every core a share of the window work.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    A cluster has to name one.  Only a local session, where every task runs on
    this machine, may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pavilion-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_of_job: ContextVar[list[str] | None] = ContextVar("paths written by the running job", default=None)


@contextmanager
def leaving_nothing(spark: SparkSession) -> Iterator[None]:
    """Delete what ``written`` wrote inside the block when it ends, also on failure."""
    paths: list[str] = []
    token = _of_job.set(paths)
    try:
        yield
    finally:
        _of_job.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_releasing: dict[int, tuple[int, str]] = {}  # of a session: writes under way, and its own setting
_release_lock = Lock()


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """A query that begins inside the block leaves no shuffle files when it ends.

    Otherwise they stay until the driver happens to collect its garbage.  Writes
    may run side by side; the last one to end restores the session's setting.
    """
    with _release_lock:
        n, own = _releasing.get(id(spark)) or (0, spark.conf.get(_RELEASE))
        _releasing[id(spark)] = n + 1, own
        spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        with _release_lock:
            n, own = _releasing.pop(id(spark))
            if n > 1:
                _releasing[id(spark)] = n - 1, own
            else:
                spark.conf.set(_RELEASE, own)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a value must not change if a task is run again (positions in a
    global order) or where several outputs hang on one expensive parse.  The
    folder carries the application id, so whatever expires old checkpoints can
    expire these too.  What the write shuffled is deleted with its end: no other
    query reads it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if (job := _of_job.get()) is not None:
        job.append(path)
    with shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
