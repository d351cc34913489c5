"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, types as T

#: A table above this size is never dealt out anew.
SPREAD_BYTES = 16 << 30

REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: dict[str, str] = {}
#: The setting from before, and one entry per holder of ``shuffles_removed``.
_removing: list[str | None] = []
_removing_lock = Lock()
#: Where ``cut`` notes the tables it writes, while somebody owns them.
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, name: str = "gleanery") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GLEANERY_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folder:
            _own_folder[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        named = _own_folder[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/gleanery/{label}-{uuid.uuid4().hex}"


def _has_void(kind: T.DataType) -> bool:
    parts = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [getattr(kind, n) for n in ("elementType", "keyType", "valueType") if hasattr(kind, n)]
    return isinstance(kind, T.NullType) or any(_has_void(p) for p in parts)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    The result no longer depends on executors or on recomputed inputs; being a columnar table, later steps read only
    the columns they use and know its size. Schemas that Parquet cannot hold are checkpointed instead.
    """
    spark = df.sparkSession
    if _has_void(df.schema):
        shared_folder(spark)
        return df.checkpoint(eager=True)
    path = fresh_path(spark, "cut")
    if (owner := _owner.get()) is not None:
        owner.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owning(paths: list[str]) -> Iterator[None]:
    """Tables that ``cut`` writes inside are noted in ``paths``, so that their owner can remove them."""
    token = _owner.set(paths)
    try:
        yield
    finally:
        _owner.reset(token)


def remove_unread(spark: SparkSession, paths: list[str], reader: DataFrame) -> None:
    """Delete the noted tables that ``reader`` does not read, and strike them off ``paths``.

    Results that were not written yet and read such a table are lost, so an owner calls this once they are.
    """
    read = {part for file in reader.inputFiles() for part in file.split("/")[-3:]} if paths else set()
    for path in [p for p in paths if p.rsplit("/", 1)[1] not in read]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        paths.remove(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a query's shuffles go when the query ends, instead of when the driver next collects garbage.

    For loops of queries that each start from written tables and whose result is written or collected once. Threads may overlap.
    """
    with _removing_lock:
        if not _removing:
            _removing.append(spark.conf.get(REMOVE_SHUFFLES, None))
        _removing.append("true")
        spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _removing_lock:
            _removing.pop()
            if len(_removing) == 1:
                before = _removing.pop()
                if before is None:
                    spark.conf.unset(REMOVE_SHUFFLES)
                else:
                    spark.conf.set(REMOVE_SHUFFLES, before)


def keep(df: DataFrame) -> DataFrame:
    """Cache for reuse within one job chain; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out before heavy per-row work when the input is too small to be split by the scan.

    A file with one row group is read by one task. Inputs larger than one scan split per core come in enough
    partitions already and pass through, and so does anything above ``SPREAD_BYTES``, however many cores there are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = 128 * 1024 * 1024
    return df.repartition(cores) if size < min(cores * split, SPREAD_BYTES) else df
