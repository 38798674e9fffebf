"""Tables that a job writes for itself, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a new local folder only where that is unset (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="srcquarry-")
        spark.conf.set("spark.checkpoint.dir", known)
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


#: The size up to which Spark broadcasts a side of a join: by the sizes of files when it plans, and by measured rows afterwards.
PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"

_lock = threading.Lock()
#: By session and setting: how many writes hold it, and the session's own value (none: unset).
_writes: dict[tuple[int, str], tuple[int, str | None]] = {}
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def value_of(spark: SparkSession, key: str) -> str | None:
    """The session's value now; none where it leaves the size measured to the one planned with."""
    return spark.conf.get(key) if key == PLANNED else spark.conf.get(key, "false" if key == CLEANUP else None)


@contextmanager
def holding(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` hold while a write is under way; the last of several at once puts the session's own back."""
    session = spark._jsparkSession.hashCode()
    with _lock:
        for key, value in settings.items():
            n, before = _writes.get((session, key), (0, None))
            if not n:
                before = value_of(spark, key)
                spark.conf.set(key, value)
            _writes[session, key] = (n + 1, before)
    try:
        yield
    finally:
        with _lock:
            for key in settings:
                n, before = _writes.pop((session, key))
                if n > 1:
                    _writes[session, key] = (n - 1, before)
                elif before is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, before)


def own_value(spark: SparkSession, key: str) -> str | None:
    """The session's value of ``key``, whatever writes under way hold."""
    session = spark._jsparkSession.hashCode()
    with _lock:
        return _writes[session, key][1] if (session, key) in _writes else value_of(spark, key)


def write_settings(spark: SparkSession, measured: bool) -> dict[str, str]:
    """Shuffle files go with their query.  If ``measured``, joins broadcast only what a shuffle has found small enough: packed files
    of keys and nested facts are up to a hundred times as large as rows, and the driver holds every row it broadcasts."""
    return {CLEANUP: "true"} | ({PLANNED: "-1", MEASURED: own_value(spark, MEASURED) or own_value(spark, PLANNED)} if measured else {})


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def stored(df: DataFrame, name: str, measured: bool = True) -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends there, and lost executors cost nothing.  ``measured``: see
    ``write_settings``.

    The shuffle files behind it are not needed any more and go at once, so disk holds one step's and not all steps'.
    """
    spark = df.sparkSession
    path, schema = scratch(spark, name), df.schema
    with holding(spark, write_settings(spark, measured)):
        df.write.parquet(path)
    read = spark.read.schema(schema).parquet(path)
    read.scratch_path = path
    return read


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """The paths that ``scratch`` and ``stored`` take meanwhile, in this thread and context."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*spent: DataFrame) -> None:
    """Delete tables of ``stored`` that no later step reads."""
    for df in spent:
        delete_paths(df.sparkSession, [df.scratch_path])
