"""Helpers that the corpus operators share: scratch tables, Arrow batches, bounded memo tables."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcquarry.sources import scratch as tables
from srcquarry.sources.scratch import discard, scratch

__all__ = ["Memo", "chunks", "discard", "held", "keyed_text", "map_rows", "pa_schema", "released", "scratch", "slices", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``stored`` with joins as Spark plans them: what the operators join with is small by its files too."""
    return tables.stored(df, name, measured=False)


def keyed_text(df: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Just the columns an operator needs; a null text counts as empty."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text), *more)


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[list, list], dict]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Run ``start()(keys, texts) -> {column: values}`` over Arrow batches; ``start`` is called once per task."""
    out = pa_schema(df.sparkSession, schema)
    names = out.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in slices(batches):
            got = work(b.column(key).to_pylist(), b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(got[n], out.field(n).type) for n in names], schema=out)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def chunks(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """``texts`` in turn, in lists of about ``chars`` characters: split words take ten times the memory of their text."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What ``make()`` gives, kept by this Python worker until another ``key`` is asked for.

    Workers outlive stages: the models of stages that follow each other do not pile up.
    """
    if key not in _held:
        released()
        _held[key] = make()
    return _held[key]


def released() -> None:
    """Called at the start of tasks that hold no such model: the one of an earlier stage goes, and its memory to the system."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


class Memo(dict):
    """A dict that computes what it lacks and holds at most ``limit`` entries: half of them new, half of the generation before,
    from which what is asked again returns."""

    def __init__(self, make: Callable, limit: int = 1_000_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
