"""Order within keys, for keys of any size: positions and running hashes that cross partitions, hashes of joined texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from srcquarry.llm.common import slices, stored


def running(df: DataFrame, key: str, order: list[Column], keep: list[str | Column], xors: dict[str, str], name: str) -> DataFrame:
    """The columns ``keep`` of every row, its ``position`` (1, 2, ... within ``key``, a long that may be null) and, for each
    ``{new: old}`` of ``xors``, the exclusive-or of the long column ``old`` over the rows of the key up to it.

    Rows are sorted by range over (key, order), so a large key spreads over several partitions.  Each partition counts from
    its own start; what a key brings from the partitions before is added afterwards, one short row for each partition.
    """
    s = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).select(*keep)
    new = ["position", *xors]
    schema = T.StructType([*s.schema.fields, *(T.StructField(c, T.LongType()) for c in [*new, "_part", "_row"])])
    out = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried, seen = TaskContext.get().partitionId(), None, dict.fromkeys(new, 0), 0
        for b in slices(batches, 20_000):
            n = b.num_rows
            null = b.column(key).is_null().to_numpy(zero_copy_only=False)
            k = b.column(key).fill_null(0).to_numpy(zero_copy_only=False)
            fresh = np.ones(n, bool)
            fresh[1:] = (k[1:] != k[:-1]) | (null[1:] != null[:-1])
            fresh[0] = (bool(null[0]), int(k[0])) != last
            begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            open_rows = n if not fresh.any() else int(fresh.argmax())  # rows of the key that the last batch ended with
            sums = {"position": np.arange(n) - begin + 1}
            sums["position"][:open_rows] += carried["position"]
            for c, old in xors.items():
                v = b.column(old).to_numpy(zero_copy_only=False)
                total = np.bitwise_xor.accumulate(v)
                sums[c] = total ^ (total ^ v)[begin]
                sums[c][:open_rows] ^= carried[c]
            carried = {c: int(v[-1]) for c, v in sums.items()}
            last = (bool(null[-1]), int(k[-1]))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(sums[c]) for c in new), pa.array(np.full(n, part)), pa.array(np.arange(seen, seen + n))], schema=out)
            seen += n

    rows = stored(s.mapInArrow(run, schema), name)
    ends = rows.groupBy("_part").agg(F.min_by(F.struct(key), "_row").alias("first"), F.max_by(F.struct(key, *new), "_row").alias("last"))
    moved, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r._part):
        after = {c: r["last"][c] for c in new}
        if before is not None and before[0] == r["first"][key]:
            brought = before[1]
            moved.append((r._part, r["first"][key], *brought.values()))
            if r["last"][key] == r["first"][key]:
                after = {c: brought[c] + v if c == "position" else brought[c] ^ v for c, v in after.items()}
        before = (r["last"][key], after)
    if not moved:
        out = rows.drop("_part", "_row")
        out.scratch_path = rows.scratch_path
        return out
    # at most one row for each partition
    types = T.StructType([T.StructField(c, T.LongType()) for c in ["_part", "_key", *(f"_{c}" for c in new)]])
    carry = df.sparkSession.createDataFrame(moved, types)
    at = (rows["_part"] == carry["_part"]) & rows[key].eqNullSafe(carry["_key"])
    none = F.lit(0).cast("long")
    fixed = {c: F.col(c) + F.coalesce(f"_{c}", none) if c == "position" else F.col(c).bitwiseXOR(F.coalesce(f"_{c}", none)) for c in new}
    out = rows.join(F.broadcast(carry), at, "left").withColumns(fixed).select(*s.columns, *new)
    out.scratch_path = rows.scratch_path
    return out


def joined_sha256(df: DataFrame, keys: list[str], order: str, text: str, separator: str) -> DataFrame:
    """For each ``keys`` the SHA-256 (lowercase hex) of its texts in ``order``, joined by ``separator``.

    The texts of a key pass one after the other through the hash of one task, which holds one of them at a time.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("sha256", T.StringType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for b in slices(batches, 2_000):
            done = []
            for *k, t in zip(*(b.column(c).to_pylist() for c in keys), b.column(text).to_pylist()):
                if k == last:
                    digest.update(separator.encode())
                else:
                    if digest is not None:
                        done.append((*last, digest.hexdigest()))
                    last, digest = k, hashlib.sha256()
                digest.update(t.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*last, digest.hexdigest()), out)], schema=out)

    return df.select(*keys, order, text).repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
