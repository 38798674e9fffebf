"""Greedy selection of conflicting groups, in rounds instead of one sorted pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.sources.scratch import discard, stored

#: So few claims that conflict with no others are settled by one task.
FEW = 1 << 18


def first_fit(claims: DataFrame, group: list[str], places: list[str], order: str, apart: str | None = None, few: int = FEW) -> DataFrame:
    """The ``group`` keys that a pass in ascending ``order`` would take, if each takes all its ``places`` and goes without where
    one of them is taken.

    ``claims`` has a row for each group and place; ``order`` is the same in all rows of a group and no two groups share it.
    In each round every group that is first at all its places is taken, and all groups at these places go: they are what the
    sorted pass would refuse, so each round settles groups everywhere at once.  A round is two aggregations and no pair of
    groups is ever formed.  Rounds number as the longest falling chain of conflicts.

    Where ``apart`` names a key of both groups and places, groups of different values of it never meet: values that have at most
    ``few`` claims left are settled by the sorted pass itself, each in one task, and need no further rounds.
    """
    left = stored(claims.select(*dict.fromkeys([*group, *places, order])).distinct(), "claims")
    taken = None
    while True:
        if apart:
            small = stored(left.groupBy(apart).agg(F.count("*").alias("n")).where(F.col("n") <= few).select(apart), "small")
            whole = stored(left.join(small, apart, "left_semi"), "claims")
            done = stored(sorted_pass(whole, group, places, order, apart), "won")
            taken = done if taken is None else taken.unionByName(done)
            rest = stored(left.join(small, apart, "left_anti"), "claims")
            discard(left, small, whole)
            left = rest
            if left.isEmpty():
                return taken
        first = left.groupBy(*places).agg(F.min(order).alias("_first"))
        won = left.join(first, places).groupBy(*group).agg(F.every(F.col(order) == F.col("_first")).alias("won")).where("won").select(*group)
        won = stored(won, "won")
        if won.isEmpty():
            return taken if taken is not None else won
        taken = won if taken is None else taken.unionByName(won)
        gone = left.join(won, group, "left_semi").select(*places).distinct()
        lost = left.join(gone, places, "left_semi").select(*group).distinct()
        rest = stored(left.join(lost, group, "left_anti"), "claims")
        discard(left)
        left = rest


def sorted_pass(claims: DataFrame, group: list[str], places: list[str], order: str, apart: str) -> DataFrame:
    """The ``group`` keys that are taken in ``order``; the claims of each value of ``apart`` are read as a stream by one task.

    ``claims`` must be a stored table: behind a join by ``apart`` Spark leaves the repartition out, and a join that it then turns
    into a broadcast deals the rows of a value over many tasks.
    """
    rows = claims.repartition(apart).sortWithinPartitions(apart, order, *group)
    schema = rows.select(*group).schema
    at_group, at_places, at_apart = ([rows.columns.index(c) for c in names] for names in (group, places, [apart]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types, part, now, wants, taken = to_arrow_schema(schema), None, None, [], set()

        def settled() -> list[dict]:
            if now is None or not taken.isdisjoint(wants):
                return []
            taken.update(wants)
            return [dict(zip(group, now))]

        for b in batches:
            won, columns = [], [c.to_pylist() for c in b.columns]
            for r in zip(*columns):
                key = tuple(r[k] for k in at_group)
                if key != now:
                    won += settled()
                    now, wants = key, []
                if r[at_apart[0]] != part:
                    part, taken = r[at_apart[0]], set()
                wants.append(tuple(r[k] for k in at_places))
            yield pa.RecordBatch.from_pylist(won, schema=types)
        yield pa.RecordBatch.from_pylist(settled(), schema=types)

    return rows.mapInArrow(run, schema)
