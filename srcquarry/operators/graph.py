"""Graph queries as loops of joins; each round is written to the shared folder, so plans stay short and losses cheap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.sources.scratch import discard, stored


def reachable(edges: DataFrame, start: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, hops) of all nodes that can be reached from ``start`` (a column ``node``), with the least number of steps."""
    seen = front = stored(start.select("node").distinct().withColumn("hops", F.lit(0)), "reach")
    hops = 0
    while True:
        hops += 1
        step = front.join(edges.select(F.col(src).alias("node"), F.col(dst).alias("to")), "node").select(F.col("to").alias("node")).distinct()
        front = stored(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hops)), "reach")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if hops % 10 == 0:
            seen = stored(seen, "reach")


def reachable_views(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, views): in which views of a graph each node is reached, as bits.

    ``edges`` (src, dst, views) hold in the views whose bits they carry, ``start`` (node, views) begins in them.  One frontier
    serves all views: a node is visited again only with bits that are new to it.
    """
    every = lambda df: df.groupBy("node").agg(F.bit_or("views").alias("views"))
    edges = stored(edges.groupBy("src", "dst").agg(F.bit_or("views").alias("on")).where("on <> 0"), "edges")
    seen = front = stored(every(start.select("node", "views")).where("views <> 0"), "views")
    rounds = 0
    while not front.isEmpty():
        rounds += 1
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node"), F.col("views").bitwiseAND(F.col("on")).alias("views"))
        known = every(seen).withColumnRenamed("views", "old")
        fresh = F.col("views").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0))))
        front = stored(every(step).join(known, "node", "left").select("node", fresh.alias("views")).where("views <> 0"), "views")
        seen = seen.unionByName(front)
        if rounds % 10 == 0:
            seen = stored(every(seen), "views")
    return every(seen)


def least_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the least label of all nodes that reach each node along (src, dst), its own included."""
    now = stored(labels.select("node", "label", F.lit(True).alias("fresh")), "labels")
    while True:
        sent = now.where("fresh").join(edges, F.col("node") == edges.src).groupBy(F.col("dst").alias("at")).agg(F.min("label").alias("new"))
        after = now.join(sent, now.node == sent.at, "left").select("node", F.least("label", "new").alias("label"), F.coalesce(F.col("new") < F.col("label"), F.lit(False)).alias("fresh"))
        now, before = stored(after, "labels"), now
        discard(before)
        if now.where("fresh").isEmpty():
            return now.drop("fresh")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc_id) of every node of (src, dst): the least node of its strongly connected component.

    Forward labels split the nodes into classes; the nodes of a class that reach its root backwards are the root's
    component.  They go, and the rest starts again.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    left = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    done = None
    while True:
        labels = least_labels(edges, left.withColumn("label", F.col("node")))
        both = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        inside = stored(both.where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "edges")
        roots = labels.where("node = label").select("node")
        back = reachable(inside, roots)
        found = stored(labels.join(back.select("node"), "node", "left_semi").select("node", F.col("label").alias("scc_id")), "components")
        done = found if done is None else done.unionByName(found)
        left = stored(left.join(found, "node", "left_anti"), "nodes")
        if left.isEmpty():
            return done
        kept = left.select(F.col("node").alias("src"))
        edges = stored(edges.join(kept, "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "edges")


def cyclic(edges: DataFrame) -> DataFrame:
    """(node, scc_id, size) of the nodes on a cycle: components of several nodes, and nodes with an edge to themselves."""
    parts = strong_components(edges)
    sizes = parts.groupBy("scc_id").agg(F.count("*").alias("size"))
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    return parts.join(sizes, "scc_id").join(loops, "node", "left").where("size > 1 OR loop").select("node", "scc_id", "size")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of one step or more; for graphs whose closure is meant to be a result."""
    paths = stored(edges.select("src", "dst").distinct(), "paths")
    n = paths.count()
    while True:
        longer = paths.select("src", F.col("dst").alias("mid")).join(paths.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        paths = stored(paths.union(longer).distinct(), "paths")
        n, before = paths.count(), n
        if n == before:
            return paths


def shortest_path(edges: DataFrame, start, goal) -> list:
    """The least of the shortest paths in the order of its nodes; empty if there is none.  Only the path comes to the driver."""
    kind = f"node {dict(edges.dtypes)['src']}"
    levels = stored(reachable(edges, edges.sparkSession.createDataFrame([(goal,)], kind), "dst", "src"), "levels")
    row = levels.where(F.col("node") == start).first()
    if row is None:
        return []
    path = [start]
    for hops in range(row.hops - 1, -1, -1):
        step = edges.where(F.col("src") == path[-1]).join(levels.where(F.col("hops") == hops), edges.dst == levels.node)
        path.append(step.agg(F.min("dst")).first()[0])
    return path


def round_trips(edges: DataFrame) -> DataFrame:
    """(scc_id, path): a closed walk from the least node of each component of (scc_id, src, dst), at each node to the least
    neighbour that was not met yet, until the first is a neighbour.  Where all neighbours were met it goes to the least of them and from there to the first node,
    even if no edge leads there.  One component is one row of its edges."""
    sides = edges.distinct().groupBy("scc_id", "src").agg(F.array_sort(F.collect_set("dst")).alias("to"))
    whole = sides.groupBy("scc_id").agg(F.collect_list(F.struct("src", "to")).alias("near"))

    def walk(near: dict) -> list:
        first = min(near)
        path, met = [first], {first}
        while True:
            to = near.get(path[-1], [])
            if first in to and len(path) > 1:
                return [*path, first]
            new = next((x for x in to if x not in met), None)
            if new is None:
                return [*path, *to[:1], first]
            path.append(new)
            met.add(new)

    def run(batches):
        for b in batches:
            walks = [walk({x["src"]: x["to"] for x in near}) for near in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(walks, pa.list_(pa.string()))], names=["scc_id", "path"])

    return whole.mapInArrow(run, "scc_id string, path array<string>")
