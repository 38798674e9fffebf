"""Graph queries over the digraph of nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcquarry.operators import aggregates, graph, joins
from srcquarry.plans.tables import EDGES_SQL, edges, table, trade
from srcquarry.sources.scratch import stored

REACH_SQL = f"WITH RECURSIVE {EDGES_SQL}, reach(n) AS (SELECT 0 UNION SELECT dst FROM edges JOIN reach ON src = n)"
PATHS_SQL = f"WITH RECURSIVE {EDGES_SQL}, tc(src, dst) AS (SELECT src, dst FROM edges UNION SELECT tc.src, e.dst FROM tc JOIN edges e ON tc.dst = e.src)"
ALL_SQL = PATHS_SQL + """, nodes AS (SELECT src AS n FROM edges UNION SELECT dst FROM edges),
mutual AS (SELECT n AS a, n AS b FROM nodes UNION SELECT x.src, x.dst FROM tc x JOIN tc y ON x.src = y.dst AND x.dst = y.src),
scc AS (SELECT a AS node, min(b) AS scc_id FROM mutual GROUP BY 1)"""


def root(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0,)], "node int")


def edge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


def unreachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = graph.reachable(stored(edges(spark, sf_dir), "edges"), root(spark))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), "n_name")
    return joins.missing(nations, seen, "node")


def reach_filtered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to a higher-numbered node only, as one view of the graph."""
    return graph.reachable(stored(edges(spark, sf_dir).where("dst > src"), "edges"), root(spark)).select("node")


def scc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(edges(spark, sf_dir))


def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), "n_name")
    return graph.cyclic(stored(edges(spark, sf_dir), "edges")).join(nations, "node")


def shortest_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(stored(edges(spark, sf_dir), "edges"), root(spark)).select("node", F.col("hops").cast("long").alias("hops"))


def would_close_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New edges between nations of the same region that would close a cycle: the target already reaches the source."""
    n = table(spark, sf_dir, "nation")
    planned = n.select(F.col("n_nationkey").alias("src"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("dst"), "n_regionkey"), "n_regionkey").where("src <> dst").select("src", "dst")
    return planned.join(graph.closure(edges(spark, sf_dir)).select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")


def fan_in_out_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.degrees(trade(spark, sf_dir))


def fan_in_out_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.degrees(trade(spark, sf_dir), distinct=False)


def instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = aggregates.degrees(edges(spark, sf_dir))
    return d.select("node", (F.col("fan_out") * 1000 / (F.col("fan_in") + F.col("fan_out"))).cast("long").alias("per_mille"))


def propagate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's own trade plus that of the nodes that point at it, one step."""
    own = trade(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("own"))
    sent = edges(spark, sf_dir).join(own.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("own").alias("sent"))
    return own.join(sent, "node", "full_outer").select("node", (F.coalesce("own", F.lit(0)) + F.coalesce("sent", F.lit(0))).alias("total"))


QUERIES = {
    edge_build: f"WITH {EDGES_SQL} SELECT src, dst FROM edges",
    unreachable_nodes: REACH_SQL + " SELECT n_nationkey AS node, n_name FROM nation WHERE n_nationkey NOT IN (SELECT n FROM reach)",
    reach_filtered_view: f"WITH RECURSIVE {EDGES_SQL}, reach(n) AS (SELECT 0 UNION SELECT dst FROM edges JOIN reach ON src = n WHERE dst > src) SELECT n AS node FROM reach",
    scc_components: ALL_SQL + " SELECT node, scc_id FROM scc",
    cycle_members: ALL_SQL + """, sized AS (SELECT scc_id, count(*) AS size FROM scc GROUP BY 1)
        SELECT node, scc_id, size, n_name FROM scc JOIN sized USING (scc_id) JOIN nation ON n_nationkey = node
        WHERE size > 1 OR node IN (SELECT src FROM edges WHERE src = dst)""",
    shortest_hops: f"WITH RECURSIVE {EDGES_SQL}, h(n, hops) AS (SELECT 0, 0::BIGINT UNION SELECT dst, hops + 1 FROM edges JOIN h ON src = n WHERE hops < 25) SELECT n AS node, min(hops) AS hops FROM h GROUP BY 1",
    would_close_cycle: PATHS_SQL + """ SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
        WHERE EXISTS (SELECT 1 FROM tc WHERE tc.src = b.n_nationkey AND tc.dst = a.n_nationkey)""",
    fan_in_out_distinct: f"WITH {EDGES_SQL}, p AS (SELECT src, dst FROM f) SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM p UNION ALL SELECT dst, 1, 0 FROM p) GROUP BY 1",
    fan_in_out_multi: f"WITH {EDGES_SQL} SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, n AS o FROM f UNION ALL SELECT dst, n, 0 FROM f) GROUP BY 1",
    instability: f"WITH {EDGES_SQL} SELECT node, floor(sum(o) * 1000 / (sum(i) + sum(o)))::BIGINT AS per_mille FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1",
    propagate_counts: f"""WITH {EDGES_SQL}, own AS (SELECT src AS node, sum(n) AS own FROM f GROUP BY 1),
        sent AS (SELECT dst AS node, sum(own) AS sent FROM edges JOIN own ON src = node GROUP BY 1)
        SELECT coalesce(own.node, sent.node) AS node, (coalesce(own, 0) + coalesce(sent, 0))::BIGINT AS total FROM own FULL JOIN sent ON own.node = sent.node""",
}
