"""Source analysis over files that are generated from the shared tables, so that SQL over the same tables tells the answer."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcquarry.plans import evidence, patches, report, rules
from srcquarry.plans.graph_queries import REACH_SQL
from srcquarry.plans.resolve import Repositories
from srcquarry.plans.tables import EDGES_SQL, edges, table
from srcquarry.sources.declarations import Boundary, Project, declarations

PROJECT = Project(roots=("src",), entry=("src/app/n0.py",), min_lines=4, min_tokens=12, max_cyclomatic=4, max_cognitive=100, hotspot_score=1000)


def nation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module for each nation, importing those that its edges point at."""
    lines = edges(spark, sf_dir).groupBy(F.col("src").alias("n_nationkey")).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("from app import n%d", "dst"))), "\n").alias("imports"))
    n = table(spark, sf_dir, "nation").join(lines, "n_nationkey", "left")
    return n.select(F.lit("nations").alias("repo"), F.format_string("src/app/n%d.py", "n_nationkey").alias("path"), F.concat(F.coalesce("imports", F.lit("")), F.lit("\n")).alias("text"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part a module, in one of 25 repositories, with a function of as many branches as its size modulo 7."""
    p = table(spark, sf_dir, "part")
    body = F.repeat(F.lit("    if value:\n        value -= 1\n"), F.col("p_size") % 7)
    return p.select(F.col("p_brand").alias("repo"), F.format_string("src/app/p%d.py", "p_partkey").alias("path"), F.concat(F.lit("def work(value):\n"), body, F.lit("    return value\n")).alias("text"))


def number(column: str) -> Column:
    return F.regexp_extract(column, r"(\d+)(\.py)?$", 1)


def source_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Repositories(nation_files(spark, sf_dir), PROJECT).edges
    return e.select(number("importer").cast("int").alias("src"), number("target").cast("int").alias("dst")).distinct()


def source_unused_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.unused_modules(Repositories(nation_files(spark, sf_dir), PROJECT))
    return found.select(number("module").cast("int").alias("node"), "confidence")


def source_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Repositories(part_files(spark, sf_dir), PROJECT).functions
    return f.select(F.col("repo").alias("brand"), number("path").cast("long").alias("p_partkey"), "cyclomatic", "cognitive", "lines")


def source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity findings of all repositories, counted."""
    return rules.complexity(Repositories(part_files(spark, sf_dir), PROJECT)).groupBy(F.col("repo").alias("brand"), "rule").agg(F.count("*").alias("n"))



def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` in as many partitions as a shuffle makes: a small file of keys is one task, and much text comes of it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def ring_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer, in the repository of its nation, three modules that import one another in a ring."""
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    rows = c.select(F.format_string("nation%d", "c_nationkey").alias("repo"), "c_custkey", F.inline(F.expr("array(struct('a' AS m, 'from app import k%d_c, k%d_b' AS t), struct('b' AS m, 'import app.k%d_c' AS t), struct('c' AS m, 'from app import k%d_a, k%d_a' AS t))")))
    return rows.select("repo", F.format_string("src/app/k%d_%s.py", "c_custkey", "m").alias("path"), F.replace("t", F.lit("%d"), F.col("c_custkey").cast("string")).alias("text"))


def region_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package for each region that passes on its nations by a star (odd ones by ``__all__``), and ``world``, which passes on all
    regions' stars; ``ring`` and ``world`` pass on one another."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.format_string("N%d", "n_nationkey"))).alias("names"))
    body = F.array_join(F.transform("names", lambda x: F.concat(x, F.lit(" = 1"))), "\n")
    listed = F.when(F.col("n_regionkey") % 2 == 1, F.concat(F.lit("\n__all__ = ['"), F.array_join("names", "', '"), F.lit("']"))).otherwise("")
    k = F.col("n_regionkey")
    inner = n.select(F.format_string("r%d/impl.py", k).alias("path"), F.concat(body, F.lit("\n_hidden = 1"), listed).alias("text"))
    outer = n.select(F.format_string("r%d/__init__.py", k).alias("path"), F.format_string("from r%d.impl import *\n", k).alias("text"))
    world = n.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("from r%d import *", k))), "\n").alias("t")).select(F.lit("world/__init__.py").alias("path"), F.concat("t", F.lit("\nfrom ring import *\n")).alias("text"))
    ring = n.limit(1).select(F.lit("ring/__init__.py").alias("path"), F.lit("from world import *\n").alias("text"))
    return inner.unionByName(outer).unionByName(world).unionByName(ring).select(F.lit("regions").alias("repo"), "path", "text")


def framework_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a file of the repository of its nation, whose name or text tells a framework by the remainder of its key."""
    s, at = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 11
    path = F.when(at == 0, F.format_string("src/s%d/urls.py", "s_suppkey")).when(at == 1, F.format_string("tests/test_s%d.py", "s_suppkey")).otherwise(F.format_string("src/s%d.py", "s_suppkey"))
    text = F.when(at == 2, "import sqlalchemy.orm\n").when(at == 3, "from web import FastAPI\napp = FastAPI()\n").otherwise("import sqlite3\n")
    return s.select(F.format_string("nation%d", "s_nationkey").alias("repo"), path.alias("path"), text.alias("text"))


def source_cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways round all import cycles, with how many of their steps an edge proves."""
    c = Repositories(ring_files(spark, sf_dir), PROJECT).cycle_paths
    return c.select("repo", F.array_join("path", " -> ").alias("way"), F.size("steps").alias("steps"), F.size("members").alias("members"))


def source_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Repositories(region_packages(spark, sf_dir), PROJECT).exported
    return e.select("module", "name", "source", "origin_module", "origin_symbol", "confidence", "complete", "explicit")


def source_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests stand beside ``src``, so the repository's own folder is a root too; roots that are found would leave them out."""
    return Repositories(framework_files(spark, sf_dir), Project(roots=("src", "."), include_tests=True)).frameworks


def state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' modules again: imports of odd nations are for types only, and the key tells what else a module does."""
    line = F.when(F.col("dst") % 2 == 1, F.format_string("if TYPE_CHECKING:\n    from app import n%d", "dst")).otherwise(F.format_string("from app import n%d", "dst"))
    lines = edges(spark, sf_dir).groupBy(F.col("src").alias("n_nationkey")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("imports"))
    k = F.col("n_nationkey")
    more = F.concat(
        F.when(k % 7 == 3, "from web import FastAPI\napp = FastAPI()\n").otherwise(""),
        F.when(k % 6 == 5, "import importlib\nimportlib.import_module(name)\n").otherwise(""),
        F.when(k % 4 == 1, "VALUE = 1\n__all__ = ['VALUE']\n").otherwise(""),
    )
    n = table(spark, sf_dir, "nation").join(lines, "n_nationkey", "left")
    body = F.concat(F.lit("from typing import TYPE_CHECKING\n"), F.coalesce("imports", F.lit("")), F.lit("\n"), more)
    return n.select(F.lit("nations").alias("repo"), F.format_string("src/app/n%d.py", k).alias("path"), body.alias("text"))


def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six states of the nations' modules: imports for types count for reach."""
    s = Repositories(state_files(spark, sf_dir), PROJECT).states
    return s.select(number("module").cast("int").alias("node"), "reachable", "referenced", "entrypoint_managed", "public_api", "framework_managed", "dynamic_uncertain")


def source_reached_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs and what is only known to types, of the same modules, by one search."""
    v = Repositories(state_files(spark, sf_dir), PROJECT).views
    return v.select(number("node").cast("int").alias("node"), (F.col("views") % 2 == 1).alias("runs"), (F.col("views") >= 2).alias("known"))


def reexport_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages ``r<region>`` pass on their nations' names, ``api`` and ``world`` pass on those; a customer's module uses its
    nation's name through one of the three."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.format_string("N%d", "n_nationkey"))).alias("names"))
    k = F.col("n_regionkey")
    inner = n.select(F.format_string("r%d/impl.py", k).alias("path"), F.array_join(F.transform("names", lambda x: F.concat(x, F.lit(" = 1"))), "\n").alias("text"))
    outer = n.select(F.format_string("r%d/__init__.py", k).alias("path"), F.concat(F.format_string("from r%d.impl import ", k), F.array_join("names", ", ")).alias("text"))
    passing = n.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.format_string("from r%d import ", k), F.array_join("names", ", ")))), "\n").alias("text"))
    whole = passing.select(F.explode(F.array(F.lit("api/__init__.py"), F.lit("world/__init__.py"))).alias("path"), "text")
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, sf_dir, "customer").join(F.broadcast(region), "c_nationkey")  # a nation for each row of a table of 25
    way = F.when(F.col("c_custkey") % 3 == 0, "api").when(F.col("c_custkey") % 3 == 1, "world").otherwise(F.format_string("r%d", k))
    users = c.select(F.format_string("users/c%d.py", "c_custkey").alias("path"), F.concat(F.lit("from "), way, F.format_string(" import N%d\n", "c_nationkey")).alias("text"))
    return inner.unionByName(outer).unionByName(whole).unionByName(users).select(F.lit("regions").alias("repo"), "path", "text")


def source_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of the nations' names at their origin: ``api`` comes before the regions' packages and counts, ``world`` after them."""
    s = Repositories(reexport_files(spark, sf_dir), PROJECT).symbols
    return s.where("module LIKE 'r%.impl'").select("module", "name", F.col("production").cast("long").alias("uses"))


def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part a file in the repository of its brand: thirty lines that parts of one size modulo 5 share, and forty that
    those with remainder 0 or 1 share."""
    p, k = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey"), F.col("p_size") % 5
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("a"), k.cast("string"), F.lit("_"), i.cast("string"), F.lit(" = b * "), i.cast("string"))), "\n")
    both = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("c"), i.cast("string"), F.lit(" = (\n    d + "), i.cast("string"), F.lit("\n)"))), "\n")
    return p.select(F.col("p_brand").alias("repo"), F.format_string("src/app/p%d.py", "p_partkey").alias("path"), F.concat(own, F.lit("\n"), F.when(k < 2, both).otherwise("")).alias("text"))


def source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted groups of equal code: one for each set of files."""
    d = Repositories(duplicate_files(spark, sf_dir), replace(PROJECT, strict_duplicates=True)).duplicates
    files = F.array_sort(F.array_distinct(F.transform("fragments", lambda f: f["path"])))
    return d.select(F.col("repo").alias("brand"), F.size(files).cast("long").alias("files"), number_of(files[0]).alias("first_part"))


def suppressed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a file with a stale comment on a line of its own, after code, or none."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    second = F.when(k % 3 == 0, "# srcquarry: ignore[large-file]\n").when(k % 3 == 1, F.format_string("b = %d  # srcquarry: ignore[large-file] for now\n", k)).otherwise("b = 2\n")
    return s.select(F.format_string("nation%d", "s_nationkey").alias("repo"), F.format_string("src/s%d.py", k).alias("path"), F.concat(F.lit("a = 1\n"), second, F.lit("c = 3")).alias("text"))


def source_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diffs that take stale comments away."""
    files = suppressed_files(spark, sf_dir)
    r = Repositories(files, PROJECT)
    found = rules.classified(rules.with_suppressions(rules.parse_errors(r), r))
    return patches.unified(patches.stale_comments(found), files).select("repo", "path", "patch")


def source_line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of the lines at which the parts' functions are found too complex."""
    files = part_files(spark, sf_dir)
    found = rules.complexity(Repositories(files, PROJECT))
    return report.with_line_hashes(found, files).select(F.col("repo").alias("brand"), "path", "line", "line_hash")


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the report of a run with an item for each order: a plan, a list of issues, or a text that breaks off."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    severity = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warning").otherwise("info")
    item = F.struct(F.col("o_orderpriority").alias("rule"), severity.alias("severity"), F.when(F.col("o_totalprice") > 150000, "high").otherwise("low").alias("confidence"), F.col("o_orderkey").cast("string").alias("fingerprint"))
    each = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(item).alias("items")).join(c, "c_custkey")
    text = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(F.col("items").alias("blocking")))).otherwise(F.to_json(F.struct(F.col("items").alias("issues"))))
    text = F.when(F.col("c_custkey") % 10 == 1, F.substring(text, 1, 25)).otherwise(text)
    return each.select(F.format_string("nation%d", "c_nationkey").alias("repo"), F.col("c_custkey").cast("string").alias("report"), text.alias("text"))


def evidence_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, unread = evidence.findings_of(run_reports(spark, sf_dir))
    lost = unread.groupBy("repo").agg(F.count("*").alias("n")).select(F.lit("unread").alias("what"), F.col("repo").alias("value"), "n")
    return evidence.counters(found).unionByName(lost)


def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as findings of their users: which were not seen in the last day of all events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("fingerprint"), F.col("ts").cast("timestamp").alias("seen"))
    return evidence.states(e, "1 day").select("repo", "fingerprint", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "runs", "status")


def dependent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a file, every fourth one a test, that imports one of five packages; each nation declares two and one more."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    repo = F.format_string("nation%d", "s_nationkey").alias("repo")
    path = F.when(k % 4 == 0, F.format_string("tests/test_s%d.py", k)).otherwise(F.format_string("src/s%d.py", k))
    code = s.select(repo, path.alias("path"), F.format_string("import pkg%d\n", k % 5).alias("text"))
    return code.unionByName(s.select(repo).distinct().select("repo", F.lit("requirements.txt").alias("path"), F.lit("pkg0>=1\npkg1\npkg9 # idle\n").alias("text")))


def source_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against used packages."""
    files = dependent_files(spark, sf_dir)
    return rules.dependencies(Repositories(files, PROJECT, declarations(files))).select("repo", "rule", F.col("target").alias("package"), "severity")


def source_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity findings that no comment suppresses, and comments of even parts that suppress nothing."""
    comment = F.when(F.regexp_extract("path", r"(\d+)\.py$", 1).cast("int") % 2 == 0, "  # srcquarry: ignore[high-complexity]").otherwise("")
    files = part_files(spark, sf_dir).withColumn("text", F.concat(F.lit("def work(value):"), comment, F.substring("text", 17, 10_000)))
    r = Repositories(files, PROJECT)
    return rules.with_suppressions(rules.complexity(r), r).select(F.col("repo").alias("brand"), number_of(F.col("path")).alias("p_partkey"), "rule")


def source_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of nations 20 to 24 by nations 10 to 19."""
    rule = Boundary("tens", ("app.n1?",), ("src/app/n2?.py",), "error")
    found = rules.boundaries(Repositories(nation_files(spark, sf_dir), replace(PROJECT, boundaries=(rule,))))
    return found.select(number("module").cast("int").alias("src"), number("target").cast("int").alias("dst"), "severity").distinct()


def source_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity findings against those of odd parts under a lower limit."""
    files = part_files(spark, sf_dir)
    now = rules.fingerprinted(rules.complexity(Repositories(files, PROJECT)))
    odd = files.where(F.regexp_extract("path", r"(\d+)\.py$", 1).cast("int") % 2 == 1)
    before = report.baseline_of(rules.fingerprinted(rules.complexity(Repositories(odd, replace(PROJECT, max_cyclomatic=3)))))
    new, existing, resolved = (df.groupBy(F.col("repo").alias("brand")).agg(F.count("*").alias("n")) for df in report.compared(now, before))
    return new.withColumn("status", F.lit("new")).unionByName(existing.withColumn("status", F.lit("existing"))).unionByName(resolved.withColumn("status", F.lit("resolved")))


def number_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.py$", 1).cast("long")


STATE_SQL = f"""WITH RECURSIVE {EDGES_SQL},
    reach(n) AS (SELECT 0 UNION SELECT dst FROM edges JOIN reach ON src = n),
    runs(n) AS (SELECT 0 UNION SELECT dst FROM edges JOIN runs ON src = n WHERE dst % 2 = 0)"""


QUERIES = {
    source_import_edges: f"WITH {EDGES_SQL} SELECT src, dst FROM edges WHERE src <> dst",
    source_unused_modules: REACH_SQL + " SELECT n_nationkey AS node, 'high' AS confidence FROM nation WHERE n_nationkey NOT IN (SELECT n FROM reach)",
    source_complexity: "SELECT p_brand AS brand, p_partkey, (1 + p_size % 7)::INT AS cyclomatic, (p_size % 7)::INT AS cognitive, (2 + 2 * (p_size % 7))::INT AS lines FROM part",
    source_findings: "SELECT p_brand AS brand, 'high-cyclomatic-complexity' AS rule, count(*) AS n FROM part WHERE 1 + p_size % 7 > 4 GROUP BY 1",
    source_cycle_paths: """SELECT 'nation' || c_nationkey AS repo, printf('app.k%d_a -> app.k%d_b -> app.k%d_c -> app.k%d_a', c_custkey, c_custkey, c_custkey, c_custkey) AS way,
        3::INT AS steps, 3::INT AS members FROM customer""",
    source_exports: """WITH own AS (SELECT 'r' || n_regionkey AS region, 'N' || n_nationkey AS name, n_regionkey % 2 = 1 AS complete FROM nation)
        SELECT module, name, 'star-reexport' AS source, region || '.impl' AS origin_module, name AS origin_symbol, 'low' AS confidence, complete, false AS explicit
        FROM (SELECT *, region AS module FROM own UNION ALL SELECT *, 'world' FROM own UNION ALL SELECT *, 'ring' FROM own)""",
    source_frameworks: """SELECT DISTINCT 'nation' || s_nationkey AS repo, CASE s_suppkey % 11 WHEN 0 THEN 'django' WHEN 1 THEN 'pytest' WHEN 2 THEN 'sqlalchemy' ELSE 'fastapi' END AS framework
        FROM supplier WHERE s_suppkey % 11 < 4""",
    source_states: STATE_SQL
    + """ SELECT n_nationkey AS node, n_nationkey IN (SELECT n FROM reach) AS reachable, n_nationkey IN (SELECT dst FROM edges WHERE src <> dst) AS referenced,
        n_nationkey = 0 AS entrypoint_managed, n_nationkey % 4 = 1 AS public_api, n_nationkey % 7 = 3 AS framework_managed, n_nationkey % 6 = 5 AS dynamic_uncertain FROM nation""",
    source_reached_views: STATE_SQL + " SELECT n AS node, n IN (SELECT n FROM runs) AS runs, true AS known FROM reach",
    source_reference_counts: """SELECT 'r' || n_regionkey || '.impl' AS module, 'N' || n_nationkey AS name, count(c_custkey) FILTER (c_custkey % 3 <> 1) AS uses
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    source_patches: r"""SELECT 'nation' || s_nationkey AS repo, f AS path, '--- a/' || f || chr(10) || '+++ b/' || f || chr(10) || CASE s_suppkey % 3
        WHEN 0 THEN concat_ws(chr(10), '@@ -1,3 +1,2 @@', ' a = 1', '-# srcquarry: ignore[large-file]', ' c = 3', '\ No newline at end of file', '')
        ELSE concat_ws(chr(10), '@@ -1,3 +1,3 @@', ' a = 1', '-b = ' || s_suppkey || '  # srcquarry: ignore[large-file] for now', '+b = ' || s_suppkey || '  # for now', ' c = 3', '\ No newline at end of file', '') END AS patch
        FROM (SELECT *, 'src/s' || s_suppkey || '.py' AS f FROM supplier) WHERE s_suppkey % 3 < 2""",
    source_dependencies: """WITH u AS (SELECT 'nation' || s_nationkey AS repo, 'pkg' || s_suppkey % 5 AS package, bool_and(s_suppkey % 4 = 0) AS tests FROM supplier GROUP BY 1, 2),
        d AS (SELECT DISTINCT 'nation' || s_nationkey AS repo, unnest(['pkg0', 'pkg1', 'pkg9']) AS package FROM supplier),
        x AS (SELECT repo, package, CASE WHEN d.package IS NULL AND NOT tests THEN 'missing-runtime-dependency' WHEN u.package IS NULL THEN 'unused-runtime-dependency'
            WHEN d.package IS NOT NULL AND tests THEN 'runtime-dependency-used-only-in-tests' END AS rule FROM u FULL JOIN d USING (repo, package))
        SELECT repo, rule, package, CASE WHEN rule LIKE 'missing%' THEN 'error' ELSE 'warning' END AS severity FROM x WHERE rule IS NOT NULL""",
    source_suppressions: """SELECT p_brand AS brand, p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'high-cyclomatic-complexity' ELSE 'stale-suppression' END AS rule
        FROM part WHERE (p_partkey % 2 = 1) = (1 + p_size % 7 > 4)""",
    source_boundaries: f"WITH {EDGES_SQL} SELECT DISTINCT src, dst, 'error' AS severity FROM edges WHERE src BETWEEN 10 AND 19 AND dst BETWEEN 20 AND 24",
    source_baseline: """WITH p AS (SELECT p_brand AS brand, p_partkey % 2 = 1 AS odd, 1 + p_size % 7 AS c FROM part)
        SELECT brand, count(*) AS n, CASE WHEN c <= 4 THEN 'resolved' WHEN odd THEN 'existing' ELSE 'new' END AS status FROM p WHERE c > 4 OR (odd AND c > 3) GROUP BY 1, 3""",
    evidence_counters: """WITH f AS (SELECT o_orderpriority AS rule, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'info' END AS severity,
            CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS confidence, 'nation' || c_nationkey AS repo, o_custkey AS c
            FROM orders JOIN customer ON o_custkey = c_custkey),
        g AS (SELECT *, CASE WHEN c % 3 = 0 OR severity = 'error' OR (severity = 'warning' AND confidence = 'high') THEN 'blocking' WHEN severity = 'info' THEN 'auto_safe' ELSE 'review_needed' END AS bucket
            FROM f WHERE c % 10 <> 1)
        SELECT 'rule' AS what, rule AS value, count(*) AS n FROM g GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM g GROUP BY 2
        UNION ALL SELECT 'confidence', confidence, count(*) FROM g GROUP BY 2 UNION ALL SELECT 'repo', repo, count(*) FROM g GROUP BY 2
        UNION ALL SELECT 'bucket', bucket, count(*) FROM g GROUP BY 2 UNION ALL SELECT 'unread', repo, count(DISTINCT c) FROM f WHERE c % 10 = 1 GROUP BY 2""",
    evidence_states: """SELECT user_id::VARCHAR AS repo, event_type AS fingerprint, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS runs,
        CASE WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'resolved' ELSE 'open' END AS status
        FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, event_type""",
    source_line_hashes: """SELECT p_brand AS brand, 'src/app/p' || p_partkey || '.py' AS path, 1 AS line, sha1('def work(value):') AS line_hash
        FROM part WHERE 1 + p_size % 7 > 4""",
    source_duplicates: """WITH p AS (SELECT p_brand AS brand, p_size % 5 AS k, 'src/app/p' || p_partkey || '.py' AS path FROM part),
        sets AS (SELECT brand, list(path ORDER BY path) AS paths FROM p GROUP BY brand, k UNION SELECT brand, list(path ORDER BY path) FROM p WHERE k < 2 GROUP BY brand)
        SELECT brand, len(paths) AS files, regexp_extract(paths[1], '(\\d+)\\.py$', 1)::BIGINT AS first_part FROM sets WHERE len(paths) > 1""",
}
