"""Scans, filters, joins, aggregations, windows, rankings and set operations of the workload over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcquarry.functions import text
from srcquarry.operators import aggregates, joins, windows
from srcquarry.plans.tables import table

WORDS_SQL = "CASE WHEN trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) = '' THEN []::VARCHAR[] ELSE string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') END"
WINDOWS_SQL = f"""t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, len(w) - 40 + 1, 20)) AS i FROM t WHERE len(w) >= 40),
h AS (SELECT doc_id, i AS start, sha1(array_to_string(w[i + 1 : i + 40], ' '))[1:20] AS digest FROM p)"""
PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
#: (name, glob over p_type); the first match counts.
TYPE_RULES = [("economy", "ECON*"), ("small-like", "*M*L*"), ("pr", "PR*"), ("any-o", "*O*")]
RULES_SQL = "CASE WHEN p_type GLOB 'ECON*' THEN 'economy' WHEN p_type GLOB '*M*L*' THEN 'small-like' WHEN p_type GLOB 'PR*' THEN 'pr' WHEN p_type GLOB '*O*' THEN 'any-o' END"
DAY_US = 86_400_000_000


def duplicate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.duplicate_windows(table(spark, sf_dir, "documents"), "doc_id", "text")


def contaminated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share an 8-word window with a benchmark item, with the number of their such windows."""
    docs = windows.token_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 8, 1)
    items = windows.token_windows(table(spark, sf_dir, "benchmark"), "item_id", "text", 8, 1).select("digest").distinct()
    return docs.join(items, "digest", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of one part shipped within three days of each other."""
    day = F.unix_date(F.to_date("l_shipdate"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", day.alias("first"), (day + 3).alias("last"))
    pairs = joins.overlapping(lines, lines, ["l_partkey"], "first", "last", 30)
    before = F.struct("a.l_orderkey", "a.l_linenumber") < F.struct("b.l_orderkey", "b.l_linenumber")
    return pairs.where(before).groupBy(F.col("a.l_partkey").alias("l_partkey")).agg(F.count("*").alias("pairs"))


def greedy_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the events that begin at least an hour after the last kept one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return windows.greedy_apart(e, "user_id", "at", 3_600_000_000, "event_id").select("user_id", "event_id")


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def declared_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return joins.missing(table(spark, sf_dir, "part").select("p_partkey", "p_name"), used, "p_partkey")


def scope_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return aggregates.use_policy(e, "user_id", F.col("event_type") == "view", F.col("event_type").isin("view", "click"), F.col("event_type") == "error")


def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return aggregates.first_per_group(o, "o_custkey", "o_orderdate", "o_orderkey")


def key_dedupe_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose exact text an earlier document has, with that document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("kept_doc_id"))
    return d.join(first, "digest").where("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id")


def longest_prefix_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's longest registered prefix; registered are host/language pairs and hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    parts = F.split("path", "/")
    known = pages.select(F.explode(F.array(F.array_join(F.slice(parts, 1, 2), "/"), parts[0])).alias("prefix")).distinct()
    hit = joins.first_candidate(pages, "path", text.prefixes(F.col("path"), "/", "/"), known, "prefix")
    return pages.join(hit, "path").select("page_id", "prefix")


def relative_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name ``..x`` as seen from each page's dotted host."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return p.select("page_id", text.absolute_name(F.lit("..x"), F.col("host")).alias("name"))


def cross_class_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders of customers of the BUILDING segment, one for each customer and day."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return o.join(c, "o_custkey").distinct()


def glob_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.get(joins.matching_rules(F.col("p_type"), TYPE_RULES), F.lit(0)).alias("rule")).where("rule IS NOT NULL")


def suppression_rules(spark: SparkSession) -> DataFrame:
    rows = [(1, "error", 30.0), (2, "error", 10.0), (3, "click", 5.0), (4, "purchase", 1e9), (5, "click", 4.0)]
    return spark.createDataFrame(rows, "seq int, event_type string, least double")


SUPPRESSIONS_SQL = "rules(seq, event_type, least) AS (VALUES (1, 'error', 30.0), (2, 'error', 10.0), (3, 'click', 5.0), (4, 'purchase', 1e9), (5, 'click', 4.0)), taken AS (SELECT event_id, min(seq) AS seq FROM events JOIN rules USING (event_type) WHERE value >= least GROUP BY 1)"


def suppression_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that no rule takes."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return joins.apply_first(e, ["event_id"], suppression_rules(spark), ["event_type"], F.expr("d.value >= r.least"), "seq")[0]


def suppression_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are not the first fit of any event."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return joins.apply_first(e, ["event_id"], suppression_rules(spark), ["event_type"], F.expr("d.value >= r.least"), "seq")[1]


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderdate >= '1998-01-01'").select("o_custkey"), o.where("o_orderdate < '1996-01-01'").select("o_custkey")


def baseline_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, base = halves(spark, sf_dir)
    return joins.missing(current, base, "o_custkey")


def baseline_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, base = halves(spark, sf_dir)
    return joins.matching(current, base, "o_custkey")


def baseline_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, base = halves(spark, sf_dir)
    return base.subtract(current)


def baseline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, base = halves(spark, sf_dir)
    return joins.with_status(current, base, "o_custkey").groupBy("baseline_status").agg(F.count("*").alias("n"))


def entry_union_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    branches = [c.where("c_acctbal > 9000"), c.where("c_mktsegment = 'BUILDING'"), c.where("c_nationkey = 3"), c.where("c_acctbal < 0")]
    out = [b.select("c_custkey", F.lit(n).alias("reason")) for n, b in zip(("rich", "building", "nation", "debt"), branches)]
    return joins.first_of_branches(out, "c_custkey").select("c_custkey", "reason")


def reference_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1)))
    return e.select("user_id", *(F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in ("click", "error", "view")))


def export_star_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of all pages, each once for each target."""
    links = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"), "page_id")
    return links.groupBy("target").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("links"))


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return aggregates.counted(table(spark, sf_dir, "events"), total=F.lit(True), errors=kind == "error", views=kind == "view", large=F.col("value") > 50, large_errors=(kind == "error") & (F.col("value") > 50))


def summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select("o_orderpriority", "o_orderstatus", "n", F.col("level").cast("long").alias("level"))


def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer scores of parts: weights by return flag, a capped bonus for lines, and only scores of 20 or more."""
    weight = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.sum(weight) + F.least(F.lit(20), 2 * F.count("*")) + F.greatest(F.max("l_linenumber") - 5, F.lit(0))).alias("score"))
    return s.where("score >= 20")


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg(F.col("p_size").cast("double")).alias("mean_size"), F.max("p_size").alias("max_size"), F.count("*").alias("n"))


def median_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"))


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 20).alias("large"), F.count("*").alias("n"))


def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(text.ranked(F.col("o_orderpriority"), PRIORITIES) >= 3)
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase")).select("event_id", "event_type")


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of changed customers, or with a line from a changed supplier."""
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    changed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    touched = lines.join(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    own = o.join(changed, "o_custkey", "left_semi").select("o_orderkey")
    return own.union(o.join(touched, "o_orderkey", "left_semi").select("o_orderkey")).distinct()


def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    p = table(spark, sf_dir, "pages").select("page_id", text.matches_glob(u, "https://*").alias("secure"), text.matches_glob(u, "*://blog.*", "*://m.*").alias("section"), u.rlike("[?]").alias("has_query"), u.rlike("[.](org|net)/").alias("org_or_net"))
    return p


def classify_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    bucket = F.when(F.col("toxic") == 1, "blocking").when(F.col("quality") == 0, "auto_safe").when(F.col("quality").isNull(), "manual_only").when(F.col("n_chars") > 2000, "review_needed").otherwise("kept")
    return aggregates.in_buckets(d, bucket, ("auto_safe", "review_needed", "blocking", "manual_only", "kept", "never"))


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each part from the template of its type, the last word of which is filled in."""
    kinds = spark.createDataFrame([("ECONOMY", "cheap {name} of {brand}"), ("SMALL", "small {name} by {brand}"), ("LARGE", "{brand}: large {name}")], "p_type string, template string")
    p = table(spark, sf_dir, "part").join(F.broadcast(kinds), "p_type")  # three literal rows
    return p.select("p_partkey", F.replace(F.replace("template", F.lit("{name}"), "p_name"), F.lit("{brand}"), "p_brand").alias("rendered"))


def related_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order of many lines its other parts: the ten smallest."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    others = lines.where("l_linenumber > 1").select("l_orderkey", F.col("l_partkey").alias("other"), F.col("l_linenumber").alias("at"))
    pairs = lines.where("l_linenumber = 1").join(others, "l_orderkey").select("l_orderkey", "other", "at")
    return windows.top_per_group(pairs, ["l_orderkey"], 10, F.col("other"), F.col("at"))


def finding_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return windows.top_rows(lines, 200, F.desc("l_quantity"), F.asc("l_returnflag"), F.asc("l_orderkey"), F.asc("l_linenumber"))


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return windows.top_per_group(lines, ["l_suppkey"], 20, F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"))


def truncated_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each priority has more than 150 orders that a report of 150 would not show."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return o.select("o_orderpriority", F.least("n", F.lit(150)).alias("shown"), (F.col("n") > 150).alias("truncated"))


def running_logical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running number of turns of each conversation that are not the system's."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return windows.running_total(c, ["conv_id"], (F.col("role") != "system").cast("long"), "logical", "turn").select("conv_id", "turn", "logical")


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.fingerprint(F.col("event_type").alias("path"), F.col("props").alias("rule"), F.col("user_id").alias("symbol")).alias("fingerprint"))


def line_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.line_hash(F.col("text")).alias("hash"))


def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.package_name(F.concat_ws("__", "p_brand", "p_name", "p_type")).alias("name"))


def import_spec_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, alias = text.import_spec(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(name).alias("name"), F.md5(alias).alias("alias"))


def json_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", text.first_filled(F.get_json_object(p, "$.missing"), F.get_json_object(p, "$.k"), F.lit("none")).alias("k"))


def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long").alias("links"))


def union_all_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    stages = n.select(F.lit(0).alias("stage"), F.col("n_name").alias("name")).unionByName(c.select(F.lit(1).alias("stage"), F.col("c_name").alias("name"))).unionByName(s.select(F.lit(2).alias("stage"), F.col("s_name").alias("name")))
    return stages.groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).subtract(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


def framework_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that label something toxic, hold long texts, or come first in a language."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = joins.matching(d, labels.where("toxic = 1"), "doc_id").select("source")
    first = d.groupBy("lang").agg(F.min_by("source", "doc_id").alias("source")).select("source")
    return toxic.union(d.where("n_chars > 15000").select("source")).union(first).distinct()


def report_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.signature(table(spark, sf_dir, "documents"), "doc_id", "text")


def grouped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per status and priority: totals, sorted, as a report of counts by GROUPING SETS."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("srcquarry_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM srcquarry_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each distinct part name the three most alike type and brand words; see ``functions.fuzzy``."""
    from srcquarry.functions.fuzzy import close_matches

    p = table(spark, sf_dir, "part").select("p_name").distinct()
    return p.select("p_name", close_matches(["small bolt", "red ring", "blue gear", "hot widget", "green nut"], 3, 0.45)(F.col("p_name")).alias("close"))


HREF = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
PATH_SQL = "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages"
QUERIES = {
    duplicate_windows: f"WITH {WINDOWS_SQL} SELECT digest, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM h GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2",
    contaminated_docs: f"""WITH t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), b AS (SELECT {WORDS_SQL} AS w FROM benchmark),
        x AS (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM t WHERE len(w) >= 8), y AS (SELECT w, unnest(range(0, len(w) - 7)) AS i FROM b WHERE len(w) >= 8)
        SELECT doc_id, count(*) AS n FROM x WHERE array_to_string(w[i + 1 : i + 8], ' ') IN (SELECT array_to_string(w[i + 1 : i + 8], ' ') FROM y) GROUP BY 1""",
    overlap_pairs: """SELECT a.l_partkey, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND (a.l_orderkey, a.l_linenumber) < (b.l_orderkey, b.l_linenumber)
        AND abs(date_diff('day', a.l_shipdate::DATE, b.l_shipdate::DATE)) <= 3 GROUP BY 1""",
    greedy_nonoverlap: """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        g(user_id, k, last, kept) AS (SELECT user_id, k, ts, true FROM o WHERE k = 1 UNION ALL
          SELECT o.user_id, o.k, CASE WHEN o.ts >= g.last + INTERVAL 1 HOUR THEN o.ts ELSE g.last END, o.ts >= g.last + INTERVAL 1 HOUR FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1)
        SELECT o.user_id, o.event_id FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k WHERE kept""",
    missing_keys: "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    declared_unused: "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
    scope_policy: """SELECT user_id, CASE WHEN bool_and(event_type = 'view') THEN 'test-only' WHEN bool_and(event_type IN ('view', 'click')) THEN 'type-only'
        WHEN bool_or(event_type = 'error') THEN 'optional-guarded' ELSE 'runtime' END AS policy FROM events GROUP BY 1""",
    first_per_group: "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    key_dedupe_shadow: "WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS kept_doc_id FROM documents) SELECT doc_id, kept_doc_id FROM f WHERE doc_id <> kept_doc_id",
    longest_prefix_resolve: f"""WITH p AS ({PATH_SQL}), k AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS prefix FROM p UNION SELECT string_split(path, '/')[1] FROM p)
        SELECT page_id, arg_max(prefix, length(prefix)) AS prefix FROM p JOIN k ON path = prefix OR starts_with(path, prefix || '/') GROUP BY page_id""",
    relative_resolve: """WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^https?://([^/]+)', 1), '.') AS h FROM pages)
        SELECT page_id, CASE WHEN len(h) < 2 THEN NULL ELSE array_to_string(h[1 : len(h) - 1], '.') || '.x' END AS name FROM p""",
    cross_class_join: "SELECT DISTINCT o_custkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING'",
    glob_boundary: f"SELECT p_partkey, {RULES_SQL} AS rule FROM part WHERE {RULES_SQL} IS NOT NULL",
    suppression_active: f"WITH {SUPPRESSIONS_SQL} SELECT event_id, event_type, value FROM events WHERE event_id NOT IN (SELECT event_id FROM taken)",
    suppression_stale: f"WITH {SUPPRESSIONS_SQL} SELECT seq::INT AS seq, event_type, least::DOUBLE AS least FROM rules WHERE seq NOT IN (SELECT seq FROM taken)",
    baseline_new: "SELECT o_custkey FROM orders WHERE o_orderdate >= '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < '1996-01-01')",
    baseline_existing: "SELECT o_custkey FROM orders WHERE o_orderdate >= '1998-01-01' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < '1996-01-01')",
    baseline_resolved: "SELECT o_custkey FROM orders WHERE o_orderdate < '1996-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= '1998-01-01'",
    baseline_status: """SELECT CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < '1996-01-01') THEN 'existing' ELSE 'new' END AS baseline_status, count(*) AS n
        FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY 1""",
    entry_union_priority: """SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'rich' WHEN c_mktsegment = 'BUILDING' THEN 'building' WHEN c_nationkey = 3 THEN 'nation' ELSE 'debt' END AS reason
        FROM customer WHERE c_acctbal > 9000 OR c_mktsegment = 'BUILDING' OR c_nationkey = 3 OR c_acctbal < 0""",
    reference_pivot: "SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY 1",
    export_star_expand: f"SELECT target, count(DISTINCT page_id) AS pages, count(*) AS links FROM (SELECT page_id, unnest({HREF}) AS target FROM pages) GROUP BY 1",
    summary_counts: """SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (value > 50) AS large,
        count(*) FILTER (event_type = 'error' AND value > 50) AS large_errors FROM events""",
    summary_rollup: "SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping_id(o_orderpriority, o_orderstatus)::BIGINT AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    weighted_score: """SELECT * FROM (SELECT l_partkey, (sum(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) + least(20, 2 * count(*)) + greatest(max(l_linenumber) - 5, 0))::BIGINT AS score
        FROM lineitem GROUP BY 1) WHERE score >= 20""",
    metric_summary: "SELECT p_brand, avg(p_size::DOUBLE) AS mean_size, max(p_size) AS max_size, count(*) AS n FROM part GROUP BY 1",
    median_by_phase: "SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY 1",
    coverage_counts: "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 20) AS large, count(*) AS n FROM events GROUP BY 1",
    threshold_filter: "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('2-HIGH', '1-URGENT') GROUP BY 1",
    rule_filter: "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')",
    scope_filter: """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
        OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))""",
    path_predicates: "SELECT page_id, url GLOB 'https://*' AS secure, url GLOB '*://blog.*' OR url GLOB '*://m.*' AS section, contains(url, '?') AS has_query, regexp_matches(url, '[.](org|net)/') AS org_or_net FROM pages",
    classify_case: """WITH d AS (SELECT CASE WHEN toxic = 1 THEN 'blocking' WHEN quality = 0 THEN 'auto_safe' WHEN quality IS NULL THEN 'manual_only' WHEN n_chars > 2000 THEN 'review_needed' ELSE 'kept' END AS bucket
        FROM documents LEFT JOIN labels USING (doc_id)), b(bucket) AS (VALUES ('auto_safe'), ('review_needed'), ('blocking'), ('manual_only'), ('kept'), ('never'))
        SELECT b.bucket, count(d.bucket) AS n FROM b LEFT JOIN d ON b.bucket = d.bucket GROUP BY 1""",
    template_render: """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'cheap ' || p_name || ' of ' || p_brand WHEN 'SMALL' THEN 'small ' || p_name || ' by ' || p_brand ELSE p_brand || ': large ' || p_name END AS rendered
        FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE')""",
    related_rows: """SELECT a.l_orderkey, b.l_partkey AS other, b.l_linenumber AS at, row_number() OVER (PARTITION BY a.l_orderkey ORDER BY b.l_partkey, b.l_linenumber)::INT AS rank
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber > 1 QUALIFY rank <= 10""",
    finding_sort_topk: "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem ORDER BY l_quantity DESC, l_returnflag, l_orderkey, l_linenumber LIMIT 200",
    topk_per_group: """SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber)::INT AS rank
        FROM lineitem QUALIFY rank <= 20""",
    truncated_flag: "SELECT o_orderpriority, least(count(*), 150) AS shown, count(*) > 150 AS truncated FROM orders GROUP BY 1",
    running_logical_lines: "SELECT conv_id, turn, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS logical FROM conversations",
    fingerprint: """SELECT event_id, sha1('{"path":' || to_json(event_type) || ',"rule":' || to_json(props) || ',"symbol":' || user_id || '}')[1:20] AS fingerprint FROM events""",
    line_hash: r"SELECT item_id, sha1(regexp_replace(trim(text), '\s+', ' ', 'g')) AS hash FROM benchmark",
    normalize_name: "SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_brand || '__' || p_name || '__' || p_type)), '[-_.]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS name FROM part",
    import_spec_parse: r"""SELECT conv_id, turn, md5(CASE WHEN contains(text, ' as ') THEN regexp_extract(text, '(?s)^(.*) as (.*)$', 1) ELSE text END) AS name,
        md5(CASE WHEN contains(text, ' as ') THEN regexp_extract(text, '(?s)^(.*) as (.*)$', 2) END) AS alias FROM conversations""",
    json_coalesce: "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), nullif(json_extract_string(props, '$.k'), ''), 'none') AS k FROM events",
    href_extract: f"SELECT page_id, len({HREF}) AS links FROM pages",
    union_all_stages: """SELECT stage, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT 0 AS stage, n_name AS name FROM nation UNION ALL SELECT 1, c_name FROM customer UNION ALL SELECT 2, s_name FROM supplier) GROUP BY 1""",
    union_distinct: "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    intersect_keys: "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier",
    except_keys: "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    framework_semi: """SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION SELECT source FROM documents WHERE n_chars > 15000
        UNION SELECT arg_min(source, doc_id) FROM documents GROUP BY lang""",
    report_signature: """WITH p AS (SELECT doc_id % 256 AS part, md5(string_agg(md5(coalesce(text, '')), '' ORDER BY doc_id, md5(coalesce(text, '')))) AS digest FROM documents GROUP BY 1)
        SELECT md5(string_agg(digest, '' ORDER BY part)) AS signature FROM p""",
    grouped_report: "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    fuzzy_candidates: None,
}
