"""What reports of many runs and repositories say together: nested JSON read as VARIANT, counters, states of findings, texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcquarry.plans.report import BUCKETS

#: How many rules a summary names, and how many findings of a bucket a comment shows.
TOP_RULES, SHOWN = 15, 20
COUNTED = ("bucket", "severity", "confidence", "rule", "repo")
FIELDS = {"rule": ("rule", "code"), "severity": ("severity",), "confidence": ("confidence",), "fingerprint": ("fingerprint",), "file": ("file", "path"), "message": ("one_liner", "message")}


def report_files(spark: SparkSession, folder: str, names: str = "*.json", repo: str = "local/unknown") -> DataFrame:
    """(repo, report, text) of the report files below ``folder``."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).text(folder)
    return raw.select(F.lit(repo).alias("repo"), F.col("_metadata.file_path").alias("report"), F.col("value").alias("text"))


def items(value: Column, path: str) -> Column:
    """The array at ``path`` of a VARIANT, empty if there is none."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def findings_of(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((repo, report, bucket, FIELDS) of all findings, (repo, report) of reports that are no JSON object).

    A plan's buckets count if one of them holds anything, else the report's issues, with the bucket that severity and confidence
    suggest.  What is no object is left out; fields that are missing or empty are ``unknown``, or empty for texts.
    """
    parsed = reports.select("repo", "report", F.try_parse_json("text").alias("v"))
    fits = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    whole = parsed.where(fits)

    def listed(path: str, bucket: str | None) -> Column:
        return F.transform(items(F.col("v"), f"$.{path}"), lambda x: F.struct(F.lit(bucket).cast("string").alias("bucket"), x.alias("item")))

    planned, plain = F.flatten(F.array(*(listed(b, b) for b in BUCKETS))), listed("issues", None)
    object_only = lambda xs: F.filter(xs, lambda x: F.schema_of_variant(x["item"]).startswith("OBJECT"))
    whole = whole.select("repo", "report", object_only(planned).alias("planned"), object_only(plain).alias("plain"))
    rows = whole.select("repo", "report", F.explode(F.when(F.size("planned") > 0, F.col("planned")).otherwise(F.col("plain"))).alias("x")).select("repo", "report", "x.bucket", "x.item")

    def field(name: str) -> Column:
        given = [F.nullif(F.try_variant_get("item", f"$.{key}", "string"), F.lit("")) for key in FIELDS[name]]
        return F.coalesce(*given, F.lit("" if name in ("fingerprint", "file", "message") else "unknown")).alias(name)

    rows = rows.select("repo", "report", "bucket", *map(field, FIELDS))
    severity, sure = F.lower("severity"), F.lower("confidence") == "high"
    suggested = F.when((severity == "error") | ((severity == "warning") & sure), "blocking").when(severity == "info", "auto_safe").otherwise("review_needed")
    return rows.withColumn("bucket", F.coalesce("bucket", suggested)), parsed.where(~fits).select("repo", "report")


def counters(findings: DataFrame) -> DataFrame:
    """(what, value, n): findings by bucket, severity, confidence, rule and repository in one pass, of rules the most frequent."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in COUNTED)))
    n = findings.select(pairs.alias("p")).groupBy("p.what", "p.value").agg(F.count("*").alias("n"))
    rules = n.where("what = 'rule'").orderBy(F.desc("n"), "value").limit(TOP_RULES)
    return n.where("what <> 'rule'").unionByName(rules)


def states(findings: DataFrame, expiry: str = "7 days") -> DataFrame:
    """(repo, fingerprint, first_seen, last_seen, runs, status) of findings (repo, fingerprint, seen): resolved where none was
    seen for ``expiry`` before the last time that anything was."""
    known = findings.where("fingerprint IS NOT NULL AND seen IS NOT NULL")
    now = known.agg(F.max("seen").alias("now"))
    each = known.groupBy("repo", "fingerprint").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count("*").alias("runs"))
    status = F.when(F.col("last_seen") < F.col("now") - F.expr(f"INTERVAL {expiry}"), "resolved").otherwise("open")
    return each.join(F.broadcast(now)).select("repo", "fingerprint", "first_seen", "last_seen", "runs", status.alias("status"))  # one row


def first_of_buckets(findings: DataFrame, k: int = SHOWN) -> DataFrame:
    """The first ``k`` findings of each bucket, with how many it has."""
    order = Window.partitionBy("bucket").orderBy("repo", "file", "rule", "fingerprint", "message")
    sizes = findings.groupBy("bucket").agg(F.count("*").alias("of"))
    shown = findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return shown.join(F.broadcast(sizes), "bucket")  # a row for each of four buckets


def summary_markdown(findings: DataFrame, unread: DataFrame) -> str:
    """The counters as a text for readers; a list stops at 200 values."""
    titles = {"bucket": "Finding Categories", "severity": "Severities", "confidence": "Confidences", "rule": "Top Rules", "repo": "Findings By Repo"}
    rows = counters(findings).withColumn("place", F.row_number().over(Window.partitionBy("what").orderBy(F.desc("n"), "value"))).where("place <= 200").collect()
    out = ["# Evidence summary", "", f"- Reports with findings: {findings.select('repo', 'report').distinct().count()}", f"- Findings observed: {findings.count()}", ""]
    for what, title in titles.items():
        values = sorted((r for r in rows if r.what == what), key=lambda r: r.place if what == "rule" else r.value)
        out += [f"## {title}", "", *([f"- `{r.value}`: {r.n}" for r in values] or ["- none"]), ""]
    lost = unread.orderBy("repo", "report").limit(200).collect()
    out += ["## Warnings", "", *(f"- {r.repo}: skipped {r.report}" for r in lost), ""] if lost else []
    return "\n".join(out).rstrip() + "\n"


def comment(findings: DataFrame) -> Iterator[str]:
    """Lines of a comment on a change: the first findings of each bucket, and how many more there are."""
    rows = sorted(first_of_buckets(findings).collect(), key=lambda r: (r.bucket, r.place))
    yield "## Findings of this change"
    for bucket in BUCKETS:
        own = [r for r in rows if r.bucket == bucket]
        if own:
            yield f"### {bucket} ({own[0].of})"
            yield from (f"- `{r.rule}` {r.file}: {r.message}" for r in own)
            if own[0].of > len(own):
                yield f"- ... {own[0].of - len(own)} more"
    if not rows:
        yield "Nothing was found."
