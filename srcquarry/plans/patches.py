"""Edits that are safe, as rows, and what they make of files, as unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["repo", "path"]
CONTEXT = 3


def without(line: Column, comment: Column) -> Column:
    """``line`` less the first ``comment`` in it; words after the comment stay a comment."""
    before = F.split_part(line, comment, F.lit(1))
    after = F.substring(line, F.length(before) + F.length(comment) + 1, F.length(line))
    rest = F.when((F.trim(after) == "") | F.ltrim(after).startswith("#"), after).otherwise(F.concat(F.lit("# "), F.ltrim(after)))
    return F.when(F.contains(line, comment), F.concat(before, rest)).otherwise(line)


def stale_comments(findings: DataFrame) -> DataFrame:
    """(repo, path, line, before, after) of the lines that stale suppressions stand in; ``after`` is null where nothing is left.

    All stale comments of a line make one edit.
    """
    seen = F.from_json("evidence", "line_text string, suppression string")
    f = findings.where("rule = 'stale-suppression' AND decision = 'auto_safe'").select(*KEYS, "line", seen.alias("e"))
    f = f.groupBy(*KEYS, "line").agg(F.first("e.line_text").alias("before"), F.array_sort(F.collect_list("e.suppression")).alias("comments"))
    left = F.rtrim(F.aggregate("comments", F.col("before"), lambda line, comment: without(line, comment)), F.lit(" \t"))
    return f.select(*KEYS, "line", "before", F.when(F.trim(left, F.lit(" \t")) != "", left).alias("after"))


def as_patches(edits: DataFrame) -> DataFrame:
    """(repo, path, line, patch): each edit as JSON for a plan."""
    kind = F.when(F.col("after").isNull(), "delete_line").otherwise("replace_line")
    return edits.select(*KEYS, "line", F.to_json(F.struct(kind.alias("type"), F.col("path").alias("file"), "line", "before", "after"), {"ignoreNullFields": "false"}).alias("patch"))


def unified(edits: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, patch): one unified diff for each edited file of (repo, path, text), with three lines of context.

    Only lines near an edit are kept.  Hunks begin where the kept lines have a gap, so edits that are near one another share
    one; the new numbers of a hunk follow from the lines that went before it.  Line ends and a missing last one are kept.
    """
    own = files.join(edits.select(*KEYS).distinct(), KEYS, "left_semi")
    whole = F.col("text").endswith("\n")
    parts = F.split("text", "\n")
    lines = own.select(*KEYS, whole.alias("whole"), F.posexplode(F.when(whole, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)).alias("line", "text"), F.size(parts).alias("n"))
    lines = lines.withColumn("line", F.col("line") + 1).withColumn("open", ~F.col("whole") & (F.col("line") == F.col("n")))
    near = edits.select(*KEYS, F.explode(F.sequence(F.col("line") - CONTEXT, F.col("line") + CONTEXT)).alias("line")).distinct()
    kept = lines.join(near, [*KEYS, "line"], "left_semi").join(edits.select(*KEYS, "line", F.lit(True).alias("edited"), "after"), [*KEYS, "line"], "left")

    by_line = Window.partitionBy(*KEYS).orderBy("line")
    gap = F.coalesce(F.col("line") - F.lag("line").over(by_line) > 1, F.lit(True))
    gone = (F.col("edited") & F.col("after").isNull()).cast("int")
    kept = kept.withColumn("gone", F.coalesce(gone, F.lit(0))).withColumn("gap", gap.cast("int"))
    kept = kept.withColumn("hunk", F.sum("gap").over(by_line)).withColumn("gone_before", F.sum("gone").over(by_line) - F.col("gone"))
    end = F.when(F.col("open"), "\n\\ No newline at end of file").otherwise("")
    old = F.concat(F.when(F.col("edited"), "-").otherwise(" "), "text", end)
    body = F.concat_ws("\n", old, F.when(F.col("edited"), F.concat(F.lit("+"), "after", F.when(F.col("text").endswith("\r"), "\r").otherwise(""), end)))

    hunks = kept.groupBy(*KEYS, "hunk").agg(
        F.min("line").alias("start"),
        F.count("*").alias("n"),
        F.sum("gone").alias("gone"),
        F.min("gone_before").alias("gone_before"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", body.alias("body")))), lambda x: x["body"]), "\n").alias("body"),
    )
    size = F.col("n") - F.col("gone")
    start = F.col("start") - F.col("gone_before") - F.when(size == 0, 1).otherwise(0)
    hunk = F.format_string("@@ -%d,%d +%d,%d @@\n%s\n", "start", "n", start, size, "body")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", hunk.alias("hunk")))), lambda x: x["hunk"]), "")
    return hunks.groupBy(*KEYS).agg(text.alias("hunks")).select(*KEYS, F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"), "hunks").alias("patch"))
