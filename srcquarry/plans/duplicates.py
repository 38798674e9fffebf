"""Duplicate token windows of source files: groups of equal windows as joins, the final choice by the places they claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.operators.greedy import first_fit
from srcquarry.operators.windows import top_per_group
from srcquarry.sources.scratch import stored


def accepted(found: DataFrame, code: DataFrame, most: int) -> DataFrame:
    """(repo, digest, fragments) of the groups of windows in at least two files that a pass in order of lines (most first), path,
    start and digest takes, each by its first fragment: without those whose set of files was taken or that touch a taken line; of
    each repository the first ``most``.  ``found`` is the result of ``windowed``, ``code`` (repo, path) the files that count.

    Files of one profile have the same windows, so they are in the same groups and lose lines together: the choice is made among
    profiles, with the first path of each, and files come back for the groups that it took.
    """
    files = found.select("repo", "path", "profile").join(code, ["repo", "path"], "left_semi").groupBy("repo", "path").agg(F.min("profile").alias("profile"))
    files = stored(files, "files")
    classes = files.groupBy("repo", "profile").agg(F.count("*").alias("files"), F.min("path").alias("path"))
    once = found.where("windows IS NOT NULL").groupBy("profile").agg(F.first("windows").alias("windows"))
    each = stored(classes.join(once, "profile").select("repo", "profile", "files", "path", F.inline("windows")), "profiles")

    head = F.struct((F.col("ranges")[0]["first"] - F.col("ranges")[0]["last"]).alias("lines"), "path", F.col("ranges")[0]["first"].alias("first"), "digest")
    profiles = F.md5(F.array_join(F.array_sort(F.collect_list("profile")), " "))
    g = each.groupBy("repo", "digest").agg(F.sum("files").alias("files"), F.min_by(head, "path").alias("o"), profiles.alias("profiles"))
    g = stored(g.where("files >= 2").select("repo", "digest", "o", "profiles"), "groups")
    claims = each.join(g, ["repo", "digest"]).select("repo", "digest", "o", "profile", F.explode("places").alias("place"))
    claims = claims.unionByName(g.select("repo", "digest", "o", F.col("profiles").alias("profile"), F.lit(-1).alias("place")))
    kept = first_fit(claims, ["repo", "digest"], ["repo", "profile", "place"], "o", "repo")
    taken = stored(top_per_group(g.join(kept, ["repo", "digest"], "left_semi"), ["repo"], most, F.col("o")).select("repo", "digest", "o"), "taken")

    parts = each.join(taken, ["repo", "digest"]).select("repo", "digest", "o", "profile", "ranges").join(files, ["repo", "profile"])
    parts = parts.groupBy("repo", "digest", "o").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ranges", lambda r: F.struct(F.col("path").alias("path"), r["first"].alias("first"), r["last"].alias("last")))))).alias("fragments"))
    return parts.repartition("repo").sortWithinPartitions("repo", "o").select("repo", "digest", "fragments")
