"""Would these imports work?  Checks planned imports against the facts before an edit, all of them in one job."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.functions import text
from srcquarry.operators import graph
from srcquarry.operators.similar import similar
from srcquarry.plans.resolve import Repositories
from srcquarry.sources.declarations import normal
from srcquarry.sources.scratch import stored

BUCKETS = ("safe", "review_needed", "hallucinated", "cycle", "boundary", "missing_dependency")
#: Packages that an unknown name may well mean.
COMMON_PACKAGES = "bs4 celery click django fastapi flask httpx numpy pandas pydantic pytest requests sqlalchemy typer".split()
#: How alike names must be that are suggested.
MODULE_CUTOFF, SYMBOL_CUTOFF = 0.6, 0.45


def verify_imports(r: Repositories, planned: DataFrame) -> DataFrame:
    """(repo, importer, raw, target_module, symbol, bucket, distribution, similar) of planned (repo, importer, raw), e.g.
    ``a.b.name as x``, ``..sibling`` or ``a.b.*``.

    ``raw`` is the longest known module and at most one name of it.  hallucinated: no such module or name, ``similar`` then has
    up to three that are alike; review_needed: a star; cycle: the target reaches the importer; boundary: a rule forbids it;
    missing_dependency: neither local, nor standard, nor declared, but a package that is known or mapped.
    """
    spec, _ = text.import_spec(F.trim("raw"))
    own = r.modules.select("repo", F.col("module").alias("importer"), F.col("is_package").alias("inits"))
    p = planned.select("repo", "importer", "raw", spec.alias("spec")).distinct().join(own, ["repo", "importer"], "left")
    package = F.when(F.coalesce("inits", F.lit(False)), F.col("importer")).otherwise(F.regexp_replace("importer", r"\.?[^.]*$", ""))
    name = F.coalesce(text.absolute_name(F.col("spec"), package), F.regexp_replace("spec", r"^\.+", ""))
    p = p.withColumn("name", F.coalesce(name, F.lit(""))).withColumn("star", F.col("name").endswith(".*")).withColumn("name", F.regexp_replace("name", r"\.\*$", "")).drop("spec", "inits")
    asked = p.select("repo", "importer", "raw", "name", F.posexplode(text.prefixes(F.col("name"))).alias("rank", "module"))
    hit = asked.join(r.modules.select("repo", "module", "path"), ["repo", "module"]).groupBy("repo", "importer", "raw").agg(F.min_by(F.struct("module", "path"), "rank").alias("hit"))
    p = p.join(hit, ["repo", "importer", "raw"], "left").select("repo", "importer", "raw", "name", "star", F.col("hit.module").alias("target_module"), F.col("hit.path").alias("target_path"))
    p = p.withColumn("symbol", F.when(F.col("target_module") != F.col("name"), F.substring("name", F.length("target_module") + 2, F.length("name"))))
    names = r.symbols.select("repo", F.col("module").alias("target_module"), F.col("name").alias("symbol"))
    passed = r.imports.where("is_package").select("repo", F.col("module").alias("target_module"), F.coalesce("alias", "symbol", "raw").alias("symbol"))
    stars = r.exported.select("repo", F.col("module").alias("target_module"), F.col("name").alias("symbol"))
    known = names.unionByName(passed).unionByName(stars).distinct().withColumn("known", F.lit(True))
    p = stored(p.join(known, ["repo", "target_module", "symbol"], "left"), "planned")
    # all targets' reach in one closure over the graph that the targets span
    back = p.where("target_module IS NOT NULL AND target_module <> importer").select(F.concat_ws(":", "repo", "target_module").alias("start"), F.concat_ws(":", "repo", "importer").alias("goal")).distinct()
    closes = reaching(r.edges, back).withColumn("closes", F.lit(True))
    p = p.withColumn("start", F.concat_ws(":", "repo", "target_module")).withColumn("goal", F.concat_ws(":", "repo", "importer")).join(closes, ["start", "goal"], "left")
    own = r.modules.select("repo", F.col("module").alias("importer"), F.col("path").alias("importer_path"))
    p = p.join(own, ["repo", "importer"], "left")
    hits = lambda patterns, path, module: text.matches_glob(F.col(path), *patterns) | text.matches_glob(F.col(module), *patterns)
    forbidden = F.lit(False)
    for b in r.project.boundaries:
        forbidden = forbidden | F.coalesce(hits(b.sources, "importer_path", "importer") & hits(b.disallow, "target_path", "target_module"), F.lit(False))
    top = F.substring_index("name", ".", 1)
    mapped = F.lit(None).cast("string")
    for known_name, package_name in sorted(r.project.import_map.items(), key=lambda x: len(x[0])):
        mapped = F.when((F.col("name") == known_name) | F.col("name").startswith(f"{known_name}."), normal(package_name)).otherwise(mapped)
    p = p.withColumn("top", top).withColumn("package", F.coalesce(mapped, text.package_name(top)))
    if r.declared is not None:
        p = p.join(r.declared.where("scope <> 'script'").select("repo", F.col("name").alias("package")).distinct().withColumn("declared", F.lit(True)), ["repo", "package"], "left")
    else:
        p = p.withColumn("declared", F.lit(None).cast("boolean"))
    packages = {*COMMON_PACKAGES, *(normal(x) for pair in r.project.import_map.items() for x in pair)}
    outside = F.col("target_module").isNull()
    missing_name = F.col("symbol").isNotNull() & F.col("known").isNull()
    bucket = (
        F.when(F.col("name") == "", "hallucinated")
        .when(F.col("star"), "review_needed")
        .when(~outside & missing_name, "hallucinated")
        .when(outside & (top.isin(*sorted(sys.stdlib_module_names)) | F.coalesce("declared", F.lit(False))), "safe")
        .when(outside & (F.col("package").isin(*sorted(packages)) | text.package_name(top).isin(*sorted(packages))), "missing_dependency")
        .when(outside, "hallucinated")
        .when(F.coalesce("closes", F.lit(False)), "cycle")
        .when(forbidden, "boundary")
        .otherwise("safe")
    )
    p = stored(p.withColumn("bucket", bucket), "verified")
    lost = p.where("bucket = 'hallucinated' AND name <> ''")
    module = lost.where("target_module IS NULL").select("repo", F.lit("").alias("inside"), "name", F.lit(MODULE_CUTOFF).alias("cutoff"))
    symbol = lost.where("target_module IS NOT NULL").select("repo", F.col("target_module").alias("inside"), F.col("symbol").alias("name"), F.lit(SYMBOL_CUTOFF).alias("cutoff"))
    here = names.unionByName(stars).select("repo", F.col("target_module").alias("inside"), F.col("symbol").alias("name"))
    here = here.unionByName(r.modules.select("repo", F.lit("").alias("inside"), F.col("module").alias("name")))
    close = similar(module.unionByName(symbol), here, ["repo", "inside"]).select("repo", "inside", F.col("name").alias("wanted"), F.col("close").alias("similar"))
    p = p.withColumn("inside", F.coalesce("target_module", F.lit(""))).withColumn("wanted", F.when(F.col("bucket") == "hallucinated", F.when(outside, F.col("name")).otherwise(F.col("symbol"))))
    p = p.join(close, ["repo", "inside", "wanted"], "left").withColumn("distribution", F.when(outside & ~top.isin(*sorted(sys.stdlib_module_names)), F.col("package")))
    return p.select("repo", "importer", "raw", "target_module", "symbol", "bucket", "distribution", F.coalesce("similar", F.array().cast("array<string>")).alias("similar"))


def reaching(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (start, goal) ``pairs`` for which a path exists: one breadth-first search that carries its starts along."""
    pairs = stored(pairs, "pairs")
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    seen = front = stored(pairs.select("start", F.col("start").alias("node")).distinct(), "search")
    while True:
        step = front.join(steps, "node").select("start", F.col("to").alias("node")).distinct()
        front = stored(step.join(seen, ["start", "node"], "left_anti"), "search")
        if front.isEmpty():
            return seen.withColumnRenamed("node", "goal").join(pairs, ["start", "goal"], "left_semi")
        seen = stored(seen.unionByName(front), "search")


def cycle_path(r: Repositories, repo: str, importer: str, target: str) -> list[str]:
    """The modules of the cycle that ``importer -> target`` would close, importer first; empty if none."""
    path = graph.shortest_path(r.edges.select("src", "dst").distinct(), f"{repo}:{target}", f"{repo}:{importer}")
    return [importer, *(n.partition(":")[2] for n in path)] if path else []
