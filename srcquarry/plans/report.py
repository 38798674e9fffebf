"""What is made of findings: summaries, filters, baselines, scopes and documents.

Tables stay DataFrames.  A document for machines (JSON, SARIF, a plan, a graph) holds every finding or edge: its items are a
DataFrame of texts, and ``*_parts`` yield the document piece by piece, so that the driver holds one partition of them at a time.
Only the reports for readers (text, markdown) stop at ``limit`` findings, and say so.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcquarry.functions.text import ranked
from srcquarry.operators import aggregates, joins
from srcquarry.plans.resolve import Repositories
from srcquarry.plans.rules import ALIASES, CONFIDENCES, RULES, SEVERITIES

BUCKETS = ("auto_safe", "review_needed", "blocking", "manual_only")
COMMANDS = {
    "cycles": ("circular-dependency",),
    "dupes": ("duplicate-code",),
    "deps": tuple(k for k, v in RULES.items() if v[1] == "dependencies"),
    "dead-code": ("unused-module", "unused-symbol", "stale-suppression"),
    "health": tuple(ALIASES["high-complexity"]),
    "boundaries": ("boundary-violation",),
}
LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def order() -> list[Column]:
    """Most severe first, then by rule number, place and text."""
    return [ranked(F.col("severity"), SEVERITIES).desc(), F.col("id").asc(), F.coalesce("path", F.lit("")).asc(), F.col("line").asc(), F.coalesce("symbol", F.lit("")).asc(), F.col("message").asc()]


def summary(findings: DataFrame) -> DataFrame:
    rule, severity = F.col("rule"), F.col("severity")
    family = lambda category: rule.isin(*(k for k, v in RULES.items() if v[1] == category))
    return aggregates.counted(
        findings, total_issues=F.lit(True), errors=severity == "error", warnings=severity == "warning", info=severity == "info",
        unused_modules=rule == "unused-module", unused_symbols=rule == "unused-symbol", circular_dependencies=rule == "circular-dependency", duplicate_groups=rule == "duplicate-code",
        complexity_hotspots=family("complexity"), boundary_violations=rule == "boundary-violation",
        missing_dependencies=rule.isin("missing-runtime-dependency", "missing-type-dependency", "missing-test-dependency"), unused_dependencies=rule == "unused-runtime-dependency",
        parse_errors=rule == "parse-error", config_errors=rule == "config-error", stale_suppressions=rule == "stale-suppression",
    )


def filtered(findings: DataFrame, confidence: str = "low", severity: str = "info", command: str | None = None) -> DataFrame:
    out = findings.where((ranked(F.col("confidence"), CONFIDENCES) >= CONFIDENCES.index(confidence)) & (ranked(F.col("severity"), SEVERITIES) >= SEVERITIES.index(severity)))
    return out.where(F.col("rule").isin(*COMMANDS[command])) if command else out


def in_scope(findings: DataFrame, changed: DataFrame, duplicates: DataFrame, cycles: DataFrame, modules: DataFrame) -> DataFrame:
    """Findings of changed files (repo, path), and those of cycles, boundaries and duplicates that touch one.

    The analysis itself is always whole; only its findings are narrowed.
    """
    marks = changed.select("repo", "path").distinct()
    own = modules.join(marks, ["repo", "path"], "left_semi").select("repo", "module")
    digests = duplicates.select("repo", "digest", F.explode(F.transform("fragments", lambda f: f["path"])).alias("path")).join(marks, ["repo", "path"], "left_semi").select("repo", F.col("digest").alias("target")).distinct()
    touched = findings.where("rule = 'circular-dependency'").withColumn("member", F.explode(F.split("target", ","))).join(own.withColumnRenamed("module", "member"), ["repo", "member"], "left_semi").select("repo", "target").distinct()
    bounded = findings.where("rule = 'boundary-violation'").join(own.withColumnRenamed("module", "target"), ["repo", "target"], "left_semi").select("repo", "target").distinct()
    places = findings.join(marks, ["repo", "path"], "left_semi")
    rest = findings.join(marks, ["repo", "path"], "left_anti")
    for rule, keys in (("duplicate-code", digests), ("circular-dependency", touched), ("boundary-violation", bounded)):
        places = places.unionByName(rest.where(F.col("rule") == rule).join(keys, ["repo", "target"], "left_semi"))
    return places


def baseline_of(findings: DataFrame) -> DataFrame:
    return findings.select("repo", "fingerprint", "rule", "path", "symbol", "severity", "confidence")


def compared(findings: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, existing, resolved): fingerprints may repeat in the first two and stand once in the third."""
    return joins.missing(findings, baseline, "repo", "fingerprint"), joins.matching(findings, baseline, "repo", "fingerprint"), joins.missing(baseline, findings, "repo", "fingerprint").select("repo", "fingerprint").distinct()


def with_baseline_status(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """``findings`` with ``baseline_status``: existing or new."""
    known = baseline.select("repo", "fingerprint").distinct().withColumn("_known", F.lit(True))
    return findings.join(known, ["repo", "fingerprint"], "left").withColumn("baseline_status", F.when(F.col("_known"), "existing").otherwise("new")).drop("_known")


def buckets(findings: DataFrame) -> DataFrame:
    return aggregates.in_buckets(findings, F.col("decision"), BUCKETS)


def exit_code(findings: DataFrame, fail_on: str, only_new: DataFrame | None = None) -> int:
    """1 if a finding is at least as severe as ``fail_on`` (``none``, ``any`` or a severity), else 0."""
    if fail_on == "none":
        return 0
    counted = only_new if only_new is not None else findings
    return int(not filtered(counted, severity="info" if fail_on == "any" else fail_on).isEmpty())


def rows(findings: DataFrame, limit: int) -> tuple[list[dict], int]:
    """The first ``limit`` findings in order, and how many there are."""
    return [r.asDict() for r in findings.orderBy(*order()).limit(limit).collect()], findings.count()


def lines(items: DataFrame) -> Iterator[str]:
    return (r.value for r in items.toLocalIterator())


def listed(items: Iterable[str]) -> Iterator[str]:
    """A JSON list, one item in a line."""
    yield "["
    for n, x in enumerate(items):
        yield f"{',' if n else ''}\n{x}"
    yield "]"


def as_object(*fields: str | Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")


def json_items(findings: DataFrame) -> DataFrame:
    """(value): each finding as JSON, in order."""
    return findings.orderBy(*order()).select(as_object(*sorted(findings.columns)))


def json_parts(findings: DataFrame) -> Iterator[str]:
    yield f'{{"summary": {json.dumps(summary(findings).first().asDict(), sort_keys=True)}, "truncated": false, "issues": '
    yield from listed(lines(json_items(findings)))
    yield "}"


LIMITATIONS = (
    "Sources are parsed and never run: what is imported, called or registered by computed names is not seen.",
    "Frameworks are told by names and decorators, so unusual registrations look unused.",
    "Packages are known by name; their versions and what they bring along are not read.",
    "Equal code is told by windows of tokens, not by what it does.",
)


def ambiguities(r: Repositories) -> DataFrame:
    """(repo, module, selected_path, shadowed_path) of files whose module another file, first by path, already has."""
    return r.shadowed.select("repo", "module", F.col("kept_path").alias("selected_path"), F.col("path").alias("shadowed_path"))


def metrics(r: Repositories) -> DataFrame:
    """A row for each repository: functions, mean (two places) and greatest complexity, modules, lines and imports."""
    f = r.functions.groupBy("repo").agg(F.count("*").alias("functions"), F.round(F.avg("cyclomatic"), 2).alias("mean_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"), F.round(F.avg("cognitive"), 2).alias("mean_cognitive"), F.max("cognitive").alias("max_cognitive"))
    m = r.modules.groupBy("repo").agg(F.count("*").alias("modules"), F.sum("line_count").alias("lines"))
    i = r.imports.groupBy("repo").agg(F.count("*").alias("imports"))
    return m.join(f, "repo", "left").join(i, "repo", "left").na.fill(0)


def module_rows(r: Repositories) -> DataFrame:
    """Every module with its place, states, degrees over distinct neighbours and instability (three places, 0 without edges)."""
    d = aggregates.degrees(r.edges)
    m = r.states.join(r.modules.select("repo", "module", "path", "line_count", "is_test"), ["repo", "module"]).withColumn("node", F.concat_ws(":", "repo", "module")).join(d, "node", "left").drop("node")
    both = F.coalesce("fan_in", F.lit(0)) + F.coalesce("fan_out", F.lit(0))
    return m.na.fill(0, ["fan_in", "fan_out"]).withColumn("instability", F.coalesce(F.round(F.try_divide(F.coalesce("fan_out", F.lit(0)), both), 3), F.lit(0.0)))


def whole_json_parts(r: Repositories, findings: DataFrame) -> Iterator[str]:
    """The findings with what they rest on: modules, edges, cycles, ambiguous names, frameworks, measures and limits."""
    yield f'{{"summary": {json.dumps(summary(findings).first().asDict(), sort_keys=True)}, "truncated": false, "issues": '
    yield from listed(lines(json_items(findings)))
    tables = {
        "modules": (module_rows(r), ["repo", "module"]),
        "edges": (r.edges.select("repo", F.col("importer").alias("from"), F.col("target").alias("to"), "path", "line", "symbol", "type_checking"), ["repo", "from", "to", "line", "symbol"]),
        "cycles": (r.cycle_paths.select("repo", "scc_id", "path", "steps"), ["scc_id"]),
        "module_ambiguities": (ambiguities(r), ["repo", "module", "shadowed_path"]),
        "frameworks": (r.frameworks, ["repo", "framework"]),
        "metrics": (metrics(r), ["repo"]),
    }
    for name, (df, keys) in tables.items():
        yield f', "{name}": '
        yield from listed(lines(df.orderBy(*keys).select(as_object(*df.columns))))
    yield f', "limitations": {json.dumps(LIMITATIONS)}}}'


def as_json(findings: DataFrame) -> str:
    return "".join(json_parts(findings))


def as_text(findings: DataFrame, limit: int = 200, markdown: bool = False) -> str:
    shown, n = rows(findings, limit)
    line = (lambda r: f"- **{r['severity']}** `{r['rule']}` {r['path']}:{r['line']} {r['message']}") if markdown else (lambda r: f"{r['severity']:7} {r['id']} {r['path']}:{r['line']} {r['message']} [{r['confidence']}]")
    out = [*(["# Findings", ""] if markdown else []), f"{n} findings", *map(line, shown)]
    return "\n".join(out + ([f"... {n - len(shown)} more"] if n > len(shown) else []))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(id, rule, place) of the rules that occur, sorted; places begin at 0."""
    return findings.select("id", "rule").distinct().withColumn("place", F.row_number().over(Window.orderBy("id", "rule")) - 1)


def source_lines(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo, path, line, text) of the ``wanted`` (repo, path, line) that the files (repo, path, text) have."""
    asked = wanted.select("repo", "path", "line").distinct()
    own = files.join(asked.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    rows = own.select("repo", "path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return rows.join(asked, ["repo", "path", "line"], "left_semi")


def with_line_hashes(findings: DataFrame, files: DataFrame | None) -> DataFrame:
    """Adds ``line_hash``: SHA-1 of the finding's source line with white space folded, or of its place where the line is gone."""
    at = F.greatest(F.lit(1), F.coalesce("line", F.lit(1)))
    gone = F.sha1(F.concat_ws(":", F.coalesce("path", F.lit(".")), at.cast("string"), "rule", F.coalesce("symbol", F.lit(""))))
    if files is None:
        return findings.withColumn("line_hash", gone)
    found = findings.withColumn("line", at)
    text = source_lines(files, found).withColumn("here", F.sha1(F.trim(F.regexp_replace("text", r"\s+", " ")))).select("repo", "path", "line", "here")
    return found.join(text, ["repo", "path", "line"], "left").withColumn("line_hash", F.coalesce("here", gone)).drop("here")


#: What evidence holds that SARIF shows as further places.
PLACES = "import_lines array<struct<`from`: string, to: string, path: string, line: int>>, fragments array<struct<path: string, first: int, last: int>>"


def related_places(limit: int) -> Column:
    """Array of SARIF locations: the imports of a cycle, the fragments of a duplicate, the first ``limit`` of them."""
    seen = F.from_json("evidence", PLACES)
    cycle = F.transform(seen["import_lines"], lambda x: F.struct(F.concat(x["from"], F.lit(" imports "), x["to"]).alias("text"), x["path"].alias("path"), x["line"].alias("first"), x["line"].alias("last")))
    copies = F.transform(seen["fragments"], lambda x: F.struct(F.lit("The same code").alias("text"), x["path"].alias("path"), x["first"].alias("first"), x["last"].alias("last")))
    places = F.slice(F.coalesce(cycle, copies), 1, max(0, limit)) if limit > 0 else F.slice(copies, 1, 0)

    def location(x: Column, i: Column) -> Column:
        region = F.struct(x["first"].alias("startLine"), x["last"].alias("endLine")).alias("region")
        physical = F.struct(F.struct(x["path"].alias("uri")).alias("artifactLocation"), region)
        return F.struct((i + 1).alias("id"), F.struct(x["text"]).alias("message"), physical.alias("physicalLocation"))

    return F.transform(places, location)


def sarif_results(findings: DataFrame, files: DataFrame | None = None, related: int = 20) -> DataFrame:
    """(value): each finding as a SARIF result, in order; ``files`` give the hashes of lines."""
    level = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in LEVELS.items()), F.lit("warning"))
    line = F.greatest(F.lit(1), F.coalesce("line", F.lit(1)))
    region = F.struct(line.alias("startLine"), F.greatest(line, F.coalesce("end_line", line)).alias("endLine"))
    location = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    marks = F.struct(F.col("fingerprint").alias("stable"), F.col("line_hash").alias("primaryLocationLineHash"))
    hashed = with_line_hashes(findings, files).withColumn("related", related_places(related))
    return hashed.join(F.broadcast(sarif_rules(findings)), ["id", "rule"]).orderBy(*order()).select(
        as_object(
            F.col("id").alias("ruleId"), F.col("place").alias("ruleIndex"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
            marks.alias("partialFingerprints"), F.array(location).alias("locations"), F.coalesce("related", F.from_json(F.lit("[]"), hashed.schema["related"].dataType)).alias("relatedLocations"),
            F.struct("rule", "confidence", "category").alias("properties"),
        )
    )


def sarif_parts(findings: DataFrame, files: DataFrame | None = None, related: int = 20) -> Iterator[str]:
    rules = [{"id": r.id, "name": r.rule} for r in sarif_rules(findings).orderBy("place").collect()]
    yield f'{{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{{"tool": {{"driver": {{"name": "srcquarry", "rules": {json.dumps(rules)}}}}}, "results": '
    yield from listed(lines(sarif_results(findings, files, related)))
    yield "}]}"


def as_sarif(findings: DataFrame, files: DataFrame | None = None, related: int = 20) -> dict:
    """A SARIF 2.1.0 log; rules are the sorted ones that occur, results point to them by place."""
    return json.loads("".join(sarif_parts(findings, files, related)))


#: What to look at before acting on a finding, by category.
HINTS = {
    "parse": "Parse the file with the Python version that the project runs on.",
    "config": "Compare the setting with the section it belongs to.",
    "imports": "Look for the module in other source roots, and for a name that a call makes at run time.",
    "architecture": "Find the least concept that both sides share and let it stand alone.",
    "dead-code": "Search templates, settings and entry point tables for the name.",
    "suppressions": "See whether the finding that the comment named was mended or renamed.",
    "dependencies": "Tell a package of another name from one that is really missing or unused.",
    "duplication": "Tell code with one purpose from code that only looks alike.",
    "complexity": "Test what the function does before cutting it into parts.",
}


def plan_items(findings: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """(bucket, value): what to do about each finding and why, bucket by bucket in order, with its patch if there is one."""
    hint = F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair))[F.col("category")]
    if patches is None:
        findings = findings.withColumn("patch", F.lit(None).cast("string"))
    else:
        keys = ["repo", "path", "line"]
        fix = patches.select(*keys, "patch").withColumn("rule", F.lit("stale-suppression"))
        findings = findings.join(fix, [*keys, "rule"], "left")
    item = as_object("rule", F.col("path").alias("file"), "line", "symbol", "fingerprint", F.col("message").alias("one_liner"), "rationale", hint.alias("hint"), F.col("patch").alias("minimal_patch"))
    return findings.where(F.col("decision").isin(*BUCKETS)).orderBy(ranked(F.col("decision"), BUCKETS), *order()).select(F.col("decision").alias("bucket"), item)


def plan_parts(findings: DataFrame, patches: DataFrame | None = None) -> Iterator[str]:
    sizes = {r.bucket: r.n for r in buckets(findings).collect()}
    yield f'{{"summary": {json.dumps({"total": findings.count(), **{f"{b}_count": sizes[b] for b in BUCKETS}})}'
    left = list(BUCKETS)
    for bucket, items in groupby(plan_items(findings, patches).toLocalIterator(), key=lambda r: r.bucket):
        while left[0] != bucket:
            yield f', "{left.pop(0)}": []'
        yield f', "{left.pop(0)}": '
        yield from listed(r.value for r in items)
    yield from (f', "{b}": []' for b in left)
    yield "}"


def fix_plan(findings: DataFrame, patches: DataFrame | None = None) -> dict:
    """The four buckets, always all there, with what to do about each finding."""
    return json.loads("".join(plan_parts(findings, patches)))


def graph_lines(edges: DataFrame, kind: str = "mermaid") -> DataFrame:
    """(value): each edge once, in order."""
    a, b = F.col("importer"), F.col("target")
    if kind == "dot":
        line = F.format_string('  "%s" -> "%s";', a, b)
    else:
        line = F.format_string('  %s["%s"] --> %s["%s"]', F.replace(a, F.lit("."), F.lit("_")), a, F.replace(b, F.lit("."), F.lit("_")), b)
    return edges.select(a, b).distinct().orderBy(a, b).select(line.alias("value"))


def graph_parts(edges: DataFrame, kind: str = "mermaid") -> Iterator[str]:
    yield "digraph imports {" if kind == "dot" else "graph TD"
    yield from (f"\n{x}" for x in lines(graph_lines(edges, kind)))
    if kind == "dot":
        yield "\n}"


def graph_text(edges: DataFrame, kind: str = "mermaid") -> str:
    return "".join(graph_parts(edges, kind))


def context(modules: DataFrame, edges: DataFrame, findings: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """Small tables that describe a code base: degrees by edges, risk, dead code, dependencies."""
    degrees = aggregates.degrees(edges, distinct=False)
    kinds = {c: findings.where(F.col("rule").isin(*COMMANDS[c])).orderBy(*order()).limit(k) for c in ("dead-code", "deps", "health", "boundaries")}
    return {
        "overview": modules.groupBy("repo").agg(F.count("*").alias("modules"), F.sum("line_count").alias("lines"), F.count_if("is_test").alias("tests")),
        "fan_in": degrees.orderBy(F.desc("fan_in"), "node").limit(k),
        "fan_out": degrees.orderBy(F.desc("fan_out"), "node").limit(k),
        **kinds,
    }


def context_json(tables: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """The small tables of ``context`` as lists."""
    return {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()}


def context_markdown(tables: dict[str, DataFrame]) -> str:
    """The same for readers."""
    out = ["# Code base"]
    for name, rows in context_json(tables).items():
        out += ["", f"## {name.replace('_', ' ').replace('-', ' ').capitalize()}"]
        for r in rows:
            if "rule" in r:
                out.append(f"- `{r['rule']}` {r['path']}:{r['line']} {r['message']}")
            else:
                key, *rest = r.items()
                out.append(f"- {key[1]}: " + ", ".join(f"{k} {v}" for k, v in rest))
        out += [] if rows else ["- none"]
    return "\n".join(out) + "\n"


def explained(findings: DataFrame, fingerprint: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the finding, up to ``k`` others of its file)."""
    one = findings.where(F.col("fingerprint") == fingerprint)
    places = one.select("repo", "path").distinct()
    return one, findings.where(F.col("fingerprint") != fingerprint).join(places, ["repo", "path"], "left_semi").orderBy(*order()).limit(k)


def safe_to_remove(findings: DataFrame, asked: DataFrame) -> DataFrame:
    """(fingerprint, decision) for each asked fingerprint; unknown ones are manual_only."""
    known = findings.groupBy("fingerprint").agg(F.first("decision").alias("decision"))
    return asked.select("fingerprint").distinct().join(known, "fingerprint", "left").select("fingerprint", F.coalesce("decision", F.lit("manual_only")).alias("decision"))
