"""The findings: each rule is a query over the facts, all with the same columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcquarry.functions import text
from srcquarry.operators import aggregates
from srcquarry.plans.resolve import CONFIDENCES, Repositories, node, rank
from srcquarry.sources.python_source import marker_pattern

#: Number and category of each rule.
RULES = {
    "parse-error": ("PY000", "parse"), "config-error": ("PY001", "config"), "unresolved-import": ("PY010", "imports"), "dynamic-import": ("PY011", "imports"), "production-imports-test-code": ("PY012", "imports"),
    "circular-dependency": ("PY020", "architecture"), "unused-module": ("PY030", "dead-code"), "unused-symbol": ("PY031", "dead-code"), "stale-suppression": ("PY032", "suppressions"),
    "missing-runtime-dependency": ("PY040", "dependencies"), "missing-type-dependency": ("PY043", "dependencies"), "missing-test-dependency": ("PY044", "dependencies"), "dev-dependency-used-in-runtime": ("PY045", "dependencies"),
    "optional-dependency-used-in-runtime": ("PY046", "dependencies"), "runtime-dependency-used-only-in-tests": ("PY047", "dependencies"), "runtime-dependency-used-only-for-types": ("PY048", "dependencies"), "unused-runtime-dependency": ("PY049", "dependencies"),
    "duplicate-code": ("PY050", "duplication"), "high-cyclomatic-complexity": ("PY060", "complexity"), "high-cognitive-complexity": ("PY061", "complexity"), "large-function": ("PY062", "complexity"), "large-file": ("PY063", "complexity"),
    "boundary-violation": ("PY070", "architecture"), "framework-entrypoint-detected": ("PY080", "frameworks"), "risky-hotspot": ("PY090", "complexity"),
}
SEVERITIES = ("info", "warning", "error")
#: Basenames of modules that frameworks load by name.
LOADED_BY_NAME = "settings config urls admin apps models schemas serializers views tasks conftest".split()
#: Suppression names that stand for several rules.
ALIASES = {
    "high-complexity": ["high-cyclomatic-complexity", "high-cognitive-complexity", "large-function", "large-file", "risky-hotspot"],
    "missing-dependency": ["missing-runtime-dependency", "missing-type-dependency", "missing-test-dependency", "dev-dependency-used-in-runtime"],
    "unused-dependency": ["unused-runtime-dependency", "runtime-dependency-used-only-in-tests", "runtime-dependency-used-only-for-types"],
    "undeclared-optional-dependency": ["optional-dependency-used-in-runtime"],
    "expected-unused": ["unused-module", "unused-symbol"],
}
COLUMNS = ("repo", "rule", "severity", "confidence", "path", "line", "end_line", "symbol", "module", "message", "target", "flags", "evidence")


def finding(df: DataFrame, rule: str | Column, severity: str | Column, confidence: str | Column, message: Column, **more: Column) -> DataFrame:
    """``df`` as findings; ``target`` is what a fingerprint names, ``flags`` what the classification asks for, ``evidence`` a
    struct that becomes JSON."""
    none = F.lit(None).cast("string")
    own = {c: F.col(c) if c in df.columns else none for c in ("module", "path")}
    known = own | {"rule": rule, "severity": severity, "confidence": confidence, "message": message, "target": none, "symbol": none, "line": F.lit(1), "flags": F.array().cast("array<string>")} | more
    known["end_line"] = more.get("end_line", known["line"])
    known["evidence"] = F.to_json(more["evidence"]) if "evidence" in more else none
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("repo", *(lit(known[c]).alias(c) for c in COLUMNS[1:])).withColumns({c: F.col(c).cast("int") for c in ("line", "end_line")})


def case(*pairs: tuple[Column, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for c, v in reversed(pairs):
        out = F.when(c, v).otherwise(out)
    return out


def parse_errors(r: Repositories) -> DataFrame:
    return finding(r.modules.where("parse_error IS NOT NULL"), "parse-error", "error", "high", F.concat(F.lit("File does not parse: "), "parse_error"), line=F.col("error_line"))


def config_errors(r: Repositories) -> DataFrame | None:
    """Settings that do not hold, once for each repository of the run."""
    if not r.project.config_errors:
        return None
    wrong = r.modules.select("repo").distinct().withColumn("e", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(m).alias("text")) for k, m in r.project.config_errors))))
    return finding(wrong, "config-error", "error", "high", F.concat_ws(": ", "e.key", "e.text"), path=F.lit("pyproject.toml"), target=F.col("e.key"))


def import_findings(r: Repositories) -> DataFrame:
    i = r.imports if r.project.include_tests else r.imports.where("NOT is_test")
    dynamic = finding(i.where("NOT literal"), "dynamic-import", "info", "low", F.lit("Import target is not a literal"), line=F.col("line"))
    lost = finding(i.where("level > 0 AND classification = 'unknown' AND literal"), "unresolved-import", "warning", "medium", F.concat(F.lit("No module for "), F.coalesce("symbol", "raw")), line=F.col("line"), target=F.concat(F.repeat(F.lit("."), F.col("level")), "raw"))
    return dynamic.unionByName(lost)


def production_imports_tests(r: Repositories) -> DataFrame:
    tests = r.modules.where("is_test").select("repo", F.col("module").alias("target_module"))
    i = r.imports.where("NOT is_test").join(tests, ["repo", "target_module"]).dropDuplicates(["repo", "module", "target_module", "line"])
    return finding(i, "production-imports-test-code", "warning", "high", F.concat(F.lit("Imports test module "), "target_module"), line=F.col("line"), target=F.col("target_module"))


def circular(r: Repositories) -> DataFrame:
    """One finding for each cycle, with a way round it; its place is the first import of the way in its first file."""
    names = F.transform("members", lambda m: F.substring_index(m, ":", -1))
    typed = F.when(F.exists("steps", lambda s: s["typed"]), F.array(F.lit("typed"))).otherwise(F.array().cast("array<string>"))
    imports = F.transform("steps", lambda x: F.struct(x["importer"].alias("from"), x["target"].alias("to"), x["path"].alias("path"), x["line"].alias("line")))
    evidence = F.struct(imports.alias("import_lines"), F.exists("steps", lambda x: x["typed"]).alias("type_checking_imports_contributed"))
    c = r.cycle_paths.withColumn("at", F.col("steps")[0]).withColumnRenamed("path", "way")
    return finding(c, "circular-dependency", "warning", "high", F.concat(F.lit("Import cycle: "), F.array_join("way", " -> ")), path=F.array_min(F.transform("steps", lambda s: s["path"])), line=F.col("at.line"), module=names[0], target=F.array_join(names, ","), flags=typed, evidence=evidence)


def unused_modules(r: Repositories) -> DataFrame:
    eligible = r.modules.where("parse_error IS NULL AND" + (" NOT is_package AND" if r.project.init_is_entry else "") + " NOT is_migration AND NOT generated AND NOT path RLIKE '/management/commands/'" + ("" if r.project.include_tests else " AND NOT is_test"))
    started = r.entries.select("repo").distinct()
    left = eligible.join(started, "repo", "left_semi").withColumn("node", node()).join(r.reached.select("node"), "node", "left_anti")
    explicit = "high" if r.project.entry else "medium"
    risky = (F.col("dynamic_hints") > 0) | (F.size("framework_hints") > 0) | F.regexp_replace("file", r"\.py$", "").isin(*LOADED_BY_NAME)
    return finding(left, "unused-module", "warning", case((risky, "low"), otherwise=explicit), F.concat(F.lit("No entry point reaches "), "module"))


def unused_symbols(r: Repositories) -> DataFrame:
    p = r.project
    hints = r.modules.select("repo", "module", "generated", "is_migration", (F.size("framework_hints") > 0).alias("framework"), "parse_error")
    offered = r.entries.select("repo", "module").withColumn("entry", F.lit(True))
    s = r.symbols.join(hints, ["repo", "module"]).join(offered, ["repo", "module"], "left")
    if r.declared is not None:
        scripts = r.declared.where("scope = 'script' AND name LIKE '%:%'").select("repo", F.substring_index("name", ":", 1).alias("module"), F.substring_index("name", ":", -1).alias("name")).distinct()
        s = s.join(scripts, ["repo", "module", "name"], "left_anti")
    name, assigned = F.col("name"), F.col("kind") == "assignment"
    dunder = name.startswith("__") & name.endswith("__")
    protocol = F.exists("bases", lambda b: F.substring_index(b, ".", -1) == "Protocol")
    public = F.coalesce(rank("public_confidence") >= CONFIDENCES.index("medium"), F.lit(False))
    skipped = (
        name.isin(*p.ignored_symbols) | (dunder if p.ignore_dunders else F.lit(False)) | (name.startswith("_") & ~dunder) | (protocol if p.ignore_protocols else F.lit(False))
        | F.col("path").rlike("/management/commands/") | F.col("listed") | public | F.col("framework_managed") | (F.col("decorated") if p.ignore_decorated else F.lit(False))
        | F.col("is_package") | (assigned & F.col("framework")) | (F.coalesce("entry", F.lit(False)) & name.isin(*p.entry_symbols))
    )
    unused = F.col("production") == 0
    if p.include_tests:
        unused = unused & (F.col("tests") == 0)
    else:
        unused = unused & ~F.col("is_test")
    s = s.where(~skipped & unused & ~F.col("generated") & ~F.col("is_migration") & F.col("parse_error").isNull()).dropDuplicates(["repo", "module", "name", "line"])
    confidence = case((assigned | F.col("decorated") | F.col("reexported") | (F.col("type_only") > 0) | (F.col("tests") > 0), "low"), otherwise="medium")
    s = s.join(r.states.select("repo", "module", "reachable", "entrypoint_managed", "dynamic_uncertain"), ["repo", "module"])
    state = {
        "framework_managed": F.col("framework_managed"),
        "entrypoint_managed": F.coalesce("entry", F.lit(False)) & name.isin(*p.entry_symbols),
        "public_api": F.col("reexported") | F.col("listed"),
        "dynamic_uncertain": F.col("dynamic_uncertain"),
    }
    evidence = F.struct("kind", "public_confidence", F.struct("reachable", *(c.alias(k) for k, c in state.items())).alias("state"))
    flags = F.array_compact(F.array(*(F.when(c, k) for k, c in state.items())))
    severity = F.when(confidence == "medium", "warning").otherwise("info")
    return finding(s, "unused-symbol", severity, confidence, F.concat(F.lit("Nothing uses "), "name"), line=F.col("line"), end_line=F.col("end_line"), symbol=name, flags=flags, evidence=evidence)


def dependencies(r: Repositories) -> DataFrame:
    """Declared against used packages, by the decision table of the rules."""
    p, d = r.project, r.declared.where("scope <> 'script'")
    imports = r.imports.where("classification = 'third-party'").where(~F.col("distribution").isin(*p.ignored_packages) if p.ignored_packages else F.lit(True))
    used = aggregates.use_policy(imports.withColumn("key", F.struct("repo", "distribution")), "key", F.col("is_test"), F.col("type_checking"), F.col("guarded")).select("key.repo", "key.distribution", "policy")
    more = imports.groupBy("repo", "distribution").agg(F.count_if(~F.col("is_test") & ~F.col("type_checking") & ~F.col("guarded")).alias("uses"), F.min_by(F.struct("path", "line", "module", "guarded"), F.struct("path", "line")).alias("at"))
    scopes = d.groupBy("repo", F.col("name").alias("distribution")).agg(*(F.bool_or(F.col("scope") == s).alias(s) for s in ("runtime", "optional", "dev")), F.min("source").alias("source"))
    x = used.join(more, ["repo", "distribution"]).join(scopes, ["repo", "distribution"], "full_outer")
    x = x.withColumns({s: F.coalesce(s, F.lit(False)) & F.lit(on) for s, on in (("runtime", True), ("optional", p.include_optional), ("dev", p.include_dev))})
    policy, runtime, optional, dev, some = (F.col(c) for c in ("policy", "runtime", "optional", "dev", "uses"))
    nowhere = ~runtime & ~optional & ~dev & policy.isNotNull()
    rule = (
        F.when(nowhere & (policy == "test-only"), F.lit("missing-test-dependency") if p.report_test_only_missing else F.lit(None))
        .when(nowhere & (policy == "type-only"), F.lit("missing-type-dependency") if p.report_type_only_missing else F.lit(None))
        .when(nowhere, "missing-runtime-dependency")
        .when(~runtime & dev & (some > 0), "dev-dependency-used-in-runtime")
        .when(~runtime & ~dev & optional & (some > 0), "optional-dependency-used-in-runtime")
        .when(runtime & policy.isNull() & ~F.col("distribution").isin(*p.ignored_packages or ("",)), "unused-runtime-dependency")
        .when(runtime & (policy == "test-only"), "runtime-dependency-used-only-in-tests")
        .when(runtime & (policy == "type-only"), "runtime-dependency-used-only-for-types")
    )
    x = x.withColumn("rule", rule).where("rule IS NOT NULL")
    severity = case((F.col("rule").isin("missing-runtime-dependency", "dev-dependency-used-in-runtime"), "error"), (F.col("rule").isin("missing-test-dependency", "missing-type-dependency", "runtime-dependency-used-only-for-types"), "info"), otherwise="warning")
    confidence = case(((F.col("rule") == "missing-runtime-dependency") & ~F.col("at.guarded"), "high"), (severity == "info", "low"), otherwise="medium")
    declared = F.col("rule").isin("unused-runtime-dependency", "runtime-dependency-used-only-in-tests", "runtime-dependency-used-only-for-types")
    return finding(x, F.col("rule"), severity, confidence, F.concat_ws(": ", "rule", "distribution"), path=F.when(declared, F.col("source")).otherwise(F.col("at.path")), line=F.when(declared, 1).otherwise(F.col("at.line")), module=F.when(~declared, F.col("at.module")), target=F.col("distribution"), evidence=F.struct("distribution", "policy", "uses"))


def duplicates(r: Repositories) -> DataFrame:
    first = F.col("fragments")[0]
    others = F.array_join(F.array_distinct(F.transform("fragments", lambda f: f["path"])), ", ")
    return finding(r.duplicates, "duplicate-code", "warning", "high" if r.project.strict_duplicates else "medium", F.concat(F.lit("The same code stands in "), others), path=first["path"], line=first["first"], end_line=first["last"], target=F.col("digest"), evidence=F.struct("fragments"))


def boundaries(r: Repositories) -> DataFrame | None:
    """Edges from a rule's sources to what it disallows; rules are literals of the plan."""
    paths = r.modules.select("repo", F.col("module").alias("target"), F.col("path").alias("target_path"))
    e = r.edges.join(paths, ["repo", "target"])
    hit = lambda patterns, path, module: text.matches_glob(F.col(path), *patterns) | text.matches_glob(F.col(module), *patterns)
    broken = F.array_compact(F.array(*(F.when(hit(b.sources, "path", "importer") & hit(b.disallow, "target_path", "target"), F.struct(F.lit(b.name).alias("name"), F.lit(b.severity).alias("severity"))) for b in r.project.boundaries))) if r.project.boundaries else None
    if broken is None:
        return None
    e = e.select("*", F.inline(broken))
    return finding(e, "boundary-violation", F.col("severity"), "high", F.concat(F.lit("Rule "), "name", F.lit(" forbids the import of "), "target"), module=F.col("importer"), line=F.col("line"), target=F.col("target"), evidence=F.struct("name", "target", "target_path"))


def complexity(r: Repositories) -> DataFrame:
    p = r.project
    f = r.functions if p.include_tests else r.functions.where("NOT is_test")

    def of(rule: str, severity: str, value: str, most: int) -> DataFrame:
        message = F.format_string(f"%s: {rule} (%d)", "name", value)
        evidence = F.struct(F.col(value).alias("value"), F.lit(most).alias("threshold"))
        return finding(f.where(F.col(value) > most), rule, severity, "high", message, line=F.col("line"), end_line=F.col("end_line"), symbol=F.col("name"), evidence=evidence)

    return (
        of("high-cyclomatic-complexity", "warning", "cyclomatic", p.max_cyclomatic)
        .unionByName(of("high-cognitive-complexity", "warning", "cognitive", p.max_cognitive))
        .unionByName(of("large-function", "info", "lines", p.max_function_lines))
        .unionByName(finding(r.modules.where((F.col("line_count") > p.max_file_lines) & (F.lit(p.include_tests) | ~F.col("is_test"))), "large-file", "info", "high", F.format_string("%d lines", "line_count")))
    )


def hotspots(r: Repositories, violations: DataFrame | None) -> DataFrame:
    """Files by a score of size, complexity, fan-out, duplicates, cycles and boundary ``violations``."""
    inner = F.greatest(F.col("cyclomatic") - 1, F.lit(0)) + F.greatest(F.col("cognitive") - 1, F.lit(0)) + F.floor(F.col("lines") / 40)
    own = r.functions.groupBy("repo", "path").agg(F.sum(inner).alias("own"))
    fan = aggregates.degrees(r.edges).select("node", "fan_out")
    cyclic = r.cycles.select("node").withColumn("cyclic", F.lit(15))
    doubled = r.duplicates.select("repo", F.explode(F.array_distinct(F.transform("fragments", lambda f: f["path"]))).alias("path")).distinct().withColumn("doubled", F.lit(12))
    broken = (r.modules.limit(0) if violations is None else violations).select("repo", "path").distinct().withColumn("broken", F.lit(15))
    m = r.modules.where("parse_error IS NULL" + ("" if r.project.include_tests else " AND NOT is_test")).withColumn("node", node())
    m = m.join(own, ["repo", "path"], "left").join(fan, "node", "left").join(cyclic, "node", "left").join(doubled, ["repo", "path"], "left").join(broken, ["repo", "path"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = F.when(F.col("line_count") > r.project.max_file_lines, 10).otherwise(0) + zero("own") + F.least(F.lit(20), 2 * zero("fan_out")) + zero("doubled") + zero("cyclic") + zero("broken")
    m = m.withColumn("score", score.cast("int")).where(F.col("score") >= r.project.hotspot_score)
    return finding(m, "risky-hotspot", "warning", "medium", F.format_string("Hotspot score %d", "score"), evidence=F.struct("score", F.lit(r.project.hotspot_score).alias("threshold")))


def with_suppressions(findings: DataFrame, r: Repositories) -> DataFrame:
    """Findings that no comment suppresses, and comments that suppress nothing; of several fitting comments the first counts."""
    s = r.of_modules("suppressions").select("repo", "path", "module", "seq", F.col("line").alias("at"), F.col("rule").alias("names"), "file_wide", "text")
    allowed = F.create_map(*(F.lit(x) for pair in ((k, v) for k, v in ALIASES.items()) for x in pair))[F.col("names")]
    named = (F.col("names") == "*") | (F.col("names") == F.col("rule")) | F.coalesce(F.array_contains(allowed, F.col("rule")), F.lit(False))
    f = findings.withColumn("fid", F.xxhash64(*COLUMNS))
    hits = f.join(s.drop("module"), ["repo", "path"]).where(named & (F.col("file_wide") | (F.col("at") == F.col("line"))))
    taken = hits.groupBy("repo", "path", "fid").agg(F.min("seq").alias("seq"))
    active = f.join(taken.select("repo", "path", "fid"), ["repo", "path", "fid"], "left_anti").drop("fid")
    stale = s.join(taken.select("repo", "path", "seq").distinct(), ["repo", "path", "seq"], "left_anti")
    comment = F.regexp_extract_all("text", F.lit(marker_pattern(r.project.markers).replace("?P<", "?<")), 0)
    first = s.groupBy("repo", "path", "at").agg(F.min("seq").alias("first"))
    stale = stale.join(first, ["repo", "path", "at"]).withColumn("comment", F.get(comment, F.col("seq") - F.col("first")))
    evidence = F.struct(F.col("text").alias("line_text"), F.col("comment").alias("suppression"), F.col("names").alias("rules"), "file_wide")
    return active.unionByName(finding(stale, "stale-suppression", "info", "high", F.lit("Nothing is suppressed here"), line=F.col("at"), target=F.col("names"), evidence=evidence))


#: States that speak against editing a symbol, the most telling first, and why.
REASONS = {
    "framework_managed": "A framework seems to use this symbol; look before editing.",
    "entrypoint_managed": "An entry point may use this symbol; look before editing.",
    "public_api": "The symbol may be public; look at callers elsewhere before editing.",
    "dynamic_uncertain": "Dynamic access cannot be ruled out, so nothing is removed automatically.",
}


def classified(findings: DataFrame) -> DataFrame:
    """Adds ``decision`` (auto_safe, review_needed, blocking or manual_only) and ``rationale``; the states of a symbol decide
    before its confidence does, unless that is low."""
    rule, confidence = F.col("rule"), F.col("confidence")
    low, symbol = confidence == "low", rule == "unused-symbol"
    flag = lambda name: F.array_contains("flags", name)
    cases = [
        (rule.isin("parse-error", "config-error", "unresolved-import", "missing-runtime-dependency", "dev-dependency-used-in-runtime"), "blocking", "The structure is broken for certain; mend it before a commit."),
        ((rule == "circular-dependency") & flag("typed"), "review_needed", "Imports for types take part in the cycle; look before changing what runs."),
        (rule == "circular-dependency", "blocking", "Modules that run import one another; break the cycle or waive it."),
        ((rule == "boundary-violation") & (F.col("severity") == "error"), "blocking", "A boundary that is enforced is crossed."),
        (rule == "boundary-violation", "review_needed", "A boundary that only advises is crossed."),
        (rule == "stale-suppression", "auto_safe", "The comment suppresses nothing; removing it changes no code."),
        (symbol & low, "manual_only", "The signal is weak; take it as context."),
        *((symbol & flag(s), "review_needed", REASONS[s]) for s in REASONS),
        (symbol & (confidence == "high"), "auto_safe", "Nothing uses the symbol and no state speaks against its removal."),
        (symbol, "review_needed", "Nothing was found that uses the symbol; look before removing it."),
        ((rule == "unused-module") & low, "manual_only", "The signal is weak; take it as context."),
        (rule == "unused-module", "review_needed", "No entry point reaches the module statically; look before removing it."),
        (rule == "framework-entrypoint-detected", "manual_only", "This only informs about a framework."),
    ]
    what = F.struct(F.lit("review_needed").alias("decision"), F.lit("Take the finding into the review of the change.").alias("rationale"))
    for fits, decision, reason in reversed(cases):
        what = F.when(fits, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("rationale"))).otherwise(what)
    return findings.withColumn("_why", what).select("*", "_why.*").drop("_why")


def fingerprinted(findings: DataFrame) -> DataFrame:
    """Adds id, category and fingerprint; lines are no part of it, so equal findings of one place share it."""
    rules = F.create_map(*(F.lit(x) for k, v in RULES.items() for x in (k, v[0])))
    kinds = F.create_map(*(F.lit(x) for k, v in RULES.items() for x in (k, v[1])))
    target = text.first_filled(F.col("target"), F.substring_index("message", ".", 1))
    mark = text.fingerprint(F.col("module"), F.col("path"), F.col("rule"), F.col("symbol"), target.alias("target"))
    return findings.select("*", rules[F.col("rule")].alias("id"), kinds[F.col("rule")].alias("category"), mark.alias("fingerprint"))


def findings(r: Repositories) -> DataFrame:
    """All findings: (COLUMNS, id, category, fingerprint, decision)."""
    parts = [parse_errors(r), *(e for e in [config_errors(r)] if e is not None), import_findings(r), *([] if r.project.include_tests else [production_imports_tests(r)]), circular(r), unused_modules(r), unused_symbols(r)]
    parts += [dependencies(r)] if r.declared is not None else []
    broken = boundaries(r)
    parts += [duplicates(r), *([] if broken is None else [broken]), complexity(r)]
    found = reduce(DataFrame.unionByName, parts)
    found = found.unionByName(hotspots(r, broken))
    if r.project.disabled:
        found = found.where(~F.col("rule").isin(*r.project.disabled))
    return classified(fingerprinted(with_suppressions(found, r)))
