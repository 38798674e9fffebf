"""Modules, resolved imports and the import graph of any number of repositories at once.

All keys carry ``repo``; a graph node is the text ``repo:module``.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcquarry.functions import text
from srcquarry.operators import graph, joins
from srcquarry.sources.declarations import Project
from srcquarry.sources.python_source import extract, facts, windowed
from srcquarry.sources.scratch import stored

#: File names by which a module is started.
ENTRY_FILES = "__main__.py main.py app.py manage.py asgi.py wsgi.py server.py cli.py worker.py".split()

#: Folders that hold sources where none are set.
SOURCE_DIRS = "src app backend server service".split()

#: Frameworks that imports and declarations name, and file names that belong to one.
FRAMEWORKS = "celery click django fastapi flask pydantic pytest sqlalchemy typer".split()
DJANGO_FILES = "settings.py urls.py asgi.py wsgi.py".split()
CONFIDENCES = ("low", "medium", "high")
#: Bits of the views of the import graph.
RUNTIME, STATE = 1, 2


def node(module: str = "module") -> Column:
    return F.concat_ws(":", "repo", module)


def rank(column: str) -> Column:
    return text.ranked(F.col(column), CONFIDENCES)


def is_test(path: Column) -> Column:
    return path.rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.py$|(^|/)conftest\.py$")


@dataclass
class Repositories:
    """The facts of ``files`` (repo, path, text) under one configuration; every property is a DataFrame."""

    files: DataFrame
    project: Project = Project()
    declared: DataFrame | None = None  # (repo, scope, name, source)

    @cached_property
    def sources(self) -> DataFrame:
        return self.files.where(F.col("path").endswith(".py") & ~text.matches_path(F.col("path"), *self.project.ignore))

    @cached_property
    def raw(self) -> DataFrame:
        return stored(extract(self.sources, self.project.markers), "facts")

    @cached_property
    def all_modules(self) -> tuple[DataFrame, DataFrame]:
        """(modules, shadowed files): of the files with one module name the first path counts."""
        roots = sorted((r.strip("/") for r in self.project.roots), key=len, reverse=True)
        raw, inner, path = self.raw, F.col("path"), F.col("path")
        for r in reversed(roots):  # the deepest root that holds the file
            if r not in ("", "."):
                inner = F.when(path.startswith(f"{r}/"), F.substring(path, len(r) + 2, 1 << 20)).otherwise(inner)
        if not roots:
            raw, inner = raw.join(found_roots(raw), "repo").where("root OR array_contains(dirs, substring_index(path, '/', 1))"), below_found(path)
        name = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
        rows = raw.select("repo", "path", name.alias("module"), F.substring_index("path", "/", -1).alias("file"), "line_count", "generated", "parse_error", "error_line", "error_column", "dynamic_hints", F.coalesce("framework_hints", F.array().cast("array<string>")).alias("framework_hints"), is_test(path).alias("is_test"), path.rlike("(^|/)migrations/").alias("is_migration"))
        rows = rows.withColumn("is_package", F.col("file") == "__init__.py").where("module <> ''")
        if not self.project.namespace_packages:
            below = raw.select("repo", "path", inner.alias("inner"))
            rows = in_packages(rows.join(below, ["repo", "path"])).drop("inner")
        ranked = stored(joins.ranked_rows(rows, ["repo", "module"], "path"), "modules")
        return ranked.where("_n = 1").select(rows.columns), ranked.where("_n > 1").drop("_n")

    @property
    def modules(self) -> DataFrame:
        return self.all_modules[0]

    def of_modules(self, name: str) -> DataFrame:
        """One kind of facts, with the module of each row."""
        kept = self.modules.select("repo", "path", "module", "is_test", "is_package")
        return facts(self.raw, name).join(kept, ["repo", "path"])

    @cached_property
    def imports(self) -> DataFrame:
        """Imports with target_module, submodule (the name itself is a module), classification and distribution."""
        i = self.of_modules("imports")
        package = F.when(F.col("is_package"), F.col("module")).otherwise(F.regexp_replace("module", r"\.?[^.]*$", ""))
        dots = F.repeat(F.lit("."), F.col("level"))
        base = F.when(F.col("level") == 0, F.col("raw")).otherwise(text.absolute_name(F.concat(dots, "raw"), package))
        i = stored(i.withColumn("base", F.coalesce(base, F.lit(""))), "imports")
        asked = i.where("base <> '' AND literal").select("repo", "base", F.coalesce("symbol", F.lit("")).alias("sym")).distinct()
        ordered = F.concat(F.when(~F.col("sym").isin("", "*"), F.array(F.concat_ws(".", "base", "sym"))).otherwise(F.array().cast("array<string>")), text.prefixes(F.col("base")))
        found = asked.select("repo", "base", "sym", F.posexplode(ordered).alias("rank", "module")).join(self.modules.select("repo", "module"), ["repo", "module"])
        found = found.groupBy("repo", "base", "sym").agg(F.min("rank").alias("rank")).withColumn("target_module", F.get(ordered, "rank")).drop("rank")
        i = i.withColumn("sym", F.coalesce("symbol", F.lit(""))).join(found, ["repo", "base", "sym"], "left")
        submodule = F.col("target_module") == F.concat_ws(".", "base", "symbol")
        exact = F.col("target_module") == F.col("base")
        top = F.substring_index("raw", ".", 1)
        std = top.isin(*sorted(sys.stdlib_module_names))
        mapped = F.lit(None).cast("string")
        for known, package_name in sorted(self.project.import_map.items(), key=lambda x: len(x[0])):
            mapped = F.when((F.col("raw") == known) | F.col("raw").startswith(f"{known}."), package_name).otherwise(mapped)
        outside = F.col("target_module").isNull() & (F.col("raw") != "") & F.col("literal")
        kind = F.when(F.col("target_module").isNotNull(), "local").when(outside & std, "stdlib").when(outside, "third-party").otherwise("unknown")
        i = i.withColumn("submodule", F.coalesce(F.col("symbol").isNotNull() & submodule, F.lit(False))).withColumn("exact", F.coalesce(exact, F.lit(False))).withColumn("classification", kind)
        i = i.withColumn("distribution", F.when(F.col("classification") == "third-party", F.coalesce(mapped, text.package_name(top))))
        return stored(i.drop("sym"), "imports")

    @cached_property
    def edges(self) -> DataFrame:
        """(repo, importer, target, path, line, symbol, type_checking, src, dst), one for each importer, target, line and symbol."""
        e = self.imports.where("target_module IS NOT NULL AND target_module <> module").select("repo", F.col("module").alias("importer"), F.col("target_module").alias("target"), "path", "line", "symbol", "type_checking", "is_test")
        if not self.project.include_tests:
            tests = self.modules.where("is_test").select("repo", F.col("module").alias("target"))
            e = e.where("NOT is_test").join(tests, ["repo", "target"], "left_anti")
        e = e.groupBy("repo", "importer", "target", "path", "line", "symbol").agg(F.every("type_checking").alias("type_checking"))  # a module has one path
        return stored(e.withColumn("src", node("importer")).withColumn("dst", node("target")), "edges")

    @cached_property
    def entries(self) -> DataFrame:
        """(repo, module, reason, confidence) of the modules that start something."""
        m = self.modules.where("parse_error IS NULL")
        branches = []
        if self.declared is not None:
            scripts = self.declared.where("scope = 'script'").select("repo", F.substring_index("name", ":", 1).alias("wanted"))
            hit = scripts.select("repo", F.posexplode(F.slice(text.prefixes(F.col("wanted")), 1, 2)).alias("rank", "module"), "wanted").join(m.select("repo", "module"), ["repo", "module"])
            branches.append(hit.groupBy("repo", "wanted").agg(F.min_by("module", "rank").alias("module")).select("repo", "module", F.lit("packaging-script").alias("reason"), F.lit("high").alias("confidence")))
        if self.project.entry:
            branches.append(m.where(text.matches_path(F.col("path"), *self.project.entry)).select("repo", "module", F.lit("explicit-config").alias("reason"), F.lit("high").alias("confidence")))
        else:
            branches.append(m.where(F.col("file").isin(*ENTRY_FILES)).select("repo", "module", F.lit("conventional-name").alias("reason"), F.lit("medium").alias("confidence")))
            if self.project.include_tests:
                branches.append(m.where("file = 'conftest.py'").select("repo", "module", F.lit("test-configuration").alias("reason"), F.lit("medium").alias("confidence")))
        keyed = [b.withColumn("node", node()) for b in branches]
        return stored(joins.first_of_branches(keyed, "node").select("repo", "module", "reason", "confidence", "node"), "entries")

    @cached_property
    def views(self) -> DataFrame:
        """(node, views) of what the entries reach, as bits: ``RUNTIME`` without type-checking imports, ``STATE`` with them."""
        on = F.when(F.col("type_checking"), STATE).otherwise(RUNTIME | STATE)
        return stored(graph.reachable_views(self.edges.select("src", "dst", on.alias("views")), self.entries.select("node", F.lit(RUNTIME | STATE).alias("views"))), "views")

    @property
    def reached(self) -> DataFrame:
        """Nodes that run when the entries do: type-checking imports do not count."""
        return self.views.where(F.col("views").bitwiseAND(F.lit(RUNTIME)) != 0).select("node")

    @cached_property
    def cycles(self) -> DataFrame:
        """(node, scc_id, size), type-checking imports included."""
        return stored(graph.cyclic(self.edges.select("src", "dst").distinct()), "cycles")

    @cached_property
    def exported(self) -> DataFrame:
        """What packages pass on: (repo, module, name, line, source, confidence, complete, origin_module, origin_symbol, explicit).

        A named import passes on its name, unless a whole ``__all__`` leaves it out.  A star passes on what its target passes on,
        if that is a package that does, else the target's ``__all__``, else, least surely, its public symbols.  Stars of stars
        are followed until nothing new comes; a record that has been met is not followed again, so rings of packages end.
        """
        local = self.imports.where("is_package AND classification = 'local' AND symbol IS NOT NULL")
        names = self.of_modules("exports").groupBy("repo", "module", "name").agg(F.max("whole").alias("whole"))
        listed = names.select("repo", "module", "name").withColumn("explicit", F.lit(True))
        whole = names.groupBy("repo", "module").agg(F.max("whole").alias("complete"))
        sure = self.project.init_exports
        key = ["repo", "module", "name", "source", "origin_module", "origin_symbol"]
        columns = [*key, "line", "confidence", "complete"]
        named = local.where("symbol <> '*'").select("repo", "module", F.coalesce("alias", "symbol").alias("name"), F.lit("direct-reexport").alias("source"), F.col("target_module").alias("origin_module"), F.col("symbol").alias("origin_symbol"), "line", F.lit(sure).alias("confidence"))
        named = named.join(whole, ["repo", "module"], "left").withColumn("complete", F.coalesce("complete", F.lit(False))).join(listed, ["repo", "module", "name"], "left").where("NOT complete OR explicit").select(columns)
        stars = local.where("symbol = '*' AND target_module <> module").groupBy("repo", "module", "target_module").agg(F.min("line").alias("line"))
        passing = local.select("repo", F.col("module").alias("target_module")).distinct()
        final = stars.join(passing, ["repo", "target_module"], "left_anti")
        target = lambda df: df.withColumnRenamed("module", "target_module")
        star = lambda df, confidence, complete: df.select("repo", "module", "name", F.lit("star-reexport").alias("source"), F.col("target_module").alias("origin_module"), F.col("name").alias("origin_symbol"), "line", F.lit(confidence).alias("confidence"), F.lit(complete).alias("complete"))
        by_list = final.join(target(names.select("repo", "module", "name")), ["repo", "target_module"])
        public = target(self.of_modules("symbols").where("NOT name LIKE '\\_%'").select("repo", "module", "name").distinct())
        by_name = final.join(target(names.select("repo", "module").distinct()), ["repo", "target_module"], "left_anti").join(public, ["repo", "target_module"])
        first = lambda df: df.groupBy(key).agg(*(F.min_by(c, "line").alias(c) for c in columns if c not in key))
        known = front = stored(first(named.unionByName(star(by_list, sure, True)).unionByName(star(by_name, "low", False)).select(columns)), "exported")
        while not front.isEmpty():
            new = stars.join(target(front).drop("line", "source"), ["repo", "target_module"]).withColumn("source", F.lit("star-reexport"))
            new = new.withColumn("confidence", F.when(rank("confidence") > CONFIDENCES.index(sure), sure).otherwise(F.col("confidence"))).select(columns)
            front = stored(first(new).join(known, key, "left_anti").select(columns), "exported")
            known = known.unionByName(front)
        return stored(known.join(listed, ["repo", "module", "name"], "left").withColumn("explicit", F.coalesce("explicit", F.lit(False))), "exported")

    @cached_property
    def frameworks(self) -> DataFrame:
        """(repo, framework): declared, imported, or told by a call or a file's name."""
        m, file = self.modules, F.col("file")
        told = F.array_compact(F.array(
            F.when((F.col("path") == "manage.py") | file.isin(*DJANGO_FILES) | F.col("path").rlike("(^|/)management/commands/"), "django"),
            F.when((file == "conftest.py") | file.startswith("test_"), "pytest"),
        ))
        found = m.select("repo", F.explode(F.concat(told, "framework_hints")).alias("framework"))
        found = found.unionByName(self.imports.select("repo", F.substring_index("raw", ".", 1).alias("framework")).where(F.col("framework").isin(*FRAMEWORKS)))
        if self.declared is not None:
            found = found.unionByName(self.declared.where("scope <> 'script'").select("repo", F.col("name").alias("framework")).where(F.col("framework").isin(*FRAMEWORKS)))
        chosen = set(self.project.frameworks)
        if not self.project.framework_heuristics or "none" in chosen:
            return found.distinct().limit(0)
        return found.distinct() if "auto" in chosen else found.where(F.col("framework").isin(*chosen)).distinct()

    @cached_property
    def states(self) -> DataFrame:
        """(repo, module, reachable, referenced, entrypoint_managed, public_api, framework_managed, dynamic_uncertain) of every module."""
        here = lambda df, module, flag: df.select("repo", F.col(module).alias("module")).distinct().withColumn(flag, F.lit(True))
        called = self.imports.where("kind = 'dynamic' AND target_module <> module")
        flags = [
            here(self.edges, "target", "referenced"), here(self.entries, "module", "entrypoint_managed"),
            here(self.exported.select("repo", "module").unionByName(self.of_modules("exports").select("repo", "module")), "module", "public_api"), here(called, "target_module", "called"),
        ]
        state = self.views.where(F.col("views").bitwiseAND(F.lit(STATE)) != 0).select("node", F.lit(True).alias("reachable"))
        m = self.modules.withColumn("node", node()).join(state, "node", "left")
        for f in flags:
            m = m.join(f, ["repo", "module"], "left")
        own = {"framework_managed": F.size("framework_hints") > 0, "dynamic_uncertain": (F.col("dynamic_hints") > 0) | F.coalesce("called", F.lit(False))}
        known = ("reachable", "referenced", "entrypoint_managed", "public_api")
        return m.withColumns({c: F.coalesce(c, F.lit(False)) for c in known} | own).select("repo", "module", *known, *own)

    @cached_property
    def cycle_paths(self) -> DataFrame:
        """(scc_id, repo, members, path, steps): a way round each cycle from its first member, and the first edge of each step."""
        inside = self.edges.join(self.cycles.select(F.col("node").alias("src"), "scc_id"), "src").join(self.cycles.select(F.col("node").alias("dst"), F.col("scc_id").alias("other")), "dst").where("scc_id = other")
        inside = stored(inside.select("scc_id", "importer", "target", "path", "line", "symbol", "type_checking"), "inside")
        walks = stored(graph.round_trips(inside.select("scc_id", F.col("importer").alias("src"), F.col("target").alias("dst"))), "walks")
        step = F.posexplode(F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1), lambda a, b: F.struct(a.alias("importer"), b.alias("target"))))
        steps = walks.select("scc_id", step.alias("at", "step")).select("scc_id", "at", "step.importer", "step.target")
        edge = inside.groupBy("scc_id", "importer", "target").agg(F.min_by(F.struct("path", "line"), F.struct("path", "line", "symbol")).alias("e"), F.some("type_checking").alias("typed"))
        rows = steps.join(edge, ["scc_id", "importer", "target"]).groupBy("scc_id").agg(F.array_sort(F.collect_list(F.struct("at", "importer", "target", "e.path", "e.line", "typed"))).alias("steps"))
        return stored(ordered_members(self.cycles).join(walks, "scc_id").join(rows, "scc_id"), "cycle-paths")

    @cached_property
    def symbols(self) -> DataFrame:
        """Top-level names with how often production, tests and type checking refer to them, and what exports them."""
        s = self.of_modules("symbols")
        scope = F.when(F.col("is_test"), "tests").otherwise("production")
        own = self.of_modules("name_refs").select("repo", F.col("module"), "name", scope.alias("scope"))
        known = self.imports.where("classification = 'local'")
        typed = F.when(F.col("type_checking"), "type_only").otherwise(scope)
        taken = known.where("symbol IS NOT NULL AND NOT submodule AND exact AND NOT is_package").select("repo", F.col("target_module").alias("module"), F.col("symbol").alias("name"), typed.alias("scope"))
        local = F.coalesce("alias", F.when(F.col("symbol").isNull(), F.col("raw")).otherwise(F.col("symbol")))
        # the last import of a local name counts
        names = known.where("symbol IS NULL OR submodule").groupBy("repo", "module", local.alias("base")).agg(F.max_by("target_module", "seq").alias("target_module"))
        used = self.of_modules("attr_refs").join(names, ["repo", "module", "base"]).select("repo", F.col("target_module").alias("module"), F.col("attr").alias("name"), scope.alias("scope"))
        refs = own.unionByName(taken).unionByName(used).groupBy("repo", "module", "name").pivot("scope", ["production", "tests", "type_only"]).agg(F.count(F.lit(1)))
        counts = refs.select("repo", "module", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("production", "tests", "type_only")))
        counts = through_exports(counts, self.exported)
        listed = self.of_modules("exports").select("repo", "module", "name").distinct().withColumn("listed", F.lit(True))
        again = self.exported.groupBy("repo", F.col("origin_module").alias("module"), F.col("origin_symbol").alias("name")).agg(F.lit(True).alias("reexported"), F.max(rank("confidence")).alias("public"))
        again = again.withColumn("public_confidence", F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.col("public") + 1)).drop("public")
        s = s.join(counts, ["repo", "module", "name"], "left").join(listed, ["repo", "module", "name"], "left").join(again, ["repo", "module", "name"], "left")
        return stored(s.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("production", "tests", "type_only")} | {c: F.coalesce(c, F.lit(False)) for c in ("listed", "reexported")}), "symbols")

    @cached_property
    def functions(self) -> DataFrame:
        """Functions with cyclomatic and cognitive complexity."""
        kind, arity = F.col("kind"), F.col("arity")
        branch = kind.isin("If", "For", "AsyncFor", "While", "ExceptHandler", "With", "AsyncWith", "IfExp")
        bool_op, comp = kind == "BoolOp", kind.isin("ListComp", "SetComp", "DictComp", "GeneratorExp")
        cyc = F.when(branch | (kind == "Assert"), 1).when(bool_op, arity - 1).when(comp, 1 + arity).when(kind == "Match", arity).otherwise(0)
        cog = F.when(branch | (kind == "Match"), 1 + F.col("nesting")).when(bool_op, arity - 1).when(kind.isin("Break", "Continue", "Raise"), 1).otherwise(0)
        sums = facts(self.raw, "nodes").groupBy("repo", "path", F.col("func").alias("name"), F.col("func_line").alias("line")).agg(F.sum(cyc).alias("cyc"), F.sum(cog).alias("cog"))
        f = self.of_modules("functions").join(sums, ["repo", "path", "name", "line"], "left")
        return f.select("repo", "path", "module", "name", "line", "end_line", (F.coalesce("cyc", F.lit(0)) + 1).cast("int").alias("cyclomatic"), F.coalesce("cog", F.lit(0)).cast("int").alias("cognitive"), (F.col("end_line") - F.col("line") + 1).alias("lines"), "is_test")

    @cached_property
    def duplicates(self) -> DataFrame:
        """(repo, digest, fragments): accepted groups of equal token windows, in the order of their acceptance."""
        from srcquarry.plans.duplicates import accepted

        p = self.project
        code = self.modules.where("NOT generated AND parse_error IS NULL" + ("" if p.include_tests else " AND NOT is_test")).select("repo", "path")
        sources = self.sources if p.include_tests else self.sources.where(~is_test(F.col("path")))
        found = stored(windowed(sources, p.min_tokens, p.min_lines, p.strict_duplicates).where("profile IS NOT NULL"), "windows")
        return stored(accepted(found, code, p.max_groups), "duplicates")

    @cached_property
    def shadowed(self) -> DataFrame:
        return self.all_modules[1]


def found_roots(files: DataFrame) -> DataFrame:
    """(repo, dirs, root): which of the usual source folders each repository has, and whether its own folder is a root too: it
    holds files or packages, or there is no such folder."""
    nested, top = F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)
    own = F.some(~nested | F.col("path").rlike(r"^[^/.][^/]*/__init__\.py$"))
    each = files.groupBy("repo").agg(F.collect_set(F.when(nested & top.isin(*SOURCE_DIRS), top)).alias("dirs"), own.alias("own"))
    return each.select("repo", "dirs", (F.col("own") | (F.size("dirs") == 0)).alias("root"))


def below_found(path: Column) -> Column:
    """The path below the root that holds it, the deepest one."""
    top = F.substring_index(path, "/", 1)
    return F.when(F.contains(path, F.lit("/")) & F.array_contains(F.col("dirs"), top), F.substring(path, F.length(top) + 2, F.length(path))).otherwise(path)


def in_packages(rows: DataFrame) -> DataFrame:
    """Of modules with their path ``inner`` below the root, those all of whose folders there hold an ``__init__.py``.

    Each folder is asked for once: of the folders on a module's way as many as there are must be packages.
    """
    folder = F.regexp_replace("inner", r"/?[^/]*$", "")
    root = F.expr("substring(path, 1, length(path) - length(inner))")
    rows = rows.withColumn("folder", folder).withColumn("under", root)
    parts = F.split("folder", "/")
    ways = rows.where("folder <> ''").select("repo", "under", "folder").distinct()
    ways = ways.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("step"))
    packages = rows.where("is_package").select("repo", "under", F.col("folder").alias("step")).distinct().withColumn("package", F.lit(True))
    whole = ways.join(packages, ["repo", "under", "step"], "left").groupBy("repo", "under", "folder").agg(F.every(F.coalesce("package", F.lit(False))).alias("whole"))
    kept = rows.join(whole.where("whole"), ["repo", "under", "folder"], "left_semi").unionByName(rows.where("folder = ''"))
    return kept.drop("folder", "under")


SCOPES = ("production", "tests", "type_only")


def through_exports(counts: DataFrame, exported: DataFrame) -> DataFrame:
    """``counts`` (repo, module, name, SCOPES) with what packages pass on added at its origin.

    Packages pass on in the order of their names, each record once, what was counted at its name by then.  A count thus goes on
    only from a package to a later one, so the records, cut to such steps, form no ring.  All counts that meet at a name in a
    round go on as one sum: a round has at most a row for each record, however many ways lead to it, and rounds number as the
    longest chain of re-exports.  A package that passes on a name of its own counts for that name and no further.
    """
    sums = [F.sum(c).alias(c) for c in SCOPES]
    records = exported.where("origin_module IS NOT NULL AND origin_symbol IS NOT NULL").groupBy("repo", "module", "name", "origin_module", "origin_symbol")
    records = stored(records.agg(F.count("*").alias("times")), "records")
    step = counts
    while True:
        sent = step.join(records, ["repo", "module", "name"]).groupBy("repo", F.col("origin_module").alias("module"), F.col("origin_symbol").alias("name"), (F.col("module") < F.col("origin_module")).alias("later"))
        sent = stored(sent.agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in SCOPES)), "passed-on")
        if sent.isEmpty():
            return counts.groupBy("repo", "module", "name").agg(*sums)
        counts = counts.unionByName(sent.drop("later"))
        step = sent.where("later").drop("later")


def ordered_members(cycles: DataFrame) -> DataFrame:
    """(scc_id, repo, members) of each cycle; a component is as large as the cycle it reports."""
    return cycles.groupBy("scc_id").agg(F.array_sort(F.collect_list("node")).alias("members")).select("scc_id", F.substring_index("scc_id", ":", 1).alias("repo"), "members")


def ranks(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
