"""``python -m srcquarry analyze FOLDER``: the analysis from a shell."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from srcquarry import api
from srcquarry.plans import patches, report
from srcquarry.plans.resolve import Repositories

BASELINE = "repo string, fingerprint string, rule string, path string, symbol string, severity string, confidence string"

VERSION = "0.3"
FORMATS = ("json", "text", "markdown", "sarif", "plan", "mermaid", "dot")


def parts_of(kind: str, r: Repositories, found: DataFrame, limits: bool = False) -> Iterable[str]:
    """The document that ``--format`` names, piece by piece."""
    if kind == "json":
        return report.whole_json_parts(r, found)
    if kind == "sarif":
        return report.sarif_parts(found, r.files)
    if kind == "plan":
        return report.plan_parts(found, patches.as_patches(patches.stale_comments(found)))
    text = report.as_text(found, markdown=kind == "markdown")
    return [text, *(f"\n- {x}" for x in report.LIMITATIONS)] if limits else [text]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("srcquarry", description=__doc__)
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("command", choices=["analyze", "graph", "agent-context", "patch", "baseline", "compare", *report.COMMANDS])
    p.add_argument("folder")
    p.add_argument("--format", default="text", choices=FORMATS)
    p.add_argument("--section", default="srcquarry", help="the [tool.<section>] of pyproject.toml")
    p.add_argument("--include-tests", action="store_true")
    p.add_argument("--framework", help="only this one, or none")
    p.add_argument("--since", help="only findings of files that differ from this commit")
    p.add_argument("--baseline", help="a folder: written by `baseline`, else compared with")
    p.add_argument("--min-confidence", default="low", choices=["low", "medium", "high"])
    p.add_argument("--min-severity", default="info", choices=["info", "warning", "error"])
    p.add_argument("--fail-on", default="none", choices=["none", "any", "info", "warning", "error"])
    p.add_argument("--show-limitations", action="store_true")
    p.add_argument("--output")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a, SparkSession.builder.appName("srcquarry").getOrCreate())
    except (ValueError, OSError) as e:
        print(f"srcquarry: {e}", file=sys.stderr)
        return 2


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    if not Path(a.folder).is_dir():
        raise FileNotFoundError(f"no such folder: {a.folder}")
    r = api.open_folder(spark, a.folder, a.section)
    more = {"include_tests": True} if a.include_tests else {}
    if a.framework:
        more["frameworks"] = (a.framework,)
    r = replace(r, project=replace(r.project, **more))
    if a.command == "graph":
        return emit(report.graph_parts(r.edges, "dot" if a.format == "dot" else "mermaid"), a.output)
    found = api.analyze(r)
    if a.command == "patch":
        return emit((x.patch for x in patches.unified(patches.stale_comments(found), r.files).orderBy("path").toLocalIterator()), a.output)
    if a.since:
        changed = api.changed_since(spark, a.folder, a.since, ignore=r.project.ignore)
        if changed is None:
            print("--since is not available outside a Git repository; everything is reported", file=sys.stderr)
        else:
            found = report.in_scope(found, changed, r.duplicates, r.cycles, r.modules)
    if a.command == "agent-context":
        tables = report.context(r.modules, r.edges, found)
        return emit([json.dumps(report.context_json(tables), default=str)] if a.format == "json" else [report.context_markdown(tables)], a.output)
    place = a.baseline or (f"{a.folder}/{r.project.baseline or '.srcquarry-baseline'}" if a.command in ("baseline", "compare") else None)
    if a.command == "baseline":
        report.baseline_of(found).write.mode("overwrite").json(place)
        return 0
    found = report.filtered(found, a.min_confidence, a.min_severity, a.command if a.command in report.COMMANDS else None)
    new = None
    if place:
        if not Path(place).exists():
            raise FileNotFoundError(f"no such baseline: {place}")
        known = spark.read.schema(BASELINE).json(place)
        new, existing, resolved = report.compared(found, known)
        found = report.with_baseline_status(found, known)
        if a.command == "compare":
            print(f"new {new.count()}, existing {existing.count()}, resolved {resolved.count()}", file=sys.stderr)
    emit(parts_of(a.format, r, found, a.show_limitations), a.output)
    modules = r.modules.agg({"*": "count", "parse_error": "count"}).first()
    return 3 if modules[0] and modules[0] == modules[1] else report.exit_code(found, a.fail_on, new)


def emit(parts: Iterable[str], output: str | None) -> int:
    if output:
        with Path(output).open("w", encoding="utf-8") as f:
            f.writelines(parts)
    else:
        sys.stdout.writelines(parts)
        print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
