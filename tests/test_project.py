"""A small project with one of each common finding, two repositories at once."""

from __future__ import annotations

import json
import textwrap

import pytest

from srcquarry import api
from srcquarry.plans import predict, report, rules
from srcquarry.sources.declarations import Boundary, Project, declared_in, project_of, requirement

BODY = """
def {name}(limit):
    found = 0
    for step in range(limit):
        if step % 3:
            found += step
        else:
            found -= step
    return found
"""
FILES = {
    "src/shop/__init__.py": "from shop.api import Public\n__all__ = ['Public']\n",
    "src/shop/main.py": """
        import importlib
        import httpthing
        import declaredthing
        from shop.core.logic import decide
        from shop import left
        importlib.import_module("shop.plugin")
        importlib.import_module(NAME)
        def main():
            return decide(), httpthing, declaredthing, left.VALUE
        """,
    "src/shop/api.py": "class Public:\n    pass\n",
    "src/shop/left.py": "from shop import right\nVALUE = right.VALUE\n",
    "src/shop/right.py": "from shop import left\nVALUE = 1\n",
    "src/shop/plugin.py": "OPTION = 1\n",
    "src/shop/core/logic.py": """
        from shop.store.db import connect
        def decide():
            return connect()
        def knotted(value):
            total = 0
            if value > 10:
                for item in range(value):
                    if item % 2:
                        total += item
                    else:
                        total -= item
            elif value == 3:
                total = 3
            return total
        """,
    "src/shop/store/db.py": "def connect():\n    return 1\n",
    "src/shop/one.py": BODY.format(name="one"),
    "src/shop/two.py": BODY.format(name="two"),
    "src/shop/quiet.py": "def hidden():  # srcquarry: ignore[unused-symbol]\n    return 1\nx = 1  # srcquarry: ignore[large-file]\n",
    "src/shop/broken.py": "def (:\n",
    "tests/test_shop.py": "from shop.store.db import connect\nimport testthing\n",
    "pyproject.toml": '[project]\nname = "shop"\ndependencies = ["declaredthing", "idlething"]\n',
}
PROJECT = Project(roots=("src", "."), entry=("src/shop/main.py",), min_lines=3, min_tokens=10, max_cyclomatic=3, max_cognitive=4, hotspot_score=20, boundaries=(Boundary("core-no-store", ("src/shop/core/**",), ("src/shop/store/**",), "error"),))


@pytest.fixture(scope="module")
def repos(spark):
    rows = [(repo, p, textwrap.dedent(t).lstrip("\n")) for repo in ("a", "b") for p, t in FILES.items()]
    return api.repositories(spark.createDataFrame(rows, "repo string, path string, text string"), PROJECT)


@pytest.fixture(scope="module")
def found(repos, spark):
    from srcquarry.sources.scratch import stored

    return stored(api.analyze(repos), "findings")


def test_findings(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.repo, set()).add((r.rule, r.path.rpartition("/")[2], r.symbol, r.severity, r.confidence))
    want = {
        ("parse-error", "broken.py", None, "error", "high"),
        ("dynamic-import", "main.py", None, "info", "low"),
        ("circular-dependency", "left.py", None, "warning", "high"),
        ("unused-module", "one.py", None, "warning", "high"),
        ("unused-module", "two.py", None, "warning", "high"),
        ("unused-module", "quiet.py", None, "warning", "high"),
        ("unused-module", "api.py", None, "warning", "high"),
        ("unused-symbol", "logic.py", "knotted", "warning", "medium"),
        ("unused-symbol", "one.py", "one", "warning", "medium"),
        ("unused-symbol", "two.py", "two", "warning", "medium"),
        ("unused-symbol", "plugin.py", "OPTION", "info", "low"),
        ("unused-symbol", "quiet.py", "x", "info", "low"),
        ("unused-symbol", "api.py", "Public", "info", "low"),
        ("stale-suppression", "quiet.py", None, "info", "high"),
        ("missing-runtime-dependency", "main.py", None, "error", "high"),
        ("unused-runtime-dependency", "pyproject.toml", None, "warning", "medium"),
        ("duplicate-code", "one.py", None, "warning", "medium"),
        ("high-cyclomatic-complexity", "logic.py", "knotted", "warning", "high"),
        ("high-cognitive-complexity", "logic.py", "knotted", "warning", "high"),
        ("boundary-violation", "logic.py", None, "error", "high"),
        ("risky-hotspot", "logic.py", None, "warning", "medium"),
    }
    assert got["a"] == got["b"] == want


def test_graph_and_measures(repos):
    e = {(r.importer, r.target) for r in repos.edges.where("repo = 'a'").collect()}
    assert ("shop.main", "shop.plugin") in e and ("shop.left", "shop.right") in e and ("shop.core.logic", "shop.store.db") in e
    f = {r.name: (r.cyclomatic, r.cognitive) for r in repos.functions.where("repo = 'a'").collect()}
    assert f["knotted"] == (5, 8) and f["one"] == (3, 3)


def test_reports(spark, found, repos):
    s = report.summary(found).first()
    assert (s.total_issues, s.errors, s.circular_dependencies, s.complexity_hotspots) == (42, 6, 2, 6)
    plan = report.fix_plan(found)
    assert plan["summary"]["blocking_count"] == 8 and plan["summary"]["auto_safe_count"] == 2
    sarif = report.as_sarif(found)
    assert len(sarif["runs"][0]["results"]) == 42 and all(sarif["runs"][0]["tool"]["driver"]["rules"][x["ruleIndex"]]["id"] == x["ruleId"] for x in sarif["runs"][0]["results"])
    assert report.exit_code(found, "error") == 1 and report.exit_code(found.limit(0), "any") == 0
    assert report.as_text(found, 5).endswith("... 37 more")
    base = report.baseline_of(found.where("rule <> 'unused-module'"))
    new, existing, resolved = report.compared(found.where("rule <> 'parse-error'"), base)
    assert {r.rule for r in new.collect()} == {"unused-module"} and existing.count() == 32 and resolved.count() == 2
    changed = spark.createDataFrame([("a", "src/shop/two.py"), ("a", "src/shop/right.py"), ("a", "src/shop/store/db.py")], "repo string, path string")
    scope = {(r.rule, r.path.rpartition("/")[2]) for r in report.in_scope(found, changed, repos.duplicates, repos.cycles, repos.modules).collect()}
    assert {("duplicate-code", "one.py"), ("circular-dependency", "left.py"), ("boundary-violation", "logic.py"), ("unused-module", "two.py")} <= scope and ("unused-module", "one.py") not in scope


def test_documents_hold_everything(spark, found, tmp_path):
    rule = "concat('rule-', lpad(id % 30, 2, '0'))"
    many = spark.range(10_050).selectExpr(
        "'a' AS repo", f"{rule} AS rule", f"{rule} AS id", "concat('p', id % 7, '.py') AS path", "IF(id % 5 = 0, NULL, CAST(id % 900 AS INT)) AS line", "IF(id % 3 = 0, NULL, 's') AS symbol",
        "concat('say \"é\" ', id) AS message", "'high' AS confidence", "element_at(array('error', 'warning', 'info'), CAST(id % 3 + 1 AS INT)) AS severity", "concat('f', id) AS fingerprint",
        "IF(id < 10, 'blocking', 'manual_only') AS decision", "'imports' AS category", "'why' AS rationale", "CAST(NULL AS INT) AS end_line", "CAST(NULL AS STRING) AS evidence",
    )
    whole = json.loads(report.as_json(many))
    assert len({x["fingerprint"] for x in whole["issues"]}) == len(whole["issues"]) == whole["summary"]["total_issues"] == 10_050 and not whole["truncated"]
    run = report.as_sarif(many)["runs"][0]
    ids = [x["id"] for x in run["tool"]["driver"]["rules"]]
    assert len(run["results"]) == 10_050 and ids == sorted(ids) and len(ids) == 30
    assert all(ids[x["ruleIndex"]] == x["ruleId"] and x["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1 for x in run["results"])
    plan = report.fix_plan(many)
    assert [len(plan[b]) for b in report.BUCKETS] == [plan["summary"][f"{b}_count"] for b in report.BUCKETS] == [0, 0, 10, 10_040]
    edges = spark.range(5_020).selectExpr("concat('m.a', id) AS importer", "concat('m.b', id) AS target")
    for kind in ("mermaid", "dot"):
        assert sum(" -> " in x or " --> " in x for x in report.graph_text(edges, kind).splitlines()) == 5_020
    assert '  m_a7["m.a7"] --> m_b7["m.b7"]' in report.graph_text(edges) and '  "m.a7" -> "m.b7";' in report.graph_text(edges, "dot")
    shown = [r.asDict() for r in found.orderBy(*report.order()).collect()]
    assert json.loads(report.as_json(found))["issues"] == json.loads(json.dumps(shown))
    from srcquarry.__main__ import emit

    emit(report.sarif_parts(many), str(tmp_path / "log.sarif"))
    assert len(json.loads((tmp_path / "log.sarif").read_text(encoding="utf-8"))["runs"][0]["results"]) == 10_050
    assert report.as_text(many).endswith("... 9850 more")


def test_planned_imports(spark, repos):
    plans = [("shop.right", "shop.main"), ("shop.one", "shop.store.nothing"), ("shop.one", "shop.left.VALUE as v"), ("shop.core.logic", "shop.store.db.connect"), ("shop.one", "json"), ("shop.one", "declaredthing"), ("shop.one", "otherthing.x"), ("shop.store.db", "shop.core.logic"), ("shop.one", "shop.Public"), ("shop.one", "requests"), ("shop.one", ".left"), ("shop.core.logic", "..two.*"), ("shop.one", "shopp.core.logic"), ("shop.one", "shop.core.logic.decided"), ("shop.one", "yaml")]
    rows = {(r.importer, r.raw): r for r in predict.verify_imports(repos, spark.createDataFrame([("a", i, n) for i, n in plans], "repo string, importer string, raw string")).collect()}
    want = "cycle hallucinated safe boundary safe safe hallucinated cycle safe missing_dependency safe review_needed hallucinated hallucinated missing_dependency"
    assert [rows[p].bucket for p in plans] == want.split()
    assert rows["shop.one", "shopp.core.logic"].similar[0] == "shop.core.logic" and rows["shop.one", "shop.core.logic.decided"].similar == ["decide"]
    assert rows["shop.one", "yaml"].distribution == "pyyaml" and rows["shop.one", "shop.left.VALUE as v"].similar == []
    assert predict.cycle_path(repos, "a", "shop.store.db", "shop.main") == ["shop.store.db", "shop.main", "shop.core.logic", "shop.store.db"]


def test_declarations_and_settings():
    assert [requirement(x) for x in ("Foo.Bar_baz[x]>=1 ; y", "# no", "-r x", "git+https://x")] == ["foo-bar-baz", None, None, None]
    cfg = "[options]\ninstall_requires =\n    one\n    two>=2\n[options.entry_points]\nconsole_scripts =\n    go = pkg.cli:main\n"
    assert list(declared_in("setup.cfg", cfg)) == [("runtime", "one"), ("runtime", "two"), ("script", "pkg.cli:main")]
    assert list(declared_in("pyproject.toml", "not = [toml")) == []
    p = project_of('[tool.srcquarry]\nroots = ["lib"]\n[tool.srcquarry.health]\nmax_cyclomatic = 4\n[[tool.srcquarry.boundaries.rules]]\nname = "r"\nfrom = "a/*"\ndisallow = ["b"]\n')
    assert p.roots == ("lib",) and p.max_cyclomatic == 4 and p.boundaries[0].sources == ("a/*",)
    with pytest.raises(ValueError):
        project_of("[tool.srcquarry\n")


def test_settings_belong_to_their_sections():
    p = project_of("""
        [tool.fallen.python]
        ignore = ["gen/**"]
        nothing = 1
        frameworks = ["auto"]
        [tool.fallen.python.dependencies]
        ignore = ["pytest"]
        import_map = {thing = "the-thing"}
        check_missing = false
        include_dev = "yes"
        [tool.fallen.python.dead_code]
        ignore_symbols = ["A"]
        [tool.fallen.python.dupes]
        mode = "odd"
        min_lines = 0
        [[tool.fallen.python.boundaries.rules]]
        name = "r"
        from = "a/*"
        disallow = ["b"]
        severity = "fatal"
        [[tool.fallen.python.boundaries.rules]]
        name = "empty"
        """, "fallen.python")
    assert p.ignore == ("gen/**",) and p.ignored_packages == ("pytest",) and p.ignored_symbols == ("A",)
    assert p.import_map["thing"] == "the-thing" and p.import_map["yaml"] == "pyyaml" and not p.include_dev and p.min_lines == 6
    assert "missing-runtime-dependency" in p.disabled and "unused-runtime-dependency" not in p.disabled
    assert p.boundaries == (Boundary("r", ("a/*",), ("b",)),)
    assert [k for k, _ in p.config_errors] == ["nothing", "dependencies.include_dev", "dupes.mode", "dupes.min_lines", "boundaries.rules.r.severity", "boundaries.rules.empty.from", "boundaries.rules.empty.disallow"]


def test_confidence_of_exports_is_a_setting():
    text = "[tool.srcquarry.dead_code]\nconfidence_for_init_exports = '%s'\n"
    good, bad = project_of(text % "high"), project_of(text % "sure")
    assert good.init_exports == "high" and not good.config_errors
    assert bad.init_exports == "low" and [k for k, _ in bad.config_errors] == ["dead_code.confidence_for_init_exports"]


def test_packages_that_reexport_from_one_another(spark):
    files = {"a/__init__.py": "from b import X\n", "b/__init__.py": "from a import X\n", "use.py": "from a import X\nX()\n", "c/__init__.py": "from c.d import Y as Z\n", "c/d.py": "Y = 1\n", "main.py": "from c import Z\nimport use\n"}
    wrong = Project(config_errors=(("dupes.mode", "Unsupported duplicate mode: odd"),), disabled=("unused-module",))
    r = api.repositories(spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo string, path string, text string"), wrong)
    assert {(x.module, x.name): x.production for x in r.symbols.collect()}["c.d", "Y"] == 1
    got = {(x.rule, x.message) for x in api.analyze(r).collect()}
    assert ("config-error", "dupes.mode: Unsupported duplicate mode: odd") in got and "unused-module" not in {k for k, _ in got}


def test_exports_and_states(spark):
    files = {
        "p/__init__.py": "from p.a import one, two\nfrom p.b import *\nfrom p.c import *\n__all__ = ['one']\n",
        "p/a.py": "def one(): pass\ndef two(): pass\n", "p/b.py": "def three(): pass\ndef _four(): pass\n", "p/c.py": "def five(): pass\ndef six(): pass\n__all__ = ['five']\n__all__ += ['six']\n",
        "q/__init__.py": "from p import *\nfrom q import sub\n", "q/sub.py": "import importlib\nimportlib.import_module('late')\n", "late.py": "", "main.py": "from q import three\nthree()\n",
        "ring/__init__.py": "from q import *\nfrom ring import *\n",
    }
    r = api.repositories(spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo string, path string, text string"), Project(init_exports="medium"))
    got = {(x.module, x.name): (x.source[0], x.origin_module, x.confidence, x.complete, x.explicit) for x in r.exported.collect()}
    p = {"one": ("p.a", "medium", True), "three": ("p.b", "low", False), "five": ("p.c", "medium", True), "six": ("p.c", "medium", True)}
    want = {("p", n): ("d" if n == "one" else "s", *v, n == "one") for n, v in p.items()} | {(m, n): ("s", *v, False) for m in ("q", "ring") for n, v in p.items()}
    assert got == want | {("q", "sub"): ("d", "q.sub", "medium", False, False), ("ring", "sub"): ("s", "q.sub", "medium", False, False)}
    s = {(x.module, x.name): (x.production, x.reexported, x.public_confidence) for x in r.symbols.collect()}
    assert s["p.b", "three"] == (1, True, "low") and s["p.a", "two"] == (0, False, None) and s["p.c", "six"] == (0, True, "medium")
    m = {x.module: x for x in r.states.collect()}
    assert m["late"].dynamic_uncertain and m["q.sub"].referenced and m["p"].public_api and not m["p.a"].public_api and m["main"].entrypoint_managed and m["p.b"].reachable and not m["ring"].reachable


def test_changed_since(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    paths = lambda df: sorted(r.path for r in df.collect())
    sub = tmp_path / "sub"
    sub.mkdir()
    assert api.changed_since(spark, str(sub), "HEAD") is None
    git("init", "-q")
    for n in ("a", "b", "c"):
        (sub / f"{n}.py").write_text("x = 1\n")
    (tmp_path / "top.py").write_text("")
    git("add", ".")
    git("commit", "-qm", "one")
    (sub / "a.py").write_text("x = 2\n")
    git("commit", "-qam", "two")
    (sub / "b.py").write_text("x = 3\n")
    (sub / "new é.py").write_text("")
    (sub / "venv").mkdir()
    (sub / "venv" / "z.py").write_text("")
    (tmp_path / "top.py").write_text("y = 1\n")
    (sub / "c.py").unlink()
    assert paths(api.changed_since(spark, str(sub), "HEAD~1", ignore=Project().ignore)) == ["a.py", "b.py", "new é.py"]
    assert paths(api.changed_since(spark, str(tmp_path), "HEAD")) == ["sub/b.py", "sub/new é.py", "sub/venv/z.py", "top.py"]
    with pytest.raises(ValueError):
        api.changed_since(spark, str(sub), "no-such-ref")


def test_rules_are_numbered():
    assert len({i for i, _ in rules.RULES.values()}) == len(rules.RULES) == 25


def test_folder(spark, tmp_path):
    for p, t in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(textwrap.dedent(t).lstrip("\n"))
    r = api.open_folder(spark, str(tmp_path), project=PROJECT)
    assert {x.module for x in r.modules.collect()} >= {"shop.main", "shop.core.logic", "tests.test_shop"}


WRONG = [
    ('[tool.srcquarry]\nbaseline = "x"', "baseline"),
    ("[tool]\nsrcquarry = 1", "srcquarry"),
    ("[tool.srcquarry]\nboundaries = 3", "boundaries"),
    ("[tool.srcquarry.boundaries]\nrules = [1]", "boundaries.rules.0"),
    ("[tool.srcquarry.boundaries]\nrules = 3", "boundaries.rules"),
    ("tool = 3", "srcquarry"),
    ("[tool.srcquarry]\ndead_code = []", "dead_code"),
    ("[tool.srcquarry.dead_code]\nignore_decorated = 1", "dead_code.ignore_decorated"),
    ("[tool.srcquarry.dead_code]\nenabled = 'no'", "dead_code.enabled"),
    ("[tool.srcquarry.dupes]\nmode = 4", "dupes.mode"),
    ("[tool.srcquarry.dupes]\nmin_lines = true", "dupes.min_lines"),
    ("[tool.srcquarry]\nframeworks = ['rails']", "frameworks"),
    ("[tool.srcquarry]\nroots = [1]", "roots"),
    ("[tool.srcquarry.dependencies]\nimport_map = {a = 1}", "dependencies.import_map"),
    ("[[tool.srcquarry.boundaries.rules]]\nname = 'r'\nfrom = 1\ndisallow = 'x'", "boundaries.rules.r.from"),
    ("[tool.srcquarry]\nnope = 1", "nope"),
]


@pytest.mark.parametrize("text, key", WRONG)
def test_wrong_settings_become_findings(text, key):
    p = project_of(text)
    assert [k for k, _ in p.config_errors] == [key]
    assert {**vars(p), "config_errors": ()} == vars(Project())


SYMBOLS = {
    "src/app/main.py": "from app import tool\n",
    "src/app/tool.py": "from typing import Protocol\n@cached\ndef decorated():\n    return 1\nclass Shape(Protocol):\n    pass\n__extra__ = 1\n_inner = 2\n",
    "src/bare/loose.py": "x = 1\n",
    "src/app/__init__.py": "",
    "src/lone/__init__.py": "",
    "src/web.py": "import flask\nimport celery\n",
}


def test_accepted_settings_have_an_effect(spark):
    files = spark.createDataFrame([("a", p, t) for p, t in SYMBOLS.items()], "repo string, path string, text string")

    def look(settings: str):
        return api.repositories(files, project_of("[tool.srcquarry]\nentry = ['src/app/main.py']\n" + settings))

    symbols = lambda r: {(x.symbol, x.confidence) for x in rules.unused_symbols(r).where("module = 'app.tool'").collect()}
    plain, open_ = look(""), look("[tool.srcquarry.dead_code]\nignore_decorated = false\nignore_protocol_methods = false\nignore_dunder_methods = false\ntreat_init_as_entry = false\n")
    assert symbols(plain) == set()
    assert symbols(open_) == {("decorated", "low"), ("Shape", "medium"), ("__extra__", "low")}
    modules = lambda r: {x.module for x in rules.unused_modules(r).collect()}
    assert "lone" not in modules(plain) and "lone" in modules(open_)
    known = lambda r: {x.module for x in r.modules.collect()}
    assert known(plain) - known(look("namespace_packages = false\n")) == {"bare.loose"}
    frameworks = lambda r: {x.framework for x in r.frameworks.collect()}
    assert frameworks(plain) == {"flask", "celery"} and frameworks(look("frameworks = ['flask']\n")) == {"flask"}
    assert frameworks(look("framework_heuristics = false\n")) == frameworks(look("frameworks = 'none'\n")) == set()


COMMENTED = {
    "src/app/one.py": "# srcquarry: ignore[unused-symbol]\n\ndef main():\n    return 1\n",
    "src/app/two.py": "import os\n" + "".join(f"v{i} = {i}\n" for i in range(20)) + "x = 1  # srcquarry: ignore[large-file]  # srcquarry: ignore[parse-error] why\ny = 2\n# srcquarry: ignore[large-file]",
    "src/app/only.py": "# srcquarry: ignore[large-file]\n",
    "src/app/win.py": "a = 1\r\nb = 2  # srcquarry: ignore[large-file]\r\n",
    "src/app/none.py": "a = 1\n",
}


def test_patches_apply(spark, tmp_path):
    import subprocess

    from srcquarry.plans import patches

    files = spark.createDataFrame([("a", p, t) for p, t in COMMENTED.items()], "repo string, path string, text string")
    found = api.analyze(api.repositories(files, Project(entry=("src/app/one.py",))))
    edits = patches.stale_comments(found)
    got = {r.path: r.patch for r in patches.unified(edits, files).collect()}
    assert set(got) == set(COMMENTED) - {"src/app/none.py"}
    for p, t in COMMENTED.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t.encode())
    for text in got.values():
        done = subprocess.run(["git", "apply", "-"], input=text.encode(), cwd=tmp_path, capture_output=True)
        assert done.returncode == 0, (text, done.stderr)
    after = {p: (tmp_path / p).read_bytes().decode() if (tmp_path / p).exists() else None for p in COMMENTED}
    assert after["src/app/one.py"] == "\ndef main():\n    return 1\n"
    assert after["src/app/two.py"] == COMMENTED["src/app/two.py"].split("x = 1")[0] + "x = 1    # why\ny = 2\n"
    assert after["src/app/only.py"] in ("", None) and after["src/app/none.py"] == COMMENTED["src/app/none.py"]
    assert after["src/app/win.py"] == "a = 1\r\nb = 2\r\n"
    plan = report.fix_plan(found, patches.as_patches(edits))
    assert {(json.loads(x["minimal_patch"])["type"], x["file"].rpartition("/")[2]) for x in plan["auto_safe"]} >= {("delete_line", "one.py"), ("replace_line", "win.py")}
    assert all(x["rationale"] and x["hint"] for bucket in report.BUCKETS for x in plan[bucket])


def test_sarif_places_and_line_hashes(spark, repos, found):
    import hashlib

    results = report.as_sarif(found.where("repo = 'a'"), repos.files, related=2)["runs"][0]["results"]
    by = {r["properties"]["rule"]: r for r in results}
    line = textwrap.dedent(FILES["src/shop/core/logic.py"]).lstrip("\n").split("\n")[3]
    assert by["high-cyclomatic-complexity"]["partialFingerprints"]["primaryLocationLineHash"] == hashlib.sha1(line.encode()).hexdigest()
    assert by["high-cyclomatic-complexity"]["locations"][0]["physicalLocation"]["region"] == {"startLine": 4, "endLine": 14}
    gone = by["unused-runtime-dependency"]
    assert len(gone["partialFingerprints"]["primaryLocationLineHash"]) == 40 and gone["relatedLocations"] == []
    ways = by["circular-dependency"]["relatedLocations"]
    assert [w["message"]["text"] for w in ways] == ["shop.left imports shop.right", "shop.right imports shop.left"] and [w["id"] for w in ways] == [1, 2]
    copies = by["duplicate-code"]["relatedLocations"]
    assert {c["physicalLocation"]["artifactLocation"]["uri"] for c in copies} == {"src/shop/one.py", "src/shop/two.py"}


def test_states_decide_about_symbols(spark):
    base = dict.fromkeys(rules.COLUMNS) | {"repo": "a", "rule": "unused-symbol", "severity": "warning", "confidence": "medium", "message": "m"}
    cases = [([], "medium", "review_needed"), ([], "high", "auto_safe"), ([], "low", "manual_only"), (["public_api"], "high", "review_needed"), (["dynamic_uncertain"], "high", "review_needed"), (["framework_managed"], "low", "manual_only")]
    kinds = ", ".join(f"{c} {'array<string>' if c == 'flags' else 'int' if 'line' in c else 'string'}" for c in base)
    rows = [tuple((base | {"flags": f, "confidence": c, "symbol": str(n)}).values()) for n, (f, c, _) in enumerate(cases)]
    got = {r.symbol: r for r in rules.classified(spark.createDataFrame(rows, kinds)).collect()}
    assert [got[str(n)].decision for n in range(len(cases))] == [d for *_, d in cases]
    assert "public" in got["3"].rationale and "framework" not in got["5"].rationale.lower()


def test_roots_are_found(spark):
    paths = {
        "one": ["src/a/x.py", "docs/conf.py"],
        "two": ["backend/b.py", "setup.py", "tests/t.py"],
        "three": ["pkg/__init__.py", "pkg/m.py", "app/c.py"],
        "four": ["lib/d.py"],
    }
    files = spark.createDataFrame([(r, p, "x = 1\n") for r, ps in paths.items() for p in ps], "repo string, path string, text string")
    got = {(m.repo, m.path): m.module for m in api.repositories(files, Project()).modules.collect()}
    assert got == {
        ("one", "src/a/x.py"): "a.x",
        ("two", "backend/b.py"): "b", ("two", "setup.py"): "setup", ("two", "tests/t.py"): "tests.t",
        ("three", "pkg/__init__.py"): "pkg", ("three", "pkg/m.py"): "pkg.m", ("three", "app/c.py"): "c",
        ("four", "lib/d.py"): "lib.d",
    }


def test_frameworks_told_by_tests_beside_sources(spark, tmp_path):
    """Nation 1 has source files and a test, nation 2 a test only, nation 3 neither."""
    from srcquarry.plans.catalog import queries

    keys = [(11, 1), (12, 1), (4, 1), (1, 2), (5, 3)]
    spark.createDataFrame(keys, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(tuple(r) for r in queries()["source_frameworks"](spark, str(tmp_path)).collect())
    assert got == [("nation1", "django"), ("nation1", "pytest"), ("nation2", "pytest")]


def test_command_line(spark, tmp_path, capsys):
    from srcquarry.__main__ import main

    for p, t in {**COMMENTED, "src/alt/one.py": "x = 1\n", "alt/one.py": "y = 1\n", "pyproject.toml": "[tool.srcquarry]\nroots = ['src', '.']\nentry = ['src/app/two.py']\n"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t, newline="")
    folder = str(tmp_path)
    assert main(["analyze", folder, "--format", "json", "--output", str(tmp_path / "out.json")]) == 0
    whole = json.loads((tmp_path / "out.json").read_text(encoding="utf-8"))
    assert len(whole["issues"]) == whole["summary"]["total_issues"] and whole["limitations"]
    assert whole["module_ambiguities"] == [{"repo": "repo", "module": "alt.one", "selected_path": "alt/one.py", "shadowed_path": "src/alt/one.py"}]
    assert {m["module"] for m in whole["modules"]} >= {"app.one", "app.two"} and whole["metrics"][0]["functions"] == 1
    assert main(["agent-context", folder]) == 0 and "## Overview" in capsys.readouterr().out
    assert main(["agent-context", folder, "--format", "json"]) == 0 and json.loads(capsys.readouterr().out)["overview"][0]["modules"] >= 5
    assert main(["patch", folder]) == 0 and "-# srcquarry: ignore[large-file]" in capsys.readouterr().out
    assert main(["baseline", folder]) == 0
    assert main(["compare", folder, "--fail-on", "any"]) == 0 and "new 0," in capsys.readouterr().err
    (tmp_path / "src/app/fresh.py").write_text("def unused():\n    return 1\n")
    assert main(["compare", folder, "--fail-on", "any", "--format", "json"]) == 1
    assert {x["baseline_status"] for x in json.loads(capsys.readouterr().out)["issues"]} == {"new", "existing"}
    assert main(["analyze", str(tmp_path / "nothing")]) == 2 and main(["analyze", folder, "--baseline", str(tmp_path / "none")]) == 2
    with pytest.raises(SystemExit) as stop:
        main(["--version"])
    assert stop.value.code == 0
