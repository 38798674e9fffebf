"""Declared dependencies and configuration of projects: small files, one row or object for each project."""

from __future__ import annotations

import configparser
import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)")

#: Distributions of import names that differ, longest import name first where one begins another.
IMPORT_MAP = {
    "PIL": "pillow", "yaml": "pyyaml", "cv2": "opencv-python", "sklearn": "scikit-learn", "bs4": "beautifulsoup4", "Crypto": "pycryptodome", "dateutil": "python-dateutil",
    "dotenv": "python-dotenv", "jwt": "pyjwt", "OpenSSL": "pyopenssl", "google.protobuf": "protobuf", "grpc": "grpcio", "skimage": "scikit-image",
}
#: Paths that are not a project's own source.
IGNORE = tuple(".git/** .hg/** .svn/** .venv/** venv/** env/** __pycache__/** .mypy_cache/** .pytest_cache/** .ruff_cache/** build/** dist/** *.egg-info/** site-packages/** node_modules/**".split())
#: Symbols that entry modules may offer, and names that never count as unused.
ENTRY_SYMBOLS = tuple("main run app application handler lambda_handler handle cli create_app".split())
IGNORED_SYMBOLS = tuple("__version__ __all__ Meta Config Settings".split())


@dataclass(frozen=True)
class Boundary:
    name: str
    sources: tuple[str, ...]
    disallow: tuple[str, ...]
    severity: str = "warning"


@dataclass(frozen=True)
class Project:
    """What an analysis may be told; the same for all repositories of a run."""

    roots: tuple[str, ...] = ()  # none: found in each repository
    entry: tuple[str, ...] = ()
    include_tests: bool = False
    entry_symbols: tuple[str, ...] = ENTRY_SYMBOLS
    ignored_symbols: tuple[str, ...] = IGNORED_SYMBOLS
    init_exports: str = "low"  # how sure an export of a package's __init__ is
    init_is_entry: bool = True
    ignore_decorated: bool = True
    ignore_protocols: bool = True
    ignore_dunders: bool = True
    namespace_packages: bool = True
    framework_heuristics: bool = True
    frameworks: tuple[str, ...] = ("auto",)
    baseline: str = ""
    markers: tuple[str, ...] = ("srcquarry",)
    ignore: tuple[str, ...] = IGNORE
    include_optional: bool = True
    include_dev: bool = False
    report_type_only_missing: bool = True
    report_test_only_missing: bool = False
    ignored_packages: tuple[str, ...] = ("pytest", "mypy", "ruff", "black", "coverage")
    import_map: dict[str, str] = field(default_factory=lambda: dict(IMPORT_MAP))
    strict_duplicates: bool = False
    min_lines: int = 6
    min_tokens: int = 40
    max_groups: int = 200
    max_cyclomatic: int = 10
    max_cognitive: int = 15
    max_function_lines: int = 80
    max_file_lines: int = 800
    hotspot_score: int = 50
    boundaries: tuple[Boundary, ...] = ()
    #: Rules that are switched off, and (setting, what is wrong with it) of settings that do not hold.
    disabled: tuple[str, ...] = ()
    config_errors: tuple[tuple[str, str], ...] = ()


#: Settings by section, with the field they set where its name differs.
SETTINGS = {
    "": dict.fromkeys("roots entry include_tests markers ignore namespace_packages framework_heuristics frameworks".split(), ""),
    "dead_code": {
        "ignore_symbols": "ignored_symbols", "entry_symbols": "", "treat_init_as_entry": "init_is_entry", "ignore_decorated": "",
        "ignore_protocol_methods": "ignore_protocols", "ignore_dunder_methods": "ignore_dunders", "confidence_for_init_exports": "init_exports",
    },
    "dependencies": {"include_optional": "", "include_dev": "", "report_type_only_missing": "", "report_test_only_missing": "", "ignore": "ignored_packages", "import_map": ""},
    "dupes": {"mode": "strict_duplicates", "min_lines": "", "min_tokens": "", "max_groups": ""},
    "health": {"max_cyclomatic": "", "max_cognitive": "", "max_function_lines": "", "max_file_lines": "", "hotspot_score_threshold": "hotspot_score"},
    "baseline": {"path": "baseline"},
}
#: What settings with a choice may say, and how a wrong one is called.
CHOICES = {
    "dupes.mode": (("strict", "mild", "structural"), "duplicate mode"),
    "dead_code.confidence_for_init_exports": (("low", "medium", "high"), "confidence"),
    "frameworks": (("auto", "django", "fastapi", "flask", "celery", "pytest", "click", "typer", "none"), "framework value"),
}
#: Switches that turn rules off when they are false.
SWITCHES = {
    "dead_code.enabled": ("unused-module", "unused-symbol"), "dead_code.detect_unused_modules": ("unused-module",), "dead_code.detect_unused_symbols": ("unused-symbol",),
    "dependencies.enabled": ("missing-runtime-dependency", "missing-type-dependency", "missing-test-dependency", "dev-dependency-used-in-runtime", "optional-dependency-used-in-runtime", "runtime-dependency-used-only-in-tests", "runtime-dependency-used-only-for-types", "unused-runtime-dependency"),
    "dependencies.check_missing": ("missing-runtime-dependency", "missing-type-dependency", "missing-test-dependency", "dev-dependency-used-in-runtime", "optional-dependency-used-in-runtime"),
    "dependencies.check_unused": ("runtime-dependency-used-only-in-tests", "runtime-dependency-used-only-for-types", "unused-runtime-dependency"),
    "dupes.enabled": ("duplicate-code",), "health.enabled": ("high-cyclomatic-complexity", "high-cognitive-complexity", "large-function", "large-file", "risky-hotspot"),
}
#: Settings that are taken and change nothing: a string is one token, whether it documents or not.
ACCEPTED = frozenset({"dupes.ignore_docstrings"})


def normal(name: str) -> str:
    kept = "".join(c if c.isalnum() else "-" if c in "-_." else "" for c in name.strip().lower())
    return re.sub("-+", "-", kept).strip("-")


def requirement(line: str) -> str | None:
    text = re.sub(r"(^|\s)#.*", "", line).strip()
    if not text or text.startswith(("-", "git+", "http:", "https:")):
        return None
    m = NAME.match(text.split(";")[0].split("[")[0])
    return normal(m[1]) if m else None


def expected(known: object) -> str:
    kinds = {bool: "true or false", tuple: "a list of strings", dict: "a table of strings", str: "a string"}
    return kinds.get(type(known), "a positive integer")


def fitting(known: object, value: object) -> object:
    """``value`` as a value for a setting that now is ``known``; None if it is of another type or out of range."""
    strings = lambda values: all(isinstance(x, str) for x in values)
    if isinstance(known, bool):
        return value if isinstance(value, bool) else None
    if isinstance(known, int):
        return value if isinstance(value, int) and not isinstance(value, bool) and value > 0 else None
    if isinstance(known, tuple):
        value = [value] if isinstance(value, str) else value
        return tuple(value) if isinstance(value, list) and strings(value) else None
    if isinstance(known, dict):
        return {**known, **value} if isinstance(value, dict) and strings(value.values()) else None
    return value if isinstance(value, str) else None


def project_of(text: str, section: str = "srcquarry", base: Project = Project()) -> Project:
    """The settings of ``[tool.<section>]`` of a pyproject file; ``section`` may be dotted.

    Each setting belongs to its section.  One that is unknown, of the wrong type or out of range keeps its default and is listed
    in ``config_errors``; only a file that is no TOML raises ValueError.
    """
    own, errors, given = tomllib.loads(text), [], {}
    for part in ("tool", *section.split(".")):
        own = own.get(part, {}) if isinstance(own, dict) else own
    if not isinstance(own, dict):
        errors.append((section, f"Expected a table, got {own!r}."))
        own = {}
    for name, value in own.items():
        if name not in SETTINGS and name != "boundaries":
            given[name] = value
        elif not isinstance(value, dict):
            errors.append((name, f"Expected a table, got {value!r}."))
        elif name != "boundaries":
            given |= {f"{name}.{k}": v for k, v in value.items()}
    put, off = {}, []
    for name, value in given.items():
        table, _, key = name.rpartition(".")
        at = SETTINGS.get(table, {}).get(key)
        if name in SWITCHES:
            off += SWITCHES[name] if value is False else ()
            errors += [] if isinstance(value, bool) else [(name, f"Expected true or false, got {value!r}.")]
        elif at is not None:
            choices, called = CHOICES.get(name, (None, ""))
            known = "" if name == "dupes.mode" else getattr(base, at or key)
            fit = fitting(known, value)
            wrong = [x for x in (fit if isinstance(fit, tuple) else [fit]) if choices and fit is not None and x not in choices]
            if fit is None:
                errors.append((name, f"Expected {expected(known)}, got {value!r}."))
            elif wrong:
                errors.append((name, f"Unsupported {called}: {wrong[0]}"))
            else:
                put[at or key] = fit == "strict" if name == "dupes.mode" else fit
        elif name not in ACCEPTED:
            errors.append((name, "Unknown setting."))
    rules = own["boundaries"].get("rules", []) if isinstance(own.get("boundaries"), dict) else []
    boundaries, more = boundary_rules(rules)
    return replace(base, **put, boundaries=boundaries, disabled=tuple(dict.fromkeys(off)), config_errors=(*errors, *more))


def boundary_rules(rules: object) -> tuple[tuple[Boundary, ...], list[tuple[str, str]]]:
    """The rules that hold, and what is wrong with the others."""
    kept, errors = [], []
    if not isinstance(rules, list):
        return (), [("boundaries.rules", f"Expected a list of tables, got {rules!r}.")]
    for n, r in enumerate(rules):
        if not isinstance(r, dict):
            errors.append((f"boundaries.rules.{n}", f"Expected a table, got {r!r}."))
            continue
        name, severity = str(r.get("name", "boundary-rule")), str(r.get("severity", "warning"))
        at = f"boundaries.rules.{name}"
        if severity not in ("info", "warning", "error"):
            errors.append((f"{at}.severity", f"Unsupported boundary severity: {severity}"))
            severity = "warning"
        patterns = []
        for key, value in (("from", r.get("from", r.get("from_patterns", []))), ("disallow", r.get("disallow", []))):
            fit = fitting((), value)
            if not fit:
                errors.append((f"{at}.{key}", f"Boundary rule has no {key} patterns." if fit == () else f"Expected a list of strings, got {value!r}."))
            patterns.append(fit or ())
        if all(patterns):
            kept.append(Boundary(name, *patterns, severity))
    return tuple(kept), errors


def declared_in(path: str, text: str) -> Iterable[tuple[str, str]]:
    """(scope, package or script target) of pyproject.toml, setup.cfg or a requirements file; broken files declare nothing."""
    name = path.rpartition("/")[2]
    try:
        if name == "pyproject.toml":
            t = tomllib.loads(text)
            p, poetry = t.get("project", {}), t.get("tool", {}).get("poetry", {})
            groups = {"runtime": list(p.get("dependencies", [])), "optional": [x for xs in p.get("optional-dependencies", {}).values() for x in xs], "dev": [x for xs in t.get("dependency-groups", {}).values() for x in xs if isinstance(x, str)]}
            groups["runtime"] += [x for x in poetry.get("dependencies", {}) if x != "python"]
            groups["dev"] += [*poetry.get("dev-dependencies", {}), *(x for g in poetry.get("group", {}).values() for x in g.get("dependencies", {}))]
            yield from ((scope, n) for scope, lines in groups.items() for x in lines if (n := requirement(x)))
            yield from (("script", str(x)) for x in {**p.get("scripts", {}), **poetry.get("scripts", {})}.values())
        elif name == "setup.cfg":
            c = configparser.ConfigParser(interpolation=None)
            c.read_string(text)
            yield from (("runtime", n) for x in c.get("options", "install_requires", fallback="").splitlines() if (n := requirement(x)))
            for lines in c["options.entry_points"].values() if c.has_section("options.entry_points") else ():
                yield from (("script", x.partition("=")[2].strip()) for x in lines.splitlines() if "=" in x)
        elif name.endswith(".txt"):
            yield from (("runtime", n) for x in text.splitlines() if (n := requirement(x)))
    except (tomllib.TOMLDecodeError, configparser.Error, AttributeError, TypeError):
        return


def declarations(files: DataFrame) -> DataFrame:
    """(repo, scope, name, source) of the declaration files in (repo, path, text); the first declaration of a scope stays."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(r, s, n, p) for r, p, t in zip(*(c.to_pylist() for c in b.columns)) for s, n in declared_in(p, t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in range(4)], ["repo", "scope", "name", "source"])

    found = files.select("repo", "path", "text").where(F.col("path").rlike(r"(^|/)(pyproject\.toml|setup\.cfg|requirements\.txt|requirements/[^/]*\.txt)$"))
    return found.mapInArrow(run, "repo string, scope string, name string, source string").groupBy("repo", "scope", "name").agg(F.min("source").alias("source"))
