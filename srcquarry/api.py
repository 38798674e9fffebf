"""The entry points for users: analyse a folder or a table of files."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcquarry.functions import text
from srcquarry.plans import report, rules
from srcquarry.plans.resolve import Repositories
from srcquarry.sources.declarations import Project, declarations, project_of
from srcquarry.sources.python_source import read_files
from srcquarry.sources.scratch import stored


def repositories(files: DataFrame, project: Project = Project(), declared: DataFrame | None = None) -> Repositories:
    """``files``: (repo, path, text) of any number of repositories, sources and declaration files together."""
    return Repositories(files, project, declarations(files) if declared is None else declared)


def open_folder(spark: SparkSession, folder: str, section: str = "srcquarry", project: Project | None = None) -> Repositories:
    """The repository in a local or shared folder, configured by its pyproject.toml unless ``project`` is given."""
    root = Path(folder)
    found = [p for p in (root / "pyproject.toml", root / "setup.cfg", root / "requirements.txt", *sorted((root / "requirements").glob("*.txt"))) if p.is_file()]
    if project is None:
        project = project_of((root / "pyproject.toml").read_text(encoding="utf-8"), section) if (root / "pyproject.toml").is_file() else Project()
    texts = spark.createDataFrame([("repo", p.relative_to(root).as_posix(), p.read_text(encoding="utf-8", errors="replace")) for p in found], "repo string, path string, text string")
    return Repositories(read_files(spark, str(root.resolve()), ignore=project.ignore), project, declarations(texts))


def analyze(r: Repositories) -> DataFrame:
    """All findings, worked out once; see ``plans.rules`` for their columns and ``plans.report`` for what to make of them."""
    return stored(rules.findings(r), "findings")


def changed_since(spark: SparkSession, folder: str, ref: str, repo: str = "repo", ignore: tuple[str, ...] = ()) -> DataFrame | None:
    """(repo, path) of the Python files below ``folder`` that differ from ``ref``: committed, staged, unstaged and untracked ones.

    Paths are relative to ``folder``, which may lie anywhere in its repository; ignored ones are left out.  Null where the folder
    is in no Git repository or Git cannot compare: then everything counts.  An unknown ``ref`` raises ValueError.
    """

    def git(*args: str) -> list[str] | None:
        try:
            got = subprocess.run(["git", "-C", folder, *args], capture_output=True, timeout=30)
        except (FileNotFoundError, subprocess.TimeoutExpired):
            return None
        return None if got.returncode else [x for x in got.stdout.decode("utf-8", "replace").split("\0" if "-z" in args else "\n") if x]

    if git("rev-parse", "--git-dir") is None:
        return None
    if (base := git("rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}")) is None:
        raise ValueError(f"ref not found: {ref}")
    compared = ("diff", "-z", "--name-only", "--relative", "--find-renames", "--diff-filter=ACMR")
    found = [git(*compared, f"{base[0]}...HEAD"), git(*compared, "HEAD"), git("ls-files", "-z", "--others", "--exclude-standard")]
    if found[0] is None:
        return None
    names = sorted({n for part in found for n in part or () if n.endswith(".py")})
    changed = spark.createDataFrame([(repo, n) for n in names], "repo string, path string")
    return changed.where(~text.matches_path(F.col("path"), *ignore)) if ignore else changed


__all__ = ["Project", "analyze", "changed_since", "open_folder", "report", "repositories"]
