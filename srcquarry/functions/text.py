"""String functions as column expressions, all evaluated in the JVM."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a shell pattern whose ``*`` also crosses ``/``."""
    return fnmatch.translate(pattern).replace(r"\Z", r"\z")


def matches_glob(value: Column, *patterns: str) -> Column:
    return value.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def matches_path(path: Column, *patterns: str) -> Column:
    """True if a pattern matches the whole path or its last part, or is ``prefix/**`` of it."""
    last = [p for p in patterns if "/" not in p or "[" in p]  # others ask for a slash, which the last part has none of
    found = matches_glob(path, *patterns) | matches_glob(F.substring_index(path, "/", -1), *last)
    for p in patterns:
        if p.endswith("/**"):
            found = found | (path == p[:-3]) | path.startswith(p[:-2])
    return found


def package_name(name: Column) -> Column:
    """Lower case, runs of ``- _ .`` as one dash, other characters dropped, no dash at either end."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[-_.]+", "-"), r"[^\p{L}\p{N}-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def requirement_name(line: Column) -> Column:
    """The normalised package of a requirements line; null for comments, options and addresses."""
    text = F.trim(F.regexp_replace(line, r"(^|\s)#.*$", ""))
    head = F.regexp_extract(F.substring_index(F.substring_index(text, ";", 1), "[", 1), r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.when((text == "") | text.startswith("-") | text.rlike("^(git[+]|https?:)") | (head == ""), None).otherwise(package_name(head))


def import_spec(raw: Column) -> tuple[Column, Column]:
    """(what is imported, alias or null), split at the last `` as ``."""
    there = raw.rlike(r"(?s)^.* as .*$")
    return F.when(there, F.regexp_extract(raw, r"(?s)^(.*) as (.*)$", 1)).otherwise(raw), F.when(there, F.regexp_extract(raw, r"(?s)^(.*) as (.*)$", 2))


def absolute_name(name: Column, package: Column) -> Column:
    """``..a.b`` inside ``package``: one leading dot is the package, each further one its parent; null beyond the root."""
    dots = F.length(name) - F.length(F.regexp_replace(name, r"^\.+", ""))
    parts = F.split(package, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots + 1, F.lit(0))), ".")
    rest = F.regexp_replace(name, r"^\.+", "")
    return F.when(dots == 0, name).when(dots > F.size(parts), None).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(rest, F.lit(""))))


def prefixes(name: Column, separator: str = r"\.", joiner: str = ".") -> Column:
    """All beginnings of a separated name, longest first."""
    parts = F.split(name, separator)
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), joiner))


def fingerprint(*fields: Column) -> Column:
    """Twenty hex digits of the SHA-1 of the compact JSON of ``fields``, which come in the order of their names."""
    return F.substring(F.sha1(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), 1, 20)


def line_hash(line: Column) -> Column:
    return F.sha1(F.regexp_replace(F.trim(line), r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; no words: an empty array."""
    bare = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def ranked(value: Column, order: tuple[str, ...]) -> Column:
    """The place of ``value`` in ``order``, -1 if it has none."""
    return F.array_position(F.array(*map(F.lit, order)), value).cast("int") - 1
