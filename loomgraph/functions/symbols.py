"""Names, files and places of symbols as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_segment(fqn: Column) -> Column:
    """The name after the last dot before any parameter list."""
    return F.regexp_extract(F.split_part(fqn, F.lit("("), F.lit(1)), "([^.]*)$", 1)


def member_suffix(member_fqn: Column, type_fqn: Column) -> Column:
    """What follows the type's name in its member's; null if the member isn't named so."""
    return F.when(member_fqn.startswith(type_fqn), F.substring(member_fqn, F.length(type_fqn) + 1, F.length(member_fqn)))


def dotted_prefixes(fqn: Column) -> Column:
    """The name and each of its prefixes that end before a dot."""
    parts = F.split(fqn, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def directory(path: Column) -> Column:
    """The path up to its last slash, with slashes only."""
    return F.regexp_replace(slashed(path), "[^/]*$", "")


def directories(path: Column) -> Column:
    """All directories above a file, in lower case, each with a slash at its end."""
    parts = F.split(F.lower(directory(path)), "/", -1)
    return F.when(path.isNotNull(), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) that a character offset lies in; null outside the text."""
    before = F.substring(text, F.lit(1), offset)
    return F.when((offset >= 0) & (offset <= F.length(text)), F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1)


def location(file: Column, line: Column) -> Column:
    return F.concat(file, F.lit(":"), F.coalesce(line.cast("string"), F.lit("?")))


def display(kind: Column, fqn: Column, file: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("] "), fqn, F.coalesce(F.concat(F.lit(" — "), file), F.lit("")))


def is_test_project(name: Column) -> Column:
    return F.lower(name).contains("test")


def truncated(text: Column, limit: int = 60) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def project_of_path(path: Column) -> Column:
    """The file name of a Windows or other path without its last extension."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def severity_rank(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s == "critical", 4).when(s == "high", 3).when(s == "moderate", 2).when(s == "low", 1).otherwise(0)
