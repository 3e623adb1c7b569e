"""Functions of source files: line ranges, tokens, containers, cost."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hunk_ranges(header: Column) -> dict[str, Column]:
    """Old and new start and count of '@@ -a[,b] +c[,d] @@'; an omitted count is 1, a malformed header gives nulls."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda i: F.regexp_extract(header, pattern, i)
    number = lambda i, default: F.when(part(1) != "", F.coalesce(F.nullif(part(i), F.lit("")), F.lit(default)).cast("int"))
    return {"old_start": number(1, None), "old_count": number(2, "1"), "new_start": number(3, None), "new_count": number(4, "1")}


def range_overlap(start: Column, end: Column, ranges: Column) -> Column:
    """How many lines of start..end lie in the disjoint ranges (array of struct start, count); none for null."""
    inside = lambda r: F.greatest(F.lit(0), F.least(end, r["start"] + r["count"] - 1) - F.greatest(start, r["start"]) + 1)
    return F.coalesce(F.aggregate(ranges, F.lit(0), lambda n, r: n + inside(r)), F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct ASCII identifiers; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))


def unit_tokens(lines: Column, start: Column, end: Column) -> Column:
    """The token set of the lines start..end (counted from 1) of a file's array of lines."""
    first = F.greatest(start, F.lit(1))
    return token_set(F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "\n"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two sets over all of theirs; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def container(name: Column) -> Column:
    """What stands before the last '::' of a unit's name, else ''."""
    return F.coalesce(F.regexp_extract(name, r"(?s)^(.*)::", 1), F.lit(""))


def unit_cost(wmc_other: Column, cc: Column, dlines: Column) -> Column:
    """max(wmc_other, 1) * cc * dlines in 64 bits."""
    big = lambda c: c.cast("bigint")
    return F.greatest(big(wmc_other), F.lit(1)) * big(cc) * big(dlines)
