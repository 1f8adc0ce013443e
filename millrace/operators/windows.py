"""Sliding windows of lines over source files, and filters on them.

A window is ``context`` with ``line_no`` (its centre), ``start_line_no`` and ``end_line_no`` (0-based, end exclusive). Null
contents have no windows; an empty file has none; windows of white space only are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, splitlines


def line_windows(df: DataFrame, content: str | Column, window: int = 20, slices: int = 2, keep: list[str] | None = None, lines: Column | None = None) -> DataFrame:
    """Windows of every file, centred on each ``window // slices``-th line (WIN-01)."""
    step = max(1, window // slices)
    keep = keep if keep is not None else df.columns
    source = df.select(*keep, (lines if lines is not None else splitlines(content)).alias("__lines")).where(F.size("__lines") > 0)
    n = F.size("__lines")
    at = source.select("*", F.explode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("line_no"))
    start, end = F.greatest(F.lit(0), F.col("line_no") - window // 2), F.least(n, F.col("line_no") + window - window // 2)
    out = at.select(*keep, "line_no", start.alias("start_line_no"), end.alias("end_line_no"), F.array_join(F.slice("__lines", start + 1, end - start), "\n").alias("context"))
    return out.where(F.trim(F.regexp_replace("context", r"\s", "")) != "")


def without_range(content: str | Column, start: Column, end: Column) -> Column:
    """Lines of a file without those of the half-open 0-based range (WIN-03)."""
    lines = splitlines(content)
    n = F.size(lines)
    a, b = F.least(F.greatest(start, F.lit(0)), n), F.least(F.greatest(end, F.lit(0)), n)
    return F.concat(F.slice(lines, 1, a), F.slice(lines, F.greatest(a, b) + 1, n))


def without_file(files: DataFrame, excluded: DataFrame, repo: str, path: str, column: str) -> DataFrame:
    """Files of each repository but for the one that ``excluded`` (a row a repository) names for it (WIN-04), before they are windowed.

    Repositories without a row keep all files; null repositories and paths are kept.
    """
    gone = excluded.select(F.col(repo).alias("__repo"), F.col(column).alias("__path"))
    return files.join(gone, F.col(repo).eqNullSafe(F.col("__repo")) & (F.col(path) == F.col("__path")), "left_anti")


def merge_windows(windows: DataFrame, group: str, path: str, order: list[str]) -> DataFrame:
    """Windows of a group with the same text as one, with their places in order (WIN-02).

    Groups are (group, hash of the text), so a big repository is no hot group; the places of one text are held together,
    as the reference's metadata list is.
    """
    place = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(path).alias("path"), "line_no", "start_line_no", "end_line_no")
    merged = windows.groupBy(group, "context").agg(F.array_sort(F.collect_list(place)).alias("places"))
    return merged.select(group, "context", F.transform("places", lambda p: F.struct(p["path"].alias("path"), p["line_no"].alias("line_no"), p["start_line_no"].alias("start_line_no"), p["end_line_no"].alias("end_line_no"))).alias("places"))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two inclusive ranges of lines meet (FLT-09)."""
    return ~((e1 < s2) | (e2 < s1))


def outside_focal(places: str | Column, path: Column, start: Column, end: Column) -> Column:
    """Places of a window but for those in the focal file that meet the focal range (FLT-07); keep the window if any is left."""
    return F.filter(col(places), lambda p: (p["path"] != path) | ~overlap(p["start_line_no"], p["end_line_no"], start, end))


def touches_focal(places: str | Column, path: Column, start: Column, end: Column) -> Column:
    """Whether any place of a window meets the focal range in the focal file (FLT-08)."""
    return F.exists(col(places), lambda p: (p["path"] == path) & overlap(p["start_line_no"], p["end_line_no"], start, end))


def imported_only(places: str | Column, path: Column, imports: Column) -> Column:
    """Places of a window in files that the focal one imports (FLT-06); all other files if it imports nothing."""
    return F.filter(col(places), lambda p: (p["path"] != path) & (F.coalesce(F.size(imports) <= 0, F.lit(True)) | F.array_contains(imports, p["path"])))
