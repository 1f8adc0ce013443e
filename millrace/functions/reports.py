"""Coverage and mutation reports as Column expressions: text in, ``(covered_lines, total_lines)`` or counts out.

Malformed parts of a report are skipped; a null or broken report gives 0 of 0. A line is counted once, and as covered if
any entry covers it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _tail(path: Column, n: int) -> Column:
    """The last n segments of a path."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    return F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n)


def _stats(numbers: Column) -> Column:
    """Statistics of an array of (line, hits)."""
    total = F.array_distinct(F.transform(numbers, lambda x: x["line"]))
    covered = F.array_distinct(F.transform(F.filter(numbers, lambda x: x["hits"] > 0), lambda x: x["line"]))
    return F.struct(F.coalesce(F.size(covered), F.lit(0)).alias("covered_lines"), F.coalesce(F.size(total), F.lit(0)).alias("total_lines"))


def _lines_of(blocks: Column) -> Column:
    """(line, hits) of every line of blocks (first, last, hits) that has a first line up to its last."""
    some = F.filter(blocks, lambda b: b["first"] <= b["last"])
    return F.flatten(F.transform(some, lambda b: F.transform(F.sequence(b["first"], b["last"]), lambda n: F.struct(n.alias("line"), b["hits"].alias("hits")))))


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def go_profile(report: str | Column, path: str | Column, first: Column, last: Column) -> Column:
    """Lines of a focal range in a Go cover profile (CV-01): of entries whose file holds the last two parts of the path."""
    entry = r"^(\S+?):(\d+)\.\d+,(\d+)\.\d+\s+\S+\s+(-?\d+)\s*$"
    wanted = F.array_join(_tail(col(path), 2), "/")
    entries = F.filter(F.split(F.coalesce(col(report), F.lit("")), "\n", -1), lambda s: s.rlike(entry) & F.contains(F.regexp_extract(s, entry, 1), wanted))
    blocks = F.transform(entries, lambda s: F.struct(F.greatest(_number(s, entry, 2), first).alias("first"), F.least(_number(s, entry, 3), last).alias("last"), _number(s, entry, 4).alias("hits")))
    return _stats(_lines_of(blocks))


def go_branches(report: str | Column, first: Column, last: Column) -> Column:
    """(covered_branches, total_branches) of conditions in the focal range (CV-02): counted both ways, never, or one way."""
    at, counted = r"^.+?:(\d+):\d+: condition", r"condition .*? (\d+) times true.*?(\d+) times false"
    known = F.filter(
        F.split(F.coalesce(col(report), F.lit("")), r"\r?\n", -1),
        lambda s: _number(s, at, 1).between(first, last) & s.rlike(rf"{counted}|was never evaluated|was once true but never false|was once false but never true"),
    )

    def covered(s: Column) -> Column:
        both = (_number(s, counted, 1) > 0).cast("int") + (_number(s, counted, 2) > 0).cast("int")
        return F.when(s.rlike(counted), both).when(F.contains(s, F.lit("was never evaluated")), 0).otherwise(1)

    return F.struct(F.aggregate(F.transform(known, covered), F.lit(0), lambda a, x: a + x).alias("covered_branches"), (F.size(known) * 2).alias("total_branches"))


def llvm_file(files: Column, path: str | Column) -> Column:
    """The file of an LLVM report that is the focal one (CV-04); null if none is.

    The first file that is equal, ends the other's path, or holds its last two parts; else the last with its base name.
    """
    focal = F.replace(col(path), F.lit("\\"), F.lit("/"))
    two = _tail(focal, 2)

    def name(f: Column) -> Column:
        return F.replace(f["filename"], F.lit("\\"), F.lit("/"))

    def strong(f: Column) -> Column:
        n = name(f)
        return (n == focal) | F.endswith(n, focal) | F.endswith(focal, n) | ((F.size(two) >= 2) & F.contains(n, F.array_join(two, "/")))

    def weak(f: Column) -> Column:
        return F.element_at(F.split(name(f), "/", -1), -1) == F.element_at(F.split(focal, "/", -1), -1)

    return F.coalesce(F.get(F.filter(files, strong), F.lit(0)), F.element_at(F.concat(F.array(F.get(files, F.lit(-1))), F.filter(files, weak)), -1))


def llvm_segments(segments: Column, first: Column, last: Column) -> Column:
    """(covered_lines, total_lines, line_coverage) of LLVM segments ``array<array<int>>`` (CV-03).

    A segment holds from its line to that before the next one in order of (line, column); one without a count is left
    out, with three elements it has one.
    """
    ordered = F.array_sort(F.transform(F.coalesce(segments, F.array().cast("array<array<int>>")), lambda s: F.struct(s[0].alias("line"), s[1].alias("at"), s[2].alias("hits"), F.coalesce(F.get(s, F.lit(3)), F.lit(1)).alias("counted"))))
    blocks = F.transform(
        ordered,
        lambda s, i: F.struct(F.greatest(s["line"], first).alias("first"), F.least(F.coalesce(F.get(ordered, i + 1)["line"] - 1, last), last).alias("last"), s["hits"].alias("hits"), s["counted"].alias("counted")),
    )
    stats = _stats(_lines_of(F.filter(blocks, lambda b: b["counted"] != 0)))
    rate = F.when(stats["total_lines"] > 0, F.bround(stats["covered_lines"] * F.lit(100.0) / stats["total_lines"], 2)).otherwise(0.0)
    return F.struct(stats["covered_lines"].alias("covered_lines"), stats["total_lines"].alias("total_lines"), rate.alias("line_coverage"))


def _loose(name: Column, path: Column) -> Column:
    """Whether a file's name holds any of the last two parts of a path."""
    return F.exists(_tail(path, 2), lambda p: F.contains(F.replace(name, F.lit("\\"), F.lit("/")), p))


def clover(report: str | Column, path: str | Column, first: Column, last: Column) -> Column:
    """Statement lines of a focal range in a Clover XML report (CV-05)."""
    file = r'(?s)<file\b[^>]*\bname="([^"]*)"[^>]*>(.*?)</file>'
    broken = ~col(report).rlike(r"(?s)^\s*<.*>\s*$") | (F.size(F.regexp_extract_all(col(report), F.lit(r"<file\b[^>]*[^/>]>"), F.lit(0))) != F.size(F.regexp_extract_all(col(report), F.lit("</file>"), F.lit(0))))
    files = F.filter(F.regexp_extract_all(col(report), F.lit(file), F.lit(0)), lambda f: _loose(F.regexp_extract(f, file, 1), col(path)))
    tags = F.flatten(F.transform(files, lambda f: F.regexp_extract_all(f, F.lit(r"<line\b[^>]*>"), F.lit(0))))
    statements = F.filter(tags, lambda t: t.rlike(r'\btype="stmt"'))
    found = F.transform(statements, lambda t: F.struct(_number(t, r'\bnum="([^"]*)"', 1).alias("line"), F.coalesce(_number(t, r'\bcount="([^"]*)"', 1), F.lit(0)).alias("hits")))
    return F.when(col(report).isNull() | broken, F.struct(F.lit(0).alias("covered_lines"), F.lit(0).alias("total_lines"))).otherwise(_stats(F.filter(found, lambda x: x["line"].between(first, last))))


SIMPLECOV = "map<string, struct<coverage: map<string, array<int>>>>"


def simplecov(report: str | Column, path: str | Column, first: Column, last: Column) -> Column:
    """Lines of a focal range in a SimpleCov JSON report (CV-06); null hits are lines that can't be run."""
    suites = F.map_values(F.from_json(col(report), SIMPLECOV))
    entries = F.flatten(F.transform(suites, lambda s: F.map_entries(s["coverage"])))
    own = F.filter(entries, lambda e: _loose(e["key"], col(path)))
    found = F.flatten(F.transform(own, lambda e: F.transform(e["value"], lambda hits, i: F.struct((i + 1).alias("line"), hits.alias("hits")))))
    return _stats(F.filter(found, lambda x: x["hits"].isNotNull() & x["line"].between(first, last)))


def percent_text(report: str | Column, first: Column, last: Column) -> Column:
    """Coverage from the first percentage of a text (CV-07): the focal lines times it, cut to whole lines; none gives 0 of 0."""
    share = F.regexp_extract(col(report), r"(\d+(?:\.\d+)?)%", 1).try_cast("double")
    n = last - first + 1
    return F.when(share.isNull(), F.struct(F.lit(0).alias("covered_lines"), F.lit(0).alias("total_lines"))).otherwise(F.struct(F.floor(n * share / 100).cast("int").alias("covered_lines"), n.cast("int").alias("total_lines")))


def _mutation(killed: Column, total: Column, score: Column) -> Column:
    return F.struct(killed.cast("int").alias("killed_count"), total.cast("int").alias("total_count"), score.cast("double").alias("mutation_score"))


def go_mutation(log: str | Column) -> Column:
    """Go mutation result (MU-01): the summary line, else PASS (killed) and FAIL (escaped) lines."""
    s = r"The mutation score is ([\d.]+) \((\d+) killed, (\d+) escaped, (\d+) skipped, total is (\d+)\)"
    log = F.coalesce(col(log), F.lit(""))
    passed, failed = F.regexp_count(log, F.lit(r"(?m)^PASS\s")), F.regexp_count(log, F.lit(r"(?m)^FAIL\s"))
    by_lines = _mutation(passed, passed + failed, F.coalesce(F.try_divide(passed, passed + failed), F.lit(0.0)))
    return F.when(log.rlike(s), _mutation(_number(log, s, 2), _number(log, s, 5), F.regexp_extract(log, s, 1).try_cast("double"))).otherwise(by_lines)


def rust_mutation(log: str | Column) -> Column:
    """Rust mutation result (MU-02): caught of caught, missed and timed out; JSON outcomes or the text summary."""
    log = F.coalesce(col(log), F.lit(""))
    outcomes = F.from_json(log, "array<struct<outcome: string>>")

    def counted(json: str, word: str) -> Column:
        listed = F.size(F.filter(outcomes, lambda o: o["outcome"] == json))
        return F.when(F.startswith(F.trim(log), F.lit("[")), F.greatest(listed, F.lit(0))).otherwise(F.coalesce(_number(log, rf"(\d+) {word}", 1), F.lit(0)))

    killed, escaped, timeout, unviable = counted("caught", "caught"), counted("missed", "missed"), counted("timeout", "timeouts?"), counted("unviable", "unviable")
    tested = killed + escaped + timeout
    return _mutation(killed, tested + unviable, F.when(tested > 0, F.bround(killed / tested, 4)).otherwise(0.0))


def ruby_mutation(log: str | Column) -> Column:
    """Ruby mutation result (MU-03): kills of mutations."""
    killed, total = (F.coalesce(_number(F.coalesce(col(log), F.lit("")), rf"{w}\s*:\s*(\d+)", 1), F.lit(0)) for w in ("Kills", "Mutations"))
    return _mutation(killed, total, F.when(total > 0, killed / total).otherwise(0.0))


def php_mutation(statuses: Column) -> Column:
    """PHP mutation result from an array of statuses (MU-04): killed, timed out and errors, of all that are covered."""

    def count(*names: str) -> Column:
        return F.size(F.filter(statuses, lambda s: s.isin(*names)))

    killed, errors, open_ = count("Killed", "Timeout"), count("Error"), count("Not Covered")
    covered = F.size(statuses) - open_
    return _mutation(killed, F.size(statuses), F.when(covered > 0, F.bround((killed + errors) / covered, 2)).otherwise(0.0))
