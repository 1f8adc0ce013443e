"""Outcomes of tests: facts, summaries, roll-ups, overlaps, domains.

Input is an evaluated sample: ``test``, ``checks``, ``coverage_stats``, ``mutation_scores`` (parallel arrays that may be
null, empty, of unequal length, or hold nulls). Rates are doubles in percent; a rate over nothing is null, unless said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import test_key
from ..functions.text import col


def rate(part: Column, whole: Column, scale: float = 100.0) -> Column:
    return F.try_divide(part.cast("double") * F.lit(scale), whole.cast("double"))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def outcomes(df: DataFrame, path: Column | None = None, name: Column | None = None) -> DataFrame:
    """A row for each check that isn't null, at its own position (PRJ-03): ``position, compiled, passed, invoked, coverage, synthetic``.

    A sample without checks gives one failed row at position 0, marked ``synthetic``. ``passed`` is compiled and tests.
    """
    base = [c for c in df.columns if c not in ("test", "logs", "checks", "coverage_stats", "mutation_scores")]
    some = F.size(F.filter(F.coalesce("checks", F.array()), lambda c: c.isNotNull())) > 0
    present = df.where(flag(some)).select(*base, "coverage_stats", F.posexplode("checks").alias("position", "check")).where("check IS NOT NULL")
    present = present.select(
        *base, "position", flag(F.col("check.compilation")).alias("compiled"), (flag(F.col("check.compilation")) & flag(F.col("check.tests"))).alias("passed"),
        flag(F.col("check.invocation")).alias("invoked"), F.get("coverage_stats", F.col("position"))["line_coverage"].alias("coverage"), F.lit(False).alias("synthetic"),
    )
    absent = df.where(~flag(some)).select(
        *base, F.lit(0).alias("position"), F.lit(False).alias("compiled"), F.lit(False).alias("passed"), F.lit(False).alias("invoked"), F.lit(None).cast("double").alias("coverage"), F.lit(True).alias("synthetic")
    )
    facts = present.unionByName(absent)
    return facts if path is None else facts.withColumn("test_id", test_key(path, name, F.col("position")))


def padded(df: DataFrame) -> DataFrame:
    """A row for each test, with what the parallel arrays have at its position (PRJ-04); without tests one row, ``synthetic``."""
    base = [c for c in df.columns if c not in ("test", "logs", "checks", "coverage_stats", "mutation_scores")]
    n = F.size(F.coalesce("test", F.array().cast("array<string>")))
    at = df.select("*", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("position"))
    take = [F.get(c, F.col("position")).alias(a) for c, a in (("test", "test_code"), ("logs", "log"), ("checks", "check"), ("coverage_stats", "coverage_stat"))]
    return at.select(*base, "position", *take, (n == 0).alias("synthetic"))


def summary(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Evaluation summary (AGG-01): ``total_samples, max_tests, total_slots``, rates over slots, and the mutation block.

    Slots are the samples times the longest test list, so a sample without tests counts with all its slots as failed.
    Coverage adds the covered share of each of the first ``max_tests`` slots; a missing one adds 0. The mutation columns are
    null unless any check has ``mutation``. Two map-side combined aggregations; the arrays never leave their row.
    """
    groups = groups or []
    longest = df.groupBy(*groups).agg(F.coalesce(F.max(F.size(F.coalesce("test", F.array().cast("array<string>")))), F.lit(0)).alias("max_tests"))

    def count(test) -> Column:
        return F.size(F.filter(F.coalesce("checks", F.array()), test))

    def total(array: str, number) -> Column:
        return F.aggregate(F.transform(F.coalesce(array, F.array()), number), F.lit(0.0), lambda a, x: a + x)

    n = F.col("max_tests")
    if groups:
        keys = [df[g].eqNullSafe(F.col(f"__{g}")) for g in groups]
        sliced = df.join(longest.withColumnsRenamed({g: f"__{g}" for g in groups}), reduce(lambda a, b: a & b, keys))
    else:
        sliced = df.withColumn("max_tests", longest.scalar())
    kept = F.slice(F.coalesce("coverage_stats", F.array()), F.lit(1), F.greatest(n, F.lit(0)))
    covered = F.aggregate(
        F.transform(kept, lambda c: F.coalesce(F.try_divide(c["covered_lines"].cast("double"), c["total_lines"].cast("double")), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x
    )
    per_sample = sliced.select(
        *groups, n,
        count(lambda c: flag(c["compilation"])).alias("compiled"), count(lambda c: flag(c["compilation"]) & flag(c["tests"])).alias("passed"), count(lambda c: flag(c["invocation"])).alias("invoked"),
        count(lambda c: flag(c["mutation"])).alias("mutated"), covered.alias("covered"),
        total("mutation_scores", lambda m: F.coalesce(m["killed_count"].cast("double"), F.lit(0.0))).alias("killed"), total("mutation_scores", lambda m: F.coalesce(m["total_count"].cast("double"), F.lit(0.0))).alias("mutants"),
    )
    sums = per_sample.groupBy(*groups).agg(
        F.count("*").alias("total_samples"), F.max("max_tests").alias("max_tests"),
        *[F.sum(c).alias(c) for c in ("compiled", "passed", "invoked", "mutated", "covered", "killed", "mutants")],
    )
    slots = F.col("total_samples") * F.col("max_tests")

    def percent(c: str) -> Column:
        return F.coalesce(rate(F.col(c), slots), F.lit(0.0))

    mutation = F.col("mutated") > 0
    return sums.select(
        *groups, "total_samples", "max_tests", slots.alias("total_slots"), percent("compiled").alias("compiled_rate"), percent("passed").alias("test_pass_rate"),
        percent("invoked").alias("invocation_rate"), percent("covered").alias("line_coverage"),
        F.when(mutation, F.col("mutated")).alias("mutation_run"), F.when(mutation, rate(F.col("mutated"), slots)).alias("mutation_run_rate"), F.when(mutation, F.col("killed").cast("bigint")).alias("killed_mutants"),
        F.when(mutation, F.col("mutants").cast("bigint")).alias("total_mutants"), F.when(mutation, F.coalesce(F.try_divide(F.col("killed"), F.col("mutants")), F.lit(0.0))).alias("mutation_score"),
    )


def pass_rates(facts: DataFrame, groups: list[str], least: int = 0) -> DataFrame:
    """``n_tests, n_passed, pass_rate`` of groups with at least ``least`` rows (AGG-02, FLT-15); the whole is the rows, not slots."""
    out = facts.groupBy(*groups).agg(F.count("*").alias("n_tests"), F.count_if("passed").alias("n_passed"))
    return out.where(F.col("n_tests") >= least).withColumn("pass_rate", rate(F.col("n_passed"), F.col("n_tests")))


def disagreement(facts: DataFrame, groups: list[str]) -> DataFrame:
    """Passing tests that don't invoke the focal function, rolled up over ``groups`` (AGG-03, AGG-04).

    ``level`` is the grouping id: 0 for all groups, then one bit for each that is rolled up. Synthetic rows don't count.
    """
    real = facts.where(~F.col("synthetic"))
    out = real.rollup(*groups).agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n_checks"), F.count_if("passed").alias("tpr_count"), F.count_if(F.col("passed") & ~F.col("invoked")).alias("ir_fail_count")
    )
    return out.select(*groups, "level", "n_checks", "tpr_count", "ir_fail_count", rate(F.col("tpr_count"), F.col("n_checks")).alias("tpr_rate"), rate(F.col("ir_fail_count"), F.col("tpr_count")).alias("disagreement_rate"))


def successes(df: DataFrame, keys: list[str], model: str) -> DataFrame:
    """Distinct (keys, model) with a successful sample (SET-02)."""
    least = F.when(F.lower(F.trim(F.col("language"))) == "ruby", 1).otherwise(0)
    n = F.size(F.coalesce("checks", F.array()))
    at = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: flag(F.get("checks", i)["tests"]) & flag(F.get("coverage_stats", i)["covered_lines"] > least)), lambda x: x)
    return df.where(F.size(at) > 0).select(*keys, F.col(model).alias("model")).distinct()


def venn3(succeeded: DataFrame, keys: list[str], models: tuple[str, str, str]) -> DataFrame:
    """Sizes of the seven regions of three models' successes and of their union (SET-01): one row, one shuffle by key."""
    marks = succeeded.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, 1).otherwise(0)).alias(x) for m, x in zip(models, "abc", strict=True)])

    def region(a: int, b: int, c: int) -> Column:
        return F.count_if((F.col("a") == a) & (F.col("b") == b) & (F.col("c") == c))

    return marks.agg(
        region(1, 0, 0).alias("only_a"), region(0, 1, 0).alias("only_b"), region(0, 0, 1).alias("only_c"), region(1, 1, 0).alias("a_and_b"), region(1, 0, 1).alias("a_and_c"), region(0, 1, 1).alias("b_and_c"),
        region(1, 1, 1).alias("all_three"), F.count_if((F.col("a") + F.col("b") + F.col("c")) > 0).alias("in_any"),
    )


def success_pivot(succeeded: DataFrame, row: str, models: list[str]) -> DataFrame:
    """Successes of each model in a column of its own, by ``row`` (SET-03)."""
    return succeeded.groupBy(row).pivot("model", models).count().na.fill(0)


def domain_rates(df: DataFrame, domains: DataFrame, repo: str, success: Column, model: str) -> DataFrame:
    """Success rates by model and domain (AGG-16, PRJ-06); repositories without a domain are ``Unknown`` and left out.

    The domain of a repository comes by a join on its name; Spark broadcasts it while it is small and else sorts.
    """
    d = domains.select(F.col("repo").alias("__repo"), "domain")
    joined = df.select(F.col(repo).alias("__r"), F.col(model).alias("model"), success.alias("__s")).join(d, F.col("__r") == F.col("__repo"), "left")
    joined = joined.withColumn("domain", F.coalesce("domain", F.lit("Unknown"))).where("domain <> 'Unknown'")
    return joined.groupBy("model", "domain").agg(F.count("*").alias("n"), F.count_if("__s").alias("n_success")).withColumn("success_rate", rate(F.col("n_success"), F.col("n")))


def rollup_counts(df: DataFrame, groups: list[str]) -> DataFrame:
    """Row counts of groups and of all their roll-ups (AGG-19, AGG-22); ``level`` as in ``disagreement``."""
    return df.rollup(*groups).agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"))


def coverage_overview(df: DataFrame, group: str, covered: Column, total: Column) -> DataFrame:
    """Coverage by group (AGG-17, AGG-18): mean, least and largest of the rows' shares, and the share of all lines."""
    share = rate(covered, total)
    return df.groupBy(group).agg(
        F.count(share).alias("n"), F.avg(share).alias("mean_coverage"), F.min(share).alias("least_coverage"), F.max(share).alias("largest_coverage"), rate(F.sum(covered), F.sum(total)).alias("micro_coverage")
    )


def repair_counts(facts: DataFrame, before: str, after: str, groups: list[str]) -> DataFrame:
    """``total, repaired_count`` of samples that failed before and pass after (AGG-24)."""
    return facts.groupBy(*groups).agg(F.count("*").alias("total"), F.count_if(~F.col(before) & F.col(after)).alias("repaired_count"))


def leaders(rates: DataFrame, setting: list[str], model: str, value: str, lower: str, upper: str) -> DataFrame:
    """First model of each setting and whether its interval lies over that of the second (AGG-23)."""
    w = Window.partitionBy(*setting).orderBy(F.col(value).desc(), F.col(model))
    ranked = rates.select("*", F.row_number().over(w).alias("__n"), F.lead(upper).over(w).alias("__next"))
    return ranked.where("__n = 1").select(*setting, model, value, flag(F.col(lower) > F.col("__next")).alias("separated"))


def error_groups(classified: DataFrame, sample: str, category: str, groups: list[str]) -> DataFrame:
    """Samples, tests, errors and error rate by each of ``groups`` on its own, and in all (AGG-07): ``grouping, name, ...``.

    classified: a row for each test, ``category`` null without an error; a null group is ``unknown``. One aggregation
    over grouping sets, pre-aggregated by sample, so that samples are counted without a distinct over all rows.
    """
    named = classified.select(sample, category, *[F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias(g) for g in groups])
    per_sample = named.groupBy(sample, *groups).agg(F.count("*").alias("tests"), F.count(category).alias("errors"))
    single = F.explode(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("name")), *[F.struct(F.lit(g).alias("grouping"), F.col(g).alias("name")) for g in groups]))
    out = per_sample.select("tests", "errors", single.alias("s")).groupBy("s.grouping", "s.name").agg(F.count("*").alias("total_samples"), F.sum("tests").alias("total_tests"), F.sum("errors").alias("total_errors"))
    return out.withColumn("error_rate", F.when(F.col("total_tests") > 0, F.col("total_errors") / F.col("total_tests")).otherwise(0.0))


def report_totals(checks: str | Column, stats: str | Column) -> Column:
    """Totals of a report's rows (AGG-21): ``covered_lines, total_lines, passed, failed, errors``.

    A row that passed counts as passed, one that compiled but didn't pass as failed, any other as an error; nulls count 0.
    """
    c, s = F.coalesce(col(checks), F.array()), F.coalesce(col(stats), F.array())
    count = lambda test: F.size(F.filter(c, test))
    known = lambda x, name: F.coalesce(x[name], F.lit(False))
    total = lambda name: F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[name], F.lit(0)))
    return F.struct(
        total("covered_lines").alias("covered_lines"), total("total_lines").alias("total_lines"), count(lambda x: known(x, "tests")).alias("passed"),
        count(lambda x: known(x, "compilation") & ~known(x, "tests")).alias("failed"), count(lambda x: ~known(x, "compilation") & ~known(x, "tests")).alias("errors"),
    )


def rounded(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Doubles rounded for a report (AGG-05), half to even; other columns stay."""
    return df.select(*[F.bround(c, decimals).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
