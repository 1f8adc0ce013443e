"""Statistics to compare models: bootstrap intervals, McNemar tests, correlations, index quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of the rational approximation 7.1.26 of the error function (Abramowitz and Stegun).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to 1.5e-7."""
    t = 1.0 / (1.0 + ERF_P * x)
    poly = t * (ERF_A[0] + t * (ERF_A[1] + t * (ERF_A[2] + t * (ERF_A[3] + t * ERF_A[4]))))
    return poly * F.exp(-x * x)


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """Continuity-corrected statistic and p-value of b and c discordant pairs (AGG-15); 0 and 1 if there are none."""
    n = b + c
    chi = F.when(n > 0, F.pow(F.abs(b - c) - 1, F.lit(2)) / n).otherwise(0.0)
    return chi, F.when(n > 0, erfc(F.sqrt(chi / 2))).otherwise(1.0)


def contingency(a: DataFrame, b: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """Agreement of two outcomes (``passed``) over the keys that both have, with the test (AGG-15, JON-05).

    Keys must be unique in each (``operators.relational.last_wins``). One co-partitioned join; counts combine map-side.
    """
    left = a.select(*groups, *keys, F.col("passed").alias("__a"))
    right = b.select(*groups, *keys, F.col("passed").alias("__b"))
    x, y = F.col("__a"), F.col("__b")
    counts = left.join(right, [*groups, *keys]).groupBy(*groups).agg(
        F.count("*").alias("n_aligned"), F.count_if(x & y).alias("both_pass"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("both_fail")
    )
    chi, p = mcnemar(F.col("only_a"), F.col("only_b"))
    return counts.select("*", chi.alias("chi2"), p.alias("p_value"))


def significant(tests: DataFrame, n_pairs: int, alpha: float = 0.05) -> DataFrame:
    """Bonferroni: significant below ``alpha / n_pairs``; pairs are counted before any is left out (AGG-15)."""
    level = alpha / max(1, n_pairs)
    return tests.withColumn("alpha", F.lit(level)).withColumn("significant", F.col("p_value") < level)


def bootstrap(rates: DataFrame, groups: list[str], total: str, passed: str, iterations: int = 10_000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Percentile intervals of pass rates (AGG-13, AGG-14): ``mean, std, cv, ci_lower, ci_upper, unstable``.

    The number of passes in a resample of n outcomes is binomial with their rate, so a group needs its two counts only, not
    its rows. Each group draws from a generator seeded by ``seed`` and its own name: the same numbers under any
    partitioning. Groups without tests give nulls. ``unstable`` is a cv over 0.5; the cv at mean 0 is infinite.
    """
    fields = [f"{g} {rates.schema[g].dataType.simpleString()}" for g in groups]
    low, high = 50 * (1 - confidence), 50 * (1 + confidence)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                names, n, k = row[: len(groups)], row[-2], row[-1]
                if not n:
                    rows.append((*names, None, None, None, None, None, None))
                    continue
                rng = np.random.default_rng([seed, zlib.crc32("\x1f".join(map(str, names)).encode())])
                x = rng.binomial(int(n), k / n, iterations) * (100.0 / n)
                mean, std = float(x.mean()), float(x.std(ddof=1)) if iterations > 1 else 0.0
                cv = std / mean if mean else float("inf")
                rows.append((*names, mean, std, cv, float(np.percentile(x, low)), float(np.percentile(x, high)), cv > 0.5))
            yield pd.DataFrame(rows, columns=[*groups, "mean", "std", "cv", "ci_lower", "ci_upper", "unstable"])

    schema = ", ".join([*fields, "mean double, std double, cv double, ci_lower double, ci_upper double, unstable boolean"])
    return rates.select(*groups, total, passed).mapInPandas(run, schema)


def pearson(df: DataFrame, x: str, y: str) -> Column:
    """Correlation of two columns over the rows that have both; null where one doesn't vary (AGG-11)."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)).cast("double"), F.when(F.col(x).isNotNull(), F.col(y)).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def pearson_matrix(df: DataFrame, metrics: list[str]) -> DataFrame:
    """All pairs of metrics in rows ``metric_a, metric_b, r``: one aggregation for all of them (AGG-11)."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i:]]
    one = df.agg(*[pearson(df, a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def average_rank(c: str) -> Column:
    """Rank with ties at their mean. Over a whole column: for small tables, such as one row a model."""
    w = Window.orderBy(c)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of a small table (AGG-12): one row ``rho``."""
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = clean.select(average_rank(x).alias("a"), average_rank(y).alias("b"))
    return ranks.agg(pearson(ranks, "a", "b").alias("rho"))


def kendall(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Kendall's tau-b of a small table such as one row a model (AGG-12): one row ``tau``; pairs are formed by ``key`` order."""
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    a, b = clean.alias("a"), clean.alias("b")
    sx, sy = F.signum(F.col("a.x") - F.col("b.x")), F.signum(F.col("a.y") - F.col("b.y"))
    s = a.join(b, F.col("a.k") < F.col("b.k")).select(sx.alias("sx"), sy.alias("sy"))
    n1, n2 = F.sum(F.abs("sx")), F.sum(F.abs("sy"))
    return s.agg(F.when((n1 > 0) & (n2 > 0), F.sum(F.col("sx") * F.col("sy")) / F.sqrt(n1 * n2)).alias("tau"))


def index_quantiles(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Mean, least, largest, and the elements at n // 4, n // 2 and 3n // 4 of the sorted values (AGG-09); nulls don't count.

    Values are ranked in a window by group and value; only the three elements leave it.
    """
    w = Window.partitionBy(*groups)
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("v"))
    ranked = rows.select(*groups, "v", (F.row_number().over(w.orderBy("v")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    i, n = F.col("i"), F.col("n")

    def at(position: Column) -> Column:
        return F.max(F.when(i == position, F.col("v")))

    return ranked.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("largest"),
        at(F.floor(n / 4)).alias("p25"), at(F.floor(n / 2)).alias("median"), at(F.floor(n * 3 / 4)).alias("p75"),
    )
