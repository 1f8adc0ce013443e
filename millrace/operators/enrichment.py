"""Lookups and reports around samples: logs, external scores, examples, availability, syntax nodes, model inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import top_k


def with_logs(errors: DataFrame, samples: DataFrame, key: str, position: str, own_log: str, into: str = "log") -> DataFrame:
    """Errors with their log (JON-04): the own one, else the one at the error's position in the sample's logs."""
    logs = samples.select(F.col(key).alias("__k"), F.col("logs").alias("__logs"))
    joined = errors.join(logs, F.col(key) == F.col("__k"), "left")
    return joined.withColumn(into, F.coalesce(F.nullif(F.col(own_log), F.lit("")), F.get("__logs", F.col(position)))).drop("__k", "__logs")


def with_scores(rates: DataFrame, scores: DataFrame, model: str, score: str) -> DataFrame:
    """Models that have an external score, best first (FLT-14)."""
    return rates.join(scores.where(F.col(score).isNotNull()).select(model, score), model).orderBy(F.col(score).desc(), model)


def mean_over_groups(rates: DataFrame, by: str, over: str, metrics: list[str]) -> DataFrame:
    """Unweighted means of group rates, and how many groups they are of (AGG-10)."""
    return rates.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics], F.countDistinct(over).cast("bigint").alias(f"n_{over}"))


def examples(df: DataFrame, group: str, order: list[Column], text: dict[str, int], k: int = 5) -> DataFrame:
    """Rows of each group with the first ``k`` of them as examples, texts cut to lengths (AGG-08): ``group, n, examples``."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    first = top_k(df, group, order, k, "__n")
    row = F.struct("__n", *[F.substring(F.coalesce(F.col(c), F.lit("")), 1, n).alias(c) for c, n in text.items()])
    listed = first.groupBy(F.col(group).alias("__g")).agg(F.array_sort(F.collect_list(row)).alias("examples"))
    return counts.join(listed, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def availability(df: DataFrame, repo: str, passed: Column) -> DataFrame:
    """Easy and hard samples of each repository (AGG-25, JON-12): ``repo, easy, hard``."""
    return df.groupBy(repo).agg(F.count_if(passed).alias("easy"), F.count_if(~passed).alias("hard"))


def having_node(df: DataFrame, nodes: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """Rows that have a syntax node of one of these kinds in a given table ``key, kind`` (FLT-03, INV-01)."""
    return df.join(nodes.where(F.col("kind").isin(kinds)).select(key).distinct(), key, "left_semi")


def kept_share(before: Column, after: Column) -> Column:
    """Percent of tokens that a filter removed (ENR-01); 0 of none."""
    return F.coalesce(F.try_divide((F.size(before) - F.size(after)) * F.lit(100.0), F.size(before).cast("double")), F.lit(0.0))


def inferred(df: DataFrame, inputs: list[str], schema: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], dedupe: bool = True) -> DataFrame:
    """Rows of a model for distinct inputs (RET-03, PPL-01, AST-01, INC-04): the model is loaded once a task, batches stream through it.

    load: returns batch -> batch with the columns of ``schema``, among them the inputs to join by.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    source = df.select(*inputs)
    return (source.dropDuplicates(inputs) if dedupe else source).mapInPandas(run, schema)
