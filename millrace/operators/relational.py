"""Deduplication, resume, lookups, top-k: what dictionaries and loops do elsewhere, as joins and windows.

"First" and "last" need an order; every function takes columns that make it total, so that results don't depend on
partitioning. Rows are never collected. Where one key may hold a third of all rows, the winner is found by a map-side
combined ``max_by`` of a struct instead of a sort of the key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import record_succeeded, task_key, task_number


def _winner(df: DataFrame, keys: list[str], order: list[Column], last: bool) -> DataFrame:
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    pick = (F.max_by if last else F.min_by)(row, rank)
    return df.groupBy(*keys).agg(pick.alias("__row")).select("__row.*")


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by ``order`` (DED-01, JON-03, JON-05). Null keys are a key."""
    return _winner(df, keys, order, True)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by ``order`` (DED-03, DED-04, JON-01). Null keys are a key."""
    return _winner(df, keys, order, False)


def dedupe_tasks(df: DataFrame, task_id: str, order: list[Column]) -> DataFrame:
    """Last record of each task id; records without one (null, blank, ``unknown``) all stay (DED-01).

    ``007`` and ``7`` are one id. Sort the result with ``functions.records.task_order`` where order matters.
    """
    key = df.withColumn("__key", task_key(task_id))
    known = last_wins(key.where("__key <> 'unknown'"), ["__key"], order)
    return known.unionByName(key.where("__key = 'unknown'")).drop("__key")


def dedupe_tasks_or_functions(df: DataFrame, task_id: str, path: str, name: str, order: list[Column]) -> DataFrame:
    """Last record by task id, else by (path, name); records with neither all stay (DED-02)."""
    id_key = F.when(task_key(task_id) != "unknown", F.concat(F.lit("id:"), task_key(task_id)))
    name_key = F.when(F.col(path).isNotNull() & F.col(name).isNotNull(), F.concat(F.lit("fn:"), F.col(path), F.lit("\x00"), F.col(name)))
    key = df.withColumn("__key", F.coalesce(id_key, name_key))
    return last_wins(key.where("__key IS NOT NULL"), ["__key"], order).unionByName(key.where("__key IS NULL")).drop("__key")


def remaining(inputs: DataFrame, outputs: DataFrame, task_id: str, done: Column | None = None) -> DataFrame:
    """Inputs whose normalised id isn't among the done outputs (JON-08, JON-09); ids that are unknown are never done."""
    made = outputs if done is None else outputs.where(done)
    made = made.select(task_key(task_id).alias("__done")).where("__done <> 'unknown'").distinct()
    return inputs.join(made, task_key(inputs[task_id]) == F.col("__done"), "left_anti")


def successful(df: DataFrame, status: str, response: str) -> DataFrame:
    """Records that count as done when a run resumes (DED-05)."""
    return df.where(record_succeeded(status, response))


def responses_with_base(responses: DataFrame, base: DataFrame, task_id: str, order: list[Column], base_order: list[Column], columns: list[str]) -> DataFrame:
    """Inner join of responses and base records on the numeric id (JON-01): the first response, the last base record."""
    r = first_wins(responses.withColumn("__id", task_number(task_id)).where("__id IS NOT NULL"), ["__id"], order)
    b = last_wins(base.withColumn("__id", task_number(task_id)).where("__id IS NOT NULL"), ["__id"], base_order)
    return r.join(b.select("__id", *columns), "__id").drop("__id")


def side_or_base(base: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base records with their columns replaced by those of the side record, as a whole, where there is one (JON-02)."""
    s = side.select(F.col(key).alias("__key"), F.struct(*columns).alias("__side"))
    b = base.join(s, F.col(key) == F.col("__key"), "left")
    return b.select(key, F.coalesce("__side", F.struct(*columns)).alias("__all"), F.col("__side").isNotNull().alias("from_side")).select(key, "__all.*", "from_side")


def restrict(df: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the subset (JON-10)."""
    return df.join(subset.select(key).distinct(), key, "left_semi")


def missing(subset: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Keys of the subset that the table lacks (JON-10, JON-11)."""
    return subset.select(key).distinct().join(df.select(key), key, "left_anti")


def top_k(df: DataFrame, group: str, order: list[Column], k: int, into: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group by a total order, numbered from 1 (TOP-01 to TOP-08).

    Spark cuts each sorted partition at ``k`` before the shuffle (window group limit), so a hot group moves k rows a task.
    """
    return df.withColumn(into, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(into) <= k)


def ranked_pairs(df: DataFrame, group: list[str], rank: str, key: str, most: int) -> DataFrame:
    """Pairs (a before b) of the first ``most`` keys of each group (JON-06): at most ``most * (most - 1) / 2`` of them."""
    top = df.where(F.col(rank) <= most)
    a = top.select(*group, F.col(rank).alias("__ra"), F.col(key).alias("a"))
    b = top.select(*group, F.col(rank).alias("__rb"), F.col(key).alias("b"))
    return a.join(b, group).where("__ra < __rb").select(*group, "a", "b")


def stratified(df: DataFrame, strata: list[str], key: str, per_stratum: int, seed: int) -> DataFrame:
    """``per_stratum`` keys of each stratum, chosen by a seeded hash (SMP-01): the same rows under any partitioning."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    n = F.row_number().over(Window.partitionBy(*strata).orderBy(draw, key))
    return df.withColumn("draw_no", n).where(F.col("draw_no") <= per_stratum)
