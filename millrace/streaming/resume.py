"""Append, resume, compact: incremental runs on Structured Streaming (INC-01), and repair rounds (INC-02).

Event-time windows are no part of this: the records have no event time to go by. Progress is kept by the checkpoint of the
query, and by the ids of the output, so a lost executor or a restarted driver repeats no finished record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.records import task_key
from ..operators.relational import dedupe_tasks, remaining


def resumable(
    spark: SparkSession, source: str, schema: str, output: str, checkpoint: str, task_id: str, process: Callable[[DataFrame], DataFrame], done: Column | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Process each new input file once and append its records as JSON; ids that the output has already are skipped.

    process: input rows -> output rows with ``task_id``. done: which output rows count as finished (all by default). A
    batch that is repeated after a failure writes to its own folder again instead of beside it.
    """

    def batch(df: DataFrame, number: int) -> None:
        try:
            made = spark.read.option("recursiveFileLookup", "true").json(output)
            made = made if task_id in made.columns else None
        except Exception as e:  # no output yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            made = None
        todo = df if made is None else remaining(df, made, task_id, done)
        process(todo).write.mode("overwrite").json(f"{output}/batch={number}")

    writer = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def compacted(appended: DataFrame, task_id: str, order: list[Column]) -> DataFrame:
    """The appended records, the last one of each id."""
    return dedupe_tasks(appended, task_id, order)


def repair_rounds(first: DataFrame, rounds: int, task_id: str, passed: Column, repair: Callable[[DataFrame, int], DataFrame], keep: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Rounds of repair (INC-02): each takes the failing rows of the one before; passing rows are copied through.

    repair: failing rows, round -> rows of the same schema; keep: makes a round's table durable (such as ``materialize``).
    Column ``attempt`` is the last round that changed a row.
    """
    current = first.withColumn("attempt", F.lit(0))
    for n in range(1, rounds + 1):
        failing = current.where(~F.coalesce(passed, F.lit(False)))
        fixed = repair(failing.drop("attempt"), n).withColumn("attempt", F.lit(n))
        current = keep(current.where(F.coalesce(passed, F.lit(False))).unionByName(fixed), n)
    return current


def latest_attempt(attempts: DataFrame, task_id: str) -> DataFrame:
    """The row of the last attempt of each id."""
    row = F.struct(*attempts.columns)
    return attempts.groupBy(task_key(task_id).alias("__k")).agg(F.max_by(row, F.col("attempt")).alias("r")).select("r.*")
