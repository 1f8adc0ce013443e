"""Mixtures of sources with target shares of all tokens.

Each source's records are shuffled by a hash and laid end to end; cut into blocks of equal tokens, they queue for the
source's slots. A low-discrepancy sequence (multiples of the golden ratio, modulo 1) is mapped through the cumulative
weights to the source of each slot, so that any stretch of the mixture is close to the targets; the r-th slot of a source
takes its r-th block. A source that is too small starts again, at most ``max_repeats`` times over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_total
from ..session import materialize
from .packing import token_table
from .tokens import TOKENIZER_DIR, TOKENIZER_FILE

#: Tokens in a block.
BLOCK_TOKENS = 4096
#: Rows in a bucket of the running totals.
BUCKET_ROWS = 50_000
GOLDEN = 0.6180339887498949


def source_name(column: str | Column) -> Column:
    """One spelling of a source's name: trimmed, lower case, ``_`` between words."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s-]+", "_")


def quotas(available: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to take from each source.

    available: tokens by source; targets: (share, most repeats) by source. Without ``total`` the mixture is the largest one
    that meets all targets exactly; sources without tokens are left out. With ``total``, sources that can't reach their
    share give all they may, and the others fill up in proportion to their shares.
    """
    most = {s: available.get(s, 0.0) * max(0, repeats) for s, (share, repeats) in targets.items() if share > 0}
    share = {s: targets[s][0] for s, room in most.items() if room > 0}
    if not share:
        return {}
    if total is None:
        whole = sum(share.values())
        size = min(most[s] * whole / share[s] for s in share)
        return {s: size * share[s] / whole for s in share}
    out: dict[str, float] = {}
    left, open_ = min(total, sum(most[s] for s in share)), dict(share)
    while open_:
        whole = sum(open_.values())
        full = [s for s in open_ if most[s] <= left * open_[s] / whole + 1e-9]
        if not full:
            out |= {s: left * open_[s] / whole for s in open_}
            break
        for s in full:
            out[s] = most[s]
            left -= most[s]
            del open_[s]
    return out


def mixture(
    docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, total: float | None = None, block: int = BLOCK_TOKENS,
    folder: str = TOKENIZER_DIR, vocabulary: str = TOKENIZER_FILE, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The mixture: ``slot, source, block_no, position, key, use_no, n_tokens``; ordered by (slot, position) it is the stream.

    targets: ``source, target_share, max_repeats``, a row for each source (a small fixed table, read by the driver). Records
    with null or unknown source (after ``source_name``), without text or without tokens aren't in the mixture; repeated
    texts count as records of their own; other columns are ignored. ``use_no`` counts the uses of a record from 0.

    Nothing holds a source: its records get their positions by two-level running totals over hash buckets, and the slots
    their ranks in the same way over ranges. What comes to the driver is one row for each source.
    """
    wanted = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in targets.select(source_name("source"), "target_share", "max_repeats").collect() if r[0]}
    named = docs.select(F.col(key), F.col(text).alias("__text"), source_name(source).alias("source")).where(F.col("source").isin(list(wanted)) if wanted else F.lit(False))
    sizes = materialize(token_table(named, key, "__text", ["source"], terms=False, folder=folder, vocabulary=vocabulary).where("n_tokens > 0"), "sizes")
    have = {r["source"]: (r["tokens"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    quota = quotas({s: t for s, (t, _) in have.items()}, wanted, total)
    spark = docs.sparkSession
    size = sum(quota.values())
    rows = [(s, float(have[s][0]), float(q)) for s, q in quota.items() if q > 0]
    plan = F.broadcast(spark.createDataFrame(rows or [("", 1.0, 0.0)], "source string, available double, quota double"))  # a row for each source
    largest = max((n for _, n in have.values()), default=1)
    buckets = max(1, math.ceil(largest / bucket_rows))
    shuffled = sizes.withColumn("__h", F.xxhash64(F.lit("mix"), F.col(key).cast("string")))
    placed = running_total(shuffled, "source", F.pmod(F.col("__h"), F.lit(buckets)), ["__h", key], "n_tokens", "__start")
    uses = placed.join(plan, "source").withColumn("use_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("quota") / F.col("available")) - 1, F.lit(0)).cast("int"))))
    uses = uses.withColumn("position", F.col("__start") + F.col("use_no") * F.col("available").cast("bigint")).where(F.col("position") + F.col("n_tokens") / 2 <= F.col("quota"))
    uses = uses.withColumn("block_no", F.floor(F.col("position") / F.lit(block)).cast("bigint"))
    slots = max(1, math.ceil(size / block))
    turn, edge = F.expr(f"(id * {GOLDEN}D + 0.5D) - floor(id * {GOLDEN}D + 0.5D)"), 0.0
    last = max(quota, default="")
    picked: Column = F.when(F.lit(False), last)
    for s, q in sorted(quota.items()):
        edge += q / size
        picked = picked.when(turn < edge, s)
    schedule = spark.range(slots).select(F.col("id").alias("slot"), picked.otherwise(last).alias("source"), F.lit(1).alias("one"))
    ranked = running_total(schedule, "source", F.floor(F.col("slot") / F.lit(bucket_rows)), ["slot"], "one", "block_no")
    ranked = ranked.select("source", F.col("block_no").cast("bigint").alias("block_no"), "slot")
    joined = uses.join(ranked, ["source", "block_no"], "left")
    # the sequence may give a source a slot too few: such a block comes after the last slot
    return joined.select(F.coalesce("slot", F.lit(slots) + F.col("block_no")).alias("slot"), "source", "block_no", "position", key, "use_no", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares really reached: ``source, target_share, max_repeats, n_tokens, n_records, most_uses, share``; a row for each target."""
    own = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_records"), (F.max("use_no") + 1).alias("most_uses"))
    whole = own.agg(F.sum("n_tokens")).scalar()
    wanted = targets.select(source_name("source").alias("source"), "target_share", "max_repeats")
    report = wanted.join(own, "source", "left")
    zero = F.lit(0).cast("bigint")
    return report.select(
        "source", "target_share", "max_repeats", F.coalesce("n_tokens", zero).alias("n_tokens"), F.coalesce("n_records", zero).alias("n_records"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce(F.col("n_tokens") / whole, F.lit(0.0)).alias("share"),
    )
