"""Paths through control-flow graphs given as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import condition_complexity, condition_identifiers, normalised_condition, paren_depth
from ..session import materialize
from .relational import first_wins


def all_paths(edges: DataFrame, graph: str, entry: str = "ENTRY", exit_: str = "EXIT", loop_bound: int = 2) -> DataFrame:
    """Paths from entry to exit of each graph: ``graph, path_no, nodes, conditions, truncated`` (CFG-02).

    edges: the graph's key, ``src``, ``dst``, ``condition`` (null or the branch taken), ``is_back`` (null counts false). A node is
    visited at most ``loop_bound`` times on a path, which ends every path, and back edges are cut. All graphs advance one edge
    at a time in one join on (graph, node), never one graph on one task, until no path is open. The number of paths can grow
    exponentially with the branches; all are given, so ``truncated`` is always false.
    """
    from pyspark.sql import Window

    e = edges.where(~F.coalesce("is_back", F.lit(False))).select(F.col(graph).alias("__g"), F.col("src").alias("__src"), F.col("dst").alias("__dst"), F.col("condition").alias("__c"))
    e = materialize(e, "edges")
    none = F.array().cast("array<string>")
    open_ = e.where(F.col("__src") == entry).select("__g").distinct().select("__g", F.array(F.lit(entry)).alias("nodes"), none.alias("conditions"))
    done, steps = None, 0
    while done is None or not open_.isEmpty():
        step = open_.join(e, (open_["__g"] == e["__g"]) & (F.element_at("nodes", -1) == F.col("__src"))).drop(e["__g"])
        step = step.where(F.size(F.filter("nodes", lambda n: n == F.col("__dst"))) < loop_bound)
        step = step.select("__g", F.concat("nodes", F.array("__dst")).alias("nodes"), F.when(F.col("__c").isNull(), F.col("conditions")).otherwise(F.concat("conditions", F.array("__c"))).alias("conditions"))
        step = materialize(step, "paths")
        ended = step.where(F.element_at("nodes", -1) == exit_)
        done = ended if done is None else done.unionByName(ended)
        steps += 1
        if steps % 50 == 0:  # else the plan grows with the longest path
            done = materialize(done, "paths")
        open_ = step.where(F.element_at("nodes", -1) != exit_)
    number = F.row_number().over(Window.partitionBy("__g").orderBy(F.to_json("nodes"), F.to_json("conditions")))
    return done.select(F.col("__g").alias(graph), number.alias("path_no"), "nodes", "conditions", F.lit(False).alias("truncated"))


def unique_conditions(paths: DataFrame, graph: str) -> DataFrame:
    """Distinct conditions of each graph, normalised, with complexity, depth and identifiers, simplest first (CFG-03, DED-04, SRT-02)."""
    flat = paths.select(graph, "path_no", F.posexplode("conditions").alias("position", "raw")).withColumn("condition", normalised_condition("raw"))
    first = first_wins(flat, [graph, "condition"], [F.col("path_no"), F.col("position")])
    out = first.select(graph, "condition", condition_complexity("condition").alias("complexity"), paren_depth(F.col("condition")).alias("depth"), condition_identifiers("condition").alias("identifiers"))
    return out.orderBy(graph, "complexity", "depth", "condition")


def best_path(paths: DataFrame, graph: str, code_lines: Column) -> DataFrame:
    """Path with the smallest score of each graph, the first one of equals (SRT-04): ten for each condition and one for each line."""
    score = F.size("conditions") * 10 + code_lines
    picked = paths.groupBy(graph).agg(F.min_by(F.struct("path_no", "nodes", "conditions", score.alias("score")), F.struct(score, F.col("path_no"))).alias("p"))
    return picked.select(graph, "p.*")
