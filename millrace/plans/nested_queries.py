"""Queries of the nested-record operator (problem 2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shredding import child_table, shredded_children
from ..session import table


def p2_children(spark: SparkSession, sf: str) -> DataFrame:
    """All children of the raw lines, with the path of their parent."""
    return shredded_children(table(spark, sf, "detailed_results_raw"), "raw_id", "json_line")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_children(spark, sf).select("raw_id", "node_path").distinct()


def _results(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return shredded_children(table(spark, sf, "detailed_results"), "result_id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def p2_checks(spark: SparkSession, sf: str) -> DataFrame:
    kinds = dict.fromkeys(("compilation", "tests", "coverage", "invocation", "mutation"), "boolean")
    return child_table(_results(spark, sf, "checks"), "checks", "result_id", kinds).drop("node_path", "parent_path")


def p2_coverage_stats(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"covered_lines": "int", "total_lines": "int", "line_coverage": "double"}
    return child_table(_results(spark, sf, "coverage_stats"), "coverage_stats", "result_id", kinds).drop("node_path", "parent_path")


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    record = F.to_json(F.struct("function_component", "metadata"), {"ignoreNullFields": "false"})
    return shredded_children(table(spark, sf, "function_metadata"), "record_id", record)


def p2_arguments(spark: SparkSession, sf: str) -> DataFrame:
    return child_table(_functions(spark, sf), "arguments", "record_id", {"name": "string", "type": "string"}).drop("node_path", "parent_path")


def p2_definitions(spark: SparkSession, sf: str) -> DataFrame:
    t = child_table(_functions(spark, sf), "definitions", "record_id", {"type_name": "string", "definition": "string", "location": "string"})
    argument = F.regexp_extract("parent_path", r"\[(\d+)\]$", 1).cast("int")
    return t.select("record_id", argument.alias("argument_position"), "position", "type_name", "definition", "location")


def p2_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).where("node_table = 'metadata'").select("record_id", F.col("position").alias("name"), F.col("attributes")["value"].alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p2_found, p2_children, p2_checks, p2_coverage_stats, p2_arguments, p2_definitions, p2_metadata)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    at = "unnest(generate_series(0, len({0}) - 1))"
    return {
        "p2_checks": f"""
            WITH e AS (SELECT result_id, {at.format("checks")} AS position, checks FROM detailed_results)
            SELECT result_id, CAST(position AS INTEGER) AS position, c.compilation, c.tests, c.coverage, c.invocation, c.mutation
            FROM (SELECT result_id, position, checks[position + 1] AS c FROM e) WHERE c IS NOT NULL""",
        "p2_coverage_stats": f"""
            WITH e AS (SELECT result_id, {at.format("coverage_stats")} AS position, coverage_stats FROM detailed_results)
            SELECT result_id, CAST(position AS INTEGER) AS position, c.covered_lines, c.total_lines, c.line_coverage
            FROM (SELECT result_id, position, coverage_stats[position + 1] AS c FROM e) WHERE c IS NOT NULL""",
        "p2_arguments": f"""
            WITH a AS (SELECT record_id, function_component.argument_definitions_lsp AS args FROM function_metadata),
            e AS (SELECT record_id, {at.format("args")} AS position, args FROM a)
            SELECT record_id, CAST(position AS INTEGER) AS position, x.name, x.type
            FROM (SELECT record_id, position, args[position + 1] AS x FROM e) WHERE x IS NOT NULL""",
        "p2_definitions": f"""
            WITH a AS (SELECT record_id, function_component.argument_definitions_lsp AS args FROM function_metadata),
            e AS (SELECT record_id, {at.format("args")} AS p, args FROM a),
            d AS (SELECT record_id, p, args[p + 1].definitions AS defs FROM e),
            f AS (SELECT record_id, p, {at.format("defs")} AS q, defs FROM d)
            SELECT record_id, CAST(p AS INTEGER) AS argument_position, CAST(q AS INTEGER) AS position, x.type_name, x.definition, x.location
            FROM (SELECT record_id, p, q, defs[q + 1] AS x FROM f) WHERE x IS NOT NULL""",
        "p2_metadata": """
            SELECT record_id, e.key AS name, e.value AS value
            FROM (SELECT record_id, unnest(map_entries(metadata)) AS e FROM function_metadata) WHERE e.value IS NOT NULL""",
    }
