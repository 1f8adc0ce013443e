"""Queries of filters on places, graphs, reports and rounds that the other modules don't reach; each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import errors, reports, testing, text
from ..operators import crawling, evaluation, graph, windows
from ..session import materialize, table
from ..streaming import resume
from .core_queries import _SPLIT, LANG, WHITE, Query, _classify_sql, _files, _lang, _windows

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "function_metadata")


# --- errors by group --------------------------------------------------------------------------------------------------
@query(_classify_sql() + """, g AS (SELECT e.result_id, e.r, coalesce(d.mode, 'unknown') AS mode, coalesce(d.model, 'unknown') AS model FROM e JOIN detailed_results d USING (result_id))
    SELECT CASE WHEN mode IS NOT NULL THEN 'mode' WHEN model IS NOT NULL THEN 'model' ELSE 'all' END AS grouping, coalesce(mode, model, 'all') AS name, count(DISTINCT result_id) AS total_samples, count(*) AS total_tests,
        count(r) AS total_errors, CAST(count(r) AS DOUBLE) / count(*) AS error_rate FROM g GROUP BY GROUPING SETS ((mode), (model), ())""")  # fmt: skip
def error_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "detailed_results").select("result_id", "language", "mode", "model", "test", "logs", "checks", "coverage_stats", "mutation_scores")
    p = evaluation.padded(d)
    c = p.select("result_id", "mode", "model", errors.classify("language", "log", "test_code", F.col("check"), F.col("coverage_stat"))["category"].alias("category"))
    return evaluation.error_groups(c, "result_id", "category", ["mode", "model"])


# --- windows and places -----------------------------------------------------------------------------------------------
_PLACES = rf"""WITH {_SPLIT}, w AS (SELECT * FROM win WHERE trim(regexp_replace(context, '\s', '', 'g')) <> ''),
    foc AS (SELECT record_id, file_path AS focal, function_component.start_line AS s, function_component.end_line AS e, language FROM function_metadata WHERE function_component IS NOT NULL),
    k AS (SELECT DISTINCT record_id, focal, s, e, repo, context FROM w JOIN foc ON w.file_path = foc.focal)"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    """Merged windows of a repository with each function whose file has a place in them."""
    m = windows.merge_windows(_windows(spark, sf), "repo", "file_path", ["file_path", "line_no"])
    focal = _functions(spark, sf).where("function_component IS NOT NULL").select("record_id", F.col("file_path").alias("focal"), F.col("function_component.start_line").alias("s"), F.col("function_component.end_line").alias("e"))
    return m.withColumn("focal", F.explode(F.array_distinct(F.transform("places", lambda p: p["path"])))).join(focal, "focal")


@query(_PLACES + """ SELECT record_id, md5(k.context) AS context_md5, CAST(count(*) FILTER (w.file_path <> focal OR w.end_line_no < s OR e < w.start_line_no) AS INTEGER) AS n_left,
    bool_or(w.file_path = focal AND NOT (w.end_line_no < s OR e < w.start_line_no)) AS touches FROM k JOIN w ON k.repo = w.repo AND k.context = w.context GROUP BY record_id, focal, k.repo, k.context""")
def focal_window_filter(spark: SparkSession, sf: str) -> DataFrame:
    m, a = _merged(spark, sf), ("places", F.col("focal"), F.col("s"), F.col("e"))
    return m.select("record_id", F.md5("context").alias("context_md5"), F.size(windows.outside_focal(*a)).alias("n_left"), windows.touches_focal(*a).alias("touches"))


@query(_PLACES + """, o AS (SELECT record_id, k.context, focal, w.file_path, row_number() OVER (PARTITION BY record_id, k.repo, k.context ORDER BY w.file_path, w.line_no) AS n FROM k JOIN w ON k.repo = w.repo AND k.context = w.context),
    i AS (SELECT record_id, context, max(file_path) FILTER (n = 1) AS imported FROM o GROUP BY record_id, context)
    SELECT o.record_id, md5(o.context) AS context_md5, CAST(count(*) FILTER (o.file_path <> focal AND (o.record_id % 2 = 0 OR o.file_path = i.imported)) AS INTEGER) AS n_left FROM o JOIN i USING (record_id, context) GROUP BY o.record_id, o.context""")
def import_window_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = _merged(spark, sf)
    imports = F.when(F.col("record_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.get("places", F.lit(0))["path"]))
    return m.select("record_id", F.md5("context").alias("context_md5"), F.size(windows.imported_only("places", F.col("focal"), imports)).alias("n_left"))


@query(rf"""WITH {_SPLIT}, x AS (SELECT repo, min(file_path) AS excluded FROM files GROUP BY repo) SELECT win.repo, file_path, line_no FROM win JOIN x ON win.repo = x.repo AND file_path <> excluded WHERE trim(regexp_replace(context, '\s', '', 'g')) <> ''""")
def windows_without_file(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    excluded = files.groupBy("repo").agg(F.min("file_path").alias("excluded"))
    return windows.line_windows(windows.without_file(files, excluded, "repo", "file_path", "excluded"), "file_content", 20, 2, ["repo", "file_path"]).select("repo", "file_path", "line_no")


# --- reports ----------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT l_orderkey, l_linenumber * 2 AS line, CAST(l_quantity > 25 AS INTEGER) AS hits, lead(l_linenumber * 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity > 25) AS nxt FROM lineitem),
    b AS (SELECT l_orderkey, hits, greatest(least(coalesce(nxt - 1, 12), 12) - greatest(line, 3) + 1, 0) AS n FROM s), t AS (SELECT l_orderkey, sum(n) AS total, sum(CASE WHEN hits > 0 THEN n ELSE 0 END) AS covered FROM b GROUP BY l_orderkey)
    SELECT l_orderkey, CAST(covered AS INTEGER) AS covered_lines, CAST(total AS INTEGER) AS total_lines, CASE WHEN total > 0 THEN round_even(covered * 100.0::DOUBLE / total, 2) ELSE 0 END AS line_coverage FROM t""")
def llvm_lines(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.array(F.col("l_linenumber") * 2, F.lit(1), (F.col("l_quantity") > 25).cast("int"))
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(segment).alias("segments"))
    return s.select("l_orderkey", reports.llvm_segments(F.col("segments"), F.lit(3), F.lit(12)).alias("s")).select("l_orderkey", "s.*")


@query("""WITH x AS (SELECT record_id, replace(file_path, chr(92), '/') AS p, file_path FROM function_metadata), y AS (SELECT *, string_split(p, '/') AS parts FROM x)
    SELECT record_id, CASE record_id % 3 WHEN 0 THEN 'tail' WHEN 1 THEN 'base' END AS matched FROM y""")
def report_file(spark: SparkSession, sf: str) -> DataFrame:
    """The focal file is in the report under its last three parts, under its base name alone, or not at all."""
    p = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/", -1)
    other = F.struct(F.lit("/w/other/none.zz").alias("filename"), F.lit("other").alias("kind"))
    tail = F.struct(F.concat(F.lit("/build/"), F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(3)), 3), "/")).alias("filename"), F.lit("tail").alias("kind"))
    base = F.struct(F.concat(F.lit("/qq/"), F.element_at(parts, -1)).alias("filename"), F.lit("base").alias("kind"))
    files = F.when(F.col("record_id") % 3 == 0, F.array(other, base, tail)).when(F.col("record_id") % 3 == 1, F.array(other, base)).otherwise(F.array(other))
    return _functions(spark, sf).select("record_id", reports.llvm_file(files, "file_path")["kind"].alias("matched"))


@query("""SELECT result_id, coalesce(list_sum(list_transform(coverage_stats, lambda x: coalesce(x.covered_lines, 0))), 0)::BIGINT AS covered_lines, coalesce(list_sum(list_transform(coverage_stats, lambda x: coalesce(x.total_lines, 0))), 0)::BIGINT AS total_lines,
    coalesce(len(list_filter(checks, lambda x: coalesce(x.tests, false))), 0)::INTEGER AS passed, coalesce(len(list_filter(checks, lambda x: coalesce(x.compilation, false) AND NOT coalesce(x.tests, false))), 0)::INTEGER AS failed,
    coalesce(len(list_filter(checks, lambda x: NOT coalesce(x.compilation, false) AND NOT coalesce(x.tests, false))), 0)::INTEGER AS errors FROM detailed_results""")
def report_totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "detailed_results").select("result_id", evaluation.report_totals("checks", "coverage_stats").alias("t")).select("result_id", "t.*")


@query("""WITH r AS (SELECT model, avg(line_coverage) AS coverage, count(*) AS n FROM (SELECT model, unnest(coverage_stats, recursive := true) FROM detailed_results) GROUP BY model) SELECT model, round_even(coverage, 2) AS coverage, n FROM r""")
def rounded_report(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "detailed_results").select("model", F.explode("coverage_stats").alias("s"))
    return evaluation.rounded(s.groupBy("model").agg(F.avg("s.line_coverage").alias("coverage"), F.count("*").alias("n")))


# --- functions --------------------------------------------------------------------------------------------------------
@query("SELECT record_id, coalesce(length(focal_code) > 1500, false) AS too_large FROM function_metadata")
def function_size_guard(spark: SparkSession, sf: str) -> DataFrame:
    return crawling.prompt_columns(_functions(spark, sf), ["record_id"]).select("record_id", crawling.too_large("focal_code", 1500).alias("too_large"))


@query("""SELECT result_id, CAST(len(list_filter(generate_series(1, total), lambda i: i * 3 BETWEEN result_id % 40 AND result_id % 40 + 20)) AS INTEGER) AS n_mutants FROM (SELECT result_id, coalesce(mutation_scores[1].total_count, 0) AS total FROM detailed_results)""")
def focal_mutants(spark: SparkSession, sf: str) -> DataFrame:
    total = F.coalesce(F.get("mutation_scores", F.lit(0))["total_count"], F.lit(0))
    mutants = F.when(total > 0, F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), lambda i: F.struct((i * 3).alias("line"), F.lit("m").alias("method"), F.lit("killed").alias("status"))))
    start = F.col("result_id") % 40
    picked = testing.focal_mutants(F.coalesce(mutants, F.array().cast("array<struct<line:int,method:string,status:string>>")), start, start + 20, F.lit("m"))
    return table(spark, sf, "detailed_results").select("result_id", F.size(picked).alias("n_mutants"))


_DEFINED = "SELECT record_id, list_filter(flatten(list_transform(coalesce(function_component.argument_definitions_lsp, []), lambda a: coalesce(a.definitions, []))), lambda d: d.location IS NOT NULL) AS d FROM function_metadata"


@query(f"""WITH t AS ({_DEFINED}), k AS (SELECT record_id, list_filter(d, lambda x: NOT regexp_matches(lower(x.location), 'test/|tests/|_test\\.|test_|spec/|_spec\\.')) AS d FROM t)
    SELECT record_id, CAST(least(len(d), 2) AS INTEGER) AS n_references, d[1].location AS first_location FROM k""")
def first_references(spark: SparkSession, sf: str) -> DataFrame:
    all_ = F.flatten(F.transform(F.coalesce("function_component.argument_definitions_lsp", F.array()), lambda a: F.coalesce(a["definitions"], F.array())))
    found = F.transform(F.filter(all_, lambda d: d["location"].isNotNull()), lambda d: F.struct(d["location"].alias("path"), d["definition"].alias("code")))
    f = _functions(spark, sf).select("record_id", F.coalesce(found, F.array()).alias("found"))
    return f.select("record_id", testing.references("found", 2).alias("r")).select("record_id", F.size("r").alias("n_references"), F.get("r", F.lit(0))["path"].alias("first_location"))


@query("""WITH t AS (SELECT record_id, list_filter(coalesce(function_component.argument_definitions_lsp, []), lambda a: a IS NOT NULL) AS a FROM function_metadata)
    SELECT record_id, CAST(len(a) AS INTEGER) AS total_tokens, CAST(len(list_filter(a, lambda x: x.definitions[1].definition IS NOT NULL)) AS INTEGER) AS tokens_with_definitions, 0 AS tokens_with_references,
        array_to_string(list_sort(list_distinct(list_transform(list_filter(a, lambda x: x.definitions[1].definition IS NOT NULL AND contains(x.type, 'int')), lambda x: x.name)))[1:10], ' ') AS key_types FROM t""")
def token_summary(spark: SparkSession, sf: str) -> DataFrame:
    known = F.filter(F.coalesce("function_component.argument_definitions_lsp", F.array()), lambda a: a.isNotNull())
    tokens = F.transform(known, lambda a: F.struct(a["name"].alias("word"), F.when(F.contains(a["type"], F.lit("int")), "type").otherwise("other").alias("type"), F.get(a["definitions"], F.lit(0))["definition"].alias("definition"), F.lit(None).cast("array<string>").alias("references")))
    s = _functions(spark, sf).select("record_id", testing.token_summary(F.coalesce(tokens, F.array())).alias("s")).select("record_id", "s.*")
    return s.select("record_id", "total_tokens", "tokens_with_definitions", "tokens_with_references", F.array_join("key_types", " ").alias("key_types"))


@query(rf"""WITH m AS (SELECT record_id, 'head METADATA = {{ "task": 1 }}' || chr(10) || focal_code AS t FROM function_metadata WHERE focal_code IS NOT NULL)
    SELECT record_id, md5(trim(regexp_replace(t, '(?s)METADATA\s*=\s*\{{.*?\}}', '', 'g'), {WHITE})) AS rest_md5 FROM m""")
def metadata_removal(spark: SparkSession, sf: str) -> DataFrame:
    f = _functions(spark, sf).where("focal_code IS NOT NULL")
    return f.select("record_id", F.md5(text.without_metadata(F.concat(F.lit('head METADATA = { "task": 1 }\n'), F.col("focal_code")))).alias("rest_md5"))


@query(r"""WITH f AS (SELECT record_id, string_split(focal_code, chr(10)) AS x FROM function_metadata WHERE focal_code IS NOT NULL)
    SELECT record_id, md5(CASE WHEN len(x) < 2 OR regexp_matches(trim(x[2], chr(9) || chr(13) || ' '), '^(import|from|use) ') THEN '' ELSE array_to_string(list_concat([substring(x[2], 2)], x[3:least(len(x), 3)], CASE WHEN len(x) >= 4 THEN [substring(x[4], 1, 5)] ELSE [] END), chr(10)) END) AS range_md5 FROM f""")
def code_range(spark: SparkSession, sf: str) -> DataFrame:
    f = _functions(spark, sf).where("focal_code IS NOT NULL")
    return f.select("record_id", F.md5(text.range_text("focal_code", F.lit(1), F.lit(1), F.lit(3), F.lit(5))).alias("range_md5"))


@query(rf"""WITH t AS (SELECT response_id, {LANG} AS language, 'x.rb:' || response_id % 90 || ': e' || chr(10) || 'f on line ' || response_id % 70 || ' @ y:' || response_id % 50 AS log FROM generation_result)
    SELECT response_id, CAST(CASE language WHEN 'php' THEN response_id % 70 WHEN 'ruby' THEN response_id % 90 WHEN 'julia' THEN response_id % 50 ELSE response_id % 70 END AS INTEGER) AS line_number FROM t""")
def log_line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("response_id")
    log = F.concat(F.lit("x.rb:"), k % 90, F.lit(": e\nf on line "), k % 70, F.lit(" @ y:"), k % 50)
    return table(spark, sf, "generation_result").select("response_id", text.log_line_number(log, _lang()).alias("line_number"))


# --- graphs -----------------------------------------------------------------------------------------------------------
_ORDER_EDGES = """l AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS n FROM lineitem), e AS (SELECT g, 'ENTRY' AS src, CAST(n AS VARCHAR) AS dst, 'q1 > 0' AS condition FROM l WHERE n = 1
    UNION ALL SELECT a.g, CAST(a.n AS VARCHAR), CAST(b.n AS VARCHAR), CASE WHEN b.n - a.n = 1 THEN 'q' || a.n || ' > ' || b.n ELSE 'skip' || b.n || ' == q' || a.n END FROM l a JOIN l b ON a.g = b.g AND b.n - a.n BETWEEN 1 AND 2
    UNION ALL SELECT g, CAST(max(n) AS VARCHAR), 'EXIT', NULL FROM l GROUP BY g),
    p AS (SELECT g, dst AS cur, ['ENTRY', dst] AS nodes, [condition] AS conditions FROM e WHERE src = 'ENTRY'
    UNION ALL SELECT p.g, e.dst, list_append(p.nodes, e.dst), CASE WHEN e.condition IS NULL THEN p.conditions ELSE list_append(p.conditions, e.condition) END FROM p JOIN e ON p.g = e.g AND p.cur = e.src)"""


def _order_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of a graph for each order: its lines are nodes, the next two lines follow."""
    n = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("n")).distinct()
    last = F.col("n") == F.max("n").over(Window.partitionBy("g"))
    ends = n.withColumn("last", last)
    entry = n.where("n = 1").select("g", F.lit("ENTRY").alias("src"), F.col("n").cast("string").alias("dst"), F.lit("q1 > 0").alias("condition"))
    a, b = n.alias("a"), n.alias("b")
    step = F.col("b.n") - F.col("a.n")
    condition = F.when(step == 1, F.concat(F.lit("q"), F.col("a.n"), F.lit(" > "), F.col("b.n"))).otherwise(F.concat(F.lit("skip"), F.col("b.n"), F.lit(" == q"), F.col("a.n")))
    inner = a.join(b, (F.col("a.g") == F.col("b.g")) & step.between(1, 2)).select(F.col("a.g").alias("g"), F.col("a.n").cast("string").alias("src"), F.col("b.n").cast("string").alias("dst"), condition.alias("condition"))
    out = ends.where("last").select("g", F.col("n").cast("string").alias("src"), F.lit("EXIT").alias("dst"), F.lit(None).cast("string").alias("condition"))
    return graph.all_paths(entry.unionByName(inner).unionByName(out).withColumn("is_back", F.lit(False)), "g")


@query(f"WITH RECURSIVE {_ORDER_EDGES} SELECT g, array_to_string(nodes, ' ') AS nodes, array_to_string(conditions, ', ') AS conditions FROM p WHERE cur = 'EXIT'")
def cfg_order_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _order_paths(spark, sf).select("g", F.array_join("nodes", " ").alias("nodes"), F.array_join("conditions", ", ").alias("conditions"))


@query(f"""WITH RECURSIVE {_ORDER_EDGES}, c AS (SELECT DISTINCT g, unnest(conditions) AS condition FROM p WHERE cur = 'EXIT')
    SELECT g, condition, CAST(1 AS INTEGER) AS complexity, CAST(0 AS INTEGER) AS depth, array_to_string(list_sort(regexp_extract_all(condition, '[a-z]+[0-9]+')), ' ') AS identifiers FROM c""")
def cfg_conditions(spark: SparkSession, sf: str) -> DataFrame:
    c = graph.unique_conditions(_order_paths(spark, sf), "g")
    return c.select("g", "condition", "complexity", "depth", F.array_join(F.array_sort("identifiers"), " ").alias("identifiers"))


@query(f"""WITH RECURSIVE {_ORDER_EDGES}, s AS (SELECT g, array_to_string(nodes, ' ') AS nodes, len(conditions) * 10 + len(nodes) AS score, row_number() OVER (PARTITION BY g ORDER BY len(conditions) * 10 + len(nodes), to_json(nodes)::VARCHAR, to_json(conditions)::VARCHAR) AS n FROM p WHERE cur = 'EXIT')
    SELECT g, nodes, CAST(score AS INTEGER) AS score FROM s WHERE n = 1""")
def cfg_best_path(spark: SparkSession, sf: str) -> DataFrame:
    return graph.best_path(_order_paths(spark, sf), "g", F.size("nodes")).select("g", F.array_join("nodes", " ").alias("nodes"), "score")


# --- rounds -----------------------------------------------------------------------------------------------------------
@query("""WITH t AS (SELECT result_id, coalesce(checks[1].tests, false) AS passed FROM detailed_results)
    SELECT result_id, CAST(CASE WHEN passed THEN 0 WHEN result_id % 5 = 0 THEN 1 WHEN result_id % 5 = 1 THEN 2 ELSE 3 END AS INTEGER) AS attempt, passed OR result_id % 5 <= 2 AS passed FROM t""")
def repair_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds; in round n those failing rows pass whose id leaves n - 1 when divided by 5."""
    first = table(spark, sf, "detailed_results").select("result_id", F.coalesce(F.get("checks", F.lit(0))["tests"], F.lit(False)).alias("passed"))
    repair = lambda failing, n: failing.withColumn("passed", F.col("result_id") % 5 == n - 1)
    return resume.repair_rounds(first, 3, "result_id", F.col("passed"), repair, lambda df, n: materialize(df, f"round{n}"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
