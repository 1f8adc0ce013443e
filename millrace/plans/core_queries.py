"""Queries of the evaluation operators over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, records, reports, text
from ..functions.arguments import arguments
from ..operators import crawling, evaluation, graph, prompts, relational, retrieval, statistics, windows
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Words that SQL twins share: one spelling of a language, and a missing flag.
LANG = "lower(trim(language))"
WHITE = "'" + text.WHITE + "'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _lang(c: str = "language") -> Column:
    return F.lower(F.trim(F.col(c)))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "detailed_results").withColumn("language", _lang())


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    keep = ["result_id", "task_id", "repo", "language", "mode", "model", "evaluated_at", "test", "logs", "checks", "coverage_stats", "mutation_scores"]
    return evaluation.outcomes(_results(spark, sf).select(*keep))


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "function_metadata")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct files with content: one row a (path, content)."""
    return _functions(spark, sf).where("file_content IS NOT NULL").select(F.split("file_path", "/", -1)[0].alias("repo"), "file_path", "file_content").dropDuplicates(["file_path", "file_content"])


FACTS_SQL = f"""
    base AS (SELECT result_id, task_id, repo, {LANG} AS language, mode, model, evaluated_at, checks, coverage_stats FROM detailed_results),
    spots AS (SELECT *, unnest(generate_series(0, len(checks) - 1)) AS position FROM base),
    real AS (SELECT result_id, task_id, repo, language, mode, model, evaluated_at, CAST(position AS INTEGER) AS position, coalesce(c.compilation, false) AS compiled,
               coalesce(c.compilation, false) AND coalesce(c.tests, false) AS passed, coalesce(c.invocation, false) AS invoked, s.line_coverage AS coverage, false AS synthetic
        FROM (SELECT *, checks[position + 1] AS c, coverage_stats[position + 1] AS s FROM spots) WHERE c IS NOT NULL),
    facts AS (SELECT * FROM real UNION ALL
        SELECT result_id, task_id, repo, language, mode, model, evaluated_at, 0, false, false, false, CAST(NULL AS DOUBLE), true FROM base WHERE result_id NOT IN (SELECT result_id FROM real))"""


# --- outcomes and summaries -------------------------------------------------------------------------------------------
@query(f"WITH {FACTS_SQL} SELECT result_id, position, compiled, passed, invoked, coverage, synthetic FROM facts")
def outcome_fact(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select("result_id", "position", "compiled", "passed", "invoked", "coverage", "synthetic")


_SUMMARY = """
    WITH base AS (SELECT {LANG} AS language, mode, model, coalesce(len(test), 0) AS n_tests, checks, coverage_stats, mutation_scores FROM detailed_results),
    longest AS (SELECT {g} max(n_tests) AS max_tests FROM base {group}),
    one AS (SELECT {bg} max_tests,
        len(list_filter(coalesce(checks, []), lambda c: coalesce(c.compilation, false))) AS compiled,
        len(list_filter(coalesce(checks, []), lambda c: coalesce(c.compilation, false) AND coalesce(c.tests, false))) AS passed,
        len(list_filter(coalesce(checks, []), lambda c: coalesce(c.invocation, false))) AS invoked,
        len(list_filter(coalesce(checks, []), lambda c: coalesce(c.mutation, false))) AS mutated,
        coalesce(list_sum(list_transform(coalesce(coverage_stats, [])[1:max_tests], lambda s: CASE WHEN s.total_lines > 0 THEN coalesce(CAST(s.covered_lines AS DOUBLE) / s.total_lines, 0) ELSE 0 END)), 0) AS covered,
        coalesce(list_sum(list_transform(coalesce(mutation_scores, []), lambda m: coalesce(CAST(m.killed_count AS DOUBLE), 0))), 0) AS killed,
        coalesce(list_sum(list_transform(coalesce(mutation_scores, []), lambda m: coalesce(CAST(m.total_count AS DOUBLE), 0))), 0) AS mutants
        FROM base {join} longest {on}),
    sums AS (SELECT {g} count(*) AS total_samples, max(max_tests) AS max_tests, sum(compiled) AS compiled, sum(passed) AS passed, sum(invoked) AS invoked, sum(mutated) AS mutated,
        sum(covered) AS covered, sum(killed) AS killed, sum(mutants) AS mutants FROM one {group})
    SELECT {g} total_samples, CAST(max_tests AS INTEGER) AS max_tests, total_samples * max_tests AS total_slots,
        coalesce(CAST(compiled AS DOUBLE) * 100 / nullif(total_samples * max_tests, 0), 0) AS compiled_rate, coalesce(CAST(passed AS DOUBLE) * 100 / nullif(total_samples * max_tests, 0), 0) AS test_pass_rate,
        coalesce(CAST(invoked AS DOUBLE) * 100 / nullif(total_samples * max_tests, 0), 0) AS invocation_rate, coalesce(round(CAST(covered AS DOUBLE) * 100 / nullif(total_samples * max_tests, 0), 6), 0) AS line_coverage,
        CASE WHEN mutated > 0 THEN CAST(mutated AS BIGINT) END AS mutation_run, CASE WHEN mutated > 0 THEN CAST(mutated AS DOUBLE) * 100 / nullif(total_samples * max_tests, 0) END AS mutation_run_rate,
        CASE WHEN mutated > 0 THEN CAST(killed AS BIGINT) END AS killed_mutants, CASE WHEN mutated > 0 THEN CAST(mutants AS BIGINT) END AS total_mutants,
        CASE WHEN mutated > 0 THEN coalesce(killed / nullif(mutants, 0), 0) END AS mutation_score FROM sums"""
_BY = "language, mode, model"


def _summary_sql(grouped: bool) -> str:
    return _SUMMARY.format(
        LANG=LANG, g=f"{_BY}," if grouped else "", bg="base.language, base.mode, base.model," if grouped else "", group=f"GROUP BY {_BY}" if grouped else "", join="JOIN" if grouped else ", ",
        on="ON base.language IS NOT DISTINCT FROM longest.language AND base.mode IS NOT DISTINCT FROM longest.mode AND base.model IS NOT DISTINCT FROM longest.model" if grouped else "",
    )


@query(_summary_sql(True))
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.summary(_results(spark, sf), ["language", "mode", "model"]).withColumn("line_coverage", F.round("line_coverage", 6))


@query(_summary_sql(False))
def eval_summary_all(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.summary(_results(spark, sf)).withColumn("line_coverage", F.round("line_coverage", 6))


@query(f"""WITH {FACTS_SQL} SELECT language, mode, model, count(*) AS n_tests, count(*) FILTER (passed) AS n_passed, CAST(count(*) FILTER (passed) AS DOUBLE) * 100 / count(*) AS pass_rate
    FROM facts GROUP BY language, mode, model""")
def pass_rate_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.pass_rates(_facts(spark, sf), ["language", "mode", "model"])


@query(f"""WITH {FACTS_SQL} SELECT language, mode, model, count(*) AS n_tests, count(*) FILTER (passed) AS n_passed, CAST(count(*) FILTER (passed) AS DOUBLE) * 100 / count(*) AS pass_rate
    FROM facts GROUP BY language, mode, model HAVING count(*) >= 50""")
def min_tests_gate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.pass_rates(_facts(spark, sf), ["language", "mode", "model"], 50)


@query(f"""WITH {FACTS_SQL} SELECT language, mode, model, CAST(grouping(language, mode, model) AS BIGINT) AS level, count(*) AS n_checks, count(*) FILTER (passed) AS tpr_count,
    count(*) FILTER (passed AND NOT invoked) AS ir_fail_count, CAST(count(*) FILTER (passed) AS DOUBLE) * 100 / count(*) AS tpr_rate,
    CAST(count(*) FILTER (passed AND NOT invoked) AS DOUBLE) * 100 / nullif(count(*) FILTER (passed), 0) AS disagreement_rate FROM facts WHERE NOT synthetic GROUP BY ROLLUP (language, mode, model)""")
def ir_tpr_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.disagreement(_facts(spark, sf), ["language", "mode", "model"])


@query(f"""WITH s AS (SELECT DISTINCT {LANG} AS language, task_id, model FROM detailed_results WHERE task_id IS NOT NULL AND len(list_filter(list_transform(generate_series(1, coalesce(len(checks), 0)),
        lambda i: coalesce(checks[i].tests, false) AND coalesce(coverage_stats[i].covered_lines > CASE WHEN {LANG} = 'ruby' THEN 1 ELSE 0 END, false)), lambda x: x)) > 0),
    t AS (SELECT language, task_id, max(CASE WHEN model = 'corvid-7b' THEN 1 ELSE 0 END) AS a, max(CASE WHEN model = 'saola-pro' THEN 1 ELSE 0 END) AS b, max(CASE WHEN model = 'osprey-mini' THEN 1 ELSE 0 END) AS c
        FROM s GROUP BY language, task_id)
    SELECT count(*) FILTER (a = 1 AND b = 0 AND c = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1 AND c = 0) AS only_b, count(*) FILTER (a = 0 AND b = 0 AND c = 1) AS only_c,
        count(*) FILTER (a = 1 AND b = 1 AND c = 0) AS a_and_b, count(*) FILTER (a = 1 AND b = 0 AND c = 1) AS a_and_c, count(*) FILTER (a = 0 AND b = 1 AND c = 1) AS b_and_c,
        count(*) FILTER (a = 1 AND b = 1 AND c = 1) AS all_three, count(*) FILTER (a + b + c > 0) AS in_any FROM t""")
def overlap_venn3(spark: SparkSession, sf: str) -> DataFrame:
    won = evaluation.successes(_results(spark, sf).where("task_id IS NOT NULL"), ["language", "task_id"], "model")
    return evaluation.venn3(won, ["language", "task_id"], ("corvid-7b", "saola-pro", "osprey-mini"))


@query(f"""WITH s AS (SELECT DISTINCT {LANG} AS language, task_id, model FROM detailed_results WHERE task_id IS NOT NULL AND len(list_filter(list_transform(generate_series(1, coalesce(len(checks), 0)),
        lambda i: coalesce(checks[i].tests, false) AND coalesce(coverage_stats[i].covered_lines > CASE WHEN {LANG} = 'ruby' THEN 1 ELSE 0 END, false)), lambda x: x)) > 0)
    SELECT language, count(*) FILTER (model = 'corvid-7b') AS "corvid-7b", count(*) FILTER (model = 'saola-pro') AS "saola-pro", count(*) FILTER (model = 'osprey-mini') AS "osprey-mini" FROM s GROUP BY language""")
def overlap_pivot(spark: SparkSession, sf: str) -> DataFrame:
    won = evaluation.successes(_results(spark, sf).where("task_id IS NOT NULL"), ["language", "task_id"], "model")
    return evaluation.success_pivot(won, "language", ["corvid-7b", "saola-pro", "osprey-mini"])


@query(f"""WITH {FACTS_SQL} SELECT f.model, d.domain, count(*) AS n, count(*) FILTER (passed) AS n_success, CAST(count(*) FILTER (passed) AS DOUBLE) * 100 / count(*) AS success_rate
    FROM facts f JOIN repo_domain d ON f.repo = d.repo WHERE d.domain IS NOT NULL AND d.domain <> 'Unknown' GROUP BY f.model, d.domain""")
def domain_rates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.domain_rates(_facts(spark, sf), table(spark, sf, "repo_domain"), "repo", F.col("passed"), "model")


@query(f"SELECT {LANG} AS language, repo, CAST(grouping({LANG}, repo) AS BIGINT) AS level, count(*) AS n FROM function_metadata GROUP BY ROLLUP ({LANG}, repo)")
def crawl_stats_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.rollup_counts(_functions(spark, sf).withColumn("language", _lang()), ["language", "repo"])


@query(f"""WITH s AS (SELECT {LANG} AS language, unnest(coverage_stats) AS c FROM detailed_results), r AS (SELECT language, c.covered_lines AS a, c.total_lines AS b, CAST(c.covered_lines AS DOUBLE) * 100 / nullif(c.total_lines, 0) AS x FROM s WHERE c IS NOT NULL)
    SELECT language, count(x) AS n, round(avg(x), 6) AS mean_coverage, min(x) AS least_coverage, max(x) AS largest_coverage, CAST(sum(a) AS DOUBLE) * 100 / nullif(sum(b), 0) AS micro_coverage FROM r GROUP BY language""")
def coverage_overview(spark: SparkSession, sf: str) -> DataFrame:
    s = _results(spark, sf).select("language", F.explode("coverage_stats").alias("c")).where("c IS NOT NULL")
    return evaluation.coverage_overview(s, "language", F.col("c.covered_lines"), F.col("c.total_lines")).withColumn("mean_coverage", F.round("mean_coverage", 6))


# --- statistics -------------------------------------------------------------------------------------------------------
_ALIGNED = f"""WITH {FACTS_SQL}, fact AS (SELECT * FROM facts WHERE task_id IS NOT NULL),
    last AS (SELECT language, mode, model, task_id, position, passed FROM (SELECT *, row_number() OVER (PARTITION BY language, mode, model, task_id, position ORDER BY evaluated_at DESC, result_id DESC) AS r FROM fact) WHERE r = 1)"""
_P = "(1.0 / (1.0 + 0.3275911 * sqrt(chi2 / 2)))"
_MCNEMAR = f"""t AS (SELECT *, CASE WHEN only_a + only_b > 0 THEN power(abs(only_a - only_b) - 1, 2) / CAST(only_a + only_b AS DOUBLE) ELSE 0 END AS chi2 FROM counts)
    SELECT * EXCLUDE (chi2), round(chi2, 9) AS chi2, round(CASE WHEN only_a + only_b > 0 THEN
        {_P} * (0.254829592 + {_P} * (-0.284496736 + {_P} * (1.421413741 + {_P} * (-1.453152027 + {_P} * 1.061405429)))) * exp(-chi2 / 2) ELSE 1 END, 9) AS p_value FROM t"""
_COUNTS = "count(*) AS n_aligned, count(*) FILTER (a.passed AND b.passed) AS both_pass, count(*) FILTER (a.passed AND NOT b.passed) AS only_a, count(*) FILTER (NOT a.passed AND b.passed) AS only_b, count(*) FILTER (NOT a.passed AND NOT b.passed) AS both_fail"


def _last_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    facts = _facts(spark, sf).where("task_id IS NOT NULL")
    return relational.last_wins(facts, ["language", "mode", "model", "task_id", "position"], [F.col("evaluated_at"), F.col("result_id")])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("chi2", F.round("chi2", 9)).withColumn("p_value", F.round("p_value", 9))


@query(f"""{_ALIGNED}, rates AS (SELECT language, mode, model, avg(CAST(passed AS INT)) AS rate FROM last GROUP BY language, mode, model),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language, mode ORDER BY rate DESC, model) AS r FROM rates) WHERE r <= 3),
    pairs AS (SELECT a.language, a.mode, a.model AS model_a, b.model AS model_b FROM top a JOIN top b ON a.language = b.language AND a.mode = b.mode AND a.r < b.r),
    counts AS (SELECT p.language, p.mode, p.model_a, p.model_b, {_COUNTS} FROM pairs p JOIN last a ON a.language = p.language AND a.mode = p.mode AND a.model = p.model_a
        JOIN last b ON b.language = p.language AND b.mode = p.mode AND b.model = p.model_b AND a.task_id = b.task_id AND a.position = b.position GROUP BY ALL), {_MCNEMAR}""")
def mcnemar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    last = _last_outcomes(spark, sf)
    rates = last.groupBy("language", "mode", "model").agg(F.avg(F.col("passed").cast("int")).alias("rate"))
    ranked = relational.top_k(rates.withColumn("__g", F.concat_ws("\x1f", "language", "mode")), "__g", [F.col("rate").desc(), F.col("model")], 3)
    pairs = relational.ranked_pairs(ranked, ["language", "mode"], "rank", "model", 3).withColumnsRenamed({"a": "model_a", "b": "model_b"})
    a = last.join(pairs.withColumnRenamed("model_a", "model"), ["language", "mode", "model"]).withColumnRenamed("model", "model_a")
    b = last.join(pairs.withColumnRenamed("model_b", "model"), ["language", "mode", "model"]).withColumnRenamed("model", "model_b")
    return _rounded(statistics.contingency(a, b, ["task_id", "position"], ["language", "mode", "model_a", "model_b"]))


@query(f"""{_ALIGNED}, counts AS (SELECT a.language, a.model, {_COUNTS} FROM last a JOIN last b ON a.language = b.language AND a.model = b.model AND a.task_id = b.task_id AND a.position = b.position
    WHERE a.mode = 'standard' AND b.mode = 'file_context' GROUP BY ALL), {_MCNEMAR}""")
def mcnemar_cross_mode(spark: SparkSession, sf: str) -> DataFrame:
    last = _last_outcomes(spark, sf)
    return _rounded(statistics.contingency(last.where("mode = 'standard'"), last.where("mode = 'file_context'"), ["task_id", "position"], ["language", "model"]))


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.bootstrap(pass_rate_by_group(spark, sf), ["language", "mode", "model"], "n_tests", "n_passed")


_METRICS = f"""WITH {FACTS_SQL}, m AS (SELECT model, avg(CAST(compiled AS INT)) AS csr, avg(CAST(passed AS INT)) AS tpr, avg(CAST(invoked AS INT)) AS ir, round(avg(coverage), 9) AS cov FROM facts GROUP BY model)"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).groupBy("model").agg(
        F.avg(F.col("compiled").cast("int")).alias("csr"), F.avg(F.col("passed").cast("int")).alias("tpr"), F.avg(F.col("invoked").cast("int")).alias("ir"), F.round(F.avg("coverage"), 9).alias("cov")
    )


@query(_METRICS + "".join(
    f"{' UNION ALL' if k else ''} SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(corr({a}, {b}), 9) AS r FROM m"
    for k, (a, b) in enumerate((a, b) for i, a in enumerate(("csr", "tpr", "ir", "cov")) for b in ("csr", "tpr", "ir", "cov")[i:])
))
def correlation_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.pearson_matrix(_metrics(spark, sf), ["csr", "tpr", "ir", "cov"]).withColumn("r", F.round("r", 9))


@query(_METRICS + ", k AS (SELECT rank() OVER (ORDER BY tpr) + (count(*) OVER (PARTITION BY tpr) - 1) / 2.0 AS a, rank() OVER (ORDER BY cov) + (count(*) OVER (PARTITION BY cov) - 1) / 2.0 AS b FROM m WHERE cov IS NOT NULL) SELECT round(corr(a, b), 9) AS rho FROM k")
def correlation_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.spearman(_metrics(spark, sf), "tpr", "cov").select(F.round("rho", 9).alias("rho"))


@query(_METRICS + """, p AS (SELECT sign(a.tpr - b.tpr) AS x, sign(a.cov - b.cov) AS y FROM m a JOIN m b ON a.model < b.model WHERE a.cov IS NOT NULL AND b.cov IS NOT NULL)
    SELECT round(sum(x * y) / sqrt(CAST(sum(abs(x)) * sum(abs(y)) AS DOUBLE)), 9) AS tau FROM p""")
def correlation_kendall(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.kendall(_metrics(spark, sf), "tpr", "cov", "model").select(F.round("tau", 9).alias("tau"))


@query("""WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS largest, max(v) FILTER (i = n // 4) AS p25, max(v) FILTER (i = n // 2) AS median, max(v) FILTER (i = (n * 3) // 4) AS p75 FROM r GROUP BY event_type""")
def index_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.index_quantiles(table(spark, sf, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query(f"""WITH t AS (SELECT DISTINCT {LANG} AS language, task_id FROM function_metadata WHERE task_id IS NOT NULL)
    SELECT language, task_id, draw_no FROM (SELECT *, CAST(row_number() OVER (PARTITION BY language ORDER BY md5('7:' || CAST(task_id AS VARCHAR)), task_id) AS INTEGER) AS draw_no FROM t) WHERE draw_no <= 20""")
def stratified_subset(spark: SparkSession, sf: str) -> DataFrame:
    tasks = _functions(spark, sf).where("task_id IS NOT NULL").select(_lang().alias("language"), "task_id").distinct()
    return relational.stratified(tasks, ["language"], "task_id", 20, 7)


# --- identifiers, status, joins ---------------------------------------------------------------------------------------
_NUM = "try_cast(trim(task_id) AS BIGINT)"
_KEY = f"coalesce(CAST({_NUM} AS VARCHAR), nullif(trim(task_id), ''), 'unknown')"
_STATUS = r"CASE WHEN trim(regexp_replace(coalesce(response, ''), '\s', ' ', 'g')) = '' THEN 'error' WHEN regexp_matches(coalesce(response, ''), '^(Error|Exception|\[ERROR:)') THEN 'error' ELSE 'success' END"


@query(f"SELECT response_id, {_NUM} AS task_number, {_KEY} AS task_key FROM generation_result")
def task_id_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "generation_result").select("response_id", records.task_number("task_id").alias("task_number"), records.task_key("task_id").alias("task_key"))


@query(f"SELECT response_id, CASE WHEN {_NUM} IS NOT NULL THEN 0 ELSE 1 END AS k1, {_NUM} AS k2, coalesce(task_id, '') AS k3 FROM generation_result ORDER BY k1, k2, k3")
def task_id_sort(spark: SparkSession, sf: str) -> DataFrame:
    keys = [k.alias(f"k{i}") for i, k in enumerate(records.task_order("task_id"), start=1)]
    return table(spark, sf, "generation_result").select("response_id", *keys).orderBy("k1", "k2", "k3")


@query("""SELECT record_id, 'rag:' || sha1('[' || to_json(file_path) || ',' || coalesce(to_json(function_name), 'null') || ',' || coalesce(CAST(function_component.start_line AS VARCHAR), 'null') || ',' ||
    coalesce(CAST(function_component.end_line AS VARCHAR), 'null') || ']') AS stable_id FROM function_metadata""")
def stable_task_id(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).select("record_id", records.stable_id("file_path", "function_name", F.col("function_component.start_line"), F.col("function_component.end_line")).alias("stable_id"))


@query(f"SELECT response_id, {_STATUS} AS response_status, (status IS NULL OR lower(trim(status)) IN ('', 'success')) AND {_STATUS} = 'success' AS succeeded FROM generation_result")
def record_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "generation_result").select("response_id", records.response_status("response").alias("response_status"), records.record_succeeded("status", "response").alias("succeeded"))


@query(f"""WITH k AS (SELECT *, {_KEY} AS key FROM generation_result), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC NULLS LAST, response_id DESC) AS n FROM k)
    SELECT response_id, task_id, model, mode FROM r WHERE n = 1 OR key = 'unknown'""")
def dedupe_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "generation_result").select("response_id", "task_id", "model", "mode", "created_at")
    return relational.dedupe_tasks(g, "task_id", [F.coalesce("created_at", F.lit("1900-01-01").cast("timestamp")), F.col("response_id")]).drop("created_at")


@query(f"""SELECT record_id, task_id FROM function_metadata WHERE task_id IS NULL OR CAST(task_id AS VARCHAR) NOT IN
    (SELECT {_KEY} FROM generation_result WHERE (status IS NULL OR lower(trim(status)) IN ('', 'success')) AND {_STATUS} = 'success')""")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    done = relational.successful(table(spark, sf, "generation_result"), "status", "response").select("task_id")
    return relational.remaining(_functions(spark, sf).select("record_id", "task_id"), done, "task_id")


@query(f"""WITH r AS (SELECT * FROM (SELECT response_id, {_NUM} AS id, row_number() OVER (PARTITION BY {_NUM} ORDER BY response_id) AS n FROM generation_result WHERE {_NUM} IS NOT NULL) WHERE n = 1),
    b AS (SELECT * FROM (SELECT task_id AS id, record_id, function_name, row_number() OVER (PARTITION BY task_id ORDER BY record_id DESC) AS n FROM function_metadata WHERE task_id IS NOT NULL) WHERE n = 1)
    SELECT response_id, record_id, function_name FROM r JOIN b USING (id)""")
def response_join_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "generation_result").select("response_id", "task_id")
    b = _functions(spark, sf).select("task_id", "record_id", "function_name")
    return relational.responses_with_base(g, b, "task_id", [F.col("response_id")], [F.col("record_id")], ["record_id", "function_name"]).drop("task_id")


@query(f"""WITH side AS (SELECT repo, min({LANG}) AS language, 'crawled' AS domain FROM function_metadata WHERE repo IS NOT NULL GROUP BY repo)
    SELECT b.repo, CASE WHEN s.repo IS NOT NULL THEN s.language ELSE b.language END AS language, CASE WHEN s.repo IS NOT NULL THEN s.domain ELSE b.domain END AS domain, s.repo IS NOT NULL AS from_side
    FROM repo_domain b LEFT JOIN side s ON b.repo = s.repo""")
def side_lookup_fallback(spark: SparkSession, sf: str) -> DataFrame:
    side = _functions(spark, sf).where("repo IS NOT NULL").groupBy("repo").agg(F.min(_lang()).alias("language"), F.lit("crawled").alias("domain"))
    return relational.side_or_base(table(spark, sf, "repo_domain"), side, "repo", ["language", "domain"])


@query(f"""WITH sub AS (SELECT DISTINCT task_id FROM function_metadata WHERE repo IN (SELECT repo FROM repo_domain WHERE domain IS NOT NULL)), {FACTS_SQL}
    SELECT model, count(*) AS n_tests, count(*) FILTER (passed) AS n_passed, CAST(count(*) FILTER (passed) AS DOUBLE) * 100 / count(*) AS pass_rate FROM facts WHERE task_id IN (SELECT task_id FROM sub) GROUP BY model""")
def restricted_summary(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "repo_domain").where("domain IS NOT NULL")
    subset = relational.restrict(_functions(spark, sf).select("repo", "task_id"), known, "repo")
    return evaluation.pass_rates(relational.restrict(_facts(spark, sf), subset, "task_id"), ["model"])


@query("SELECT DISTINCT task_id FROM function_metadata WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM detailed_results WHERE task_id IS NOT NULL)")
def missing_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return relational.missing(_functions(spark, sf).where("task_id IS NOT NULL"), table(spark, sf, "detailed_results"), "task_id")


# --- text -------------------------------------------------------------------------------------------------------------
@query("SELECT DISTINCT file_path, split_part(file_path, '/', 1) AS repo, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE 'unknown' END AS julia_repo FROM function_metadata")
def repo_from_path(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).select("file_path", text.repo_of("file_path").alias("repo"), text.repo_or_unknown("file_path").alias("julia_repo")).distinct()


_LINES = rf"len(list_filter(string_split({{0}}, chr(10)), lambda s: trim(s, {WHITE}) <> '' AND NOT regexp_matches(trim(s, {WHITE}), '^(//|#|--|/\*|\*)')))"


@query(f"SELECT record_id, CAST({_LINES.format('focal_code')} AS INTEGER) AS n_lines FROM function_metadata")
def line_count(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).select("record_id", text.code_line_count("focal_code").alias("n_lines"))


@query(rf"""SELECT record_id, CASE {LANG} WHEN 'go' THEN regexp_extract(file_content, '(?m)^[ \t]*package[ \t]+([A-Za-z_]\w*)', 1) WHEN 'julia' THEN regexp_extract(file_content, '(?m)^[ \t]*module[ \t]+([A-Za-z_]\w*)', 1)
    WHEN 'rust' THEN regexp_extract(file_content, '(?m)^[ \t]*(?:pub[ \t]+)?mod[ \t]+([A-Za-z_]\w*)', 1) WHEN 'ruby' THEN regexp_extract(file_content, '(?m)^module[ \t]+([A-Za-z_][\w:]*)', 1)
    WHEN 'php' THEN regexp_extract(file_content, '(?m)^namespace[ \t]+([\w\\]+)', 1) ELSE '' END AS package FROM function_metadata""")
def package_name(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).select("record_id", text.package_name("file_content", "language").alias("package"))


@query()
def signature(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).select("record_id", text.signature("focal_code", "language").alias("signature"))


@query()
def argument_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).select("record_id", F.posexplode(arguments(text.signature("focal_code", "language"), "language")).alias("position", "a")).select("record_id", "position", "a.*")


@query(r"SELECT response_id, array_to_string(regexp_extract_all(response, '(?s)```(?:julia|ruby|go|rust|php)?\r?\n(.*?)```', 1), chr(10) || chr(10)) AS code FROM generation_result")
def fence_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "generation_result").select("response_id", text.fenced_code("response").alias("code"))


@query(rf"""WITH b AS (SELECT record_id, {LANG} AS l, CASE {LANG} WHEN 'julia' THEN regexp_replace(focal_code, '(?s)#=.*?=#', '', 'g') WHEN 'ruby' THEN regexp_replace(focal_code, '(?ms)^=begin.*?^=end[^\n]*', '', 'g')
        ELSE regexp_replace(focal_code, '(?s)/\*.*?\*/', '', 'g') END AS c FROM function_metadata)
    SELECT record_id, array_to_string(list_filter(list_transform(string_split(c, chr(10)), lambda s: rtrim(CASE WHEN l IN ('julia', 'ruby') THEN regexp_replace(s, '#.*$', '') WHEN l = 'php' THEN regexp_replace(s, '(?://|#).*$', '') ELSE regexp_replace(s, '//.*$', '') END, {WHITE})),
        lambda s: trim(s, {WHITE}) <> ''), chr(10)) AS code FROM b""")
def comment_strip(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).select("record_id", text.without_comments("focal_code", "language").alias("code"))


_LOGS = f"""p AS (SELECT result_id, task_id, {LANG} AS language, CAST(position AS INTEGER) AS position, test[position + 1] AS test_code, logs[position + 1] AS log, checks[position + 1] AS c, coverage_stats[position + 1] AS s, coalesce(len(test), 0) = 0 AS synthetic
    FROM (SELECT *, unnest(generate_series(0, greatest(coalesce(len(test), 0) - 1, 0))) AS position FROM detailed_results))"""


def _padded(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.padded(_results(spark, sf).select("result_id", "task_id", "language", "test", "logs", "checks", "coverage_stats", "mutation_scores"))


@query(f"WITH {_LOGS} SELECT result_id, position, test_code, log, synthetic FROM p")
def padded_tests(spark: SparkSession, sf: str) -> DataFrame:
    return _padded(spark, sf).select("result_id", "position", "test_code", "log", "synthetic")


@query(rf"""WITH {_LOGS}, t AS (SELECT result_id, position, log, list_transform(string_split(coalesce(log, ''), chr(10)), lambda s: trim(s, {WHITE})) AS x FROM p)
    SELECT result_id, position, coalesce(list_filter(x, lambda s: regexp_matches(lower(s), 'error|failed|exception|panic|fatal'))[1], list_filter(x, lambda s: s <> '')[1], '')[1:200] AS error_line,
        coalesce(try_cast(regexp_extract(log, '(?i)line[:\s]+(\d+)', 1) AS INTEGER), try_cast(regexp_extract(log, ':(\d+):', 1) AS INTEGER)) AS line_number FROM t""")
def first_error_line(spark: SparkSession, sf: str) -> DataFrame:
    return _padded(spark, sf).select("result_id", "position", text.first_error_line("log").alias("error_line"), text.log_line_number("log").alias("line_number"))


def _classify_sql() -> str:
    def quoted(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    whens = [
        "WHEN contains(lower(t), 'preprocessing') AND contains(lower(t), 'no tests generated') THEN {'category': 'syntactic_compilation', 'confidence': 0.85::DOUBLE}",
        "WHEN code = '' OR (t = '' AND c IS NULL) THEN {'category': 'syntactic_compilation', 'confidence': 0.8::DOUBLE}",
        "WHEN stage = 'pass' AND coalesce(c.coverage, false) AND s.covered_lines <= CASE WHEN language = 'ruby' THEN 1 ELSE 0 END THEN {'category': 'test_design_mocking', 'confidence': 0.65::DOUBLE}",
    ]
    for r in errors.RULES:
        if r.codes:
            hit = f"regexp_extract(t, {quoted(errors.ERROR_CODE)}, 1) IN ({', '.join(map(quoted, r.codes))})"
        else:
            hit = f"regexp_matches({'code' if r.on_code else 't'}, {quoted(r.pattern)})"
        if r.also:
            hit += f" AND regexp_matches(t, {quoted('(?i)' + '|'.join(f'(?:{p})' for p in r.also))})"
        if r.first_line:
            hit += " AND (" + " OR ".join(f"contains(lower(error_line), {quoted(w)})" for w in r.first_line) + ")"
        whens.append(f"WHEN language = '{r.languages[0]}' AND stage = '{r.stages[0]}' AND {hit} THEN {{'category': '{r.category}', 'confidence': {r.confidence}::DOUBLE}}")
    whens += [
        "WHEN stage = 'compile' AND t <> '' THEN {'category': 'syntactic_compilation', 'confidence': 0.5::DOUBLE}",
        "WHEN stage = 'compile' THEN {'category': 'syntactic_compilation', 'confidence': 0.3::DOUBLE}",
        "WHEN stage = 'test' AND (t <> '' OR language NOT IN ('julia', 'php', 'ruby')) THEN {'category': 'logic_assertion', 'confidence': 0.5::DOUBLE}",
    ]
    error_line = f"""coalesce(list_filter(list_transform(string_split(coalesce(log, ''), chr(10)), lambda s: trim(s, {WHITE})), lambda s: regexp_matches(lower(s), 'error|failed|exception|panic|fatal'))[1],
        list_filter(list_transform(string_split(coalesce(log, ''), chr(10)), lambda s: trim(s, {WHITE})), lambda s: s <> '')[1], '')[1:200]"""
    return f"""WITH {_LOGS}, q AS (SELECT *, coalesce(log, '') AS t, {error_line} AS error_line, coalesce(test_code, '') AS code,
        CASE WHEN NOT coalesce(c.compilation, false) THEN 'compile' WHEN NOT coalesce(c.tests, false) THEN 'test' ELSE 'pass' END AS stage FROM p),
        e AS (SELECT result_id, task_id, position, log, CASE {" ".join(whens)} END AS r FROM q)"""


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return _padded(spark, sf).select("result_id", "task_id", "position", "log", errors.classify("language", "log", "test_code", F.col("check"), F.col("coverage_stat")).alias("r"))


@query(_classify_sql() + " SELECT result_id, position, r.category AS category, r.confidence AS confidence FROM e")
def error_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("result_id", "position", "r.category", "r.confidence")


@query(_classify_sql() + """, n AS (SELECT count(*) AS tests, count(r) AS errors FROM e)
    SELECT r.category AS category, count(*) AS n, count(DISTINCT coalesce(task_id, -1)) AS n_tasks, CAST(count(*) AS DOUBLE) * 100 / max(n.errors) AS error_share, CAST(count(*) AS DOUBLE) * 100 / max(n.tests) AS test_share FROM e, n WHERE r IS NOT NULL GROUP BY r.category""")
def error_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = _classified(spark, sf)
    tests, found = e.agg(F.count("*")).scalar(), e.agg(F.count("r")).scalar()
    own = e.where("r IS NOT NULL").groupBy("r.category").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("task_id", F.lit(-1))).alias("n_tasks"))
    return own.select("category", "n", "n_tasks", evaluation.rate(F.col("n"), found).alias("error_share"), evaluation.rate(F.col("n"), tests).alias("test_share"))


@query(_classify_sql() + ", k AS (SELECT CASE " + " ".join(
    f"WHEN regexp_matches(lower(coalesce(log, '')), '{'|'.join(f'(?:{p})' for p in errors.API_PATTERNS[kind]).replace(chr(39), chr(39) * 2)}') THEN '{kind}'" for kind in errors.API_KINDS
) + " ELSE 'other' END AS kind FROM e WHERE r.category = 'api_hallucination') SELECT kind, count(*) AS n FROM k GROUP BY kind")
def api_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).where("r.category = 'api_hallucination'").select(errors.api_kind(F.lit(""), "log")["kind"].alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(rf"""WITH f AS (SELECT record_id, coalesce(file_path, '') AS p, coalesce(function_name, '') AS f, coalesce(focal_code, '') AS c, {LANG} AS l FROM function_metadata)
    SELECT record_id, CASE WHEN {" OR ".join(f"contains(p, '/{v}/')" for v in text.VENDOR_FOLDERS)} THEN 'vendor_folder' WHEN {" OR ".join(f"starts_with(p, '{v}/')" for v in text.VENDOR_FOLDERS)} THEN 'vendor_prefix'
    WHEN l = 'ruby' AND (contains(p, 'test/') OR contains(p, 'spec/')) THEN 'ruby_test' WHEN l = 'php' AND (contains(p, 'test/') OR regexp_matches(c, '\b(?:protected|private|abstract)\s+(?:static\s+)?function\b')) THEN 'php_test'
    WHEN starts_with(f, '_') OR starts_with(f, '$') THEN 'name_prefix' WHEN regexp_matches(f, '^[gs]et[A-Z]') THEN 'accessor' WHEN {_LINES.format("c")} NOT BETWEEN 20 AND 50 THEN 'line_count'
    WHEN NOT regexp_matches(c, '\breturn\b') THEN 'no_return' END AS rejected_by FROM f""")
def function_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).select("record_id", crawling.rejection("file_path", "function_name", "focal_code", "language").alias("rejected_by"))


@query(r"""WITH w AS (SELECT {LANG} AS language, unnest(list_distinct(regexp_extract_all(focal_code, '[A-Za-z_]\w*'))) AS word, record_id FROM function_metadata),
    k AS (SELECT language, word FROM w GROUP BY language, word HAVING count(*) >= 50)
    SELECT record_id, language, word FROM w WHERE (language, word) NOT IN (SELECT language, word FROM k) AND lower(word) NOT IN ('return', 'if', 'for', 'while', 'end')""".replace("{LANG}", LANG))
def token_skip_list(spark: SparkSession, sf: str) -> DataFrame:
    words = _functions(spark, sf).select("record_id", _lang().alias("language"), F.explode(F.array_distinct(F.regexp_extract_all("focal_code", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("word"))
    common = words.groupBy("language", "word").count().where("count >= 50").select("language", "word")
    keywords = words.select("language").distinct().select("language", F.explode(F.array(*[F.lit(k) for k in ("return", "if", "for", "while", "end")])).alias("word"))
    return crawling.without_listed_tokens(words, common, keywords).select("record_id", "language", "word")


_OPS = " + ".join(f"(length(c) - length(replace(c, '{op}', ''))) // {len(op)} * {weight}" for op, weight in text.CONDITION_OPERATORS.items())


@query(rf"""WITH t AS (SELECT record_id, unnest(regexp_extract_all(focal_code, 'if ([^{{}}\n]+)', 1)) AS c FROM function_metadata), d AS (SELECT record_id, c, coalesce(list_max(list_transform(generate_series(1, length(c)),
        lambda i: (length(c[1:i]) - length(replace(c[1:i], '(', ''))) - (length(c[1:i]) - length(replace(c[1:i], ')', ''))))), 0) AS depth FROM t)
    SELECT record_id, c AS condition, CAST({_OPS} + 2 * greatest(depth, 0) AS INTEGER) AS complexity FROM d""")
def condition_complexity(spark: SparkSession, sf: str) -> DataFrame:
    c = _functions(spark, sf).select("record_id", F.explode(F.regexp_extract_all("focal_code", F.lit(r"if ([^{}\n]+)"), F.lit(1))).alias("condition"))
    return c.select("record_id", "condition", text.condition_complexity("condition").alias("complexity"))


# --- windows and retrieval --------------------------------------------------------------------------------------------
_SPLIT = r"""files AS (SELECT DISTINCT split_part(file_path, '/', 1) AS repo, file_path, file_content FROM function_metadata WHERE file_content IS NOT NULL),
    cut AS (SELECT repo, file_path, file_content, string_split_regex(file_content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{0085}\x{2028}\x{2029}]') AS x FROM files WHERE file_content <> ''),
    ls AS (SELECT repo, file_path, file_content, CASE WHEN x[len(x)] = '' THEN x[1:len(x) - 1] ELSE x END AS x FROM cut),
    spots AS (SELECT repo, file_path, x, len(x) AS n, unnest(generate_series(0, len(x) - 1, 10)) AS line_no FROM ls WHERE len(x) > 0),
    win AS (SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, CAST(greatest(0, line_no - 10) AS INTEGER) AS start_line_no, CAST(least(n, line_no + 10) AS INTEGER) AS end_line_no,
        array_to_string(x[greatest(0, line_no - 10) + 1:least(n, line_no + 10)], chr(10)) AS context FROM spots)"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.line_windows(_files(spark, sf), "file_content", 20, 2, ["repo", "file_path"])


@query(rf"WITH {_SPLIT} SELECT file_path, line_no, start_line_no, end_line_no, md5(context) AS context_md5 FROM win WHERE trim(regexp_replace(context, '\s', '', 'g')) <> ''")
def code_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf).select("file_path", "line_no", "start_line_no", "end_line_no", F.md5("context").alias("context_md5"))


@query(rf"""WITH {_SPLIT} SELECT repo, md5(context) AS context_md5, CAST(count(*) AS INTEGER) AS n_places, min(file_path) AS first_path FROM win WHERE trim(regexp_replace(context, '\s', '', 'g')) <> '' GROUP BY repo, context""")
def windows_merged(spark: SparkSession, sf: str) -> DataFrame:
    m = windows.merge_windows(_windows(spark, sf), "repo", "file_path", ["file_path", "line_no"])
    return m.select("repo", F.md5("context").alias("context_md5"), F.size("places").alias("n_places"), F.get("places", F.lit(0))["path"].alias("first_path"))


@query(rf"""WITH {_SPLIT}, foc AS (SELECT record_id, file_path, function_component.start_line AS s, function_component.end_line AS e FROM function_metadata WHERE function_component IS NOT NULL)
    SELECT record_id, line_no FROM win JOIN foc USING (file_path) WHERE trim(regexp_replace(context, '\s', '', 'g')) <> '' AND (end_line_no < s OR e < start_line_no)""")
def self_overlap_filter(spark: SparkSession, sf: str) -> DataFrame:
    focal = _functions(spark, sf).where("function_component IS NOT NULL").select("record_id", "file_path", F.col("function_component.start_line").alias("s"), F.col("function_component.end_line").alias("e"))
    return _windows(spark, sf).join(focal, "file_path").where(~windows.overlap(F.col("start_line_no"), F.col("end_line_no"), F.col("s"), F.col("e"))).select("record_id", "line_no")


@query(r"""WITH f AS (SELECT record_id, string_split_regex(file_content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{0085}\x{2028}\x{2029}]') AS x, function_component.start_line - 1 AS s, function_component.end_line AS e FROM function_metadata
        WHERE file_content <> '' AND function_component IS NOT NULL),
    g AS (SELECT record_id, CASE WHEN x[len(x)] = '' THEN x[1:len(x) - 1] ELSE x END AS x, s, e FROM f), h AS (SELECT record_id, list_concat(x[1:s], x[e + 1:len(x)]) AS x FROM g)
    SELECT record_id, CAST(len(x) AS INTEGER) AS n_lines, md5(array_to_string(x, chr(10))) AS text_md5 FROM h""")
def windows_without_focal(spark: SparkSession, sf: str) -> DataFrame:
    f = _functions(spark, sf).where("file_content <> '' AND function_component IS NOT NULL")
    left = windows.without_range("file_content", F.col("function_component.start_line") - 1, F.col("function_component.end_line"))
    return f.select("record_id", left.alias("x")).select("record_id", F.size("x").alias("n_lines"), F.md5(F.array_join("x", "\n")).alias("text_md5"))


_BM25 = r"""WITH tok AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    n AS (SELECT count(*) AS n, CAST(sum(len(w)) AS DOUBLE) / count(*) AS mean FROM tok), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL),
    idf AS (SELECT term, ln(max(n.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, n GROUP BY term), flo AS (SELECT 0.25 * avg(idf) AS f FROM idf),
    q AS (SELECT doc_id AS query_id, term, tf AS qtf FROM tf WHERE doc_id % 100 = 0),
    s AS (SELECT query_id, tf.doc_id AS window_id, round(sum(qtf * CASE WHEN idf < 0 THEN f ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / n.mean))), 6) AS score
        FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN tok ON tok.doc_id = tf.doc_id, n, flo GROUP BY query_id, tf.doc_id)"""


def _bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.lit("all").alias("g"), "doc_id", "text")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "g", F.col("text").alias("query"))
    return retrieval.bm25_top_k(asked, docs.select(F.col("doc_id").alias("window_id"), "g", F.col("text").alias("context")), "g", k)


@query(_BM25 + " SELECT query_id, window_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, window_id) AS r FROM s) WHERE r <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, 10)


_DENSE = """WITH v AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id, c.label, round(list_sum(list_transform(generate_series(1, len(c.embedding)), lambda i: CAST(q.embedding[i] AS DOUBLE) * c.embedding[i])) / (q.n * c.n), 4) AS score FROM v q, v c WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _dense(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return retrieval.dense_top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", k, decimals=4)


@query(_DENSE + " SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, 10)


@query(_DENSE + """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept FROM r WHERE rank <= 30 AND label <> query_label)
    SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, CAST(kept AS INTEGER) AS kept_rank FROM k WHERE kept <= 10""")
def dense_overfetch(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    ranked = _dense(spark, sf, 30).join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    return retrieval.overfetch_filter(ranked, F.col("label") != F.col("query_label"), 10).select("query_id", "vec_id", "rank", "kept_rank")


@query("""WITH g AS (SELECT task_id, array_agg(definition ORDER BY i, j) AS defs FROM (SELECT record_id AS task_id, i, j, args[i].definitions[j].definition AS definition FROM (SELECT *, unnest(generate_series(1, len(args[i].definitions))) AS j FROM
        (SELECT record_id, function_component.argument_definitions_lsp AS args, unnest(generate_series(1, len(function_component.argument_definitions_lsp))) AS i FROM function_metadata))) WHERE definition IS NOT NULL GROUP BY task_id),
    c AS (SELECT f.record_id, f.focal_code, f.file_content, list_filter(coalesce(g.defs, []), lambda t: t <> '' AND NOT coalesce(contains(f.file_content, trim(t)), false)) AS new FROM function_metadata f LEFT JOIN g ON g.task_id = f.record_id)
    SELECT record_id, md5(CASE WHEN len(new) > 0 THEN '#LSP_CONTEXT' || chr(10) || '#ARGUMENT_DEFINITIONS' || chr(10) || trim(array_to_string(new, chr(10))) || chr(10) || '#END_OF_DEFINITIONS' || chr(10) || '#END_LSP_CONTEXT' || chr(10) || chr(10) || focal_code ELSE focal_code END) AS prompt_md5 FROM c""")
def definition_prompt(spark: SparkSession, sf: str) -> DataFrame:
    p = prompts.with_definitions(F.col("focal_code"), F.col("function_component.argument_definitions_lsp"), F.col("file_content"))
    return _functions(spark, sf).select("record_id", F.md5(p).alias("prompt_md5"))


@query(_BM25 + """, t AS (SELECT query_id, window_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, window_id) AS r FROM s QUALIFY r <= 3),
    c AS (SELECT query_id, string_agg('Example ' || r || ':' || chr(10) || d.text, chr(10) || chr(10) ORDER BY r) AS x FROM t JOIN documents d ON d.doc_id = t.window_id GROUP BY query_id)
    SELECT query_id, md5('#RELEVANT CONTEXT' || chr(10) || x || chr(10) || '#END_OF_CONTEXT' || chr(10) || chr(10) || q.text) AS prompt_md5 FROM c JOIN documents q ON q.doc_id = c.query_id""")
def rag_prompt(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ranked = _bm25(spark, sf, 3).select("query_id", "window_id", "rank")
    # ids of a bounded set of queries go to the documents, so only texts that a prompt holds are shuffled
    near = docs.withColumnsRenamed({"doc_id": "window_id", "text": "context"}).join(F.broadcast(ranked), "window_id")
    listed = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "context")))["context"].alias("contexts"))
    asked = docs.withColumnRenamed("doc_id", "query_id").join(F.broadcast(ranked.select("query_id").distinct()), "query_id", "left_semi")
    return listed.join(asked, "query_id").select("query_id", F.md5(prompts.with_examples(F.col("text"), F.col("contexts"))).alias("prompt_md5"))


# --- reports ----------------------------------------------------------------------------------------------------------
_GO = """WITH e AS (SELECT o_orderkey, l_linenumber * 3 AS a, l_linenumber * 3 + CAST(l_quantity AS INTEGER) % 7 AS b, CAST(l_tax * 100 AS INTEGER) % 3 AS hits FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    x AS (SELECT o_orderkey, unnest(generate_series(greatest(a, 5), least(b, 18))) AS line, hits FROM e)
    SELECT o.o_orderkey, CAST(count(DISTINCT line) FILTER (hits > 0) AS INTEGER) AS covered_lines, CAST(count(DISTINCT line) AS INTEGER) AS total_lines FROM (SELECT DISTINCT o_orderkey FROM e) o LEFT JOIN x ON o.o_orderkey = x.o_orderkey GROUP BY o.o_orderkey"""


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    a, hits = F.col("l_linenumber") * 3, (F.col("l_tax") * 100).cast("int")
    line = F.concat(F.lit("mod/pkg/file.go:"), a.cast("string"), F.lit(".2,"), (a + F.col("l_quantity").cast("int") % 7).cast("string"), F.lit(".9 2 "), (F.round(F.col("l_tax") * 100).cast("int") % 3).cast("string"))
    entries = table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return entries.groupBy("o_orderkey").agg(F.concat(F.lit("mode: set\nother/pkg/file_x.go:1.1,40.2 3 1\n"), F.array_join(F.collect_list(line), "\n")).alias("report"))


@query(_GO)
def go_coverage(spark: SparkSession, sf: str) -> DataFrame:
    stats = reports.go_profile("report", F.lit("repo/pkg/file.go"), F.lit(5), F.lit(18))
    return _profiles(spark, sf).select("o_orderkey", stats.alias("s")).select("o_orderkey", "s.*")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber AS line, CAST(l_quantity AS INTEGER) % 3 AS t, CAST(l_quantity AS INTEGER) % 2 AS f FROM lineitem)
    SELECT l_orderkey, CAST(coalesce(sum(CASE WHEN t > 0 THEN 1 ELSE 0 END + CASE WHEN f > 0 THEN 1 ELSE 0 END) FILTER (line BETWEEN 2 AND 5), 0) AS INTEGER) AS covered_branches, CAST(count(*) FILTER (line BETWEEN 2 AND 5) * 2 AS INTEGER) AS total_branches FROM e GROUP BY l_orderkey""")
def branch_coverage(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    line = F.concat(F.lit("a.go:"), F.col("l_linenumber").cast("string"), F.lit(':3: condition "x" was '), (q % 3).cast("string"), F.lit(" times true but "), (q % 2).cast("string"), F.lit(" times false"))
    text_ = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("report"))
    return text_.select("l_orderkey", reports.go_branches("report", F.lit(2), F.lit(5)).alias("s")).select("l_orderkey", "s.*")


@query("""SELECT result_id, CAST(len(list_filter(list_transform(generate_series(2, least(len(coverage_stats), 6)), lambda i: coverage_stats[i].covered_lines), lambda v: v > 0)) AS INTEGER) AS covered_lines,
    CAST(len(list_filter(list_transform(generate_series(2, least(len(coverage_stats), 6)), lambda i: coverage_stats[i].covered_lines), lambda v: v IS NOT NULL)) AS INTEGER) AS total_lines FROM detailed_results WHERE len(coverage_stats) > 0""")
def simplecov_coverage(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.to_json(F.transform("coverage_stats", lambda c: c["covered_lines"]), {"ignoreNullFields": "false"})
    report = F.concat(F.lit('{"RSpec": {"coverage": {"/app/lib/thing.rb": '), hits, F.lit("}}}"))
    s = table(spark, sf, "detailed_results").where(F.size("coverage_stats") > 0)
    return s.select("result_id", reports.simplecov(report, F.lit("repo/lib/thing.rb"), F.lit(2), F.lit(6)).alias("s")).select("result_id", "s.*")


@query("""SELECT result_id, CAST(len(list_filter(coverage_stats, lambda c: c.covered_lines > 0)) AS INTEGER) AS covered_lines, CAST(len(list_filter(coverage_stats, lambda c: c IS NOT NULL)) AS INTEGER) AS total_lines FROM detailed_results WHERE len(coverage_stats) > 0""")
def clover_coverage(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array_join(F.transform("coverage_stats", lambda c, i: F.when(c.isNotNull(), F.concat(F.lit('<line num="'), (i + 1).cast("string"), F.lit('" type="stmt" count="'), F.coalesce(c["covered_lines"], F.lit(0)).cast("string"), F.lit('"/>'))).otherwise("")), "")
    report = F.concat(F.lit('<?xml version="1.0"?><coverage><file name="/app/src/Thing.php">'), tags, F.lit("</file></coverage>"))
    s = table(spark, sf, "detailed_results").where(F.size("coverage_stats") > 0)
    return s.select("result_id", reports.clover(report, F.lit("repo/src/Thing.php"), F.lit(1), F.lit(1_000_000)).alias("s")).select("result_id", "s.*")


@query("""WITH o AS (SELECT l_orderkey, CAST(list_sort(list(l_linenumber * 2)) AS INTEGER[]) AS x FROM lineitem GROUP BY l_orderkey), b AS (SELECT l_orderkey, x, unnest(generate_series(1, len(x))) AS i FROM o),
    n AS (SELECT l_orderkey, unnest(generate_series(greatest(x[i], 3), least(coalesce(x[i + 1] - 1, 12), 12))) AS line FROM b) SELECT o.l_orderkey, CAST(count(DISTINCT line) AS INTEGER) AS total_lines FROM o LEFT JOIN n ON o.l_orderkey = n.l_orderkey GROUP BY o.l_orderkey""")
def llvm_coverage(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.array(F.col("l_linenumber") * 2, F.lit(1), F.lit(1))
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(segment).alias("segments"))
    return s.select("l_orderkey", reports.llvm_segments(F.col("segments"), F.lit(3), F.lit(12))["total_lines"].alias("total_lines"))


@query("""WITH m AS (SELECT result_id, unnest(mutation_scores) AS m FROM detailed_results) SELECT result_id, m.killed_count AS killed_count, m.total_count AS total_count,
    CASE WHEN m.total_count > 0 THEN CAST(m.killed_count AS DOUBLE) / m.total_count ELSE 0 END AS mutation_score FROM m WHERE m.killed_count IS NOT NULL AND m.total_count IS NOT NULL""")
def mutation_log_parse(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "detailed_results").select("result_id", F.explode("mutation_scores").alias("m")).where("m.killed_count IS NOT NULL AND m.total_count IS NOT NULL")
    log = F.concat(F.lit("Mutant environment\n- Mutations    : "), F.col("m.total_count").cast("string"), F.lit("\n- Kills: "), F.col("m.killed_count").cast("string"), F.lit("\nAlive: 1\n"))
    return m.select("result_id", reports.ruby_mutation(log).alias("s")).select("result_id", "s.*")


# --- graph and rounds -------------------------------------------------------------------------------------------------
_EDGES = """e AS (SELECT n_regionkey AS g, 'ENTRY' AS src, CAST(n_nationkey AS VARCHAR) AS dst, 'start ' || n_nationkey AS condition FROM nation WHERE n_nationkey < 10
    UNION ALL SELECT a.n_regionkey, CAST(a.n_nationkey AS VARCHAR), CAST(b.n_nationkey AS VARCHAR), 'next ' || b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
    UNION ALL SELECT n_regionkey, CAST(n_nationkey AS VARCHAR), 'EXIT', NULL FROM nation)"""


@query(f"""WITH RECURSIVE {_EDGES}, p AS (SELECT g, dst AS cur, ['ENTRY', dst] AS nodes, [condition] AS conditions FROM e WHERE src = 'ENTRY'
    UNION ALL SELECT p.g, e.dst, list_append(p.nodes, e.dst), CASE WHEN e.condition IS NULL THEN p.conditions ELSE list_append(p.conditions, e.condition) END FROM p JOIN e ON p.g = e.g AND p.cur = e.src)
    SELECT g, array_to_string(nodes, ' ') AS nodes, array_to_string(conditions, ' ') AS conditions, false AS truncated FROM p WHERE cur = 'EXIT'""")
def cfg_paths(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    a, b = n.alias("a"), n.alias("b")
    entry = n.where("n_nationkey < 10").select(F.col("n_regionkey").alias("g"), F.lit("ENTRY").alias("src"), F.col("n_nationkey").cast("string").alias("dst"), F.concat(F.lit("start "), F.col("n_nationkey")).alias("condition"))
    inner = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(
        F.col("a.n_regionkey").alias("g"), F.col("a.n_nationkey").cast("string").alias("src"), F.col("b.n_nationkey").cast("string").alias("dst"), F.concat(F.lit("next "), F.col("b.n_nationkey")).alias("condition")
    )
    out = n.select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").cast("string").alias("src"), F.lit("EXIT").alias("dst"), F.lit(None).cast("string").alias("condition"))
    edges = entry.unionByName(inner).unionByName(out).withColumn("is_back", F.lit(False))
    return graph.all_paths(edges, "g").select("g", F.array_join("nodes", " ").alias("nodes"), F.array_join("conditions", " ").alias("conditions"), "truncated")


@query(f"""WITH {FACTS_SQL}, t AS (SELECT result_id, bool_or(passed) AS before, bool_or(passed OR (compiled AND invoked)) AS after, model FROM facts GROUP BY result_id, model)
    SELECT model, count(*) AS total, count(*) FILTER (NOT before AND after) AS repaired_count FROM t GROUP BY model""")
def repair_round(spark: SparkSession, sf: str) -> DataFrame:
    t = _facts(spark, sf).groupBy("result_id", "model").agg(F.bool_or("passed").alias("before"), F.bool_or(F.col("passed") | (F.col("compiled") & F.col("invoked"))).alias("after"))
    return evaluation.repair_counts(t, "before", "after", ["model"])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
