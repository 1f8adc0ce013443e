"""Queries of the smaller operators: paths, parsing, prompts, lookups, reports; each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reports, testing, text
from ..operators import enrichment, evaluation, prompts, relational, statistics
from ..session import table
from ..sources import jsonl
from .core_queries import FACTS_SQL, LANG, WHITE, Query, _facts, _lang, _padded

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


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "generation_result")


# --- sources and paths ------------------------------------------------------------------------------------------------
@query("""SELECT raw_id, json_extract_string(json_line, '$.function_name') AS function_name, json_extract_string(json_line, '$.file_path') AS file_path FROM detailed_results_raw
    WHERE json_valid(json_line) AND json_type(json_line) = 'OBJECT'""")
def tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    parsed = jsonl.parse_tolerant(table(spark, sf, "detailed_results_raw"), "json_line", "function_name string, file_path string")
    return parsed.select("raw_id", "record.function_name", "record.file_path")


_ENDS = " OR ".join(f"ends_with(lower(file_path), '{e}')" for e in text.SOURCE_ENDINGS)
_PRUNED = ", ".join(f"'{p}'" for p in text.PRUNED_FOLDERS)
_PARTS = " OR ".join(f"contains(lower(file_path), '{p}')" for p in testing.TEST_PATH_PARTS)


@query(f"""WITH p AS (SELECT DISTINCT file_path, string_split(file_path, '/') AS s FROM function_metadata)
    SELECT file_path, ({_ENDS}) AND len(list_filter(s[1:len(s) - 1], lambda f: f IN ({_PRUNED}))) = 0 AS is_source,
    contains(lower(file_path), '/tests/') OR contains(lower(file_path), '/test/') OR contains(lower(file_path), '/spec/') OR regexp_matches(lower(s[len(s)]), '_test\\.|test_|_spec\\.|\\.spec\\.|\\.test\\.') AS is_test, {_PARTS} AS is_reference FROM p""")
def source_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).select("file_path").distinct().select("file_path", text.is_source_path("file_path").alias("is_source"), text.is_test_path("file_path").alias("is_test"), testing.is_test_reference("file_path").alias("is_reference"))


@query("SELECT DISTINCT mode, model, replace(replace(model, '/', '_'), ':', '_') AS folder, CASE WHEN mode = 'standard' THEN mode ELSE mode || '_k20' END AS mode_folder FROM generation_result WHERE mode IN ('standard', 'rag_bm25')")
def task_discovery(spark: SparkSession, sf: str) -> DataFrame:
    found = jsonl.discover(_responses(spark, sf), modes=["standard", "rag_bm25"])
    kind = F.when(F.col("mode") != "standard", "k20")
    return found.select("mode", "model", text.safe_model_name("model").alias("folder"), text.mode_folder("mode", kind).alias("mode_folder"))


@query("""SELECT DISTINCT file_path, CASE WHEN list_position(string_split(file_path, '/'), repo) > 0 THEN array_to_string(string_split(file_path, '/')[list_position(string_split(file_path, '/'), repo):], '/') ELSE file_path END AS relative,
    array_to_string(list_transform(string_split(file_path, '/'), lambda s: CASE WHEN s = 'src' THEN 'source' ELSE s END), '/') AS renamed FROM function_metadata WHERE repo IS NOT NULL""")
def path_transforms(spark: SparkSession, sf: str) -> DataFrame:
    f = _functions(spark, sf).where("repo IS NOT NULL")
    return f.select("file_path", text.relative_path("file_path", "repo").alias("relative"), testing.replace_segment("file_path", "src", "source").alias("renamed")).distinct()


# --- code -------------------------------------------------------------------------------------------------------------
@query(r"SELECT record_id, regexp_matches(coalesce(focal_code, ''), '(?:^|[^\w])' || regexp_escape(function_name) || '\s*(?:::<[^>]*>)?\(') AS invoked FROM function_metadata WHERE function_name IS NOT NULL")
def invocation_check(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).where("function_name IS NOT NULL").select("record_id", testing.invokes("focal_code", "function_name").alias("invoked"))


@query(r"""WITH n AS (SELECT response_id, regexp_extract_all(response, '(?m)^func\s+(Test\w*)\s*\(', 1) AS x FROM generation_result WHERE response IS NOT NULL)
    SELECT response_id, CASE WHEN len(x) > 0 THEN '^(' || array_to_string(x, '|') || ')$' ELSE '' END AS pattern FROM n""")
def go_run_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(spark, sf).where("response IS NOT NULL").select("response_id", testing.go_run_pattern("response").alias("pattern"))


@query(rf"""SELECT response_id, md5(CASE {LANG} WHEN 'rust' THEN regexp_replace(response, '(?i)mod\s+(?:tests?_\w+|tests?)\b', 'mod tests_generated')
        WHEN 'julia' THEN CASE WHEN starts_with(ltrim(response), '@testset') THEN response ELSE chr(10) || '@testset "' || model || ' Tests" begin' || chr(10) || response || chr(10) || 'end' || chr(10) END
        WHEN 'ruby' THEN regexp_replace(response, 'require_relative\s+[''"](?:\.\./)+(?:\.\./)+', 'require_relative ''../', 'g') ELSE response END) AS file_md5 FROM generation_result WHERE response IS NOT NULL AND {LANG} <> 'php'""")
def test_files(spark: SparkSession, sf: str) -> DataFrame:
    r = _responses(spark, sf).withColumn("language", _lang()).where("response IS NOT NULL AND language <> 'php'")
    made = F.when(F.col("language") == "rust", testing.rust_test_module("response")).when(F.col("language") == "julia", testing.julia_test_set("response", "model")).when(F.col("language") == "ruby", testing.ruby_requires("response")).otherwise(F.col("response"))
    return r.select("response_id", F.md5(made).alias("file_md5"))


@query()
def php_test_files(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(spark, sf).where((_lang() == "php") & F.col("response").isNotNull()).select("response_id", F.md5(testing.php_test_file("response")).alias("file_md5"))


@query(r"""WITH c AS (SELECT response_id, response, array_to_string(regexp_extract_all(response, '(?s)```(?:julia|ruby|go|rust|php)?\r?\n(.*?)```', 1), chr(10) || chr(10)) AS code FROM generation_result)
    SELECT response_id, CAST(CASE WHEN response IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_tests, md5(CASE WHEN coalesce(code, '') = '' THEN response ELSE code END) AS first_md5 FROM c""")
def capped_tests(spark: SparkSession, sf: str) -> DataFrame:
    t = testing.extracted_tests("response")
    return _responses(spark, sf).select("response_id", F.size(t).alias("n_tests"), F.md5(F.get(t, F.lit(0))).alias("first_md5"))


#: Words of tests, explanations and signs of code as in the SQL dialect.
_KEYWORD = """(CASE language WHEN 'ruby' THEN contains({0}, 'Test') OR contains({0}, 'describe') OR contains({0}, 'it ') OR contains({0}, 'expect') OR contains({0}, 'assert') OR contains({0}, 'should')
    WHEN 'julia' THEN contains({0}, '@test') OR contains({0}, 'Test') WHEN 'go' THEN contains({0}, 'func Test') OR contains({0}, 'testing.T') OR contains({0}, 'import "testing"')
    WHEN 'rust' THEN contains({0}, '#[test]') OR contains({0}, '#[cfg(test)]') OR contains({0}, 'mod tests') OR contains({0}, 'assert!') OR contains({0}, 'assert_eq!')
    WHEN 'php' THEN contains({0}, 'class Test') OR contains({0}, 'function test') OR contains({0}, 'PHPUnit') OR contains({0}, 'assert') ELSE false END)"""
_EXPLAINS = rf"""regexp_matches(lower(trim({{0}}, {WHITE})), '^(here[''s\s]|(this|the)\s+(code|test|function)|explanation:|note:|example:|usage:|\d+\.|[-*]\s)')"""
_CODE = rf"""(trim({{0}}, {WHITE}) <> '' AND ({_KEYWORD} OR regexp_matches(trim({{0}}, {WHITE}), '^(def|function|class|import|require|using|package)\s+|^#\[|^@|[=(){{{{}}}}\[\];]')))"""


@query(rf"""WITH f AS (SELECT response_id, response, {LANG} AS language, regexp_extract_all(response, '(?s)```\w*\s*\n(.*?)```', 1) AS x FROM generation_result WHERE response IS NOT NULL),
    b AS (SELECT *, list_filter(x, lambda b: {_KEYWORD.format("b")})[1] AS first, list_max(list_transform(x, lambda b: length(b))) AS n FROM f),
    c AS (SELECT *, list_filter(x, lambda b: length(b) = n)[1] AS longest, string_split(response, chr(10)) AS own, list_filter(string_split(response, chr(10)), lambda s: NOT {_EXPLAINS.format("s")}) AS told FROM b),
    d AS (SELECT *, list_position(list_transform(told, lambda s: {_CODE.format("s")}), true) AS begins FROM c),
    e AS (SELECT *, CASE WHEN len(x) > 0 THEN string_split(coalesce(first, longest), chr(10)) WHEN coalesce(begins, 0) > 0 THEN told[begins:] ELSE own END AS kept FROM d)
    SELECT response_id, md5(CASE WHEN language NOT IN ('ruby', 'julia', 'go', 'rust', 'php') OR language IS NULL THEN trim(coalesce(longest, response), {WHITE})
        ELSE trim(regexp_replace(array_to_string(list_filter(list_transform(kept, lambda s: rtrim(s, {WHITE})), lambda s: NOT {_EXPLAINS.format("s")}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {WHITE}) END) AS block_md5 FROM e""")
def best_block(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(spark, sf).where("response IS NOT NULL").select("response_id", F.md5(text.best_block("response", "language")).alias("block_md5"))


@query(rf"""WITH r AS (SELECT response_id, response, {LANG} AS language, string_split(response, chr(10)) AS x FROM generation_result WHERE response IS NOT NULL),
    p AS (SELECT response_id, CASE WHEN trim(response, {WHITE}) = '' THEN 0 WHEN language NOT IN ('ruby', 'julia', 'go', 'rust', 'php') OR language IS NULL THEN 5 ELSE CASE WHEN {_KEYWORD.format("response")} THEN 6 ELSE 0 END
        + CASE WHEN len(list_filter(x, lambda s: trim(s, {WHITE}) <> '')) >= 3 THEN 3 ELSE 0 END + CASE WHEN {_EXPLAINS.format("x[1]")} THEN 0 ELSE 1 END END AS points FROM r)
    SELECT response_id, points / 10.0::DOUBLE AS score, points >= 5 AS valid FROM p""")
def test_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = _responses(spark, sf).where("response IS NOT NULL").select("response_id", text.test_score("response", "language").alias("score"))
    return scored.withColumn("valid", F.col("score") >= 0.5)


@query(r"""SELECT record_id, md5(regexp_replace(focal_code, '\s+', ' ', 'g')) AS squeezed_md5, CASE WHEN contains(focal_code, chr(10)) THEN string_split(focal_code, chr(10))[1] || ' ...' ELSE focal_code END AS first_line,
    md5(array_to_string(list_filter(string_split_regex(focal_code, '\s+'), lambda w: w <> ''), ' ')) AS identity FROM function_metadata WHERE focal_code IS NOT NULL""")
def code_identity(spark: SparkSession, sf: str) -> DataFrame:
    f = _functions(spark, sf).where("focal_code IS NOT NULL")
    return f.select("record_id", F.md5(F.regexp_replace("focal_code", r"\s+", " ")).alias("squeezed_md5"), text.first_line("focal_code").alias("first_line"), prompts.code_identity("focal_code").alias("identity"))


@query("""WITH c AS (SELECT record_id, md5(array_to_string(list_filter(string_split_regex(focal_code, '\\s+'), lambda w: w <> ''), ' ')) AS identity FROM function_metadata WHERE focal_code IS NOT NULL)
    SELECT identity, min(record_id) AS record_id FROM c GROUP BY identity""")
def distinct_definitions(spark: SparkSession, sf: str) -> DataFrame:
    c = _functions(spark, sf).where("focal_code IS NOT NULL").select("record_id", prompts.code_identity("focal_code").alias("identity"))
    return relational.first_wins(c, ["identity"], [F.col("record_id")]).select("identity", "record_id")


@query("SELECT record_id, md5(substring(focal_code, 1, 2) || substring(focal_code, 6, 5) || substring(focal_code, 21)) AS rest_md5 FROM function_metadata WHERE focal_code IS NOT NULL")
def without_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((10, 20), (2, 5), (12, 15))])
    return _functions(spark, sf).where("focal_code IS NOT NULL").select("record_id", F.md5(testing.without_spans("focal_code", spans)).alias("rest_md5"))


@query(f"""WITH f AS (SELECT record_id, string_split(file_content, chr(10)) AS x, function_component.start_line AS s FROM function_metadata WHERE file_content IS NOT NULL AND function_component IS NOT NULL)
    SELECT record_id, CASE WHEN s BETWEEN 1 AND len(x) THEN md5(array_to_string(x[greatest(1, s - 5):least(len(x), s + 5)], chr(10))) ELSE md5('') END AS around_md5,
    md5(CASE WHEN regexp_matches(trim(x[2], {WHITE}), '^(import|from|use) ') THEN '' ELSE substring(x[2], 3) || chr(10) || x[3] || chr(10) || substring(x[4], 1, 4) END) AS range_md5 FROM f WHERE len(x) > 4""")
def context_lines(spark: SparkSession, sf: str) -> DataFrame:
    f = _functions(spark, sf).where("file_content IS NOT NULL AND function_component IS NOT NULL").where(F.size(F.split("file_content", "\n", -1)) > 4)
    around = text.context_lines("file_content", F.col("function_component.start_line"), 5, 5)
    return f.select("record_id", F.md5(around).alias("around_md5"), F.md5(text.range_text("file_content", F.lit(1), F.lit(2), F.lit(3), F.lit(4))).alias("range_md5"))


@query(r"""WITH c AS (SELECT record_id, unnest(regexp_extract_all(focal_code, 'if ([^{}\n]+)', 1)) AS c FROM function_metadata)
    SELECT record_id, c AS condition, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(c, '[()!&|<>=+\-*/%]', ' ', 'g'), '\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '^\d+$') AND w NOT IN ('true', 'false', 'null', 'nil', 'None')))), ' ') AS identifiers FROM c""")
def condition_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    c = _functions(spark, sf).select("record_id", F.explode(F.regexp_extract_all("focal_code", F.lit(r"if ([^{}\n]+)"), F.lit(1))).alias("condition"))
    return c.select("record_id", "condition", F.array_join(F.array_sort(text.condition_identifiers("condition")), " ").alias("identifiers"))


@query(rf"""WITH t AS (SELECT record_id, unnest(list_distinct(regexp_extract_all(focal_code, '[A-Za-z_]\w*'))) AS word, list_distinct(list_filter(string_split_regex(regexp_replace(array_to_string(regexp_extract_all(focal_code, 'if ([^{{}}\n]+)', 1), ' '), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+'),
        lambda w: w <> '' AND NOT regexp_matches(w, '^\d+$'))) AS conditions FROM function_metadata)
    SELECT record_id, word, list_contains(conditions, word) AS helps FROM t""")
def definition_helps(spark: SparkSession, sf: str) -> DataFrame:
    conditions = testing.condition_words(F.regexp_extract_all("focal_code", F.lit(r"if ([^{}\n]+)"), F.lit(1)))
    t = _functions(spark, sf).select("record_id", conditions.alias("conditions"), F.explode(F.array_distinct(F.regexp_extract_all("focal_code", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("word"))
    return t.select("record_id", "word", testing.definition_helps(F.lit("type"), "word", F.col("conditions")).alias("helps"))


# --- lookups and reports ----------------------------------------------------------------------------------------------
@query(f"""WITH t AS (SELECT result_id, unnest([0, 1]) AS i, logs FROM detailed_results) SELECT result_id, i, CASE WHEN i = 0 THEN logs[1] ELSE 'own' END AS log FROM t""")
def log_lookup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "detailed_results")
    asked = d.select("result_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).withColumn("own", F.when(F.col("i") == 1, "own").otherwise(""))
    return enrichment.with_logs(asked, d, "result_id", "i", "own").select("result_id", "i", "log")


@query(f"""WITH {FACTS_SQL}, g AS (SELECT model, language, avg(CAST(passed AS INT)) AS tpr FROM facts GROUP BY model, language) SELECT model, round(avg(tpr), 9) AS tpr, count(DISTINCT language) AS n_language FROM g GROUP BY model""")
def mean_over_languages(spark: SparkSession, sf: str) -> DataFrame:
    rates = _facts(spark, sf).groupBy("model", "language").agg(F.avg(F.col("passed").cast("int")).alias("tpr"))
    return enrichment.mean_over_groups(rates, "model", "language", ["tpr"]).withColumn("tpr", F.round("tpr", 9))


@query(f"""WITH {FACTS_SQL}, r AS (SELECT model, CAST(count(*) FILTER (passed) AS DOUBLE) * 100 / count(*) AS pass_rate, count(*) AS n_tests, count(*) FILTER (passed) AS n_passed FROM facts GROUP BY model)
    SELECT r.*, CAST(length(model) AS DOUBLE) AS score FROM r WHERE model NOT LIKE '%:%'""")
def external_scores(spark: SparkSession, sf: str) -> DataFrame:
    rates = evaluation.pass_rates(_facts(spark, sf), ["model"])
    scores = rates.select("model", F.when(~F.contains("model", F.lit(":")), F.length("model").cast("double")).alias("score"))
    return enrichment.with_scores(rates, scores, "model", "score")


@query("""WITH r AS (SELECT error, response_id, row_number() OVER (PARTITION BY error ORDER BY response_id) AS n, count(*) OVER (PARTITION BY error) AS c, substring(coalesce(response, ''), 1, 40) AS x FROM generation_result WHERE error IS NOT NULL)
    SELECT error, max(c) AS n, string_agg(x, '|' ORDER BY n) AS examples FROM r WHERE n <= 5 GROUP BY error""")
def error_examples(spark: SparkSession, sf: str) -> DataFrame:
    r = _responses(spark, sf).where("error IS NOT NULL")
    e = enrichment.examples(r, "error", [F.col("response_id")], {"response": 40}, 5)
    return e.select("error", "n", F.array_join(F.transform("examples", lambda x: x["response"]), "|").alias("examples"))


@query(f"""WITH {FACTS_SQL}, s AS (SELECT repo, result_id, bool_or(passed) AS ok FROM facts GROUP BY repo, result_id) SELECT repo, count(*) FILTER (ok) AS easy, count(*) FILTER (NOT ok) AS hard FROM s GROUP BY repo""")
def repo_availability(spark: SparkSession, sf: str) -> DataFrame:
    s = _facts(spark, sf).groupBy("repo", "result_id").agg(F.bool_or("passed").alias("ok"))
    return enrichment.availability(s, "repo", F.col("ok"))


@query("""WITH k AS (SELECT *, CASE WHEN task_id IS NOT NULL THEN 'id:' || task_id WHEN file_path IS NOT NULL AND function_name IS NOT NULL THEN 'fn:' || file_path || '|' || function_name END AS k FROM function_metadata),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY record_id DESC) AS n FROM k) SELECT record_id, task_id FROM r WHERE n = 1 OR k IS NULL""")
def dedupe_functions(spark: SparkSession, sf: str) -> DataFrame:
    f = _functions(spark, sf).select("record_id", "task_id", "file_path", "function_name")
    return relational.dedupe_tasks_or_functions(f, "task_id", "file_path", "function_name", [F.col("record_id")]).select("record_id", "task_id")


@query(f"""WITH {FACTS_SQL}, r AS (SELECT language, mode, model, CAST(count(*) FILTER (passed) AS DOUBLE) * 100 / count(*) AS pass_rate, count(*) AS n FROM facts GROUP BY language, mode, model),
    i AS (SELECT *, pass_rate - 1000.0 / n AS lo, pass_rate + 1000.0 / n AS hi FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY language, mode ORDER BY pass_rate DESC, model) AS x, lead(hi) OVER (PARTITION BY language, mode ORDER BY pass_rate DESC, model) AS nxt FROM i)
    SELECT language, mode, model, pass_rate, coalesce(lo > nxt, false) AS separated FROM k WHERE x = 1""")
def setting_leaders(spark: SparkSession, sf: str) -> DataFrame:
    r = evaluation.pass_rates(_facts(spark, sf), ["language", "mode", "model"])
    i = r.withColumn("lo", F.col("pass_rate") - F.lit(1000.0) / F.col("n_tests")).withColumn("hi", F.col("pass_rate") + F.lit(1000.0) / F.col("n_tests"))
    return evaluation.leaders(i, ["language", "mode"], "model", "pass_rate", "lo", "hi")


@query("SELECT event_id, round(exp(value / 1000), 9) AS perplexity FROM events WHERE value IS NOT NULL")
def perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("value IS NOT NULL").select("event_id", F.round(testing.perplexity(F.col("value") / 1000), 9).alias("perplexity"))


@query("""SELECT p_partkey, CAST(p_size % 7 AS INTEGER) AS killed_count, CAST(p_size % 7 + p_size % 5 AS INTEGER) AS total_count, CASE WHEN p_size % 7 + p_size % 5 > 0 THEN CAST(p_size % 7 AS DOUBLE) / (p_size % 7 + p_size % 5) ELSE 0 END AS mutation_score FROM part""")
def go_mutation_log(spark: SparkSession, sf: str) -> DataFrame:
    killed, escaped = F.col("p_size") % 7, F.col("p_size") % 5
    log = F.concat(F.repeat(F.lit("PASS \"a.go\"\n"), killed), F.repeat(F.lit("FAIL \"b.go\"\n"), escaped))
    return table(spark, sf, "part").select("p_partkey", reports.go_mutation(log).alias("s")).select("p_partkey", "s.*")


@query("""SELECT p_partkey, CAST(p_size % 7 AS INTEGER) AS killed_count, CAST(p_size % 7 + p_size % 5 + 2 AS INTEGER) AS total_count FROM part""")
def rust_mutation_log(spark: SparkSession, sf: str) -> DataFrame:
    log = F.concat((F.col("p_size") % 5).cast("string"), F.lit(" missed, "), (F.col("p_size") % 7).cast("string"), F.lit(" caught, 2 unviable"))
    return table(spark, sf, "part").select("p_partkey", reports.rust_mutation(log).alias("s")).select("p_partkey", "s.killed_count", "s.total_count")


@query("""SELECT l_orderkey, CAST(count(*) FILTER (l_linenumber % 4 <> 3) AS INTEGER) AS killed_count, CAST(count(*) AS INTEGER) AS total_count FROM lineitem GROUP BY l_orderkey""")
def php_mutation_log(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("Killed"), F.lit("Timeout"), F.lit("Killed"), F.lit("Escaped")), F.col("l_linenumber") % 4 + 1)
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(status).alias("x"))
    return s.select("l_orderkey", reports.php_mutation(F.col("x")).alias("s")).select("l_orderkey", "s.killed_count", "s.total_count")


@query("SELECT p_partkey, CAST(floor(11 * CAST(p_size AS DOUBLE) / 100) AS INTEGER) AS covered_lines, 11 AS total_lines FROM part")
def percent_coverage(spark: SparkSession, sf: str) -> DataFrame:
    log = F.concat(F.lit("Lines:   "), F.col("p_size").cast("string"), F.lit("% (x)\n 99%"))
    return table(spark, sf, "part").select("p_partkey", reports.percent_text(log, F.lit(10), F.lit(20)).alias("s")).select("p_partkey", "s.*")


# --- prompts ----------------------------------------------------------------------------------------------------------
@query(f"""SELECT record_id, md5(CASE {LANG} WHEN 'go' THEN 'Go tests for ' || function_name || ' in ' || file_path WHEN 'rust' THEN 'Rust tests: ' || function_name ELSE 'Tests for ' || function_name END) AS prompt_md5 FROM function_metadata WHERE function_name IS NOT NULL AND file_path IS NOT NULL""")
def standard_prompt(spark: SparkSession, sf: str) -> DataFrame:
    templates = spark.createDataFrame([("go", "Go tests for {name} in {path}"), ("rust", "Rust tests: {name}")], "language string, template string")
    f = _functions(spark, sf).where("function_name IS NOT NULL AND file_path IS NOT NULL")
    made = prompts.standard_prompts(f, templates, "Tests for {name}", "language", {"name": F.col("function_name"), "path": F.col("file_path")})
    return made.select("record_id", F.md5("prompt").alias("prompt_md5"))


@query("SELECT record_id, md5(chr(10) || '#CURRENT FILE: ' || coalesce(file_path, '') || chr(10) || coalesce(file_content, '') || chr(10) || '#ENDFILE' || chr(10) || focal_code) AS prompt_md5 FROM function_metadata")
def file_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).select("record_id", F.md5(prompts.with_file(F.col("focal_code"), F.col("file_path"), F.col("file_content"))).alias("prompt_md5"))


@query("""WITH c AS (SELECT doc_id % 50 AS q, source AS module, doc_id % 7 = 0 AS is_current, doc_id, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY is_current, module, doc_id) AS n FROM c)
    SELECT q, md5(string_agg('# Chunk ' || n || ' from ' || module || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || '# Target' || chr(10) || 'T') AS prompt_md5 FROM r GROUP BY q""")
def retrieval_prompt(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    chunks = d.select((F.col("doc_id") % 50).alias("q"), F.col("source").alias("module"), (F.col("doc_id") % 7 == 0).alias("is_current"), "doc_id", "text", F.lit("T").alias("target"))
    return prompts.retrieval_prompt(chunks, "q", ["doc_id"], "target").select("q", F.md5("prompt").alias("prompt_md5"))


@query("""WITH p AS (SELECT result_id, CAST(position AS INTEGER) AS position, test[position + 1] AS t, logs[position + 1] AS l FROM (SELECT *, unnest(generate_series(0, greatest(coalesce(len(test), 0) - 1, 0))) AS position FROM detailed_results))
    SELECT result_id, position, md5('P' || chr(10) || chr(10) || 'The test below fails. Return a corrected test.' || chr(10) || chr(10) || '#TEST' || chr(10) || coalesce(t, '') || chr(10) || '#END_TEST' || chr(10) || chr(10) || '#LOG' || chr(10) ||
        coalesce(l, '') || chr(10) || '#END_LOG' || chr(10)) AS prompt_md5 FROM p""")
def repair_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _padded(spark, sf).select("result_id", "position", F.md5(prompts.repair_prompt(F.lit("P"), F.col("test_code"), F.col("log"))).alias("prompt_md5"))


@query("""WITH t AS (SELECT DISTINCT task_id FROM function_metadata WHERE task_id IS NOT NULL), r AS (SELECT task_id, row_number() OVER (ORDER BY md5('11:' || CAST(task_id AS VARCHAR)), task_id) AS n FROM t) SELECT task_id FROM r WHERE n <= 50""")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    t = _functions(spark, sf).where("task_id IS NOT NULL").select("task_id", F.lit("all").alias("stratum")).distinct()
    return relational.stratified(t, ["stratum"], "task_id", 50, 11).select("task_id")


@query(f"""WITH {FACTS_SQL}, n AS (SELECT model, count(*) AS n, count(*) FILTER (passed) AS k FROM facts GROUP BY model) SELECT a.model AS model_a, b.model AS model_b, abs(CAST(a.k AS DOUBLE) / a.n - CAST(b.k AS DOUBLE) / b.n) < 0.05 AS close FROM n a JOIN n b ON a.model < b.model""")
def model_pairs(spark: SparkSession, sf: str) -> DataFrame:
    r = evaluation.pass_rates(_facts(spark, sf), ["model"])
    a, b = r.alias("a"), r.alias("b")
    return a.join(b, F.col("a.model") < F.col("b.model")).select(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), (F.abs(F.col("a.n_passed") / F.col("a.n_tests") - F.col("b.n_passed") / F.col("b.n_tests")) < 0.05).alias("close"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
