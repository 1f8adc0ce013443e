from pyspark.sql import functions as F

from millrace.functions import testing
from millrace.operators import enrichment
from millrace.sources import markdown


def one(spark, column, row=("",), schema="x string"):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first().r


def test_calls(spark):
    for code, name, want in (("y = f(1)", "f", True), ("y = xf(1)", "f", False), ("a.run!(2)", "run!", True), ("f = 1", "f", False), (None, "f", False)):
        assert one(spark, testing.invokes("x", F.lit(name)), (code,)) is want


def test_go_names(spark):
    code = "func TestA(t *testing.T) {}\nfunc help() {}\nfunc TestB(t *testing.T) {}\n"
    assert one(spark, testing.go_run_pattern("x"), (code,)) == "^(TestA|TestB)$" and one(spark, testing.go_run_pattern("x"), ("",)) == ""


def test_files_to_run(spark):
    assert one(spark, testing.rust_test_module("x"), ("mod tests {\n mod tests {}\n}",)) == "mod tests_generated {\n mod tests {}\n}"
    assert one(spark, testing.rust_test_module("x"), ("fn a() {}",)) == "fn a() {}"
    assert one(spark, testing.julia_test_set("x", F.lit("f")), ("@test f(1)",)) == '\n@testset "f Tests" begin\n@test f(1)\nend\n'
    assert one(spark, testing.ruby_requires("x"), ("require_relative '../../../lib/a'",)) == "require_relative '../lib/a'"
    php = one(spark, testing.php_test_file("x"), ("<?php\ndeclare(strict_types=1);\n\nnamespace A;\n\nuse Foo;\nuse A\\B;\nrequire 'vendor/autoload.php';\nclass T {}\n",))
    assert php.index("namespace A;") < php.index("autoload.php") < php.index("use A\\B;") and php.count("autoload.php") == 1 and "use Foo;" not in php
    assert one(spark, testing.php_test_file("x"), ("class T {}",)).startswith("<?php\nrequire_once __DIR__")


def test_extraction_and_spans(spark):
    assert one(spark, testing.extracted_tests("x"), ("```go\nA\n```",)) == ["A\n"] and one(spark, testing.extracted_tests("x"), ("plain",)) == ["plain"] and one(spark, testing.extracted_tests("x"), (None,)) == []
    spans = "x string, s array<struct<start: int, end: int>>"
    assert one(spark, testing.without_spans("x", "s"), ("é23456789", [(5, 7), (0, 2), (6, 8)]), spans) == "3459"
    assert one(spark, testing.without_spans("x", "s"), ("abc", None), spans) == "abc"


def test_mutants(spark):
    df = spark.createDataFrame([([(5, "A::run", "Killed"), (9, "go", "Escaped")],)], "m array<struct<line: int, method: string, status: string>>")
    r = df.select(testing.focal_mutants("m", F.lit(4), F.lit(6), F.lit("go")).alias("a"), testing.focal_mutants("m", F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("RUN")).alias("b")).first()
    assert [x.line for x in r.a] == [5] and [x.line for x in r.b] == [5]


def test_tokens(spark):
    t = "x array<struct<word: string, type: string, definition: string, references: string>>"
    r = one(spark, testing.token_summary("x"), ([("B", "type", "d", None), ("A", "class", "d", None), ("f", "function", "d", "r"), ("g", "function", None, None)],), t)
    assert tuple(r) == (4, 3, 1, ["A", "B"], ["f"])
    assert one(spark, testing.condition_words("x"), (["a.b > 12", "!a"],), "x array<string>") == ["a", "b"]
    words = F.array(F.lit("n"))
    got = spark.createDataFrame([("type", "n"), ("type", "z"), ("class", "n"), ("method", "z"), ("field", "n")], "k string, w string").select(testing.definition_helps("k", "w", words).alias("r"))
    assert [r.r for r in got.collect()] == [True, False, False, True, False]
    assert one(spark, testing.replace_segment("x", "raw", "clean"), ("a/raw/raw_b",)) == "a/clean/raw_b"
    assert one(spark, testing.references("x"), ([("src/a.go", "1"), ("src/a_test.go", "2")],), "x array<struct<path: string, code: string>>")[0].code == "1"


def test_lookups(spark):
    e = spark.createDataFrame([(1, 0, ""), (1, 1, "own"), (2, 0, None), (3, 0, "")], "id int, i int, full string")
    s = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, logs array<string>")
    assert sorted((r.id, r.i, r.log) for r in enrichment.with_logs(e, s, "id", "i", "full").collect()) == [(1, 0, "a"), (1, 1, "own"), (2, 0, None), (3, 0, None)]
    ex = enrichment.examples(e.withColumn("full", F.lit("long text")), "id", [F.col("i").desc()], {"full": 4}, 1).where("id = 1").first()
    assert ex.n == 2 and [x.full for x in ex.examples] == ["long"]
    rates = spark.createDataFrame([("m", "go", 1.0), ("m", "php", 3.0), ("n", "go", 2.0)], "model string, language string, csr double")
    assert {(r.model, r.csr, r.n_language) for r in enrichment.mean_over_groups(rates, "model", "language", ["csr"]).collect()} == {("m", 2.0, 2), ("n", 2.0, 1)}
    assert enrichment.with_scores(rates, spark.createDataFrame([("m", 5.0), ("n", None)], "model string, s double"), "model", "s").count() == 2
    assert enrichment.availability(e, "id", F.col("i") == 0).where("id = 1").first()["easy"] == 1
    nodes = spark.createDataFrame([(1, "return"), (2, "call")], "id int, kind string")
    assert enrichment.having_node(e, nodes, "id", ["return"]).count() == 2
    assert one(spark, enrichment.kept_share(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))) == 50 and one(spark, enrichment.kept_share(F.array(), F.array())) == 0


def test_inference_runs_once_for_each_text(spark):
    df = spark.createDataFrame([("a",), ("a",), ("bb",)], "t string")

    def load():
        return lambda batch: batch.assign(n=batch["t"].str.len())

    assert sorted(map(tuple, enrichment.inferred(df, ["t"], "t string, n long", load).collect())) == [("a", 1), ("bb", 2)]


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 1.234, None)], "x string, y double, z int")
    assert markdown.markdown_table(df, "T").splitlines()[-1] == "| a\\|b | 1.23 | n/a |"
    assert "The first 1 rows." in markdown.markdown_table(df.union(df), "T", most=1)
    leaders = spark.createDataFrame([("m", True), ("m", False), ("n", None)], "model string, separated boolean")
    assert markdown.comparison_paragraph(leaders, 1, 3).startswith("Leading by setting: m (2), n (1). In 1 settings")
