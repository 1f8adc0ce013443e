import pytest
from pyspark.sql import functions as F

from millrace.functions import errors, records, reports, text
from millrace.functions.arguments import arguments, split_top


def one(spark, column, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first().r


TASKS = [("42", 42, "42"), (" 007 ", 7, "7"), ("abc-1", None, "abc-1"), (None, None, "unknown"), ("  ", None, "unknown"), (" 5", 5, "5")]


@pytest.mark.parametrize("raw, number, key", TASKS)
def test_task_ids(spark, raw, number, key):
    df = spark.createDataFrame([(raw,)], "x string")
    assert tuple(df.select(records.task_number("x"), records.task_key("x")).first()) == (number, key)


def test_task_order(spark):
    df = spark.createDataFrame([("b",), ("10",), ("2",), ("1",), ("a",)], "x string")
    assert [r.x for r in df.orderBy(*records.task_order("x")).collect()] == ["1", "2", "10", "a", "b"]


@pytest.mark.parametrize("response, status", [("", "error"), (" \n\t", "error"), (None, "error"), (" ", "error"), ("Error: x", "error"), ("[ERROR: x]", "error"), ("ok", "success"), ("An Error: x", "success")])
def test_status(spark, response, status):
    assert one(spark, records.response_status("x"), row=(response,)) == status


@pytest.mark.parametrize("status, response, good", [("success", "", False), ("success", "Error: y", False), (None, "text", True), ("error", "text", False), (" Success", "text", True)])
def test_success(spark, status, response, good):
    assert one(spark, records.record_succeeded("s", "x"), "s string, x string", (status, response)) is good


def test_line_count_and_lines(spark):
    assert one(spark, text.code_line_count("x"), row=("a\n\n// c\n# d\n b",)) == 2
    assert one(spark, text.code_line_count("x"), row=("\tx\n\t// c\n\t\n\u00a0\n",)) == 1
    assert one(spark, text.lines("x"), row=("a\nb\n",)) == ["a", "b", ""]
    assert one(spark, text.splitlines("x"), row=("a\r\nb\rc\n",)) == ["a", "b", "c"]
    assert one(spark, text.splitlines("x"), row=("",)) == []
    assert one(spark, text.splitlines("x"), row=(None,)) is None


def test_fences(spark):
    assert one(spark, text.fenced_code("x"), row=("```go\nA\n``` x ```\nB\n```",)) == "A\n\n\nB\n"
    assert one(spark, text.fenced_code("x"), row=("no fence",)) == ""


def test_conditions(spark):
    assert one(spark, text.condition_complexity("x"), row=("(a <= b) && c",)) == 6
    assert one(spark, text.normalised_condition("x"), row=("((a))",)) == "a"
    assert one(spark, text.normalised_condition("x"), row=("!!ok",)) == "ok"
    assert one(spark, text.condition_identifiers("x"), row=("(a == b) && a.c > 1 || !nil",)) == ["a", "b", "a.c"]


@pytest.mark.parametrize(
    "code, language, want",
    [
        ("func Add(a int,\n\tb int) int {\n\treturn a\n}", "go", "func Add(a int,\n\tb int) int"),
        ("\n\npub fn f(x: i32) -> i32 {\n x\n}", "Rust", "pub fn f(x: i32) -> i32"),
        ("f(x, y=1) = x + y", "julia", "f(x, y=1)"),
        ("function g(x)\n  x\nend", "julia", "function g(x)"),
        ("  def run(a, b)\n  end", "ruby", "def run(a, b)"),
    ],
)
def test_signatures(spark, code, language, want):
    assert one(spark, text.signature("c", "l"), "c string, l string", (code, language)) == want


def test_packages(spark):
    for content, language, want in (("package foo\n", "go", "foo"), ("  module Bar\n", "julia", "Bar"), ("  module Bar\n", "ruby", ""), ("<?php\nnamespace A\\B;\n", "php", "A\\B")):
        assert one(spark, text.package_name("c", "l"), "c string, l string", (content, language)) == want


def test_paths_and_options(spark):
    assert one(spark, text.repo_or_unknown("x"), row=("file.jl",)) == "unknown"
    assert one(spark, text.option_list("x", F.lit("c")), row=(" a, ,b,a",)) == ["a", "b", "c"]
    assert one(spark, text.is_test_path("x"), row=("/repo/tests/unit/main.go",)) and one(spark, text.is_test_path("x"), row=("/repo/math_test.go",))
    assert not one(spark, text.is_test_path("x"), row=("/repo/math.go",))
    assert one(spark, text.is_source_path("x"), row=("r/a.py",)) and not one(spark, text.is_source_path("x"), row=("r/node_modules/a.py",))
    assert one(spark, text.context_lines("x", F.lit(3), 1, 1), row=("1\n2\n3\n4",)) == "2\n3\n4"
    assert one(spark, text.range_text("x", F.lit(0), F.lit(1), F.lit(1), F.lit(2)), row=("abc\ndef",)) == "bc\nde"


def test_error_lines(spark):
    assert one(spark, text.first_error_line("x"), row=("ok\n  build failed here \n",)) == "build failed here"
    assert one(spark, text.first_error_line("x"), row=("\n first\n",)) == "first"
    assert one(spark, text.first_error_line("x"), row=(None,)) == ""
    assert one(spark, text.log_line_number("x", F.lit("php")), row=("a:12: on line 7",)) == 7
    assert one(spark, text.log_line_number("x"), row=("a.go:12: bad",)) == 12


GO = "mode: set\nmod/pkg/file.go:10.1,12.2 2 1\nmod/pkg/file.go:13.1,14.2 1 0\nother/file.go:11.1,14.2 1 1\nmalformed\nmod/pkg/file.go:11.x,14.2 1 bogus"


def stats(spark, column, report):
    return tuple(one(spark, column, row=(report,)))


def test_go_coverage(spark):
    assert stats(spark, reports.go_profile("x", F.lit("mod/pkg/file.go"), F.lit(11), F.lit(14)), GO) == (2, 4)
    assert stats(spark, reports.go_profile("x", F.lit("mod/pkg/file.go"), F.lit(11), F.lit(14)), None) == (0, 0)
    branches = "\n".join(
        [
            'a.go:21:2: condition "x" was 2 times true but 1 times false', 'a.go:22:2: condition "y" was never evaluated',
            'a.go:23:2: condition "z" was once true but never false', 'a.go:24:2: condition "z" was once false but never true'.replace("24", "40"),
        ]
    )
    assert stats(spark, reports.go_branches("x", F.lit(20), F.lit(25)), branches) == (3, 6)


def test_llvm(spark):
    df = spark.createDataFrame([([[9, 0, 2], [10, 0, 1], [11, 0, 0], [12, 0, 3], [13, 0, 1]],)], "s array<array<int>>")
    assert tuple(df.select(reports.llvm_segments(F.col("s"), F.lit(10), F.lit(12)).alias("r")).first().r) == (2, 3, 66.67)
    files = spark.createDataFrame([([("src/other.rs",), ("/abs/repo/src/lib.rs",)],)], "f array<struct<filename: string>>")
    assert files.select(reports.llvm_file(F.col("f"), F.lit("repo/src/lib.rs")).alias("r")).first().r.filename == "/abs/repo/src/lib.rs"
    assert files.select(reports.llvm_file(F.col("f"), F.lit("x/none.rs")).alias("r")).first().r is None


def test_php_and_ruby(spark):
    xml = '<coverage><file name="/app/src/Thing.php"><line num="9" type="stmt" count="1"/><line num="10" type="stmt" count="1"/><line num="11" type="stmt" count="0"/><line num="12" type="stmt" count="2"/><line num="10" type="method" count="0"/><line num="bad" type="stmt" count="1"/></file></coverage>'
    clover = reports.clover("x", F.lit("repo/src/Thing.php"), F.lit(10), F.lit(12))
    assert stats(spark, clover, xml) == (2, 3)
    assert stats(spark, clover, "<coverage><file name='a'>") == (0, 0) and stats(spark, clover, None) == (0, 0)
    sc = reports.simplecov("x", F.lit("repo/lib/thing.rb"), F.lit(2), F.lit(4))
    assert stats(spark, sc, '{"RSpec": {"coverage": {"/app/lib/thing.rb": [null, 1, 0, 2, null]}}}') == (2, 3)
    assert stats(spark, sc, "{broken") == (0, 0)
    assert stats(spark, reports.percent_text("x", F.lit(5), F.lit(9)), "Lines: 66.7%") == (3, 5)
    assert stats(spark, reports.percent_text("x", F.lit(5), F.lit(9)), "none") == (0, 0)


def test_mutation_logs(spark):
    assert stats(spark, reports.go_mutation("x"), "The mutation score is 0.750000 (3 killed, 1 escaped, 0 skipped, total is 4)") == (3, 4, 0.75)
    assert stats(spark, reports.go_mutation("x"), "PASS a\nFAIL b\nPASS c\n") == (2, 3, pytest.approx(2 / 3))
    assert stats(spark, reports.rust_mutation("x"), '[{"outcome": "caught"}, {"outcome": "missed"}, {"outcome": "unviable"}]') == (1, 3, 0.5)
    assert stats(spark, reports.rust_mutation("x"), "1 missed, 12 caught, 2 unviable") == (12, 15, pytest.approx(0.9231))
    assert stats(spark, reports.ruby_mutation("x"), "Mutations : 12\n- Kills: 9") == (9, 12, 0.75)


@pytest.mark.parametrize(
    "signature, language, want",
    [
        ("func (s *S) Add(a, b int, f func(x int) error) (int, error)", "go", [("a", "int"), ("b", "int"), ("f", "func(x int) error")]),
        ("pub fn f<T: Into<String>>(&mut self, mut a: Vec<(i32, T)>, b: &str) -> X", "rust", [("a", "Vec<(i32, T)>"), ("b", "&str")]),
        ("function h(x::Int, y=1; z::Vector{Int}=[1, 2])", "julia", [("x", "Int"), ("y", None), ("z", "Vector{Int}")]),
        ("public function p(?int $a, array $b = [1, 2], Foo ...$rest): int", "php", [("a", "?int"), ("b", "array"), ("rest", "Foo")]),
        ("def r(a, b = 2, *c, d:, &blk)", "ruby", [("a", None), ("b", None), ("c", None), ("d:", None), ("blk", None)]),
        (None, "go", []), ("func f()", "go", []),
    ],
)
def test_arguments(spark, signature, language, want):
    got = one(spark, arguments("s", "l"), "s string, l string", (signature, language))
    assert [(a.name.rstrip(":"), a.type) for a in got] == [(n.rstrip(":"), t) for n, t in want]


def test_split_top():
    assert split_top("a, b: List<T, U>, c") == ["a", "b: List<T, U>", "c"]
    assert split_top("f: fn(i32) -> i32, g") == ["f: fn(i32) -> i32", "g"]


CHECK = "struct<compilation: boolean, tests: boolean, coverage: boolean>"


@pytest.mark.parametrize(
    "language, log, check, stat, want",
    [
        ("go", "./a_test.go:5: undefined: Foo", (False, False, None), None, ("api_hallucination", 0.85)),
        ("go", "cannot use x as int in argument", (False, False, None), None, ("type_system_memory", 0.95)),
        ("rust", "error[E0382]: use of moved value", (False, False, None), None, ("type_system_memory", 0.95)),
        ("rust", "error[E0425]: cannot find value", (False, False, None), None, ("api_hallucination", 0.85)),
        ("julia", "ParseError: x", (False, False, None), None, ("syntactic_compilation", 0.95)),
        ("ruby", "NoMethodError: undefined method", (True, False, None), None, ("api_hallucination", 0.9)),
        ("php", "Failed asserting that 1 is 2", (True, False, None), None, ("logic_assertion", 0.9)),
        ("julia", None, (True, False, None), None, None),
        ("go", None, (True, False, None), None, ("logic_assertion", 0.5)),
        ("ruby", "", (True, True, True), (1,), ("test_design_mocking", 0.65)),
        ("go", "", (True, True, True), (1,), None),
        ("go", "preprocessing: no tests generated", None, None, ("syntactic_compilation", 0.85)),
    ],
)
def test_error_cascade(spark, language, log, check, stat, want):
    df = spark.createDataFrame([(language, log, "code", check, stat)], f"l string, log string, code string, c {CHECK}, s struct<covered_lines: int>")
    got = df.select(errors.classify("l", "log", "code", F.col("c"), F.col("s")).alias("r")).first().r
    assert (tuple(got) if got else None) == want


def test_api_kinds(spark):
    for message, kind in (("cannot find package x", "phantom_library"), ("wrong number of arguments", "signature_mismatch"), ("undefined: Foo", "nonexistent_api"), ("x", "other"), (None, "other")):
        assert one(spark, errors.api_kind("x", F.lit(None)), row=(message,)).kind == kind
