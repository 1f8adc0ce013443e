import pytest
from pyspark.sql import functions as F

from millrace.functions import errors, reports, text
from millrace.operators import crawling, graph, windows
from millrace.session import scratch_dir
from millrace.sources.jsonl import read_code


def one(spark, column, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first().r


GO = 'package x\n\nimport "testing"\n\nfunc TestA(t *testing.T) {\n}'


@pytest.mark.parametrize(
    "language, response, want",
    [
        ("Go", f"Here's it:\n```text\nnothing of use, but long enough to be the longest block of all, by far\n```\n```go\n{GO}\n```", GO), ("go", "a\n```\nxx\n```\n```\nxxxx\n```", "xxxx"), ("go", "```\naa\n```\n```\nbb\n```", "aa"),
        ("ruby", "Here is a test\nsome words\nrequire 'x'\n\n\n\n\ndescribe 'a' do\nend\nNote: that is all", "require 'x'\n\ndescribe 'a' do\nend"), ("julia", "  only words  ", "only words"), ("php", "```php\n1. first\n$a = 1;  \n- point\nassert($a);\n```", "$a = 1;\nassert($a);"),
        ("cobol", "x\n```\n a \n```", "a"), (None, "  plain ", "plain"), ("go", None, ""), ("rust", "", ""), ("go", "The test follows\nx", "x"),
    ],
)
def test_best_block(spark, language, response, want):
    assert one(spark, text.best_block("r", "l"), "l string, r string", (language, response)) == want


@pytest.mark.parametrize(
    "language, code, want",
    [
        ("go", GO, 1.0), ("go", "here is what I expect", 0.0), ("go", "x\ny\nz", 0.4), ("julia", "@test 1\n@test 2\n@test 3", 1.0), ("ruby", "expect(1)", 0.7), ("rust", "Note: use assert!\n\nx\ny", 0.9), ("php", " \n", 0.0), ("go", None, 0.0),
        ("basic", "x", 0.5), (None, "x", 0.5), ("basic", "", 0.0), (" Go ", "func TestB", 0.7),
    ],
)
def test_test_score(spark, language, code, want):
    assert one(spark, text.test_score("c", "l"), "l string, c string", (language, code)) == want


@pytest.mark.parametrize(
    "check, log, want",
    [
        ((False, False), "./x.go:3: undefined: Foo (error)", ("api_hallucination", 0.85)), ((False, False), "build error: something failed\n./x.go:3: undefined: Foo", ("api_hallucination", 0.75)), ((False, False), "error: cannot find package", ("api_hallucination", 0.9)),
        ((False, False), "error: cannot use x (type int) as string in argument", ("type_system_memory", 0.95)), ((False, False), "syntax error: x", ("syntactic_compilation", 0.9)), ((False, False), "build failed", ("syntactic_compilation", 0.7)),
        ((True, False), "panic: expected 3", ("logic_assertion", 0.85)), ((True, False), "panic: runtime error: invalid type", ("type_system_memory", 0.85)), ((True, False), "--- FAIL: TestX\npanic: expected", ("logic_assertion", 0.9)), ((True, False), "first\nshould be 4", ("logic_assertion", 0.8)),
    ],
)
def test_errors_of_go(spark, check, log, want):
    schema = "l string, log string, code string, c struct<compilation boolean, tests boolean, coverage boolean>, s struct<covered_lines int>"
    got = one(spark, errors.classify("l", "log", "code", F.col("c"), F.col("s")), schema, ("go", log, "code", (*check, False), None))
    assert (got.category, got.confidence) == want


@pytest.mark.parametrize("log, want", [("error[E0382]: x", 0.95), ("error[E0425]: x", 0.85), ("error[E0423]: x", 0.95), ("error[E9999]: y", 0.5)])
def test_error_codes_of_rust(spark, log, want):
    schema = "l string, log string, code string, c struct<compilation boolean, tests boolean, coverage boolean>, s struct<covered_lines int>"
    assert one(spark, errors.classify("l", "log", "code", F.col("c"), F.col("s")), schema, ("rust", log, "code", (False, False, False), None)).confidence == want


@pytest.mark.parametrize(
    "a, b, c, d, want",
    [(1, 1, 3, 2, "ine1\nline2\nli"), (1, 1, 1, 3, "in"), (1, 3, 1, 1, "line1"), (0, 0, 9, 9, "line0\nline1\nline2\nline3"), (2, 0, 7, 1, "line2\nline3"), (4, 0, 5, 0, "")],
)
def test_range_text(spark, a, b, c, d, want):
    got = one(spark, text.range_text("x", *[F.lit(v) for v in (a, b, c, d)]), row=("line0\nline1\nline2\nline3",))
    assert got == want
    assert one(spark, text.range_text("x", F.lit(0), F.lit(0), F.lit(1), F.lit(3)), row=(' import "a"\nx',)) == ""


def test_places(spark):
    schema = "p array<struct<path string, start_line_no int, end_line_no int>>"
    row = ([("a", 0, 5), ("a", 10, 20), ("b", 0, 5), ("c", 1, 2)],)
    at = (F.lit("a"), F.lit(5), F.lit(9))
    assert [tuple(x) for x in one(spark, windows.outside_focal("p", *at), schema, row)] == [("a", 10, 20), ("b", 0, 5), ("c", 1, 2)]
    assert one(spark, windows.touches_focal("p", *at), schema, row) is True
    assert [x.path for x in one(spark, windows.imported_only("p", F.lit("a"), F.array(F.lit("c"))), schema, row)] == ["c"]
    assert [x.path for x in one(spark, windows.imported_only("p", F.lit("a"), F.lit(None).cast("array<string>")), schema, row)] == ["b", "c"]


def test_report_file(spark):
    schema = "f array<struct<filename string>>"
    pick = lambda *names: one(spark, reports.llvm_file(F.col("f"), F.lit("src/deep/lib.rs")), schema, ([(n,) for n in names],))
    assert pick("src/other.rs") is None and pick("x/y.rs", "/w/src/deep/lib.rs").filename == "/w/src/deep/lib.rs" and pick("q/lib.rs", "z/lib.rs").filename == "z/lib.rs"


def test_long_paths_end(spark):
    nodes = ["ENTRY", *[f"n{i}" for i in range(70)], "EXIT"]
    edges = spark.createDataFrame([("g", a, b, None, False) for a, b in zip(nodes, nodes[1:], strict=False)], "g string, src string, dst string, condition string, is_back boolean")
    (path,) = graph.all_paths(edges, "g").collect()
    assert path.nodes == nodes and not path.truncated


def test_guards(spark):
    assert one(spark, crawling.too_large("x"), row=("x" * 10_001,)) and not one(spark, crawling.too_large("x"), row=("x" * 10_000,)) and not one(spark, crawling.too_large("x"), row=(None,))
    df = spark.createDataFrame([(1, "a", "b", "c")], "task_id long, repo string, prompt string, other string")
    assert crawling.prompt_columns(df).columns == ["task_id", "repo"] and crawling.without_prompt(df).columns == ["task_id", "repo", "other"]


def test_undecodable_bytes(spark, tmp_path):
    (tmp_path / "a.go").write_bytes(b"x\xff = \xc3\xa9")
    assert read_code(spark, str(tmp_path), undecodable="drop").first().content == "x = \u00e9"
    assert read_code(spark, str(tmp_path)).first().content == "x\u00ff = \u00c3\u00a9"


def test_a_cluster_must_name_its_folder(spark):
    class Context:
        master = "spark://h:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        scratch_dir(Session())
    assert scratch_dir(spark)
