import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.pair_defects import blocks, complete, core, defect, human_language, length_limits, pair_defects, shortened

PROMPT = "Write unit tests in Go for the function `addAll` below.\n\nContext:\nThe parser reads the config again.\n\n```go\nfunc addAll(a int, b int) int {\n\treturn a + b\n}\n```"
GO = 'package x\n\nimport "testing"\n\nfunc TestAddAll(t *testing.T) {\n\tif got := addAll(1, 2); got != 3 {\n\t\tt.Fatalf("got %d", got)\n\t}\n}\n'
RUBY = "require 'spec_helper'\n\nRSpec.describe 'addAll' do\n  it 'adds' do\n    expect(add_all(1, 2)).to eq(3)\n  end\nend\n"


def fenced(code, tag="go"):
    return f"```{tag}\n{code}```"


@pytest.mark.parametrize(
    "response, want",
    [
        (GO, None), (fenced(GO), None), (f"Here is the test file:\n\n{fenced(GO, 'golang')}\n\nMore cases could follow...", None), (f"The function under test:\n\n```text\nfunc addAll(a int) int {{ return a }}\n```\n\n{fenced(GO)}", None),
        (f"I cannot test the private parts of `addAll` directly, so the public call is used.\n\n{fenced(GO)}", None), ("```go\n" + GO, None),
        (None, "empty"), ("", "empty"), (" \n\t", "empty"), ("​", "empty"), ("N/A", "empty"), ("```go\n\n```", "empty"), ("(no output)", "empty"), ("Error: upstream timeout after 3 s", "empty"), ("[ERROR: x]", "empty"),
        (GO[:-30], "truncated"), (fenced(GO[:-5] + "\n"), "truncated"), ("```go\n" + GO[:60], "truncated"), ("Here is the test file:", "truncated"), ('package x\n\nimport "test', "truncated"),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("The parser reads it.\n\nRequest declined.", "refusal"), ("I won’t write this test.", "refusal"), ("Lo siento, no puedo ayudar con esta petición.", "refusal"),
        (PROMPT, "copied"), ("Sure! " + PROMPT, "copied"), (PROMPT.split("\n")[0], "copied"), ("func addAll(a int, b int) int {\n\treturn a + b\n}", "copied"), ("Question: " + " ".join(PROMPT.split()), "copied"), ("\n".join("> " + x for x in PROMPT.split("\n")), "copied"),
        (fenced(RUBY, "rb"), "wrong_language"), (RUBY, "wrong_language"), (f"Aquí está el archivo de pruebas:\n\n{fenced(GO)}", "wrong_language"), (f"Voici le fichier de tests :\n\n{fenced(GO)}", "wrong_language"), (f"テストは次のとおりです。\n\n{fenced(GO)}", "wrong_language"),
    ],
)
def test_defects(response, want):
    assert defect(PROMPT, response, "go") == want


def test_without_a_prompt():
    assert defect(None, fenced(GO), " Go ") is None and defect(None, fenced(RUBY, "ruby"), "go") == "wrong_language"
    assert defect("", None, None) == "empty" and defect(None, GO, None) is None


@pytest.mark.parametrize("code, language", [(GO, "go"), (RUBY, "ruby"), ('using Test\n\n@testset "f" begin\n    @test f(x[end]) == 2  # do end\n    for i in 1:2\n        @test i > 0\n    end\nend\n', "julia"),
    ("<?php\nuse PHPUnit\\Framework\\TestCase;\nfinal class ATest extends TestCase\n{\n    public function testA(): void\n    {\n        $this->assertSame('}', f(\"{\"));\n    }\n}\n", "php"),
    ("#[cfg(test)]\nmod tests {\n    #[test]\n    fn a() {\n        let c = '{';\n        assert_eq!(f::<'_>(\"}\"), 1);\n    }\n}\n", "rust")])
def test_every_shortening_is_incomplete(code, language):
    assert complete(code, language)
    last = len(code.rstrip())
    bad = [n for n in range(1, last) if complete(code[:n], language)]
    assert bad == []


def test_languages():
    assert human_language("These tests cover the main branches.") == "en" and human_language("Die folgenden Tests decken alle Zweige ab.") == "de"
    assert human_language("Os testes seguintes cobrem todos os ramos.") == "pt" and human_language("`foo`") is None
    assert blocks("a\n```go\nx\n```\nb")[0] == [("go", "x\n", True)]


def test_a_name_that_is_a_keyword():
    assert complete('using Test\n\n@testset "do" begin\n    @test do(1, 2) == 3\nend\n', "julia")
    assert complete("RSpec.describe 'do' do\n  it 'adds' do\n    expect(do(1, 2)).to eq(3)\n  end\nend\n", "ruby")


TWO = GO + "\nfunc TestMore(t *testing.T) {\n\tif addAll(2, 2) != 4 {\n\t\tt.Error()\n\t}\n}\n"


def test_marks_decide():
    cut_between_tests = "```go\n" + GO
    assert [defect(PROMPT, cut_between_tests, "go", continued=c) for c in (False, True)] == [None, "truncated"]
    assert [defect(PROMPT, fenced(GO), "go", continued=c) for c in (False, True)] == [None, None]  # its fence is closed
    trailing = GO + "\n// and the next case is ab"
    assert [defect(PROMPT, trailing, "go", limited=c) for c in (False, True)] == [None, "truncated"]
    assert defect(PROMPT, GO, "go", limited=True) is None
    assert defect(PROMPT, PROMPT.split("\n")[0], "go", continued=True) == "copied"


def test_shortened_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("ab"), 60)) for _ in range(20)]
    code, prose = "\n@test f(1) == 2", "\nmore prose"
    texts = base + [b + c for b in base[:8] for c in (code, code * 2, prose, prose + code, "c" * 50, "\n```" + code, "...")] + [base[0]] * 40 + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    cores = {t.rstrip(" \t\r\n.…") for t in texts if t}
    want = {t for t in cores if len(t) >= 40 and any(u != t and u.startswith(t) and "@test" in u[len(t) :].split("\n```")[0] for u in cores)}
    assert len(want) == 8 * 3
    for n in (1, 4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        hashes = shortened(df.repartition(3), "t")
        assert {r.c for r in df.select(core("t").alias("c")).join(hashes, F.xxhash64("c") == F.col("core_hash")).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_longer_versions_in_other_ranges(spark):
    """One text whose longer versions fill all ranges of the sort."""
    start = "using Test\n\n# numbers of the long table below\n"
    rows = [(i, start + f"# {i:05d}\n@test f({i}) == 1") for i in range(3000)] + [(-1, start.strip())]
    df = spark.createDataFrame(rows, "id int, t string")
    got = shortened(df.repartition(3), "t")
    assert df.where("id = -1").join(got, F.xxhash64(core("t")) == F.col("core_hash")).count() == 1 and got.count() == 1


def test_limits(spark):
    rows = [("m", "x" * n) for n in range(100, 200)] + [("m", "y" * 150)] * 40 + [("k", "z" * 150)] * 5
    got = length_limits(spark.createDataFrame(rows, "model string, t string"), "t", "model").collect()
    assert [tuple(r) for r in got] == [("m", 150)]


def test_rows(spark):
    between = "```go\n" + GO
    rows = [
        (1, PROMPT, GO, "go", "m", "x"), (2, PROMPT, GO[:-30], "go", "m", "x"), (3, PROMPT, None, "go", "m", "x"), (4, PROMPT, GO[:-30], "go", "m", "x"), (5, None, None, None, None, None),
        (6, PROMPT, GO + "// end\n" * 50_000, "go", "m", "x"), (7, PROMPT, between, "go", "m", "x"), (8, PROMPT, "```go\n" + TWO + "```", "go", None, "x"), (8, PROMPT, between, "go", None, "x"),
    ]
    df = spark.createDataFrame(rows, "response_id long, prompt string, response string, language string, model string, defect string")
    args = ("response_id", "prompt", "response", "language", "model")
    got = sorted(tuple(r) for r in pair_defects(df, *args).collect())
    assert got == [(2, "truncated", "longer_version"), (3, "empty", "text"), (4, "truncated", "longer_version"), (5, "empty", "text"), (7, "truncated", "longer_version"), (8, "truncated", "longer_version")]
    alone = df.where("response_id <> 8 OR NOT endswith(response, '```')")  # without the longer version the mark is gone, and so is the answer
    assert {r.response_id for r in pair_defects(alone, *args).collect()} == {2, 3, 4, 5}
    assert pair_defects(df.limit(0), *args).count() == 0
