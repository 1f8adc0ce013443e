import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import jsonl
from millrace.streaming import resume


def test_strict_and_tolerant(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"task_id": 1}\n\n{broken\n{"task_id": 2}\n')
    assert sorted(r.task_id for r in jsonl.read_tolerant(spark, str(tmp_path), "task_id int").collect() if r.task_id) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_strict(spark, str(tmp_path), "task_id int").collect()


def test_parse_tolerant(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("",), (" ",), ("{x",), ("[1]",), (None,)], "line string")
    assert [r.record.a for r in jsonl.parse_tolerant(df, "line", "a int").collect()] == [1]


def test_results_by_folder(spark, tmp_path):
    for lang, mode, model in (("go", "standard", "m1"), ("php", "rag", "m2")):
        d = tmp_path / lang / mode / model
        d.mkdir(parents=True)
        (d / "detailed_results.jsonl").write_text('{"task_id": 7}\n')
    got = jsonl.read_results(spark, str(tmp_path), "task_id int")
    assert sorted((r.language, r["mode"], r.model) for r in got.collect()) == [("go", "standard", "m1"), ("php", "rag", "m2")]
    assert jsonl.discover(got, modes=["rag"]).count() == 1


def test_code_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.py").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.go").write_text("✓")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "node_modules" / "d.py").write_text("x")
    assert sorted((r.path.rsplit("/", 1)[1], r.content) for r in jsonl.read_code(spark, str(tmp_path)).collect()) == [("a.py", "é"), ("b.go", "✓")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("go", None, 1.23456)], "language string, x string, v double")
    jsonl.write_jsonl(df, str(tmp_path / "j"), partition_by=["language"])
    assert json.loads(next((tmp_path / "j" / "language=go").glob("*.json")).read_text()) == {"x": None, "v": 1.23456}
    jsonl.write_csv(df.select("language", "v").coalesce(1), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text().split() == ["language,v", "go,1.235"]
    jsonl.replace_path(spark, df, str(tmp_path / "r"))
    jsonl.replace_path(spark, spark.read.json(str(tmp_path / "r")).withColumn("y", F.lit(1)), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().y == 1 and not (tmp_path / "r.old").exists()


def test_resumable_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "1.json").write_text('{"task_id": "1"}\n{"task_id": "2"}\n')
    seen = []

    def process(df):
        seen.append(df.count())
        return df.withColumn("response", F.concat(F.lit("r"), "task_id"))

    def run():
        resume.resumable(spark, str(source), "task_id string", str(out), str(tmp_path / "ck"), "task_id", process).awaitTermination()

    run()
    (source / "2.json").write_text('{"task_id": "02"}\n{"task_id": "3"}\n')
    run()
    run()
    assert sorted(r.response for r in spark.read.option("recursiveFileLookup", "true").json(str(out)).collect()) == ["r1", "r2", "r3"]
    assert seen == [2, 1]


def test_repair_rounds(spark):
    first = spark.createDataFrame([(1, True, "a"), (2, False, "b"), (3, False, "c")], "task_id int, ok boolean, test string")

    def repair(df, n):
        return df.withColumn("ok", F.col("task_id") == n + 1).withColumn("test", F.concat("test", F.lit(str(n))))

    got = resume.repair_rounds(first, 2, "task_id", F.col("ok"), repair, lambda df, n: df.cache())
    assert sorted((r.task_id, r.ok, r.test, r.attempt) for r in got.collect()) == [(1, True, "a", 0), (2, True, "b1", 1), (3, True, "c12", 2)]
