import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import splitlines
from millrace.operators import crawling, evaluation, graph, prompts, relational, retrieval, statistics, windows
from millrace.operators.prefix import running_total
from millrace.plans import core_queries

SAMPLE = """id int, language string, model string, test array<string>, logs array<string>,
  checks array<struct<compilation: boolean, tests: boolean, coverage: boolean, invocation: boolean, mutation: boolean>>,
  coverage_stats array<struct<covered_lines: int, total_lines: int, line_coverage: double>>,
  mutation_scores array<struct<killed_count: int, total_count: int, mutation_score: double>>"""
T, N = True, False


def sample(id_, checks, coverage, scores=None, tests=2, language="go", model="m"):
    return (id_, language, model, ["t"] * tests, [], [c and (*c,) for c in checks] if checks is not None else None, coverage, scores)


def test_summary_of_fixtures(spark):
    b = spark.createDataFrame(
        [sample(1, [(T, T, None, T, None), (N, N, None, N, None)], [(3, 10, None), (1, 10, None)]), sample(2, [(T, T, None, N, None), (T, N, None, N, None)], [(1, 10, None)])], SAMPLE
    )
    r = evaluation.summary(b).first()
    assert (r.total_samples, r.compiled_rate, r.test_pass_rate, r.invocation_rate, round(r.line_coverage, 6), r.mutation_run) == (2, 75, 50, 25, 12.5, None)
    c = spark.createDataFrame([sample(1, [(T, T, None, T, T), (T, T, None, T, N)], [(4, 20, None)], [(3, 5, 0.6), (1, 5, 0.2)])], SAMPLE)
    r = evaluation.summary(c).first()
    assert (r.mutation_run, r.killed_mutants, r.total_mutants, r.mutation_score, r.mutation_run_rate, round(r.line_coverage, 6)) == (1, 4, 10, 0.4, 50, 10)
    assert evaluation.summary(spark.createDataFrame([], SAMPLE)).collect()[0].compiled_rate == 0


def test_outcomes_keep_positions(spark):
    df = spark.createDataFrame([sample(1, [None, (T, T, None, T, None)], [None, (1, 2, 50.0)]), sample(2, None, None), sample(3, [None], [])], SAMPLE)
    got = {(r.id, r.position, r.passed, r.coverage, r.synthetic) for r in evaluation.outcomes(df).collect()}
    assert got == {(1, 1, T, 50.0, N), (2, 0, N, None, T), (3, 0, N, None, T)}
    assert evaluation.padded(df).count() == 6


def test_disagreement(spark):
    df = spark.createDataFrame([sample(1, [(T, T, None, N, None), (T, T, None, T, None), (T, N, None, N, None)], None)], SAMPLE)
    r = evaluation.disagreement(evaluation.outcomes(df), ["language"]).where("level = 0").first()
    assert (r.n_checks, r.tpr_count, r.ir_fail_count, r.disagreement_rate) == (3, 2, 1, 50.0)


def test_venn_and_ruby_threshold(spark):
    rows = [("k1", "a"), ("k2", "a"), ("k3", "a"), ("k2", "b"), ("k3", "b"), ("k4", "b"), ("k3", "c"), ("k5", "c")]
    r = evaluation.venn3(spark.createDataFrame(rows, "k string, model string"), ["k"], ("a", "b", "c")).first()
    assert tuple(r) == (1, 1, 1, 1, 0, 0, 1, 5)
    df = spark.createDataFrame([sample(1, [(T, T, None, N, None)], [(1, 2, None)], language="Ruby"), sample(2, [(T, T, None, N, None)], [(1, 2, None)], language="go"), sample(3, [(T, T, None, N, None)], None)], SAMPLE)
    assert [x.id for x in evaluation.successes(df, ["id"], "model").collect()] == [2]


def test_dedupe(spark):
    rows = [("1", 1, "old"), (" 1", 2, "new"), ("unknown", 3, "a"), (None, 4, "b"), ("", 5, "c"), ("3", 6, "x")]
    got = relational.dedupe_tasks(spark.createDataFrame(rows, "task_id string, pos int, v string"), "task_id", [F.col("pos")])
    assert sorted(r.v for r in got.collect()) == ["a", "b", "c", "new", "x"]
    both = relational.dedupe_tasks_or_functions(spark.createDataFrame([(None, "p", "f", 1), (None, "p", "f", 2), (None, None, "f", 3)], "t string, p string, f string, o int"), "t", "p", "f", [F.col("o")])
    assert sorted(r.o for r in both.collect()) == [2, 3]


def test_resume(spark):
    inputs = spark.createDataFrame([(1,), (2,), (3,)], "task_id int")
    out = spark.createDataFrame([("1", "x"), ("02", None)], "task_id string, f string")
    assert [r.task_id for r in relational.remaining(inputs, out, "task_id").collect()] == [3]
    assert sorted(r.task_id for r in relational.remaining(inputs, out, "task_id", F.col("f").isNotNull()).collect()) == [2, 3]


def test_line_windows(spark):
    df = spark.createDataFrame([("p", "\n".join(f"l{i}" for i in range(10))), ("e", ""), ("n", None), ("b", " \n ")], "path string, c string")
    got = [(r.line_no, r.start_line_no, r.end_line_no) for r in windows.line_windows(df, "c", 4, 2, ["path"]).orderBy("line_no").collect()]
    assert got == [(0, 0, 2), (2, 0, 4), (4, 2, 6), (6, 4, 8), (8, 6, 10)]


def test_window_merge_and_filters(spark):
    df = spark.createDataFrame([("r", "a", "x\ny"), ("r", "b", "x\ny")], "repo string, path string, c string")
    merged = windows.merge_windows(windows.line_windows(df, "c", 20, 2, ["repo", "path"]), "repo", "path", ["path"])
    places = merged.first().places
    assert [p.path for p in places] == ["a", "b"]
    kept = merged.select(windows.outside_focal("places", F.lit("a"), F.lit(1), F.lit(9)).alias("k"), windows.touches_focal("places", F.lit("a"), F.lit(1), F.lit(9)).alias("t"), windows.imported_only("places", F.lit("a"), F.array(F.lit("z"))).alias("i")).first()
    assert [p.path for p in kept.k] == ["b"] and kept.t and kept.i == []
    assert spark.createDataFrame([("a\nb\nc\nd",)], "x string").select(windows.without_range("x", F.lit(1), F.lit(3)).alias("r")).first().r == ["a", "d"]
    for a, b, want in (((1, 5), (5, 9), True), ((1, 5), (6, 9), False)):
        assert spark.range(1).select(windows.overlap(*map(F.lit, (*a, *b))).alias("r")).first().r is want
    assert spark.range(1).select(splitlines(F.lit("a\u2028b")).alias("r")).first().r == ["a", "b"]


def naive_bm25(query, corpus, k1=1.5, b=0.75):
    docs = [d.split() for d in corpus]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in {x for d in docs for x in d}}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean)) for t in query.split()) for d in docs]


def test_bm25_equals_brute_force(spark):
    corpus = ["a b c a", "b c d", "a a a", "e f", "b b b b c", ""]
    windows_ = spark.createDataFrame([(i, "g", c) for i, c in enumerate(corpus)] + [(99, "other", "a b")], "window_id long, g string, context string")
    queries = spark.createDataFrame([(1, "g", "a b b"), (2, "g", "zzz"), (3, "g", None)], "query_id long, g string, query string")
    got = [(r.window_id, r.score) for r in retrieval.bm25_top_k(queries, windows_, "g", 10).orderBy("rank").collect()]
    want = naive_bm25("a b b", corpus)
    assert got == [(i, pytest.approx(s, abs=1e-6)) for s, i in sorted(((s, i) for i, s in enumerate(want) if {"a", "b"} & set(corpus[i].split())), key=lambda x: (-x[0], x[1]))]


def test_bm25_with_exclusions(spark):
    corpus = ["a b c", "b c d", "a a x", "e f", "q r", "s t", "u v"]
    w = spark.createDataFrame([(i, "g", c) for i, c in enumerate(corpus)], "window_id long, g string, context string")
    q = spark.createDataFrame([(1, "g", "a b")], "query_id long, g string, query string")
    gone = spark.createDataFrame([(1, 2)], "query_id long, window_id long")
    got = {r.window_id: r.score for r in retrieval.bm25_top_k(q, w, "g", 10, gone).collect()}
    kept = [c for i, c in enumerate(corpus) if i != 2]
    want = {i if i < 2 else i + 1: s for i, s in enumerate(naive_bm25("a b", kept)) if s}
    assert got == {i: pytest.approx(s, abs=1e-6) for i, s in want.items()}


def bm25_case():
    """Windows of two groups as (window_id, g, context), and the five best for every third as a query."""
    rng = np.random.default_rng(3)
    corpus = {g: [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 25)) if x < 60) for _ in range(90)] for g in "ab"}
    corpus["b"][7] = corpus["b"][60] = corpus["b"][3]
    rows, want = [], {}
    for g, cs in corpus.items():
        first = 1000 * (g == "b")
        rows += [(i, g, c) for i, c in enumerate(cs, first)]
        for i, query in list(enumerate(cs, first))[2::3]:
            scores = [(round(s, 6), j) for j, s in enumerate(naive_bm25(query, cs), first) if set(query.split()) & set(cs[j - first].split())]
            want[i] = [(j, pytest.approx(s, abs=1e-6)) for s, j in sorted(scores, key=lambda x: (-x[0], x[1]))[:5]]
    return rows, {i: x for i, x in want.items() if x}


def test_bm25_in_rounds_and_groups(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROUND_TERMS", 100)
    rows, want = bm25_case()
    w = spark.createDataFrame(rows, "window_id long, g string, context string").repartition(3)
    got = {}
    for r in retrieval.bm25_top_k(w.selectExpr("window_id AS query_id", "g", "context AS query"), w, "g", 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.window_id, r.score))
    assert {i: x for i, x in got.items() if i % 1000 % 3 == 2} == want


@pytest.mark.parametrize("together", [1, 1000])
def test_bm25_in_small_pieces(monkeypatch, together):
    for name, value in {"CHUNK_BYTES": 900, "SCORES": 70, "COMMON": 60, "POSTINGS": 9, "TOGETHER": together}.items():
        monkeypatch.setattr(retrieval, name, value)
    rows, want = bm25_case()
    asked = []
    for g in "ab":
        docs = [(i, c.split()) for i, h, c in rows if h == g]
        n, mean = len(docs), sum(len(d) for _, d in docs) / len(docs)
        df = {t: sum(t in d for _, d in docs) for t in {x for _, d in docs for x in d}}
        idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
        floor = 0.25 * sum(idf.values()) / len(idf)
        asked += [(i, g, t, d.count(t) * (idf[t] if idf[t] >= 0 else floor), mean) for i, d in docs if i in want for t in set(d)]
    table = pa.table(dict(zip(("query_id", "g", "term", "weight", "mean"), map(list, zip(*asked)))))
    shared = type("Shared", (), {"value": retrieval._Asked(table, "g")})
    batches = [pa.RecordBatch.from_pydict({"g": [r[1] for r in x], "window_id": [r[0] for r in x], "context": [r[2] for r in x], "words": [r[2].split() for r in x]}) for x in (rows[i::4] for i in range(4))]
    found = {}
    for batch in retrieval._best(shared, 5, 1.5, 0.75, 6)(iter(batches)):
        for r in batch.to_pylist():
            found.setdefault(r["query_id"], []).append((-r["score"], r["window_id"]))
    assert {i: [(j, -s) for s, j in sorted(x)[:5]] for i, x in found.items()} == want


def shuffled(spark):
    """Bytes that were written for shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.length()))


def test_bm25_shuffles_no_pairs(spark):
    w = spark.range(4000).selectExpr("id AS window_id", "'g' AS g", "concat('a b c d e f g h w', id % 50, ' v', id % 7) AS context")
    q = w.where("window_id % 20 = 0").selectExpr("window_id AS query_id", "g", "context AS query")
    before = shuffled(spark)
    assert retrieval.bm25_top_k(q, w, "g", 3).count() == 600
    assert shuffled(spark) - before < 500_000  # 800,000 pairs that share words


def test_rag_prompt_shuffles_only_texts_of_prompts(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"{x:02x}" for x in rng.integers(0, 64, 4000).tolist()) for i in range(1, 601)}
    spark.createDataFrame(pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())})).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        assert [r.query_id for r in core_queries.rag_prompt(spark, str(tmp_path)).orderBy("query_id").collect()] == [100, 200, 300, 400, 500, 600]
        assert shuffled(spark) - before < 1_000_000  # of 7 MB of text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dense_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[5] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, None)], "id long, v array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.dense_top_k(df.where("id < 7"), df, "id", "v", 3, block=2, chunk=16).collect()}
    u = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-30)
    for q in range(7):
        s = np.round(u[q] @ u.T, 6) + 0.0
        assert [got[q, k] for k in (1, 2, 3)] == sorted(range(60), key=lambda i: (-s[i], i))[:3] or q == 5


def test_statistics(spark):
    chi, p = statistics.mcnemar(F.col("b"), F.col("c"))
    r = spark.createDataFrame([(10, 2), (0, 0)], "b int, c int").select(chi.alias("x"), p.alias("p")).collect()
    assert r[0].x == pytest.approx(49 / 12) and r[0].p == pytest.approx(math.erfc(math.sqrt(49 / 24)), abs=2e-7) and tuple(r[1]) == (0, 1)
    q = statistics.index_quantiles(spark.createDataFrame([("g", float(x)) for x in (4, 2, 1, 3)] + [("g", None)], "k string, v double"), ["k"], "v").first()
    assert (q.n, q.p25, q.median, q.p75, q.mean) == (4, 2, 3, 4, 2.5)
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0), (3, 2.0, 4.0), (4, None, 1.0)], "k int, x double, y double")
    assert statistics.spearman(df, "x", "y").first().rho == pytest.approx(np.corrcoef([1, 2.5, 2.5], [2, 1, 3])[0, 1])
    assert statistics.kendall(df, "x", "y", "k").first().tau == pytest.approx(0.0, abs=1e-9)
    assert statistics.pearson_matrix(df.withColumn("z", F.lit(1.0)), ["x", "z"]).where("metric_b = 'z'").collect()[0].r is None


def test_bootstrap_is_reproducible(spark):
    df = spark.createDataFrame([("a", 200, 100), ("b", 0, 0), ("c", 50, 0)], "g string, n long, k long")
    one, two = ({r.g: r for r in statistics.bootstrap(df.repartition(n), ["g"], "n", "k").collect()} for n in (1, 3))
    assert one == two
    assert one["a"]["mean"] == pytest.approx(50, abs=0.5) and one["a"].ci_lower == pytest.approx(43, abs=1.5) and one["b"]["mean"] is None and one["c"].cv == math.inf


def test_running_total(spark):
    rng = np.random.default_rng(2)
    rows = [("ab"[int(g)], int(o), int(v)) for g, o, v in zip(rng.integers(0, 2, 500), range(500), rng.integers(0, 9, 500), strict=True)] + [(None, 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r.g, r.o): r.t for r in running_total(df, "g", F.floor(F.col("o") / 37), ["o"], "v", "t").collect()}
    total = {"a": 0, "b": 0}
    for g, o, v in rows[:-1]:
        assert got[g, o] == total[g]
        total[g] += v
    assert got[None, 1] == 0


def test_paths_and_conditions(spark):
    e = [("f", "ENTRY", "a", None, False), ("f", "a", "b", "(x)", False), ("f", "a", "c", "!x", False), ("f", "b", "EXIT", None, False), ("f", "c", "EXIT", None, False), ("f", "c", "a", None, True), ("g", "ENTRY", "z", None, False)]
    p = graph.all_paths(spark.createDataFrame(e, "fn string, src string, dst string, condition string, is_back boolean"), "fn")
    assert sorted((r.nodes, r.conditions, r.truncated) for r in p.collect()) == [(["ENTRY", "a", "b", "EXIT"], ["(x)"], False), (["ENTRY", "a", "c", "EXIT"], ["!x"], False)]
    assert [(r.condition, r.complexity) for r in graph.unique_conditions(p, "fn").collect()] == [("!x", 0), ("x", 0)]
    assert graph.best_path(p, "fn", F.lit(1)).first().path_no == 1


def test_long_and_many_paths(spark):
    chain = ["ENTRY", *(f"n{i}" for i in range(65)), "EXIT"]
    e = [("long", a, b, None, False) for a, b in zip(chain, chain[1:], strict=False)]
    for i in range(13):
        at, to = f"d{i}" if i else "ENTRY", f"d{i + 1}" if i < 12 else "EXIT"
        e += [("wide", at, f"d{i}{side}", f"{side}{i}", False) for side in "lr"] + [("wide", f"d{i}{side}", to, None, False) for side in "lr"]
    p = graph.all_paths(spark.createDataFrame(e, "fn string, src string, dst string, condition string, is_back boolean"), "fn")
    got = {r.fn: r for r in p.groupBy("fn").agg(F.count("*").alias("n"), F.countDistinct("conditions").alias("distinct"), F.max(F.size("nodes")).alias("nodes"), F.bool_or("truncated").alias("truncated")).collect()}
    assert (got["long"].n, got["long"].nodes) == (1, 67)
    assert (got["wide"].n, got["wide"].distinct, got["wide"].truncated) == (8192, 8192, False)


def test_function_filter(spark):
    body = "\n".join(f"x = {i}" for i in range(24)) + "\nreturn x"
    rows = [("tokio/src/runtime/mod.rs", "run"), ("tokio/macros/entry.rs", "run"), ("r/vendor/x/y.rs", "run"), ("r/src/a.rs", "_hidden"), ("r/src/a.rs", "getName"), ("r/src/a.rs", "get")]
    df = spark.createDataFrame([(p, n, body, "rust") for p, n in rows], "p string, n string, c string, l string")
    rules = crawling.FilterRules(source_roots=("src",))
    got = [r.r for r in df.select(crawling.rejection("p", "n", "c", "l", rules).alias("r")).collect()]
    assert got == [None, "source_root", "vendor_folder", "name_prefix", "accessor", None]
    assert crawling.keep_functions(df, "p", "n", "c", "l", rules, {"TOKIO": crawling.FilterRules()}).count() == 3


def test_repair_prompt_has_the_whole_log(spark):
    log = "first error\n" + "x" * 3000
    df = spark.createDataFrame([(1, log), (2, None)], "i int, log string")
    got = {r.i: r.p for r in df.select("i", prompts.repair_prompt(F.lit("P"), F.lit("t"), F.col("log")).alias("p")).collect()}
    assert got[1].endswith(f"#LOG\n{log}\n#END_LOG\n") and got[2].endswith("#LOG\n\n#END_LOG\n")


def test_prompts(spark):
    df = spark.createDataFrame([("go", "f"), ("zig", "g")], "language string, code string")
    t = spark.createDataFrame([("go", "Go: {code}")], "language string, template string")
    got = {r.language: r.prompt for r in prompts.standard_prompts(df, t, "Any: {code}", "language", {"code": F.col("code")}).collect()}
    assert got == {"go": "Go: f", "zig": "Any: g"}
    r = df.limit(1).select(prompts.with_examples(F.lit("P"), F.array(F.lit("a"), F.lit("b")), 1).alias("a"), prompts.with_examples(F.lit("P"), F.lit(None).cast("array<string>")).alias("b"), prompts.in_class(F.lit("x\ny"), F.lit("class A")).alias("c"), prompts.go_test_name(F.lit("addAll")).alias("d")).first()
    assert r.a == "#RELEVANT CONTEXT\nExample 1:\na\n#END_OF_CONTEXT\n\nP" and r.b == "P" and r.c == "class A {\n    x\n    y\n}" and r.d == "AddAll"
    chunks = spark.createDataFrame([(1, "m2", False, "two", 1, "T"), (1, "cur", True, "own", 0, "T"), (1, "m1", False, "one", 2, "T")], "q int, module string, is_current boolean, text string, o int, target string")
    prompt = prompts.retrieval_prompt(chunks, "q", ["o"], "target").first().prompt
    assert prompt.index("one") < prompt.index("two") < prompt.index("own") < prompt.index("# Target\nT")


def test_stratified_and_pairs(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("s"), "id")
    a, b = (sorted((r.s, r.id) for r in relational.stratified(df.repartition(n), ["s"], "id", 5, 1).collect()) for n in (1, 5))
    assert a == b and len(a) == 15
    ranked = spark.createDataFrame([("x", 1, "m1"), ("x", 2, "m2"), ("x", 3, "m3"), ("x", 4, "m4")], "g string, rank int, m string")
    assert {(r.a, r.b) for r in relational.ranked_pairs(ranked, ["g"], "rank", "m", 3).collect()} == {("m1", "m2"), ("m1", "m3"), ("m2", "m3")}
