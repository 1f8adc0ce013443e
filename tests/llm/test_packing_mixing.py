import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.mixing import mixture, quotas, shares, source_name
from millrace.llm.packing import _closing, _nearest, containers, document_frequencies, fill_report, pack, routed, token_table
from millrace.llm.tokens import VOCABULARY, chars_per_token, encode


def docs(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)))), ["a", "B ", "c-d", "C_D", None, "zz"][int(rng.integers(0, 6))], "n") for i in range(n)]
    rows += [(n, "x " * 900, "a", "n"), (n + 1, None, "a", "n"), (n + 2, "", "a", "n"), (n + 3, rows[0][1], "a", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")


def test_every_document_once_and_whole(spark):
    df = docs(spark)
    size = {r.doc_id: len(encode([r.text or ""])[0]) for r in df.collect()}
    for tokens in (10**6, 3000):
        got = containers(df, "doc_id", "text", {"small": 256, "big": 2048}, cluster_tokens=tokens, shard_tokens=2 * tokens).collect()
        for name, capacity in (("small", 256), ("big", 2048)):
            own = [r for r in got if r.limit_name == name]
            fill, parts = {}, {}
            for r in own:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
                parts.setdefault(r.doc_id, []).append((r.piece_no, r.first_token, r.n_tokens))
            assert max(fill.values()) <= capacity
            assert set(parts) == {i for i, n in size.items() if n}
            for i, p in parts.items():
                p.sort()
                assert len(p) == math.ceil(size[i] / capacity) and sum(n for *_, n in p) == size[i]
                assert [f for _, f, _ in p] == [k * capacity for k in range(len(p))]
            least = math.ceil(sum(size.values()) / capacity)
            assert len(fill) <= least * 1.06 + 1
            numbers = {}
            for r in own:
                numbers.setdefault(r.container_id, []).append(r.item_no)
            assert all(sorted(n) == list(range(len(n))) for n in numbers.values())


def brute_force(ids, seeds, k, idf, mean):
    """Nearest documents by BM25, straight from its formula."""
    out = {}
    counts = [dict(zip(*np.unique(np.asarray(x, int), return_counts=True), strict=True)) for x in ids]
    for s in seeds:
        scores = []
        for d, tf in enumerate(counts):
            if d != s and (score := sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ids[d]) / mean)) for t in counts[s] if t in tf)):
                scores.append((-score, d))
        out[s] = [d for _, d in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("clusters, least", [(1, 1.0), (4, 0.9), (12, 0.85)])
def test_neighbours_are_in_the_shard(spark, clusters, least):
    """Recall at ten against brute force over all documents, of seeds from the largest tenth."""
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect() if r.text]
    ids = encode(texts)
    tokens = token_table(spark.createDataFrame(list(enumerate(texts)), "item long, text string"), "item", "text")
    idf, n, mean = document_frequencies(tokens)
    assert n == len(ids)
    sharded, shards = routed(tokens, idf, n, mean, cluster_tokens=math.ceil(mean * n / clusters))
    shard = {r.item: r.shard for r in sharded.select("item", "shard").collect()}
    assert shards == clusters and len(shard) == n
    rng = np.random.default_rng(1)
    seeds = rng.choice(sorted(range(n), key=lambda i: -len(ids[i]))[: n // 10], 40, replace=False).tolist()
    want = brute_force(ids, seeds, 10, idf, mean)
    assert np.mean([shard[d] == shard[s] for s in seeds for d in want[s]]) >= least


def test_one_text_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, "the same words again and again " * 5 if i % 3 == 0 else " ".join(rng.choice(words, 30))) for i in range(900)]
    tokens = token_table(spark.createDataFrame(rows, "item long, text string"), "item", "text")
    idf, n, mean = document_frequencies(tokens)
    sharded, shards = routed(tokens, idf, n, mean, cluster_tokens=10_000, shard_tokens=4_000)
    size = [r.t for r in sharded.groupBy("shard").agg(F.sum("n_tokens").alias("t")).collect()]
    assert sum(size) == mean * n and max(size) < 1.5 * 4_000 and len(size) <= shards


def groups(rng, lengths):
    """Documents of two vocabularies that share no term."""
    return [np.sort(rng.choice(np.arange(g * 100, g * 100 + 40), k, replace=False)).astype(np.int32) for g in (0, 1) for k in lengths]


def test_neighbours_share_words():
    rng = np.random.default_rng(6)
    terms = groups(rng, [20] * 30)
    sizes = np.full(60, 20)
    idf = np.full(VOCABULARY, 2.0)
    boxes = pack(sizes, sizes, terms, [np.ones(20, np.int32)] * 60, 100, idf, 20.0)
    assert sorted(i for b in boxes for i, _ in b) == list(range(60)) and all(len(b) == 5 for b in boxes)
    assert sum(len({i // 30 for i, _ in b}) == 1 for b in boxes) == len(boxes)
    none = np.zeros(0, int)
    assert pack(none, none, [], [], 10, idf, 1.0) == []


def test_a_container_is_filled_by_its_nearest():
    """All items but those of the last gap are the nearest unused ones by the formula, whichever terms they share."""
    rng = np.random.default_rng(8)
    lengths = rng.integers(5, 30, 40).tolist()
    terms = groups(rng, lengths)
    sizes = np.array(lengths * 2)
    idf = rng.random(VOCABULARY) + 0.1
    mean = float(sizes.mean())
    near = brute_force([t.tolist() for t in terms], range(80), 80, idf, mean)
    boxes = pack(sizes, sizes, terms, [np.ones(len(t), np.int32) for t in terms], 200, idf, mean)
    used = set()
    for box in boxes[:6]:
        seed, room = box[0][0], 200 - int(sizes[box[0][0]])
        assert sizes[seed] == max(s for i, s in enumerate(sizes) if i not in used)
        used.add(seed)
        for i, shares in box[1:]:
            if room <= 2 * np.median(sizes):
                break
            assert shares and i == next(d for d in near[seed] if d not in used and sizes[d] <= room)
            used.add(i)
            room -= int(sizes[i])
        used |= {i for i, _ in box}
    assert all(sum(sizes[i] for i, _ in b) == 200 for b in boxes[:6])


def test_closing():
    sizes = np.array([7, 6, 4, 1, 5])
    near = np.array([5.0, 4, 3, 2, 1])
    of = lambda *some: (np.array(some), sizes, near, np.bincount(sizes[list(some)], minlength=200))
    assert _closing(*of(0, 1, 2, 3, 4), 10) == [1, 2]  # the nearest that has a partner
    assert _closing(*of(3, 4), 5) == [4]
    assert _closing(*of(0), 100) == [0]
    assert _closing(*of(2), 8) == [2]  # no partner for itself
    assert _nearest(np.arange(5), sizes, near, 2) == [1, 0] and _nearest(np.arange(5), sizes, np.zeros(5), 2)[-1] == 0


def test_frequencies_and_report(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, None)], "doc_id long, text string")
    t = token_table(df, "doc_id", "text")
    idf, n, mean = document_frequencies(t)
    a, b = encode(["a"])[0][0], encode([" b"])[0][0]
    assert n == 2 and mean == 2 and idf[a] == pytest.approx(math.log1p(0.5 / 2.5)) and idf[b] == pytest.approx(math.log1p(1.5 / 1.5))
    got = containers(df, "doc_id", "text", {"x": 4})
    r = fill_report(got, {"x": 4}).first()
    assert (r.n_containers, r.n_items, r.n_tokens, r.fill) == (1, 2, 4, 1.0)
    assert containers(df.limit(0), "doc_id", "text", {"x": 4}).count() == 0
    assert chars_per_token(["computer"])[0] > 4 > 2.4 > chars_per_token(["xQ9zK2mW7p"])[0]


def test_quotas():
    t = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 5), "d": (0.0, 9)}
    exact = quotas({"a": 100, "b": 30, "c": 10}, t)
    assert exact == pytest.approx({"a": 100, "b": 60, "c": 40})
    assert quotas({"a": 100, "b": 30, "c": 10}, t, 205) == pytest.approx({"a": 100, "b": 60, "c": 45})
    assert quotas({}, t) == {} and quotas({"a": 100}, t) == {"a": 100} and quotas({"a": 5, "b": 5, "c": 5}, t, 1e9) == {"a": 5, "b": 10, "c": 25}


def test_mixture(spark):
    df = docs(spark, 1500)
    targets = spark.createDataFrame([("A", 0.5, 1), ("b", 0.3, 4), ("c_d", 0.2, 2), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    for bucket in (50_000, 40):
        m = mixture(df, targets, "doc_id", "text", "source", block=256, bucket_rows=bucket).cache()
        rows = m.collect()
        uses = {}
        for r in rows:
            uses.setdefault((r.source, r.doc_id), []).append(r.use_no)
        most = {"a": 1, "b": 4, "c_d": 2}
        assert all(sorted(u) == list(range(len(u))) and len(u) <= most[s] for (s, _), u in uses.items())
        own = {r.source: r for r in shares(m, targets).collect()}
        for s, share in (("a", 0.5), ("b", 0.3), ("c_d", 0.2)):
            assert own[s].share == pytest.approx(share, abs=0.01)
        assert own["none"].n_tokens == 0
        # positions of a source lie end to end in its blocks, and any stretch of slots is close to the targets
        slots = sorted({(r.slot, r.source) for r in rows})
        a = [s == "a" for _, s in slots]
        assert all(abs(sum(a[:k]) - 0.5 * k) < 4 for k in range(1, len(a)))
        for s in most:
            p = sorted((r.position, r.n_tokens) for r in rows if r.source == s)
            assert all(x + n == y for (x, n), (y, _) in zip(p, p[1:], strict=False))
    assert mixture(df.limit(0), targets, "doc_id", "text", "source").count() == 0
    names = [r.s for r in spark.createDataFrame([("Issue-Threads ",), (None,), ("a b",)], "x string").select(source_name("x").alias("s")).collect()]
    assert names == ["issue_threads", None, "a_b"]


def test_same_mixture_under_any_partitioning(spark):
    df, targets = docs(spark, 300), spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 2)], "source string, target_share double, max_repeats int")
    one, two = (sorted(map(tuple, mixture(df.repartition(n), targets, "doc_id", "text", "source").collect())) for n in (1, 6))
    assert one == two and one
    assert mixture(df, targets, "doc_id", "text", "source", total=200).agg(F.sum("n_tokens")).first()[0] <= 260
