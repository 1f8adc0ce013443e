import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.chunking import boundaries, cut, split, text_pieces
from millrace.llm.tokens import encode


def check(text, found, limit, overlap):
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(b - a <= limit for a, b, *_ in found)
    assert all(a2 == b1 - overlap for (_, b1, *_), (a2, *_) in zip(found, found[1:], strict=False))
    assert text[: found[0][1]] + "".join(text[a + overlap : b] for a, b, *_ in found[1:]) == text


@given(st.text(st.sampled_from("ab \n\té🧪"), min_size=1, max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_round_trip(text, limit, overlap):
    found = split(text, limit, overlap)
    check(text, found, limit, overlap if len(found) > 1 else 0)


def brute(text, limit, overlap):
    """The last boundary of the strongest kind in the second half, by looking at every offset."""
    levels = [set(x.tolist()) for x in boundaries(text)]
    start, out = 0, []
    while len(text) - start > limit:
        least = start + max(overlap + 1, limit // 2)
        end = next((e for level in levels for e in range(start + limit, least - 1, -1) if e in level), start + limit)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


def test_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = "".join(rng.choice(list("xyz  \n\n}f"), 300))
        limit, overlap = int(rng.integers(20, 80)) * 2, int(rng.integers(0, 9))
        assert [(a, b) for a, b, *_ in split(text, limit, overlap)] == brute(text, limit, overlap)


def test_kinds_of_cuts():
    text = "func a() {\n  x\n}\n\nfunc b() {\n  y\n}\n"
    assert [x[3] for x in split(text, 30, 0)] == ["definition", "end"]
    assert [x[3] for x in split("x" * 100, 30, 5)] == ["hard"] * 3 + ["end"]
    assert split("", 10, 2) == [(0, 0, 0, "end")]
    assert cut(np.arange(11), [np.zeros(0, np.int64)] * 4, 3, 9)[-1][1] == 10  # an overlap over the limit still ends


def test_tokens_as_unit():
    text = "def naïve(x):\n    return x + 1\n\n" * 30
    found = split(text, 50, 10, "tokens")
    assert all(size <= 50 for *_, size, _ in found) and len(found) > 3
    assert all(len(encode([text[a:b]])[0]) <= 52 for a, b, *_ in found)
    assert found[0][0] == 0 and found[-1][1] == len(text)


def test_rows(spark):
    long = "line of code\n" * 40_000
    rows = [("a", "x\n" * 50, 1), ("a", "x\n" * 50, 2), ("b", None, 3), ("c", "", 4), ("d", "é" * 100, 5), ("a", "y\n" * 60, 6), ("e", long, 7)]
    df = spark.createDataFrame(rows, "file_path string, file_content string, piece int").repartition(3)
    got = text_pieces(df, "file_path", "file_content", [("l", "characters", 40, 4)])
    by = {}
    for r in got.collect():
        by.setdefault((r.file_path, r.text_hash), []).append((r.piece_no, r.piece, r.start, r.end))
    assert sorted(p for p, _ in by) == ["a", "a", "d", "e"]
    texts = {"".join(piece[4 if no else 0 :] for no, piece, *_ in sorted(v)) for v in by.values()}
    assert texts == {"x\n" * 50, "y\n" * 60, "é" * 100, long}
    assert text_pieces(df, "file_path", "file_content", [("l", "characters", 40, 4)], oversized_only=False).where("file_path = 'c'").count() == 1
    assert text_pieces(df.limit(0), "file_path", "file_content", [("l", "characters", 40, 4)], with_text=False).count() == 0
    assert got.agg(F.max("size")).first()[0] <= 40


@pytest.mark.parametrize("limit", [1500, 6000])
def test_files(spark, small, limit):
    df = spark.read.parquet(f"{small}/function_metadata.parquet")
    files = {r.file_content for r in df.where("file_content is not null").select("file_content").distinct().collect()}
    for text in files:
        found = split(text, limit, limit // 20)
        check(text, found, limit, limit // 20 if len(found) > 1 else 0)
