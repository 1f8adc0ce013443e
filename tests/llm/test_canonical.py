import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.canonical import LOOKALIKES, OTHER_SCRIPTS, canonical_array, canonical_text, lookalike_classes, lookalike_pairs
from millrace.operators.batches import pieces


def canonical(*texts, skeleton=False):
    return canonical_array(pa.array(list(texts), pa.string()), skeleton).to_pylist()


SAME = [
    ("ｆｕｌｌ　１２", "full 12"), ("ﬁne ﬂow ﬀ", "fine flow ff"), ("étude", "étude"), ("zero​width⁠﻿­", "zerowidth"), ("a b c d e", "a b c d e"),
    ("x‑y", "x-y"), ("АВС аес", "ABC aec"), ("Αο ν", "Ao v"), ("a;;", "a;;"), ("KK", "KK"), ("ạ̈", "ạ̈"), ("ё", "ё"), ("각", "각"), ("ㅤ", ""),
]
DIFFERENT = [("x²", "x2"), ("①", "1"), ("resume", "résumé"), ("Case", "case"), ("👩‍💻", "👩💻"), ("❤️", "❤"), ("👩‍💻", "👨‍💻"), ("a b", "a  b"), ("–", "-")]


@pytest.mark.parametrize("a, b", SAME)
def test_alike(a, b):
    assert len(set(canonical(a, b))) == 1


@pytest.mark.parametrize(
    "text, want",
    [
        ("Москва сорок", "Москва сорок"), ("Αθήνα και ο χορός", "Αθήνα και ο χορός"), ("аpple", "apple"), ("Ꭱed ꓐank ᴀdmin", "Red Bank admin"), ("ϲode", "code"), ("the а b", "the a b"),
        ("Mocква", "Москва"), ("вижу рeку", "вижу реку"), ("тест PHP и HTTP", "тест PHP и HTTP"), ("поезд о чем", "поезд о чем"), ("see Москва", "see Москва"), ("Ζoο dog", "Zoo dog"), ("dа́ta", "dáta"),
        ("ᏣᎳᎩ ᏗᎦᏬᏂ", "ᏣᎳᎩ ᏗᎦᏬᏂ"), ("Հայաստան", "Հայաստան"), ("東京 tоkyo", "東京 tokyo"),
    ],
)
def test_words_keep_their_script(text, want):
    assert canonical(text) == [unicodedata.normalize("NFC", want)]


@pytest.mark.parametrize("texts", [("Москва", "Mосквa"), ("code", "соԁе"), ("Ꭱed", "Red"), ("ϲ", "c", "с"), ("ёлка", "ëлка")])
def test_skeletons_are_equal(texts):
    assert len(set(canonical(*texts, skeleton=True))) == 1


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_not_alike(a, b):
    assert len(set(canonical(a, b))) == 2


def test_tables_are_pairs():
    assert all(len(a) == len(b) for a, b in (*LOOKALIKES, *OTHER_SCRIPTS.values()))


def plain(text):
    """The same by calls for each text, for texts without look-alikes, emoji or compatibility characters."""
    return unicodedata.normalize("NFC", text)


alphabet = st.characters(codec="utf-8", categories=("Ll", "Lu", "Mn", "Nd"), max_codepoint=0x36F)


@given(st.lists(st.text(alphabet, max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_equals_normal_form(texts):
    skip = {c for t in texts for c in t if unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c) or 0x34F == ord(c) or c in "ɑɡıɩʏ"}
    texts = ["".join(c for c in t if c not in skip) for t in texts]
    want = [plain(t) for t in texts]
    got = canonical(*texts)
    assert [unicodedata.normalize("NFD", g) for g in got] == [unicodedata.normalize("NFD", w) for w in want]
    assert canonical(*got) == got


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_stable_and_independent_of_neighbours(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    got = canonical(*texts)
    assert canonical(*got) == got
    assert [canonical(t)[0] for t in texts] == got


def test_columns_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(1, "ﬁ" * 300_000, "old"), (2, None, "x"), (3, "", "y")], "id long, text string, canonical string")
    got = {r.id: r.canonical for r in canonical_text(df, "text").collect()}
    assert got == {1: "fi" * 300_000, 2: None, 3: ""}
    assert canonical_text(df, "text").columns == ["id", "text", "canonical"]
    assert canonical_text(df.limit(0), "text").count() == 0


def test_pairs_equal_brute_force(spark):
    rows = [(1, "A b"), (2, "А b"), (3, "A b"), (4, "A b"), (5, None), (6, ""), (7, "​"), (8, "same"), (9, "same"), (None, "A b"), (10, "x²"), (11, "x2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    forms = dict(zip((i for i, _ in rows), canonical(*(t for _, t in rows), skeleton=True), strict=True))
    want = {(a, b) for a, x in rows for b, y in rows if a is not None and b is not None and a < b and x is not None and y is not None and x != y and forms[a] == forms[b]}
    assert {tuple(r) for r in lookalike_pairs(df, "doc_id", "text").collect()} == want == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (6, 7)}
    assert lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_classes_equal_pairs(spark):
    rows = [(1, "A b"), (2, "А b"), (3, "Ａ b"), (4, "A b"), (5, None), (6, ""), (7, "​"), (8, "same"), (9, "same"), (None, "A b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r["class"], r.n_spellings, r.n_links) for r in lookalike_classes(df, "doc_id", "text").collect()}
    links = {}
    for a, b in lookalike_pairs(df, "doc_id", "text").collect():
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        assert got[a][0] == got[b][0]
    # a row without a key counts in its class, in no pair
    assert {i: n for i, (_, _, n) in got.items()} == links and got[1][1] == 3 and got[6][1] == 2
    assert lookalike_classes(df.limit(0), "doc_id", "text").count() == 0


def test_many_spellings_of_one_form(spark):
    letters = ["aа", "eе", "oо", "pр", "cс", "xх"]
    texts = ["".join(x[i >> k & 1] for k, x in enumerate(letters)) for i in range(64)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lookalike_pairs(df, "doc_id", "text").count() == 64 * 63 // 2
    assert {r.n_links for r in lookalike_classes(df, "doc_id", "text").collect()} == {63}


def test_many_copies_of_one_spelling(spark):
    rows = [(i, "same text") for i in range(20_000)] + [(20_000, "ѕame text"), (20_001, "other")]
    got = lookalike_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert got.count() == 20_000 and got.where("doc_id_2 = 20000").count() == 20_000


def test_pieces_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a" * 9, None, "b" * 30, "c"])], names=["i", "t"])
    parts = list(pieces(batch, 1, most=10))
    assert [p.column(0).to_pylist() for p in parts] == [[1, 2], [3], [4]]
    assert list(pieces(batch.slice(0, 0), 1)) == []
