import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from allelake.llm import tokens as K
from allelake.llm.splitting import PARAGRAPH, SENTENCE, StrongestCut, split, split_texts


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.data())
@settings(max_examples=100, deadline=None)
def test_strongest_cut_is_the_rightmost_maximum(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    got = StrongestCut(np.array(values, np.int8)).query(lo, hi)
    best = max(values[lo : hi + 1])
    assert got == max(i for i in range(lo, hi + 1) if values[i] == best)


TEXTS = [
    " ".join(f"word{i}" + (".\n\n" if i % 41 == 0 else "." if i % 13 == 0 else "") for i in range(900)),
    "größere Häuser (Beifall. Zuruf!) und [Lärm] stehen; " * 90, "a" * 3000, "é" * 2000, "日本語のテキスト。" * 150, "\n" * 2000, "  x" * 800, "😀 " * 500, "short", "x y " * 400,
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("limit,overlap", [(100, 16), (64, 0), (256, 100)])
def test_pieces(text, limit, overlap):
    raw = text.encode()
    got = split(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(raw)
    for lo, hi, n in got:
        assert K.count(raw[lo:hi].decode()) == n <= limit  # decodes, so no character is cut
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert a < c <= b < d
        shared = K.count(raw[c:b].decode())
        assert overlap == 0 and c == b or overlap <= shared + 3 and shared <= overlap + 12
    if K.count(text) <= limit:
        assert len(got) == 1


def test_cuts_fall_on_boundaries():
    text = "".join(f"Sentence number {i} has some words in it. " + ("\n\n" if i % 9 == 8 else "") for i in range(200))
    raw = text.encode()
    for _, hi, _ in split(text, 100, 10)[:-1]:
        assert raw[:hi].rstrip().endswith(b".")


def test_no_cut_within_brackets_where_there_is_another():
    text = "one two three (four five. six seven) eight nine. " * 100
    for _, hi, _ in split(text, 80, 8)[:-1]:
        assert text[:hi].count("(") == text[:hi].count(")")


def test_odd_input(spark):
    assert split("") == [] and split("\ud800x")[0][2] >= 1
    with pytest.raises(ValueError):
        split("x", 10, 5)
    df = spark.createDataFrame([(1, "a b " * 50, "c"), (2, None, "c"), (3, "", "c"), (3, "short", None), (None, "d e " * 60, None)], "doc_id long, text string, piece string")
    got = split_texts(df, limit=40, overlap=4).collect()
    assert {r["doc_id"] for r in got} == {1, 3, None}
    assert {r["doc_id"] for r in split_texts(df, limit=40, overlap=4, only_oversized=True).collect()} == {1, None}
    assert split_texts(df.limit(0)).count() == 0
    assert PARAGRAPH > SENTENCE
