import numpy as np
import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from allelake.llm import leakage as L
from allelake.llm import words as W


def test_words():
    assert W.words("Über die STRAẞE (Beifall. [x]) läuft's – 3,5 Fuß.\nÉté́") == [b"uber", b"die", b"strasse", b"lauft", b"s", b"3", b"5", b"fuss", b"ete"]
    assert W.words("") == W.words(None) == W.words("(…)") == [] and W.words("Привет 世界") == ["привет", "世界"]
    assert W.words("open ( bracket") == [b"open", b"bracket"]


@given(st.lists(st.integers(1, 5), max_size=40), st.lists(st.integers(1, 5), max_size=40))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert L.common(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1][-1]


def test_keys_depend_on_the_window_alone():
    rng = np.random.default_rng(2)
    window = W.mixed(rng.integers(1, 1 << 60, L.WINDOW, dtype=np.uint64))
    a = np.concatenate([W.mixed(rng.integers(1, 99, 30, dtype=np.uint64)), window, np.zeros(20, np.uint64)])
    b = np.concatenate([window, W.mixed(rng.integers(1, 99, 30, dtype=np.uint64))])
    one = {k: keys[30] for k, keys in L.embedding_keys(a, 0, 40)}
    two = {k: keys[0] for k, keys in L.embedding_keys(b, 0, 20)}
    assert one == two and len(set(one.values())) == L.WALKS * L.KEYS


VOCABULARY = [f"w{i}" for i in range(400)]


def text(rng, n):
    return [VOCABULARY[i] for i in rng.integers(0, len(VOCABULARY), n)]


@pytest.mark.parametrize("kind,recall", [("run", 1.0), ("even", 0.95), ("random", 0.95), ("inserted", 0.95), ("every fourth out", 0.9), ("one after three", 0.9)])
def test_recall_of_edited_passages(kind, recall):
    rng = np.random.default_rng(7)
    items = [text(rng, int(n)) for n in rng.integers(50, 100, 60)]
    docs = []
    for w in items:
        w = list(w)
        if kind == "run":
            at = int(rng.integers(0, len(w) - L.RUN))
            w = ["zz", *w[at : at + L.RUN], "yy"]
        elif kind == "even":
            w = [x if i % 5 else "zz" for i, x in enumerate(w)]
        elif kind == "every fourth out":
            w = [x for i, x in enumerate(w) if i % 4]
        elif kind == "one after three":
            w = [y for i, x in enumerate(w) for y in ([x, "zz"] if i % 3 == 0 else [x])]
        else:
            for i in rng.permutation(len(w))[: len(w) // 4]:
                w[i] = w[i] + " zz" if kind == "inserted" else rng.choice(["", "zz"])
        docs.append(" ".join(text(rng, 40) + w + text(rng, 40)))
    none = W.Lookup(np.empty(0, np.uint64))
    ready = L.Items.of([(i, " ".join(w)) for i, w in enumerate(items)], none)
    seq, starts = W.joined(docs, L._GAP)
    found = ready.verified(np.concatenate([seq, np.zeros(L.WINDOW + 1, np.uint64)]), starts)
    assert sum((i, i) in found for i in range(len(items))) >= recall * len(items)
    assert len(found) <= len(items)  # and nothing else


@pytest.mark.parametrize("sizes", [(12, 20), (20, 45), (45, 120)])
@pytest.mark.parametrize("kind", ["evenly out", "randomly out", "evenly changed", "randomly changed", "one after two"])
def test_recall_at_the_least_share(kind, sizes):
    """70 % of the words kept, or all of them and another after every second: at least nine of ten are found, and nothing else."""
    rng = np.random.default_rng(sizes[0])
    words = [f"w{i}" for i in range(3_000)]
    often = 1 / (np.arange(3_000) + 2.0)  # some words are everywhere
    some = lambda n: list(rng.choice(words, n, p=often / often.sum()))
    items = [some(int(n)) for n in rng.integers(*sizes, 100)]
    docs = []
    for w in items:
        n, w = len(w), list(w)
        k = n - max(L.LEAST, -(-7 * n // 10))
        at = set(((np.arange(k) + 0.5) * n / max(k, 1)).astype(int).tolist() if kind.startswith("evenly") else rng.permutation(n)[:k].tolist())
        if kind.endswith("out"):
            w = [x for i, x in enumerate(w) if i not in at]
        elif kind.endswith("changed"):
            w = ["zz" if i in at else x for i, x in enumerate(w)]
        else:
            w = [y for i, x in enumerate(w) for y in ([x, "zz"] if i % 2 else [x])]
        docs.append(" ".join(some(60) + w + some(60)))
    ready = L.Items.of([(i, " ".join(w)) for i, w in enumerate(items)], W.Lookup(np.empty(0, np.uint64)))
    seq, starts = W.joined(docs, L._GAP)
    found = ready.verified(np.concatenate([seq, np.zeros(L.WINDOW + 1, np.uint64)]), starts)
    assert sum((i, i) in found for i in range(100)) >= 90
    for d, i in found - {(i, i) for i in range(100)}:  # only what the statement counts
        own = [int(x) for x in W.ids(docs[d])]
        n = len(items[i])
        assert any(L.common(W.ids(" ".join(items[i])), np.array(own[a : a + int(L.STRETCH * n)], np.uint64)) >= max(L.LEAST, -(-7 * n // 10)) for a in range(len(own)))


def test_table(spark):
    rng = np.random.default_rng(3)
    item, other = text(rng, 60), text(rng, 60)
    formula = [f"set{i}" for i in range(20)]
    docs = [(i, " ".join(text(rng, 30) + (formula if i < 40 else []) + text(rng, 30))) for i in range(100)]
    docs += [
        (200, " ".join(text(rng, 20) + item[10:23] + text(rng, 20))), (201, " ".join(item[10:20] + text(rng, 20))), (202, ("Ein (Zuruf) ".join(["", ""]) + " ".join(item)).upper().replace(" ", ",\n")),
        (203, " ".join(w for i, w in enumerate(item) if i % 4)), (204, " ".join(formula)), (205, None), (206, ""), (None, " ".join(item)), (200, " ".join(item)), (207, " ".join(other[:30] + ["(applause)"] + other[30:])),
    ]
    items = [(1, " ".join(item)), (2, " ".join(other[:30] + formula + other[30:])), (3, "few words"), (4, None), (5, ""), (1, " ".join(item)), (6, " ".join(formula))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame(items, "item_id int, text string")
    assert rows(L.leaked(d, t)) == [(200, 1), (202, 1), (203, 1), (207, 2)]
    assert L.leaked(d.limit(0), t).count() == 0 and L.leaked(d, t.limit(0)).count() == 0


def test_the_text_before_a_leak_is_not_blamed():
    rng = np.random.default_rng(11)
    items = [text(rng, 60) for _ in range(80)]
    docs = [" ".join(t) for w in items for t in (text(rng, 30), w)]
    ready = L.Items.of([(i, " ".join(w)) for i, w in enumerate(items)], W.Lookup(np.empty(0, np.uint64)))
    seq, starts = W.joined(docs, L._GAP)
    assert ready.verified(np.concatenate([seq, np.zeros(L.WINDOW + 1, np.uint64)]), starts) == {(2 * i + 1, i) for i in range(80)}


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 300)
    monkeypatch.setattr(L, "FORMULA_BLOCK", 700)
    rng = np.random.default_rng(4)
    items = [text(rng, 40) for _ in range(5)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert rows(L.leaked(d, t)) == [(i, i) for i in range(5)]


def test_copies_of_a_leak_make_no_formula(spark):
    rng = np.random.default_rng(5)
    item, formula = text(rng, 60), [f"set{i}" for i in range(20)]
    speech = text(rng, 30) + item[10:30] + text(rng, 30)
    noise = [text(rng, 60) + (formula if i < 10 else []) + text(rng, 9) for i in range(66)]
    plain = [(i, " ".join(w)) for i, w in enumerate([*noise, *[speech] * 33, text(rng, 20) + item[10:30] + text(rng, 20), item[:30] + formula + item[30:]])]
    items = spark.createDataFrame([(1, " ".join(item[:30] + formula + item[30:]))], "item_id long, text string")
    expected = sorted(((i, 1) for i in range(66, 101)), key=repr)
    assert rows(L.leaked(spark.createDataFrame(plain, "doc_id long, text string").repartition(3), items)) == expected
    # Corrected issues, each otherwise, some with a reference and all of one occasion or, without one, all with a reference.
    for told in (True, False):
        issued = []
        for i, t in plain:
            copy = 66 < i < 99
            w = t.split() + ([f"fix{i}"] if copy else [])
            issued.append((i, " ".join(w), 66 if copy and (i % 2 or not told) else None, "h", (7 if 66 <= i < 99 else i) if told else None, 1, "2024-01-01"))
        d = spark.createDataFrame(issued, "doc_id long, text string, reissue_of long, source string, sitting_id long, speech_no int, held_at string")
        assert rows(L.leaked(d.repartition(3), items)) == expected


def test_an_item_in_many_speeches_is_no_formula(spark):
    rng = np.random.default_rng(6)
    item, formula = text(rng, 60), [f"set{i}" for i in range(20)]
    whole = item[:30] + formula + item[30:]
    docs = [text(rng, 30) + (whole if i < 20 else formula if i < 50 else []) + text(rng, 30) for i in range(100)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    t = spark.createDataFrame([(1, " ".join(whole)), (2, " ".join(formula))], "item_id long, text string")
    assert rows(L.leaked(d, t)) == sorted(((i, 1) for i in range(20)), key=repr)


@pytest.mark.parametrize("n", range(8, 18))
def test_short_items(n):
    rng = np.random.default_rng(n)
    items = [text(rng, n) for _ in range(50)]
    need = max(L.LEAST, -(-7 * n // 10))
    docs = [" ".join(text(rng, 20 + i % 16) + w + text(rng, 30)) for i, w in enumerate(items)]
    docs += [" ".join(text(rng, 20) + w[:need] + text(rng, 30)) for w in items]  # the most words missing at the end
    docs += [" ".join(text(rng, 20) + [y for x in w for y in (x, "zz", "zz", "zz")] + text(rng, 30)) for w in items]  # a stretch four times as long
    ready = L.Items.of([(i, " ".join(w)) for i, w in enumerate(items)], W.Lookup(np.empty(0, np.uint64)))
    seq, starts = W.joined(docs, L._GAP)
    found = ready.verified(np.concatenate([seq, np.zeros(L.WINDOW + 1, np.uint64)]), starts)
    assert found >= {(i, i) for i in range(50)} and found <= {(i, i % 50) for i in range(100)}
    if n < 12:
        assert found == {(i, i % 50) for i in range(100)}


def test_the_first_text_may_lack_the_beginning():
    rng = np.random.default_rng(12)
    items = [text(rng, 100) for _ in range(3)]
    docs = [" ".join(y for i, x in enumerate(items[1][28:]) for y in ([x] if (i + 1) % 10 else [x, "zz"])), " ".join(text(rng, 300))]
    ready = L.Items.of([(i, " ".join(w)) for i, w in enumerate(items)], W.Lookup(np.empty(0, np.uint64)))
    for texts in (docs, docs[::-1], docs[:1]):
        seq, starts = W.joined(texts, L._GAP)
        assert ready.verified(np.concatenate([seq, np.zeros(L.WINDOW + 1, np.uint64)]), starts) == {(texts.index(docs[0]), 1)}


def searched(items, docs):
    ready = L.Items.of([(i, " ".join(w)) for i, w in enumerate(items)], W.Lookup(np.empty(0, np.uint64)))
    seq, starts = W.joined(docs, L._GAP)
    return ready.verified(np.concatenate([seq, np.zeros(L.WINDOW + 1, np.uint64)]), starts)


def test_only_texts_with_enough_of_an_items_words_are_walked(monkeypatch):
    rng = np.random.default_rng(13)
    items = [text(rng, 60) for _ in range(5)]
    edited = [w for i, w in enumerate(items[3]) if i % 4]
    docs = [" ".join([f"other{i}" for i in rng.integers(0, 400, 300)] + items[i % 5][:20] * 2) for i in range(40)]  # runs, and words that repeat, but no other leak
    docs += [" ".join(items[2][:10] + [f"other{i}" for i in range(200)]) for _ in range(40)]
    docs[50] = " ".join(text(rng, 40) + edited + text(rng, 40))
    walked, keys = [], L.embedding_keys

    def counted(seq, lo, hi):
        walked.append(hi - lo)
        return keys(seq, lo, hi)

    monkeypatch.setattr(L, "embedding_keys", counted)
    ready = L.Items.of([(i, " ".join(w)) for i, w in enumerate(items)], W.Lookup(np.empty(0, np.uint64)))
    walked.clear()
    seq, starts = W.joined(docs, L._GAP)
    found = ready.verified(np.concatenate([seq, np.zeros(L.WINDOW + 1, np.uint64)]), starts)
    assert found == {(i, i % 5) for i in range(40)} | {(50, 3)}
    assert sum(walked) <= len(docs[50].split()) + L._GAP


@given(st.lists(st.lists(st.integers(1, 6), max_size=30), min_size=1, max_size=5), st.lists(st.lists(st.integers(1, 9), max_size=60), min_size=1, max_size=5), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_the_look_at_whole_texts_misses_nothing(items, texts, side):
    mixed = lambda x: W.mixed(np.array(x, np.uint64))
    size = np.array([len(w) for w in items])
    need = np.maximum(L.LEAST, np.ceil(L.SHARE * size - 1e-9).astype(np.int64))
    seq = np.concatenate([x for t in texts for x in (mixed(t), np.zeros(3, np.uint64))])
    before, L._SIDE = L._SIDE, side
    try:
        enough = L.Bags.of(mixed([x for w in items for x in w]), size, need).enough(seq, np.cumsum([0, *[len(t) + 3 for t in texts]]))
    finally:
        L._SIDE = before
    for t, own in enumerate(texts):
        for k, w in enumerate(items):
            least = sum(min(w.count(x), own.count(x)) for x in set(w))
            most = sum(w.count(x) if own.count(x) > 1 else min(own.count(x), 1) for x in set(w))
            assert enough[t, k] == (most >= need[k]) and (enough[t, k] or least < need[k])


def test_other_texts_make_no_difference(monkeypatch):
    rng = np.random.default_rng(14)
    items = [text(rng, int(n)) for n in rng.integers(8, 90, 40)]
    docs = []
    for w in items:
        out = set(rng.permutation(len(w))[: 3 * len(w) // 10].tolist())
        docs.append(" ".join(text(rng, int(rng.integers(0, 90))) + [x for i, x in enumerate(w) if i not in out] + text(rng, 40)))
    together = searched(items, docs)
    assert together == {(i, k) for i, d in enumerate(docs) for _, k in searched(items, [d])}
    assert {(i, k) for i, k in searched(items, docs[::-1])} == {(len(docs) - 1 - i, k) for i, k in together}
    monkeypatch.setattr(L, "_PAIRS", 130)  # three texts at a time
    assert searched(items, docs) == together


def test_long_items():
    """Stretches of several thousand words, so of several rows of patches."""
    rng = np.random.default_rng(15)
    words = [f"w{i}" for i in range(20_000)]
    some = lambda n: [words[i] for i in rng.integers(0, len(words), n)]
    items = [some(5_000), some(900), some(60)]
    kept = [[x for i, x in enumerate(w) if i % 10 not in (2, 5, 8)] for w in items]
    docs = [" ".join(some(3_000) + kept[0] + some(2_000)), " ".join(some(100) + kept[1]), " ".join(some(7_000) + kept[2] + some(10)), " ".join(some(9_000)), " ".join(kept[0][:2_000])]
    assert searched(items, docs) == {(0, 0), (1, 1), (2, 2)}
