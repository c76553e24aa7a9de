import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import decontamination as dec

from .helpers import awkward, docs, empty


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dec.MATCH if x == y and x else dec.MISMATCH), h[i - 1][j] + dec.GAP, h[i][j - 1] + dec.GAP)
    return max(map(max, h))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=20))
def test_align_is_smith_waterman(a, b):
    score, start, end = dec.align(np.array(a, np.int64), np.array(b, np.int64))
    assert score == brute_align(a, b)
    assert brute_align(a, b[start:end]) == score


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_all_documents_against_verbatim_and_full_alignment(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r for r in dec.query(spark, sf_dir).collect()}
    for i, t in texts.items():
        for j, b in items.items():
            if b in t:
                assert got[i, j]["score"] == 1.0
                assert dec.words_of(t[got[i, j]["start"] : got[i, j]["end"]]) == dec.words_of(b)
    vocab = {}
    number = lambda ws: np.array([vocab.setdefault(w, len(vocab) + 1) for w in ws], np.int64)
    few = list(texts)[:40]
    for j, b in items.items():
        item = number(dec.words_of(b))
        for i in few:
            full = dec.align(item, number(dec.words_of(texts[i])))[0] / (2 * len(item))
            assert (full >= 0.5) == ((i, j) in got)


def test_edited_copies(spark):
    rng = np.random.default_rng(0)
    item = [f"w{i}" for i in range(40)]
    cases = []
    for k in range(30):
        w = list(item)
        for at in rng.choice(40, 7, replace=False):
            w[at] = f"z{k}{at}" if at % 3 else w[at] + " inserted"
        cases.append("lead words here " + " ".join(w) + " and a tail")
    clean = [" ".join(f"w{i}" for i in rng.integers(0, 40, 60)) for _ in range(30)]
    got = {r["doc_id"] for r in dec.contaminated(docs(spark, cases + clean), bench(spark, [" ".join(item)])).collect()}
    assert got == set(range(30))


def edited(rng, words, share, kind):
    """A copy with a share of its words replaced, at random or evenly spaced, or with words put in or left out."""
    w, n = list(words), len(words)
    at = set(rng.choice(n, round(share * n), replace=False).tolist()) if kind != "even" else set(range(round(1 / share) - 1, n, round(1 / share)))
    out = []
    for i, x in enumerate(w):
        if i not in at:
            out.append(x)
        elif kind in ("random", "even"):
            out.append(f"q{rng.integers(1e9)}")
        elif kind == "insert":
            out += [x, f"q{rng.integers(1e9)}"]
    return out


def recall(spark, items, cases, background):
    """Share found of the copies that full alignment scores 0.5 or more; (copies, their mean score)."""
    rows, true = [], {}
    for n, (j, copy) in enumerate(cases):
        text = "some lead words " + " ".join(copy) + " and then a tail"
        vocab = {}
        number = lambda ws: np.array([vocab.setdefault(w, len(vocab) + 1) for w in ws], np.int64)
        item = number(dec.words_of(items[j]))
        if dec.align(item, number(dec.words_of(text)))[0] / (2 * len(item)) >= 0.5:
            true[n] = j
        rows.append(text)
    frame = docs(spark, rows + background)
    got = {(r["doc_id"], r["item_id"]) for r in dec.contaminated(frame, bench(spark, items)).collect()}
    return len(true), np.mean([(n, j) in got for n, j in true.items()])


def test_recall_against_full_alignment(spark):
    d = "/root/testdata/sf0.01"
    items = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").collect()]
    background = [r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    rng = np.random.default_rng(5)
    for kind, share in (("random", 0.05), ("random", 0.15), ("random", 0.2), ("random", 0.3), ("even", 1 / 4), ("even", 1 / 3), ("insert", 0.3), ("delete", 0.3)):
        cases = [(j, edited(rng, dec.words_of(t), share, kind)) for j, t in enumerate(items)]
        n, share_found = recall(spark, items, cases, background)
        print(kind, share, n, share_found)
        assert share_found >= 0.97, (kind, share, n)


def test_short_items_and_evenly_spaced_edits(spark):
    """Cases in which most seeds are broken."""
    for n, every in ((8, 5), (12, 6), (40, 4), (100, 4), (40, 3)):
        item = [f"w{i}" for i in range(n)]
        copy = [f"z{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
        assert recall(spark, [" ".join(item)], [(0, copy)], [])[1] == 1.0
    texts = ["one answer here", "nothing at all", "the two words", "東京は日本の首都です"]
    got = {(r["doc_id"], r["item_id"]) for r in dec.contaminated(docs(spark, texts), bench(spark, ["answer", "two words", "words two", "日本の首都", "missing"])).collect()}
    assert got == {(0, 0), (2, 1), (3, 3)}


def test_blocks_give_the_same(spark, sf_dir):
    d, b = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = {tuple(r) for r in dec.contaminated(d, b).collect()}
    assert {tuple(r) for r in dec.contaminated(d, b, block_words=500).collect()} == whole


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward(spark, make):
    frame = make(spark)
    b = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "x y z"), (4, "two words"), (1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    kept = dec.clean(frame, b)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == ({2, 3, 4, None, 5, 7} if frame.count() else set())
    assert dec.clean(frame, bench(spark, []).limit(0)).count() == frame.count()
