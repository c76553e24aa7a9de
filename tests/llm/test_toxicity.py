import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import toxicity as tox

from .helpers import awkward, docs, empty


def test_grammar_scores_clauses_not_words():
    g = tox.Grammar({"moron": 1.0})
    s = lambda t: g.score(g.features(t))
    assert s("You are a moron.") > s("A moron.") > s("He said moron.") > s("plain words")
    assert s("A moron, you.") > s("A moron.") and s("People are moron") > s("A moron.")
    assert s("not a moron") < s("a moron")
    assert s("I will kill you") > 0.5 > s("they kill weeds") and s("kill time") < 0.1
    assert s("He said I will kill you") < s("I will kill you") and s("I will not kill you") < s("I will kill you")
    assert s("") == s(None) == s("nothing here") < 0.1


def test_negation_scope_ends():
    g = tox.Grammar({"moron": 1.0})
    assert g.features("not one of the many a moron")[0] == 1.0
    assert g.features("not a moron")[1] == 1.0


def brute_outputs(symbols):
    """The rules of the five transducers, one after the other over the whole clause."""
    out, intent = [], 0
    for x in symbols:  # threat
        out.append("O" if x == "W" else ("H+" if intent else "O") if x == "H" else x)
        intent = tox.INTENT_SCOPE if x == "W" else max(0, intent - 1)
    symbols, out, scope = out, [], 0
    for x in symbols:  # negation
        out.append("O" if x == "N" else {"I": "I-", "H+": "H-"}.get(x, x) if scope else x)
        scope = tox.SCOPE if x == "N" else max(0, scope - 1)
    symbols, out, said = out, [], False
    for x in symbols:  # reported speech
        out.append("O" if x == "R" else {"I": "Ir", "I-": "Ir", "H+": "Hr", "H-": "Hr"}.get(x, x) if said else x)
        said = said or x == "R"
    symbols, out, named, waits = out, [], False, None
    for x in symbols:  # target
        if x in "PG":
            out.append("+" + waits if waits else "O")
            named, waits = True, None
        elif named:
            out.append({"I": "It", "H+": "Ht"}.get(x, x))
        else:
            out.append(x)
            waits = "H" if x == "H+" or waits == "H" else "I" if x == "I" else waits
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(tox.CLASSES), max_size=14))
def test_the_composed_machine_reads_as_its_rules(symbols):
    follow, emit = tox.compose()
    state, out = 0, []
    for x in symbols:
        c = tox.CLASSES.index(x)
        out.append(emit[state][c])
        state = follow[state][c]
    assert out == brute_outputs(symbols)


def test_scores_against_brute_force(spark):
    """The query's scores are those of the rules applied to each clause."""
    frame, labels = synthetic(spark, 300)
    train = tox.training_rows(frame, labels)
    g = tox.fit(train, tox.learn_lexicon(train))
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in tox.score(frame, g).collect():
        total = np.zeros(len(tox.FEATURES))
        for clause in re.split(r"[.!?;:\n]+", texts[r["doc_id"]].lower()):
            words = re.findall(r"[\w']+", clause)
            kinds = ["I" if w in g.lexicon else next((c for c, ws in (("H", tox.THREATS), ("N", tox.NEGATIONS), ("P", tox.PERSONS), ("R", tox.REPORTS), ("W", tox.INTENTS), ("G", tox.GROUPS)) if w in ws), "O") for w in words]
            last = 1.0
            for w, x in zip(words, brute_outputs(kinds), strict=True):
                last = g.lexicon.get(w, last)
                if x in tox.EMITS:
                    f = tox.EMITS[x]
                    total[tox.FEATURES.index(f)] += 1.0 if f in ("threat", "aimed") else last
        z = g.weights[0] + g.weights[1:] @ total if total.any() else g.base
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_held_out_is_the_contracts(spark):
    got = {r["id"]: r["h"] for r in spark.range(500).select("id", tox.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(500)}


def synthetic(spark, n=900, seed=0):
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}" for a in ("the", "on", "ti", "re", "ou") for b in ("nd", "st", "ha", "er", "ing", "ble")]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        bad = i % 8 == 0
        if bad:
            for at in rng.integers(0, 40, 3):
                words[at] = str(rng.choice(["zorgo", "blarf", "krunk"]))
        rows.append(" ".join(words))
        labels.append((i, 1, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_generalises(spark):
    frame, labels = synthetic(spark)
    rows = tox.judge(frame, labels).collect()
    assert len(rows) == 900
    assert all(r["predicted"] == int(r["doc_id"] % 8 == 0) for r in rows if r["held_out"])
    lexicon = tox.learn_lexicon(tox.training_rows(frame, labels))
    assert set(lexicon) == {"zorgo", "blarf", "krunk"}


def test_copies_count_once(spark):
    frame, labels = synthetic(spark, 400)
    copies = spark.createDataFrame([(1000 + i, "ordinary uncommonword in one copied text", "en", "s", 1) for i in range(50)], frame.schema)
    more = spark.createDataFrame([(1000 + i, 1, 1) for i in range(50)], labels.schema)
    train = tox.training_rows(frame.union(copies), labels.union(more))
    assert "uncommonword" not in tox.learn_lexicon(train)


def test_held_out_quality_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = tox.query(spark, d).filter("held_out").join(labels, "doc_id").filter("toxic is not null").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    false = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(false) < 0.01 and np.mean(caught) > 0.5


def test_held_out_quality_on_the_larger_tables(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = tox.query(spark, d).filter("held_out").join(labels, "doc_id").filter("toxic is not null").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    false = [r["predicted"] for r in rows if r["toxic"] == 0]
    print(len(caught), np.sum(caught), len(false), np.sum(false))
    assert np.sum(caught) / max(1, np.sum(caught) + np.sum(false)) >= 0.97 and np.mean(caught) >= 0.8


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward(spark, make):
    frame = make(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, None, None), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = tox.judge(frame, labels).collect()
    assert len(rows) == frame.count() and all(0 <= r["score"] <= 1 for r in rows)
