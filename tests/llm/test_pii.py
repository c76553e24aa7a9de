import collections
import hashlib
import math
import re

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pii

from .helpers import awkward, docs, empty

#: The contract's patterns as they stand there.
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    if kind == "phone":
        return 9 <= len(d) <= 15
    return True


def brute(text):
    return {k: [(k, m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in CONTRACT.items()}


def spans_of(r):
    return {k: [tuple(s) for s in r[f"spans_{k}"]] for k in pii.KINDS}


def test_all_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for s in want.values() for k, a, b in s)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"].startswith(base)


TRICKY = [
    "a@b.c_d@e.f", "a@@b.c x@y", "a.b@c.d.e@f.g", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111x4111111111111111",
    "+1 (317) 555-7008.", "+1 (((((", "++12 345 678 90", "+1 2 +1 234 567 890", "é🙂 a@b.co 🙂 10.0.0.1", "", "@", "x" * 30_000, "1-" * 9_000, "a." * 9_000 + "@x", "a@b" + ".c" * 9_000, "12345678901234567890123",
]


def test_tricky_texts(spark):
    rows = pii.with_base_spans(docs(spark, TRICKY).withColumnRenamed("text", "__gl_t")).collect()
    for r in rows:
        assert spans_of(r) == brute(r["__gl_t"]), r["__gl_t"][:60]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1234@.+- ()_é🙂\n")), max_size=40), min_size=60, max_size=60))
def test_property(spark, texts):
    rows = pii.with_base_spans(docs(spark, texts).withColumnRenamed("text", "__gl_t")).collect()
    for r in rows:
        assert spans_of(r) == brute(r["__gl_t"])


def test_disclosing_terms_are_found_and_replaced(spark):
    filler = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    known = [f"{filler[i]} about Wintergreen wrote {filler[i // 2]} ann@x.org {filler[-i - 1]} today" for i in range(6)]
    clean = [f"{w} today about nothing {i} here" for i, w in enumerate(filler * 8)]
    frame = docs(spark, known + clean + ["only Wintergreen here"])
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(frame, threshold=0.9).collect()}
    assert out[len(known) + len(clean)] == "only <TERM> here"
    assert all("<EMAIL>" in out[i] and "Wintergreen" not in out[i] for i in range(6))
    assert [out[6 + i] for i in range(len(clean))] == clean


def test_contexts_that_differ_only_away_from_the_mention_count(spark):
    filler = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    clean = [f"{w} today about nothing {i} here" for i, w in enumerate(filler * 8)]
    known = [f"{filler[i]} about Wintergreen wrote ann@x.org {filler[-i - 1]} today {filler[i // 2]}" for i in range(6)]
    template = [f"{filler[i]} asks Wintergreen please write to ann@x.org today {filler[-i - 1]}" for i in range(6)]
    for texts in (known, template):
        out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, texts + clean + ["only Wintergreen here"]), threshold=0.9).collect()}
        assert out[len(texts) + len(clean)] == "only <TERM> here"
        assert all("<EMAIL>" in out[i] and "Wintergreen" not in out[i] for i in range(6))


def test_copies_of_a_text_hide_no_disclosing_term(spark):
    filler = ["alpha", "bravo", "charlie", "delta"]
    known = [f"{w} about Wintergreen wrote ann@x.org {w} today" for w in filler]
    clean = [f"{w} today about nothing {i} here" for i, w in enumerate(filler * 16)]
    for times in (1, 50):
        out = pii.sanitise(docs(spark, known * times + clean + ["only Wintergreen here"]), threshold=0.9)
        assert out.filter("text like '%Wintergreen%'").count() == 0
        assert out.filter("text = 'only <TERM> here'").count() == 1


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward(spark, make):
    frame = make(spark)
    assert pii.find(frame).count() == frame.count()
    out = pii.sanitise(frame)
    assert out.columns == frame.columns and out.count() == frame.count()
    assert out.filter("text is null").count() == frame.filter("text is null").count()
    assert out.filter("text like '%@example.com%'").count() == 0


def brute_terms(texts, threshold, support):
    """term -> removed, by the definition: pointwise mutual information over distinct texts."""
    texts = sorted({t or "" for t in texts})
    letters = regex.compile(r"\p{L}+")
    entity, pair, holds = collections.defaultdict(set), collections.defaultdict(set), collections.Counter()
    for h, t in enumerate(texts):
        holds.update({w.lower() for w in letters.findall(t)})
        for kind, found in brute(t).items():
            for _, a, b in found:
                v = t[a:b]
                d = re.sub("[^0-9]", "", v)
                whole, group = {"email": (v.lower(), v.lower().split("@")[-1]), "ip": (v, v.rsplit(".", 1)[0]), "card": (d, d[:6]), "phone": (d, d[:-7])}[kind]
                near = letters.findall(t[max(0, a - 96) : a])[::-1][:6] + letters.findall(t[b : b + 96])[:6]
                for e in ((kind, 0, whole), (kind, 1, group)):
                    entity[e].add(h)
                    for w in near:
                        if len(w) >= 4:
                            pair[e, w.lower()].add(h)
    out, n = {}, len(texts)
    for (e, w), both in pair.items():
        n_et, n_e, n_t = len(both), len(entity[e]), holds[w]
        if n_et >= support and math.log(n_et * n / (n_t * n_e)) / max(math.log(max(n, 2) / n_e), 1e-9) >= threshold - 1e-9:
            out[w] = out.get(w, False) or n_et == n_t
    return out


def test_terms_against_brute_force(spark, sf_dir):
    rng = np.random.default_rng(4)
    common = [f"{a}{b}" for a in ("lorem", "ipsum", "dolor", "amet") for b in ("a", "ba", "ca", "da", "fa")]
    people = [("ann@acme.org", "Wintergreen"), ("bob@acme.org", "Acmetown"), ("10.1.2.3", "Gateway"), ("+1 (317) 555-7008", "Mountain"), ("4111 1111 1111 1111", "Goldcard")]
    texts = []
    for i in range(300):
        words = [str(w) for w in rng.choice(common, 20)]
        if i % 4 == 0:
            value, name = people[int(rng.integers(len(people)))]
            at = int(rng.integers(0, 20))
            words[at:at] = [name if rng.random() < 0.9 else "someone", value] if rng.random() < 0.5 else [value, name]
        elif i % 31 == 0:
            words.append(people[int(rng.integers(len(people)))][1])
        texts.append(" ".join(words))
    texts += texts[:40] * 3 + [None, ""]
    for threshold, support in ((0.95, 3), (0.6, 2)):
        got = {r["term"]: r["removed"] for r in pii.disclosing_terms(docs(spark, texts), threshold, support).collect()}
        assert got == brute_terms(texts, threshold, support) and got
    # the invented prose of the tables has none, as the definition has it
    real = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["term"]: r["removed"] for r in pii.disclosing_terms(spark.read.parquet(f"{sf_dir}/documents.parquet"), 0.5, 2).collect()}
    assert got == brute_terms(real, 0.5, 2)


def test_a_term_never_seen_alone_is_removed(spark):
    filler = ["alpha", "bravo", "charlie", "delta"]
    known = [f"{w} about Wintergreen wrote ann@x.org {w} today" for w in filler]
    clean = [f"{w} today wrote about nothing {i} here" for i, w in enumerate(filler * 16)]
    out = [r["text"] for r in pii.sanitise(docs(spark, known + clean)).collect()]
    assert out[:4] == [f"{w} about  wrote <EMAIL> {w} today" for w in filler] and out[4:] == clean


def test_rows_that_say_nothing_hide_no_term(spark, tmp_path):
    """Two texts show a term in a table of any size; the rows that fill it up hold neither the term nor its entity."""
    known = docs(spark, [f"{w} about Wintergreen wrote ann@x.org" for w in ("alpha", "bravo")])
    for n in (1_000, 120_000):
        plain = spark.range(2, n).selectExpr("id as doc_id", "concat('nothing about what they wrote ', id) as text", "'en' as lang", "'src0' as source", "30L as n_chars")
        frame = known.union(plain)
        assert {r["term"]: r["removed"] for r in pii.disclosing_terms(frame).collect()} == {"wintergreen": True}
        frame.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        rows = pii.query(spark, f"{tmp_path}/{n}")
        assert rows.count() == n
        assert {r["doc_id"]: r["spans"] for r in rows.filter("n_term > 0").collect()} == {i: "email:30:39,dropped:12:23" for i in (0, 1)}


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 9, n).tolist() for n in (0, 1, 127, 128, 129, 1000)] + [None]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>")
    got = {r["i"]: (r["s"], r["m"]) for r in pii.running(pii.running(frame, "v", "s"), "v", "m", largest=True).collect()}
    for i, r in enumerate(rows):
        r = r or []
        assert got[i] == ([sum(r[:k]) for k in range(len(r))], [max([0, *r[:k]]) for k in range(len(r))])


def test_a_text_of_very_many_mentions(spark):
    """Work is linear in the mentions of a text: the square of these would take hours."""
    n = 20_000
    text = " ".join(f"wörd mail{i}@x.org" for i in range(n))
    out = pii.sanitise(docs(spark, [text, "plain"])).collect()
    assert out[0]["text"] == " ".join(["wörd <EMAIL>"] * n) and out[1]["text"] == "plain"


def test_overlapping_spans_are_replaced_once(spark):
    texts = ["x 10.0.0.1@mail.org y", "+4111 1111 1111 1111 z", "é 🙂 a@b.org🙂 10.0.0.1"]
    out = [r["text"] for r in pii.sanitise(docs(spark, texts)).collect()]
    assert out == ["x <EMAIL> y", "+<CARD> z", "é 🙂 <EMAIL>🙂 <IP>"]
