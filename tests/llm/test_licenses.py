import re

import numpy as np
import pytest

from graphloom.llm import licenses as lic

from .helpers import awkward, docs, empty


def words(text):
    text = re.sub(r"(?im)^\W*(?:copyright|\(c\)|©).*$", " ", text).lower()
    return [w for w in re.findall(r"[^\W_]+", text) if not re.fullmatch("(?:19|20)[0-9]{2}", w)]


def bigrams(w):
    return {f"{a} {b}" for a, b in zip(w, w[1:])} if len(w) > 1 else set(w)


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a else 0


KNOWN = [(k, words(t)) for k, t in lic.TEMPLATES]


def brute(text, threshold=0.7, everywhere=False):
    """licence -> best coefficient of the windows at anchors, or of all windows of a template's length."""
    out, w = {}, words(text)
    for k, t in KNOWN:
        starts = range(len(w)) if everywhere else {i - o for i, g in enumerate(zip(w, w[1:])) for o, h in enumerate(zip(t, t[1:])) if g == h and " ".join(g) in lic.anchors_of(t, threshold)}
        for at in starts:
            part = w[max(at, 0) : max(at + len(t), 0)]
            d = dice(bigrams(part), bigrams(t))
            if d >= threshold:
                out[k] = max(out.get(k, 0), d)
    return out


def found(spark, texts):
    got = {}
    for r in lic.scan(docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], {})[r["licence"]] = round(r["dice"], 6)
    return got


def test_all_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in lic.query(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], {})[r["licence"]] = r["dice"]
    want = {i: {k: round(d, 6) for k, d in b.items()} for i, t in texts.items() if (b := brute(t))}
    assert got == want and want


def test_templates_find_themselves_anywhere(spark):
    """On lines of their own, inside a line, wrapped beside code, and among much other text."""
    prose = " ".join(f"word{i}" for i in range(400))
    texts = []
    for _, t in lic.TEMPLATES:
        wrapped = "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
        texts += [f"some prose here\n{t}\nand more", f"{prose} {t} {prose}", f"int main() {{\n{wrapped}\nreturn 0; }}"]
    texts += ["Copyright 2024 Ann\n\n" + lic.TEMPLATES[4][1].replace("free of charge", "at no charge"), "the license of the version"]
    got = found(spark, texts)
    for i, (k, _) in enumerate(lic.TEMPLATES):
        assert all(got[3 * i + j][k] == 1.0 for j in range(3)), k
    assert "MIT" in got[len(texts) - 2] and len(texts) - 1 not in got


def test_recall_on_edited_notices(spark):
    """Against the best of all windows of the template's length, for notices with words changed, left out and put in."""
    rng = np.random.default_rng(7)
    texts = []
    for _, t in lic.TEMPLATES:
        for share in (0.05, 0.1, 0.15):
            out = []
            for w in t.split():
                x = rng.random()
                out += [] if x < share / 3 else [w, f"x{rng.integers(99)}"] if x < 2 * share / 3 else [f"y{rng.integers(99)}"] if x < share else [w]
            texts.append(" ".join([f"a{i}" for i in range(30)] + out + [f"b{i}" for i in range(30)]))
    got = found(spark, texts)
    want = {(i, k) for i, t in enumerate(texts) for k in brute(t, everywhere=True)}
    hit = {(i, k) for i, b in got.items() for k in b}
    assert hit <= want and len(hit) >= 0.97 * len(want) and len(want) > len(lic.TEMPLATES)
    assert got == {i: {k: round(d, 6) for k, d in b.items()} for i, t in enumerate(texts) if (b := brute(t))}


def test_rest_of_a_copyright_line_counts(spark):
    texts = ["Copyright 2024 ACME. All rights reserved.", "(c) 2020 X Co. Licensed under the Apache License, Version 2.0.", "Copyright (c) 2021 J. Doe, all rights reserved", "Copyright 2024 Ann"]
    got = {(r["doc_id"], r["licence"]) for r in lic.scan(docs(spark, texts)).collect()}
    assert got == {(0, "Proprietary"), (1, "Apache-2.0"), (2, "Proprietary")}


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward(spark, make):
    assert lic.scan(make(spark)).count() == 0
