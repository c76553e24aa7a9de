import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash

from .helpers import awkward, docs, empty


def brute_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius):
    comp = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    first = {}
    for i, c in zip(ids, comp, strict=True):
        first[c] = min(first.get(c, i), i)
    return [first[c] for c in comp]


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair(radius):
    rng = np.random.default_rng(radius)
    masks = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        diff = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(diff & m == 0 for m in masks)


def test_all_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    comp = brute_components([r["doc_id"] for r in rows], fps, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, comp, strict=True)}


def test_chains_and_blocks(spark):
    """A chain of fingerprints three bits apart, and a bucket that must be cut into blocks."""
    chain = [sum(1 << b for b in range(3 * i)) for i in range(12)]
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    cloud = [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2)) if a != b]
    fps = sorted(set(chain + cloud))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, block=8)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_components(signed, fps, 4)
    assert [roots.get(f, f) for f in signed] == want


def test_awkward(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[1] == 1 and by[6] == 1 and by[2] == by[3] == by[4] == 2 and by[5] == 5
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_deduplicate_keeps_columns_and_one_of_each(spark):
    frame = awkward(spark)
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 5, 7]


def test_equal_texts_by_case(spark):
    rows = simhash.near_duplicates(docs(spark, ["A b  c d e", "a B\nc d E", "É x y z w", "é x y z w"])).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_unlike_texts_under_one_id_both_stay(spark):
    rows = [(1, "alpha beta gamma delta epsilon"), (1, "quite another text of many other words"), (1, "alpha beta gamma delta epsilon"), (2, "Alpha beta gamma delta epsilon"), (3, "third text")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted({rows[0], rows[1], rows[4]})


def test_components_of_a_star_and_a_chain(spark):
    """A node with most of the links, and a long chain."""
    star, chain = [(0, i) for i in range(1, 3000)], [(5000 + i, 5001 + i) for i in range(60)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(star + chain, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(3000)}, **{5000 + i: 5000 for i in range(61)}}
