import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bitpack, packing
from graphloom.llm.common import scratch_path
from graphloom.llm.tokens import encoder, tokenizer_path

from .helpers import awkward, empty

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = ["a  b", "a\n \nb", "  x", "x  ", "x \n", "a\x1cb c", "　a　b", "İstanbul ǅx ª²¼\n a\nb", "I'm don't'll", "\n\n x\t y", "é ́x", "ΑΣ ΑΣ.", "<|endoftext|> a<|endoftext|>b", "é<|startoftext|>", "<|ENDOFTEXT|>", "a\x85b", "🙂 🙂🙂‍ x", "", " ", "  ", " a", "a "]


@lru_cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def whole(name, text):
    return tokenizer(name).encode(text, add_special_tokens=False).ids


def test_special_strings_can_be_ordinary_text():
    path = tokenizer_path(BYTE)
    assert np.frombuffer(encoder(path)("a<|endoftext|>"), "<u4").tolist()[-1] == 50256
    assert 50256 not in np.frombuffer(encoder(path, special=False)("a<|endoftext|>"), "<u4")


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_encoder_equals_the_tokenizer(name):
    for text in ODD:
        assert np.frombuffer(encoder(tokenizer_path(name))(text), "<u4").tolist() == whole(name, text), repr(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAZ .,'\n\t0é²ªß \x1c'smll🙂Σ-")), max_size=40))
def test_encoder_property(text):
    for name in (WORD, BYTE):
        assert np.frombuffer(encoder(tokenizer_path(name))(text), "<u4").tolist() == whole(name, text)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 25), st.lists(st.integers(0, 2**25 - 1), max_size=70))
def test_bits_round_trip(bits, ids):
    ids = np.array([i % (1 << bits) for i in ids], "<u4")
    packed = bitpack.pack_bits(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert (bitpack.unpack_bits(np.frombuffer(packed, np.uint8), bits, len(ids)) == ids).all()


def test_file_round_trip_and_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5000, n).astype("<u4") for n in (0, 3, 100, 0, 257, 64)]
    with (tmp_path / "f").open("wb") as f:
        w = bitpack.Writer(f, bitpack.width(5000), block=64)
        for i, d in enumerate(docs):
            w.add(i, d)
        w.close()
    data = (tmp_path / "f").read_bytes()
    r = bitpack.Reader(lambda offset, length: data[offset : offset + length], len(data))
    for size in (1, 50, 10_000):
        assert np.concatenate([x for _, _, x in r.runs(size)]).tolist() == np.concatenate(docs).tolist()
    assert [r.document(i).tolist() for i in range(r.n_docs)] == [d.tolist() for d in docs]
    assert r.ids(70, 90).tolist() == np.concatenate(docs)[70:90].tolist()


def test_bitpack_all_documents(spark, sf_dir):
    got = sorted(map(tuple, bitpack.query(spark, sf_dir).collect()))
    start, want = 0, []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = whole(BYTE, r["text"] or "") + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize("make,n", [(awkward, 9), (empty, 0)])
def test_bitpack_awkward(spark, make, n):
    folder = scratch_path(spark, "t")
    rows = bitpack.read(bitpack.write(make(spark), tokenizer_path(BYTE), folder), folder).collect()
    assert len(rows) == n
    assert sum(r["n_tokens"] for r in rows) == max([r["start"] + r["n_tokens"] for r in rows], default=0)


def test_bitpack_ids_minus_one_and_null_and_a_task_per_file(spark):
    frame = spark.createDataFrame([(None, "a"), (-1, "b b"), (0, ""), (None, None), (-1, "b b"), *((i, f"t {i}") for i in range(1, 40))], "doc_id long, text string")
    folder = scratch_path(spark, "t")
    manifest = bitpack.write(frame, tokenizer_path(BYTE), folder, file_bytes=20)
    files = manifest.count()
    assert files > 4
    back = bitpack.read(manifest, folder)
    got = sorted(((r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in back.collect()))
    ids = [d for _, d, _ in got]
    assert ids == [None, None, -1, -1, *range(40)]
    texts = {i: t for i, t in frame.filter("doc_id >= 0").collect()}
    assert all(x == whole(BYTE, texts[i]) + [2] for _, i, x in got if i is not None and i >= 0)
    # as many tasks as files, one file each
    assert back.rdd.getNumPartitions() == files
    from pyspark.sql import functions as F

    per = back.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n")).count()
    assert per == files


def check_packing(rows, tokens=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens
    return len(by)


def test_pack_all_documents(spark, sf_dir):
    rows = packing.query(spark, sf_dir).collect()
    n = check_packing(rows)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // 2048) * 1.02 + 1
    docs = {r["doc_id"]: np.array(whole(WORD, r["text"] or "") + [0], "<u4") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(i, k, a, len(d[a : a + 2048]), zlib.crc32(d[a : a + 2048].tobytes())) for i, d in docs.items() for k, a in enumerate(range(0, len(d), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want


@pytest.mark.parametrize("make,n", [(awkward, 9), (empty, 0)])
def test_pack_awkward(spark, make, n):
    rows = packing.pack(make(spark), tokenizer_path(WORD)).collect()
    check_packing(rows)
    assert len([r for r in rows if r["piece"] == 0]) == n


def first_fit_by_rules(lengths, cap):
    """Best fit one piece at a time, by the rules that plan() follows for runs."""
    full = np.array([cap.tokens, cap.documents, cap.attention])
    bins = []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fit = [(float((np.array([1, 0.02, 0.02]) * ((b - need) / full) ** 2).sum()), i) for i, b in enumerate(bins) if (b >= need).all()]
        if fit:
            bins[min(fit)[1]] -= need
        else:
            bins.append(full - need)
    return len(bins)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([packing.Capacity(64, 64, 4096), packing.Capacity(64, 4, 4096), packing.Capacity(100, 5, 4100)]), st.sampled_from(["norm", "dot"]))
def test_plan_keeps_every_constraint(lengths, cap, score):
    counts = {n: lengths.count(n) for n in set(lengths)}
    steps, opened = packing.plan(counts, cap, score)
    bins = {}
    for n in counts:
        for rank in range(counts[n]):
            row = [s for s in steps if s[0] == n and s[1] <= rank][-1]
            to, nth = divmod(rank - row[1], row[3])
            bins.setdefault(row[2] + to, []).append((row[4] + nth * n, n))
    assert sorted(bins) == list(range(opened))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= cap.tokens and len(parts) <= cap.documents and sum(n * n for _, n in parts) <= cap.attention
    if score == "norm":
        assert opened <= first_fit_by_rules(lengths, cap) * 1.1 + 1
