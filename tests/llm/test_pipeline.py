import corpus_pipeline as cp
from graphloom.llm import decontamination, packing, pii, quality, simhash
from graphloom.llm.tokens import tokenizer_path

from .helpers import awkward, docs, empty
from .test_packing_bitpack import check_packing, whole
from .test_pii import brute as pii_brute
from .test_simhash import brute_components, brute_fingerprint


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r["doc_id"] for r in quality.judge(docs, labels).collect() if r["kept"]}
    one = cp.quality_rules(spark, docs, sf_dir).cache()
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns

    rows = one.orderBy("doc_id").collect()
    comp = brute_components([r["doc_id"] for r in rows], [brute_fingerprint(r["text"]) for r in rows], 4)
    two = cp.near_dedup(spark, one, sf_dir).cache()
    assert {r["doc_id"] for r in two.collect()} == set(comp) and two.columns == docs.columns

    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    three = cp.decontaminate(spark, two, sf_dir).cache()
    left = {r["doc_id"] for r in three.collect()}
    leaks = {r["doc_id"] for r in two.collect() if any(i in (r["text"] or "") for i in items)}
    assert left.isdisjoint(leaks) and left == {r["doc_id"] for r in two.collect()} - leaks

    four = cp.sanitise(spark, three, sf_dir).cache()
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    after = {r["doc_id"]: r["text"] for r in four.collect()}
    assert after.keys() == before.keys()
    for i, text in before.items():
        spans = [s for k in pii_brute(text).values() for s in k]
        assert not any(text[a:b] in after[i] for k, a, b in spans if k in ("email", "card"))
        if not spans and "<TERM>" not in after[i]:
            assert after[i] == text

    five = cp.pack(spark, four, sf_dir).collect()
    check_packing(five)
    length = {}
    for r in five:
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
    assert length == {i: len(whole("word_bpe_49k.json", t or "")) + 1 for i, t in after.items()}
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, cp.run(spark, sf_dir).collect())) == sorted(map(key, five))


def test_sanitising_takes_a_term_out_at_any_size(spark, sf_dir):
    """The stage's defaults: two texts show a term however many texts that say nothing stand beside them."""
    known = docs(spark, [f"{w} about Wintergreen wrote ann@x.org" for w in ("alpha", "bravo")])
    for n in (1_000, 120_000):
        frame = known.union(spark.range(2, n).selectExpr("id", "concat('nothing about what they wrote ', id)", "'en'", "'src0'", "30L"))
        rows = cp.sanitise(spark, frame, sf_dir).filter("doc_id < 3").collect()
        assert {r["doc_id"]: r["text"] for r in rows} == {0: "alpha about  wrote <EMAIL>", 1: "bravo about  wrote <EMAIL>", 2: "nothing about what they wrote 2"}


def test_awkward(spark, sf_dir):
    for make in (awkward, empty):
        frame = make(spark)
        for out in (simhash.deduplicate(frame), pii.sanitise(frame), decontamination.clean(frame, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))):
            assert out.columns == frame.columns
            out.collect()
        assert packing.pack(frame, tokenizer_path("word_bpe_49k.json")).count() >= frame.count()
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        kept = quality.filter_documents(frame, labels)
        assert kept.columns == frame.columns
        assert {r["doc_id"] for r in kept.collect()} <= {1, 5, 6}
