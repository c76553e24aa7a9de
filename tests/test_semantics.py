"""Small literal cases for what is easily got wrong."""

import random

from pyspark.sql import functions as F

from graphloom.functions import chunks, markdown, similarity, text
from graphloom.operators import agent, evaluation, graph, harness, knowledge, retrieval, vocabulary
from graphloom.sources import tables
from graphloom.streaming.ingest import stream_merge


def one(spark, expr, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_text_scalars(spark):
    assert one(spark, text.estimate_tokens_mixed, "한국 word two") == 2 + 3
    assert one(spark, text.estimate_tokens_quarter, "abc") == 1
    assert one(spark, text.tokens_latin_then_cjk, "그래프 Graph-RAG v1.2") == ["graph-rag", "v1.2", "그", "래", "프"]
    assert one(spark, text.slug_ascii, "Ünïcode!") == "n-code" and one(spark, text.slug_ascii, "한글") == "x"
    assert one(spark, text.norm_boundary, "그래프RAG_v2") == "그래프 rag v2"
    assert one(spark, text.strip_josa, "그래프를") == "그래프" and one(spark, text.strip_josa, "나는") == "나는"
    assert one(spark, text.parse_score, "SCORE: 42") == 10 and one(spark, text.parse_score, "none") == 0
    assert [tuple(x) for x in one(spark, text.wikilinks, "[[a|b]] [[c]]")] == [("a", "b", "[[a|b]]"), ("c", None, "[[c]]")]
    assert one(spark, text.normalize_text, "a \r\nb\t\r\n\r\n") == "a\nb\n"
    assert one(spark, lambda c: text.hash_feature(c)[0], "rag") == 201 and one(spark, lambda c: text.hash_feature(c)[1], "rag") == -1


def test_rrf_bases(spark):
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid int, id string, rank int")
    assert [round(x["score"], 4) for x in retrieval.rrf(r).orderBy("id").collect()] == [0.0164, 0.0161, 0.0159]
    assert retrieval.rrf(r, 0).orderBy("id").first()["score"] == round(1 / 60, 6)


def test_minmax_of_a_constant_is_half(spark):
    r = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0)], "qid int, id string, score double")
    assert {x["scaled"] for x in retrieval.minmax(r, ["qid"]).collect()} == {0.5}


def test_pack_skips_and_never_stops(spark):
    rows = [(1, 1, "s", "a" * 40, 1), (1, 2, "s", "b" * 400, 2), (1, 3, "s", "A" * 40, 3), (1, 4, "s", "c" * 40, 4), (1, 5, "s", "d" * 40, 5), (1, 6, "s", "e" * 40, 6), (1, 7, "t", "f" * 40, 7)]
    got = retrieval.pack_budget(spark.createDataFrame(rows, "qid int, id long, source string, text string, rank int"), 50).first()
    assert got["ids"] == [1, 4, 5, 7] and got["used_tokens"] == 40


def test_regression_gate_missing_metric_fails(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 1.0)], "metric string, value double")
    now = spark.createDataFrame([("a", 0.97), ("b", 0.47)], "metric string, value double")
    assert {r["metric"]: r["passed"] for r in retrieval.compare(now, base).collect()} == {"a": True, "b": False, "c": False}


def test_construction_scores(spark):
    p, g = spark.range(8).selectExpr("id as k"), spark.range(1, 11).selectExpr("id as k")
    r = retrieval.set_prf(p, g, ["k"]).first()
    assert (r["tp"], r["fp"], r["fn"], round(r["f1"], 2)) == (7, 1, 3, 0.78)


def test_gate_order_and_conflicts(spark):
    e = spark.createDataFrame([("a", "X", "b", 1), ("a", "Y", "b", 1), ("q", "Z", "b", 0), ("q", "X", "b", 1), ("a", "X", "q", 0), ("b", "X", "a", 0)], "head string, type string, tail string, support int")
    got = knowledge.quality_gate(e, ["X", "Y"], spark.createDataFrame([("a",), ("b",)], "id string"), [("X", "Y")]).collect()
    assert {(r["head"], r["type"], r["tail"]): r["reason"] for r in got} == {("a", "X", "b"): "CONFLICT", ("a", "Y", "b"): "CONFLICT", ("q", "Z", "b"): "UNKNOWN_TYPE", ("q", "X", "b"): "UNKNOWN_HEAD", ("a", "X", "q"): "UNKNOWN_TAIL", ("b", "X", "a"): "LOW_SUPPORT"}


def test_merge_retract_revive(spark):
    b = lambda *rows: spark.createDataFrame(rows, "head string, type string, tail string, provs array<string>")
    one_ = knowledge.merge_batch(knowledge.empty_store(b(("a", "X", "b", ["p"]))), b(("a", "X", "b", ["p", "p"]), ("c", "X", "d", ["q"])), "v1")
    again = knowledge.merge_batch(one_, b(("a", "X", "b", ["p", "r"])), "v2")
    got = {r["head"]: (r["provs"], r["status"], r["ingested_in"]) for r in again.collect()}
    assert got == {"a": (["p", "p", "r"], "accumulated", ["v1", "v2"]), "c": (["q"], "untouched", ["v1"])}
    gone = knowledge.retract(again, lambda p: p == "q")
    assert knowledge.store_stats(gone).first().asDict() == {"live": 1, "tombstoned": 1, "support": 3}
    back = knowledge.merge_batch(gone, b(("c", "X", "d", ["s"])), "v3")
    assert {r["head"]: (r["status"], r["tombstone"]) for r in back.collect()}["c"] == ("revived", False)


def test_components_of_random_keys(spark):
    rng = random.Random(1)
    keys = [(i, f"k{rng.randrange(60)}") for i in range(50) for _ in range(2)]
    parent = {i: i for i in range(50)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, k in keys:
        a, b = root(i), root(by.setdefault(k, i))
        parent[max(a, b)] = min(a, b)
    got = knowledge.alias_components(spark.createDataFrame(keys, "id long, key string")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: root(i) for i in range(50)}


def test_paths_repeat_nodes_but_not_edges(spark):
    e = spark.createDataFrame([("a", "T", "b", 1), ("b", "T", "c", 2), ("c", "T", "a", 3)], "src string, type string, dst string, edge_id long")
    got = {tuple(r["nodes"]) for r in graph.paths(e, spark.createDataFrame([("a",)], "id string"), 3).collect()}
    assert ("a", "b", "c", "a") in got and ("a", "b", "a") not in got


def test_communities_split_two_cliques(spark):
    clique = lambda ids: [(f"n{i}", "T", f"n{j}") for i in ids for j in ids if i < j]
    rows = clique(range(5)) + clique(range(5, 10)) + [("n0", "T", "n5")]
    e = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src string, type string, dst string, edge_id long")
    n = spark.createDataFrame([(f"n{i}", "L", f"n{i}") for i in range(10)], "id string, label string, name string")
    label = graph.communities(n, e)
    got = {r["id"]: r["community"] for r in label.collect()}
    assert len({got[f"n{i}"] for i in range(5)}) == 1 and len(set(got.values())) == 2
    assert graph.modularity(e, label).first()["modularity"] > 0.3


def test_read_only_guard(spark):
    ok = ["MATCH (n) RETURN n", "MATCH (a)-[*1..3]-(b) RETURN a;", "MATCH (n {name: 'create; delete'}) RETURN n"]
    bad = {"": "EMPTY", "MATCH (n) RETURN n; MATCH (m) RETURN m": "MULTI_STATEMENT", "CREATE (n)": "WRITE", "MATCH (n) SET n.x = 1": "WRITE", "SHOW x": "NO_READ_ENTRY", "MATCH (a)-[*1..9]-(b) RETURN a": "HOPS", "MATCH (a)-[*]-(b) RETURN a": "HOPS"}
    assert all(one(spark, agent.read_only_reason, q) is None for q in ok)
    assert {q: one(spark, agent.read_only_reason, q) for q in bad} == bad
    assert one(spark, agent.ensure_limit, "MATCH (n) RETURN n;") == "MATCH (n) RETURN n LIMIT 50"


def test_ttl_cache_is_a_fold(spark):
    rows = [("k", t, i) for i, t in enumerate([0, 100, 299, 300, 400, 599, 601])]
    df = spark.createDataFrame(rows, "key string, t long, o long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r["hit"] for r in agent.ttl_cache(df, "key", "ts", "o").orderBy("o").collect()] == [False, True, True, False, True, True, False]


def test_sections_by_hand():
    body = "intro text.\n# One ##\nFirst sentence. Second one!\n### Deep\nx\n## Two\ny\n# End"
    got = [(h, p, body[a:b]) for h, p, a, b in chunks.sections(body)]
    assert got == [("", (), "intro text.\n"), ("One", ("One",), "First sentence. Second one!\n"), ("Deep", ("One", "Deep"), "x\n"), ("Two", ("One", "Two"), "y\n"), ("End", ("End",), "")]
    assert chunks.sections("no heading") == [("", (), 0, 10)] and [s[0] for s in chunks.sections("\n \n# A\nb")] == ["A"]


def test_chunks_by_hand():
    assert [chunks.tokens(t) for t in ("", "a b c", "한국어 text", "a-b_c 1", "、㐀")] == [0, 4, 4, 5, 2]
    assert chunks.sentences("One. Two!  Three") == [(0, 4), (5, 9), (11, 16)] and chunks.sentences("") == [(0, 0)]
    body = "# T\n\n  One two. Three four. Five six. \n"
    whole = list(chunks.chunk(body, "d", 220))
    assert whole == [("d#s0-0", "T", ["T"], 7, 37, 8, "One two. Three four. Five six.", "One two. Three four. Five six.")]
    parts = [(c[0], c[6]) for c in chunks.chunk(body, "d", 6)]
    assert parts == [("d#s0-0", "One two. Three four."), ("d#s0-1", "Three four. Five six.")]
    assert all(body[c[3] : c[4]] == c[6] for c in chunks.chunk(body, "d", 6))


def test_chunks_against_the_greedy_rule():
    """Sentence by sentence: take the next while the sum stays within the budget, one at least; begin one sentence back, but move on."""
    rng = random.Random(3)
    for _ in range(300):
        text = " ".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 9))) + rng.choice(".!?") for _ in range(rng.randint(1, 12)))
        budget, overlap = rng.randint(1, 25), rng.randint(0, 2)
        want, parts, i = [], chunks.sentences(text), 0
        if chunks.tokens(text) <= budget:
            want = [(0, len(text))]
        else:
            while True:
                j, used = i, 0
                while j < len(parts) and (j == i or used + chunks.tokens(text[slice(*parts[j])]) <= budget):
                    used += chunks.tokens(text[slice(*parts[j])])
                    j += 1
                want.append((parts[i][0], parts[j - 1][1]))
                if j >= len(parts):
                    break
                i = max(j - overlap, i + 1)
        assert chunks.spans(text, budget, overlap) == want


def test_chunks_verify_against_their_documents(spark):
    rows = [(1, "# A\n" + "One sentence here. " * 60, "v1"), (2, None, "v1"), (None, "x", "v1"), (3, "", None), (4, "plain", "v2")]
    got = chunks.chunk_documents(spark.createDataFrame(rows, "doc_id long, text string, version string"), 40).collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[c["doc_id"]][c["start"] : c["end"]] == c["text"] and c["quote"] == c["text"][:60] for c in got)
    assert {c["doc_id"] for c in got} == {1, 4} and [c["version"] for c in got if c["doc_id"] == 4] == ["v2"]


def test_markdown(spark):
    split = lambda t: tuple(one(spark, markdown.split_frontmatter, t))
    assert split("---\ntitle: a\n---\n\nbody\n---\n") == ("title: a\n", "body\n---\n") and split("---\nopen") == (None, "---\nopen") and split("text") == (None, "text")
    assert split("---\n---\nb") == ("", "b")
    strict = lambda t: tuple(one(spark, markdown.strict_frontmatter, t))
    assert strict("---\na: 1\n---\n\nb") == ("a: 1", "b", None) and strict("---\na")[2] == "unclosed" and strict("b")[2] == "missing"
    block = "title: 'x y'\ntags: [a, \"b\"]\nlinks:\n- src-1\n- src-2\nnone: []"
    assert one(spark, lambda c: markdown.scalar(c, "title"), block) == "x y" and one(spark, lambda c: markdown.listed(c, "tags"), block) == ["a", "b"]
    assert one(spark, lambda c: markdown.listed(c, "links"), block) == ["src-1", "src-2"] and one(spark, lambda c: markdown.listed(c, "none"), block) == []
    rules = [("RAG", "src-1", "RAG"), ("absent", "src-2", "x"), ("graph", "src-3", "g")]
    assert one(spark, lambda c: markdown.inject_links(c, rules), "RAG and RAG, graph") == "[[src-1|RAG]] and RAG, [[src-3|g]]"
    assert one(spark, markdown.unique_targets, "[[b|x]] [[a]] [[b]]") == ["b", "a"]
    assert one(spark, markdown.table_blocks, "| a |\n|--|\nx\n| only |\ny\n|1|\n|2|\n|3|") == 2
    assert one(spark, markdown.strip_score_lines, "SCORE: 3\nanswer\nscore: 4") == "answer"


def test_token_sort_ratio():
    assert similarity.token_sort_ratio("graph rag", "rag graph") == 100
    assert similarity.token_sort_ratio("abc", "abd") == 100 * 2 * 2 / 6


def test_sources_and_snapshot(spark, tmp_path):
    (tmp_path / "s" / "sub").mkdir(parents=True)
    (tmp_path / "s" / "One.md").write_text("# Title\nbody")
    (tmp_path / "s" / "sub" / "two.md").write_text("no heading")
    (tmp_path / "s" / "README.md").write_text("# no")
    got = {r["source_id"]: r["title"] for r in tables.load_sources(spark, None, str(tmp_path / "none"), str(tmp_path / "s")).collect()}
    assert got == {"src-one": "Title", "src-two": "two"}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n')
    rows, bad = tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=False)
    assert [r["a"] for r in rows.collect()] == [1] and bad.count() == 1
    n, e = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    tables.write_snapshot(n, e, str(tmp_path / "snap"))
    n2, e2 = tables.read_snapshot(spark, str(tmp_path / "snap"), "id string", "src string, dst string")
    assert n2.collect() == n.collect() and e2.collect() == e.collect()


def test_stream_merges_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "head string, type string, tail string, provs array<string>"
    run = lambda: stream_merge(spark, str(tmp_path / "in"), schema, str(tmp_path / "store"), str(tmp_path / "ck"))
    (tmp_path / "in" / "a.json").write_text('{"head":"a","type":"X","tail":"b","provs":["p"]}\n')
    run()
    (tmp_path / "in" / "b.json").write_text('{"head":"a","type":"X","tail":"b","provs":["q"]}\n')
    run()
    run()
    last = spark.read.parquet(str(tmp_path / "store" / "v1")).collect()
    assert [(r["provs"], r["status"], r["ingested_in"]) for r in last] == [(["p", "q"], "accumulated", ["v0", "v1"])]


def test_fuzzy_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["alpha", "alpho", "beta", "betta", "gamma", "gama", "delta", "x", "yz"]
    names = sorted({(rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for _ in range(120)})
    for percent in (90, 75):
        got = {tuple(r)[:3] for r in similarity.fuzzy_pairs(spark.createDataFrame(names, "type string, name string"), percent).collect()}
        want = {(t, a, b) for t, a in names for u, b in names if t == u and a < b and similarity.token_sort_ratio(a, b) >= percent}
        assert got == want


def test_passages_are_found_where_they_stand(spark):
    docs = [(1, "he said one two three four five six, twice"), (2, "one  two three four five six"), (3, "xone two three four fivey"), (4, "short one"), (5, None)]
    items = [(1, "one two three four five"), (2, "short"), (3, "not in any of these texts"), (4, None)]
    got = retrieval.passages_in(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "qid long, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (1, 3), (2, 4)}


def test_ttl_cache_folds_each_key(spark):
    rng = random.Random(2)
    calls = [(k, t, i) for i, (k, t) in enumerate((rng.choice("ab"), rng.randint(0, 2000)) for _ in range(400))]
    frame = spark.createDataFrame(calls, "key string, t long, n long").selectExpr("key", "timestamp_seconds(t) as ts", "n")
    got = {r["n"]: r["hit"] for r in agent.ttl_cache(frame, "key", "ts", "n", 60).collect()}
    made, want = {}, {}
    for k, t, i in sorted(calls, key=lambda c: (c[0], c[1], c[2])):
        want[i] = k in made and t - made[k] < 60
        if not want[i]:
            made[k] = t
    assert got == want


def test_published_figures():
    """Rows of the published tables that are consistent: F1 of construction, ranks fused with k = 60, an average degree."""
    p, r = 7 / 8, 7 / 10
    assert (round(p, 3), round(r, 2), round(2 * p * r / (p + r), 3)) == (0.875, 0.7, 0.778)
    assert [round(1 / (60 + k), 4) for k in (1, 2, 3)] == [0.0164, 0.0161, 0.0159] and round(22 / 14, 2) == 1.57


def test_graph_metrics_by_hand(spark):
    rows = [(1, 2, ["a"], ["x", "y"], ["x"], ["Foo", " bar"], ["FOO "]), (2, 0, [], [], ["x"], [], ["q"]), (3, 1, ["a", "b"], ["x"], ["x", "z"], ["Q"], ["q"])]
    cases = spark.createDataFrame(rows, "case int, required_hops int, edges array<string>, reference array<string>, connected array<string>, gold_entities array<string>, entities array<string>")
    got = {r["case"]: tuple(r)[1:] for r in evaluation.score_cases(cases).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (1.0, 0.0, 0.0), 3: (1.0, 1.0, 1.0)}
    assert [round(x, 6) for x in evaluation.macro(evaluation.score_cases(cases), ["multihop_path_hit", "graph_grounding_coverage", "entity_coverage"]).first()] == [0.833333, 0.5, 0.5]


def test_harness_by_hand(spark):
    row = lambda f, v: one(spark, f, v)
    assert row(harness.graph_key, '{"from": "a", "relation": "R", "to": "b"}') == "a -[R]-> b" and row(harness.graph_key, '{"name": "a", "neighbor": "b"}') == "a ~ b" and row(harness.graph_key, '{"x": 1}') is None
    assert [tuple(c) for c in row(harness.citations, '{"chunk_id": "c1", "source": "s"}')] == [("c1", "chunk", "s")]
    assert [tuple(c) for c in row(harness.citations, '{"source": "s"}')] == [("s", "source", "s")]
    assert row(harness.rows_of, '{"ok": true}') == ['{"ok":true}'] and row(harness.rows_of, '{"rows": [{"a":1}, 3]}') == ['{"a":1}'] and row(harness.rows_of, "[]") == []
    assert row(harness.labels_in, "MATCH (n:A)-[:R]->(:B), (x:A)") == ["A", "B"] and row(harness.relations_in, "MATCH (n:A)-[:R]->(:B)-[r:S]-()") == ["R", "S"]
    assert row(harness.statements, "a; b;") == 2 and row(harness.dangerous_procedure, "CALL dbms.x()") == "dbms." and row(harness.dangerous_procedure, "CALL db.index.q()") is None
    assert row(lambda c: vocabulary.substring_trap(c, F.lit("self rag")), "rag") and row(lambda c: vocabulary.substring_trap(c, F.lit("crag")), "rag") and not row(lambda c: vocabulary.substring_trap(c, F.lit("lightrag")), "light rag")
    assert len(row(vocabulary.mock_embedding, "RAG")) == 64 and row(vocabulary.mock_embedding, " rag ") == row(vocabulary.mock_embedding, "RAG")
