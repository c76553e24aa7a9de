"""Queries over the driver tables, one per operator family, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import chunks, text
from graphloom.functions.similarity import fuzzy_pairs
from graphloom.operators import agent, graph, knowledge, retrieval
from graphloom.sources.tables import graph_view, supply_relations, table
from graphloom.streaming.ingest import windowed_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- text scalars -----------------------------------------------------------------


@query("""select doc_id, 'sha256:' || substr(sha256(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), '\\n+$', '') || chr(10)), 1, 8) as hash,
  'v1@sha256:' || substr(sha256(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), '\\n+$', '') || chr(10)), 1, 8) as version from documents""")
def content_hash_version(spark: SparkSession, d: str) -> DataFrame:
    h = text.content_hash(F.col("text"))
    return table(spark, d, "documents").select("doc_id", h.alias("hash"), text.make_version(F.lit(1), h).alias("version"))


@query(r"""select doc_id, greatest(1, length(text) // 4)::bigint as quarter, round_even(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.3::double, 0)::bigint as mixed from documents""")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens_quarter(F.col("text")).alias("quarter"), text.estimate_tokens_mixed(F.col("text")).alias("mixed"))


@query(r"""select substr(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 50) as dedup_key, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1""")
def dedup_keys(spark, d):
    return table(spark, d, "documents").groupBy(text.dedup_key(F.col("text")).alias("dedup_key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(r"""select p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug,
 'urn:kb:concept:' || trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) as urn,
 regexp_replace(lower(p_brand), '[_ ]', '-', 'g') as tag, 'ent-unresolved-' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as stub from part""")
def slugs_and_ids(spark, d):
    c = F.col
    return table(spark, d, "part").select("p_partkey", text.slug_ascii(c("p_type")).alias("slug"), text.canonical_urn(c("p_name")).alias("urn"), text.normalize_tag(c("p_brand")).alias("tag"), text.unresolved_id(c("p_name")).alias("stub"))


@query(r"""select page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages""")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(text.html_links(F.col("html"))).cast("long").alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents ),
h as (select doc_id, ('0x' || substr(sha1(t), 39, 2))::int as dim, case when ('0x' || substr(sha1(t), 38, 1))::int % 2 = 0 then 1 else -1 end as s from t),
g as (select doc_id, dim, sum(s) as v from h group by all having sum(s) <> 0)
select doc_id as id, dim, round(v / sqrt(sum(v * v) over (partition by doc_id)), 6) as value from g""")
def hash_embed_docs(spark, d):
    return retrieval.hash_embed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


# -- retrieval ----------------------------------------------------------------------

BM25 = """with d as (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9가-힣]+') as t from documents), s as (select count(*) as n, avg(len(t)) as av from d),
q as (select item_id as qid, unnest(regexp_extract_all(lower(text), '[a-z0-9가-힣]+')) as token from benchmark), qa as (select qid, token, count(*) as qtf from q group by all),
p as (select id, len(t) as dl, unnest(t) as token from d), tf as (select token, id, dl, count(*) as tf from p where token in (select token from qa) group by all), df as (select token, count(*) as df from tf group by all),
sc as (select qid, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) as score from tf join df using (token) join qa using (token) cross join s group by all),
bm as (select *, row_number() over (partition by qid order by score desc, id) as rank from sc where score > 0) """


def _bm25(spark, d, k=5):
    return retrieval.bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), k)


def _gold(spark, d):
    return retrieval.passages_in(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"))


@query(BM25 + "select qid, id, score, rank from bm where rank <= 5")
def bm25_topk(spark, d):
    return _bm25(spark, d)


VEC = """with q as (select vec_id as qid, embedding as q from embeddings where vec_id % 50 = 0),
v as (select qid, vec_id as id, round(list_sum(list_transform(list_zip(q, embedding), lambda x: x[1]::double * x[2]::double)) / (sqrt(list_sum(list_transform(q, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 6) as score from embeddings, q),
vr as (select *, row_number() over (partition by qid order by score desc, id) as rank from v) """


def _vec(spark, d, k):
    e = table(spark, d, "embeddings")
    return retrieval.vector_search(e.select(F.col("vec_id").alias("id"), "embedding"), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), k)


@query(VEC + "select qid, id, score, rank from vr where rank <= 5")
def vector_topk(spark, d):
    return _vec(spark, d, 5)


def _two_rankings(spark, d):
    """The vector ranking and a second one by closeness of id, as a stand-in for a graph's."""
    v = _vec(spark, d, 20)
    g = v.select("qid", "id", F.round(1 / (1 + F.abs(F.col("qid") - F.col("id"))), 6).alias("score"))
    return v.select("qid", "id", "score", "rank"), retrieval.top_k(g, ["qid"], "score", ["id"], 20)


TWO = VEC + ", a as (select qid, id, score, rank from vr where rank <= 20), b as (select qid, id, s as score, row_number() over (partition by qid order by s desc, id) as rank from (select qid, id, round(1 / (1 + abs(qid - id)), 6) as s from a)) "


def _rrf_sql(base):
    return TWO + f"select qid, id, round(sum(1.0::double / (60 + rank - 1 + {base})), 6) as score from (select qid, id, rank from a union all select qid, id, rank from b) group by all"


@query(_rrf_sql(1))
def rrf_fuse_1based(spark, d):
    a, b = _two_rankings(spark, d)
    return retrieval.rrf(a.unionByName(b), 1)


@query(_rrf_sql(0))
def rrf_fuse_0based(spark, d):
    a, b = _two_rankings(spark, d)
    return retrieval.rrf(a.unionByName(b), 0)


@query(TWO + """, na as (select qid, id, case when max(score) over w = min(score) over w then 0.5 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as v from a window w as (partition by qid)),
nb as (select qid, id, case when max(score) over w = min(score) over w then 0.5 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as g from b window w as (partition by qid))
select qid, id, round(0.5 * coalesce(v, 0) + 0.5 * coalesce(g, 0), 6) as score from na full join nb using (qid, id)""")
def minmax_fuse(spark, d):
    a, b = _two_rankings(spark, d)
    return retrieval.fuse_minmax(a.select("qid", "id", "score"), b.select("qid", "id", "score"))


@query(VEC + "select qid, id, score, rank from vr where rank <= 20 and id in (select vec_id from embeddings where label in (1, 2, 3))")
def tag_filtered_search(spark, d):
    allowed = table(spark, d, "embeddings").filter("label in (1, 2, 3)").select(F.col("vec_id").alias("id"))
    return retrieval.tag_filtered(_vec(spark, d, 20), allowed).select("qid", "id", "score", "rank")


@query(BM25 + """, g as (select item_id as qid, doc_id as id from benchmark b join documents d on contains(d.text, b.text)), n as (select qid, count(*) as n_gold from g group by 1),
h as (select qid, min(case when g.id is not null then rank end) as first, count(distinct case when g.id is not null and rank <= 5 then id end) as tp, count(distinct id) as shown from (select * from bm where rank <= 5) left join g using (qid, id) group by 1),
m as (select qid, case when coalesce(tp, 0) > 0 then 1 else 0 end as hit, round(coalesce(1.0::double / first, 0), 6) as rr, round(coalesce(tp, 0) / n_gold, 6) as recall, round(case when coalesce(shown, 0) > 0 then tp / shown else 0 end, 6) as precision, case when n_gold > 1 then 'multi' else 'single' end as kind from n left join h using (qid))
select kind, count(*) as n, round(avg(hit), 4) as hit, round(avg(rr), 4) as rr, round(avg(recall), 4) as recall, round(avg(precision), 4) as precision from m group by rollup (kind)""")
def retrieval_metrics_grouping_sets(spark, d):
    gold = _gold(spark, d)
    m = retrieval.question_metrics(_bm25(spark, d), gold, 5)
    kind = gold.groupBy("qid").agg(F.when(F.count(F.lit(1)) > 1, "multi").otherwise("single").alias("kind"))
    return retrieval.grouped_means(m.join(kind, "qid"), "kind")


@query(BM25 + ", f as (select qid, source, min(rank) as first from bm join documents on doc_id = id where rank <= 5 group by all) select qid, source, row_number() over (partition by qid order by first) as rank from f")
def source_rank_reduction(spark, d):
    src = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return retrieval.source_ranks(_bm25(spark, d).join(src, "id"))


@query()
def pack_context(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return retrieval.pack_budget(_bm25(spark, d, 20).join(docs, "id"), 2000)


# -- validation, resolution, store ------------------------------------------------------


@query("""select case when text is null or text = '' then 'EMPTY' when lang not in ('en', 'de', 'fr') then 'LANG' when n_chars <> length(text) then 'LENGTH' when n_chars < 100 then 'SHORT' end as reason, count(*) as n from documents group by 1""")
def contract_violations(spark, d):
    rules = [("EMPTY", F.col("text").isNull() | (F.col("text") == "")), ("LANG", ~F.col("lang").isin("en", "de", "fr")), ("LENGTH", F.col("n_chars") != F.length("text")), ("SHORT", F.col("n_chars") < 100)]
    return knowledge.histogram(table(spark, d, "documents").withColumn("reason", knowledge.first_reason(rules)), "reason")


@query("select text, count(*) as n from documents group by 1 having count(*) > 1")
def duplicate_texts(spark, d):
    return knowledge.duplicates(table(spark, d, "documents"), "text")


@query("select distinct doc_id as value from documents where doc_id not in (select doc_id from labels)")
def dangling_references(spark, d):
    return knowledge.dangling(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id")


@query("""select doc_id, 1::bigint as "start", least(20, n_chars)::bigint + (doc_id % 3) as "end", case when 1 >= least(20, n_chars) + (doc_id % 3) then 'BAD_RANGE' when least(20, n_chars) + (doc_id % 3) > length(text) then 'OUT_OF_TEXT' when doc_id % 7 = 0 then 'QUOTE_MISMATCH' end as reason from documents""")
def span_verification(spark, d):
    docs = table(spark, d, "documents")
    end = F.least(F.lit(20), F.col("n_chars")).cast("long") + F.col("doc_id") % 3
    spans = docs.select("doc_id", F.lit(1).cast("long").alias("start"), end.alias("end"), F.when(F.col("doc_id") % 7 == 0, F.lit("?")).otherwise(F.substring(F.col("text"), F.lit(2), (end - 1).cast("int"))).alias("quote"))
    return knowledge.verify_spans(spans, docs)


VOCAB = [("AF", "SUPPLIES", None, None), ("NF", "SUPPLIES", None, None), ("RF", "RETURNED_BY", "inverse", "RETURNS")]


def _vocab(spark):
    return spark.createDataFrame(VOCAB, "synonym string, canonical string, symmetry string, inverse string")


NORM = """with r as (select 'supplier:' || l_suppkey as s, l_returnflag || l_linestatus as t, 'part:' || l_partkey as p, l_orderkey || '-' || l_linenumber as prov from lineitem),
c as (select case when t = 'RF' then p else s end as head, case when t in ('AF', 'NF') then 'SUPPLIES' when t = 'RF' then 'RETURNS' end as type, case when t = 'RF' then s else p end as tail, prov from r),
e as (select head, type, tail, count(*) as support, list(prov order by prov) as provs from c where type is not null group by all) """


@query(NORM + "select type, support, count(*) as n from e group by all")
def normalise_relations(spark, d):
    ok, _ = knowledge.normalize_relations(supply_relations(spark, d), _vocab(spark))
    return knowledge.histogram(ok.withColumn("support", F.col("support").cast("long")), "type", "support")


@query("select 'UNKNOWN_PREDICATE' as reason, count(*) as n from lineitem where l_returnflag || l_linestatus not in ('AF', 'NF', 'RF') having count(*) > 0")
def reject_histogram(spark, d):
    _, bad = knowledge.normalize_relations(supply_relations(spark, d), _vocab(spark))
    return knowledge.histogram(bad, "reason")


@query("""with e as (select 'supplier:' || l_suppkey as head, l_returnflag || l_linestatus as type, 'part:' || l_partkey as tail, count(*) as support from lineitem group by all),
k as (select 'supplier:' || s_suppkey as id from supplier where s_acctbal > 0 union all select 'part:' || p_partkey from part where p_size <= 45),
t as (select head, tail, list(distinct type) as types from e group by all)
select case when type not in ('AF', 'NF', 'RF') then 'UNKNOWN_TYPE' when head not in (select id from k) then 'UNKNOWN_HEAD' when tail not in (select id from k) then 'UNKNOWN_TAIL' when support < 1 then 'LOW_SUPPORT'
 when (type = 'AF' and list_contains(types, 'RF')) or (type = 'RF' and list_contains(types, 'AF')) then 'CONFLICT' end as reason, count(*) as n from e join t using (head, tail) group by 1""")
def quality_gate(spark, d):
    rel = supply_relations(spark, d).groupBy("head", "type", "tail").agg(F.count(F.lit(1)).alias("support"))
    ids = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id")).unionAll(table(spark, d, "part").filter("p_size <= 45").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id")))
    return knowledge.histogram(knowledge.quality_gate(rel, ["AF", "NF", "RF"], ids, [("AF", "RF")]), "reason")


def _batches(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("head"), F.lit("SUPPLIES").alias("type"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("tail"), "l_orderkey", (F.col("l_orderkey") % 2 == 0).alias("early"))
    one = lambda c: rows.filter(c).groupBy("head", "type", "tail").agg(F.sort_array(F.collect_set("l_orderkey")).alias("provs"))
    a, b = one("early"), one("not early")
    return knowledge.merge_batch(knowledge.merge_batch(knowledge.empty_store(a), a, "v1"), b, "v2")


MERGE = """with r as (select l_suppkey as h, l_partkey as t, l_orderkey as o, l_orderkey % 2 = 0 as early from lineitem), e as (select h, t, bool_or(early) as a, bool_or(not early) as b, list(distinct o) as provs from r group by all) """


@query(MERGE + "select case when not a then 'created' when b then 'accumulated' else 'untouched' end as status, count(*) as n, sum(len(provs))::bigint as support from e group by 1")
def merge_two_batches(spark, d):
    return _batches(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("provs")).alias("support"))


@query(MERGE + ", k as (select len(list_filter(provs, lambda o: o % 3 <> 0)) as kept from e) select count(*) filter (kept > 0) as live, count(*) filter (kept = 0) as tombstoned, sum(kept)::bigint as support from k")
def retract_source(spark, d):
    return knowledge.store_stats(knowledge.retract(_batches(spark, d), lambda p: p % 3 == 0))


@query("""with n as (select p_type as component, p_name as name, count(*) as freq, min(p_partkey) as first from part group by all) select component, arg_max(name, (freq, length(name), -first)) as canonical from n group by 1""")
def canonical_names(spark, d):
    return knowledge.canonical_name(table(spark, d, "part").select(F.col("p_type").alias("component"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")))


@query("""with recursive k as (select p_partkey as id, 'n:' || p_name as key from part union all select p_partkey, 'b:' || p_brand || ':' || p_size || ':' || p_type from part),
h as (select key, min(id) as hub from k group by 1), e as (select id, hub from k join h using (key)), u as (select id as a, hub as b from e union select hub, id from e),
r(id, c) as (select p_partkey, p_partkey from part union select u.a, r.c from r join u on u.b = r.id where r.c < u.a)
select id, min(c) as component from r group by 1""")
def alias_components(spark, d):
    p = table(spark, d, "part")
    keys = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("n:"), "p_name").alias("key")).unionAll(p.select("p_partkey", F.concat_ws(":", F.lit("b"), "p_brand", F.col("p_size").cast("string"), "p_type")))
    return knowledge.alias_components(keys)


ORACLES.pop("alias_components")  # the recursion is too slow over whole tables; held against union-find in tests


@query()
def fuzzy_name_pairs(spark, d):
    """Pairs of different part names of one type at 90 or more by sorted tokens."""
    return fuzzy_pairs(table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name"))).withColumnRenamed("type", "p_type")


@query("select lower(p_brand) as norm, arg_max(p_type, (p_size >= 25, p_partkey)) as concept from part group by 1")
def vocabulary_index(spark, d):
    return knowledge.vocabulary_index(table(spark, d, "part").select(text.norm_label(F.col("p_brand")).alias("norm"), F.col("p_type").alias("concept"), (F.col("p_size") >= 25).alias("preferred"), F.col("p_partkey").alias("pos"))).select(F.lower("norm").alias("norm"), "concept")


ORACLES["vocabulary_index"] = "select trim(regexp_replace(regexp_replace(lower(p_brand), '[-_/]', ' ', 'g'), '\\s+', ' ', 'g')) as norm, arg_max(p_type, (p_size >= 25, p_partkey)) as concept from part group by 1"


@query("""select concept, kb, external_id, "match", confidence from (select l_partkey as concept, l_returnflag as kb, 's' || l_suppkey as external_id, case when l_linestatus = 'F' then 'exact' else 'close' end as "match", l_discount as confidence, row_number() over (partition by l_partkey, l_returnflag order by l_linestatus, l_discount desc, 's' || l_suppkey) as n from lineitem) where n = 1""")
def crosswalk_best(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("concept"), F.col("l_returnflag").alias("kb"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("external_id"), F.when(F.col("l_linestatus") == "F", "exact").otherwise("close").alias("match"), F.col("l_discount").alias("confidence"))
    return knowledge.best_mapping(x)


GRAPH = """with nodes as (select 'region:' || r_regionkey as id, 'region' as label, r_name as name from region union all select 'nation:' || n_nationkey, 'nation', n_name from nation union all select 'customer:' || c_custkey, 'customer', c_name from customer union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier),
edges as (select 'nation:' || n_nationkey as src, 'IN_REGION' as type, 'region:' || n_regionkey as dst from nation union all select 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey from customer union all select 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey from supplier
 union all select distinct 'supplier:' || l_suppkey, 'SELLS_TO', 'customer:' || o_custkey from lineitem join orders on l_orderkey = o_orderkey where l_quantity >= 50) """


@query(GRAPH + ", v as (select src as subject, type as rel, dst as object, s.label as sl, o.label as ol from edges left join nodes s on s.id = src left join nodes o on o.id = dst) select rel, case when rel = 'SELLS_TO' then 'UNKNOWN_RELATION' when sl <> 'customer' then 'DOMAIN_MISMATCH' end as rule, count(*) as n from v where rel = 'SELLS_TO' or (rel = 'IN_NATION' and sl <> 'customer') group by all")
def shape_violations(spark, d):
    nodes, edges = graph_view(spark, d)
    shapes = spark.createDataFrame([("IN_REGION", "nation", "region"), ("IN_NATION", "customer", "nation")], "rel string, domain string, range string")
    return knowledge.histogram(knowledge.check_triples(edges.select(F.col("src").alias("subject"), F.col("type").alias("rel"), F.col("dst").alias("object")), nodes, shapes), "rel", "rule")


@query(GRAPH + "select id, count(src)::bigint as n from nodes left join edges on src = id and type = 'SELLS_TO' where label = 'supplier' group by 1 having count(src) < 70")
def shape_cardinality(spark, d):
    nodes, edges = graph_view(spark, d)
    return knowledge.check_cardinality(nodes, edges.select(F.col("src").alias("subject"), F.col("type").alias("rel")), "supplier", "SELLS_TO", 70)


@query("""select doc_id as id, case when lang = 'es' then 'semantic' when source in ('src1', 'src2') and lang <> 'en' then 'access' else 'policy' end as gate,
 case when lang = 'es' or (source in ('src1', 'src2') and lang <> 'en') or n_chars < 50 then 'deny' when contains(text, '@') then 'mask' else 'allow' end as decision from documents""")
def answer_time_gates(spark, d):
    items = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), (F.col("lang") != "es").alias("concept_known"), (F.col("n_chars") < 50).alias("deprecated"), F.when(F.col("source").isin("src1", "src2"), "internal").otherwise("public").alias("visibility"),
        F.when(F.col("lang") == "en", F.array(F.lit("analyst"))).otherwise(F.array(F.lit("admin"))).alias("roles"), F.array().cast("array<string>").alias("tenants"), F.col("source").alias("provenance"), F.lit(1.0).alias("confidence"), F.col("text").contains("@").alias("sensitive"),
    )
    return knowledge.answer_time_gates(items, "analyst", "t1", 0.5)


# -- graph -----------------------------------------------------------------------------


@query(GRAPH + "select label, count(*) as n from nodes group by 1")
def label_histogram(spark, d):
    return knowledge.histogram(graph_view(spark, d)[0], "label")


@query(GRAPH + "select c, count(*) as n from (select distinct a.src as a, a.dst as b, b.dst as c from edges a join edges b on a.dst = b.src where a.type = 'SELLS_TO' and b.type = 'IN_NATION') group by 1")
def two_hop_pattern(spark, d):
    return knowledge.histogram(graph.two_hop(graph_view(spark, d)[1], "SELLS_TO", "IN_NATION"), "c")


@query(GRAPH + "select id, label, count(*) as in_degree from nodes join edges on dst = id group by all order by in_degree desc, id limit 5")
def in_degree_topk(spark, d):
    return graph.in_degree_top(*graph_view(spark, d), 5)


@query(GRAPH + "select id, label, name from nodes where id not in (select src from edges where type = 'SELLS_TO' union select dst from edges where type = 'SELLS_TO')")
def isolated_nodes(spark, d):
    nodes, edges = graph_view(spark, d)
    return graph.isolated(nodes, edges.filter("type = 'SELLS_TO'"))


@query(GRAPH + ", deg as (select id, label, count(e) as degree from nodes left join (select src as e from edges union all select dst from edges) on e = id group by all) select label, max(degree) as max_degree, round(avg(degree), 6) as avg_degree from deg group by 1")
def degree_stats(spark, d):
    return graph.degrees(*graph_view(spark, d)).groupBy("label").agg(F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"))


@query(GRAPH + "select dst as id, count(distinct src) as n, min(src) as first_src from edges where type = 'SELLS_TO' group by 1 having count(distinct src) > 1")
def collect_improvers(spark, d):
    return graph_view(spark, d)[1].filter("type = 'SELLS_TO'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n"), F.min("src").alias("first_src")).filter("n > 1")


@query(GRAPH + ", u as (select src, dst from edges where type = 'IN_REGION' or type = 'IN_NATION' union select dst, src from edges where type = 'IN_REGION' or type = 'IN_NATION'), h1 as (select distinct dst as id from u where src = 'region:1'), h2 as (select distinct dst as id from u where src in (select id from h1) and dst not in (select id from h1) and dst <> 'region:1') select 'region:1' as \"start\", id, 1 as hops from h1 union all select 'region:1', id, 2 from h2")
def k_hop_expansion(spark, d):
    edges = graph_view(spark, d)[1].filter("type in ('IN_REGION', 'IN_NATION')")
    return graph.distances(edges, spark.createDataFrame([("region:1",)], "id string"), 2)


@query(GRAPH + """, u as (select src, dst, src || type || dst as e from edges where type <> 'SELLS_TO' union all select dst, src, src || type || dst from edges where type <> 'SELLS_TO'), p1 as (select src as s, dst as t, [e] as es from u where src in ('region:0', 'region:1')),
p2 as (select s, u.dst as t, list_append(es, e) as es from p1 join u on p1.t = u.src where not list_contains(es, e)), p3 as (select s, u.dst as t, list_append(es, e) as es from p2 join u on p2.t = u.src where not list_contains(es, e))
select s as "start", len(es)::int as hops, count(*) as n from (select * from p1 union all select * from p2 union all select * from p3) group by all""")
def var_length_paths_1_3(spark, d):
    edges = graph_view(spark, d)[1].filter("type <> 'SELLS_TO'")
    return knowledge.histogram(graph.paths(edges, spark.createDataFrame([("region:0",), ("region:1",)], "id string"), 3), "start", "hops")


@query(GRAPH + "select id, (select min(id) from nodes) as component from nodes")
def connected_components(spark, d):
    return graph.components(*graph_view(spark, d))


def _pagerank_sql(iterations: int) -> str:
    s = GRAPH + ", u as (select src, dst from edges union all select dst, src from edges where src <> dst), o as (select src, count(*) as n from u group by 1), l as (select u.src, u.dst, n from u join o using (src)), r0 as (select id, 0.15::double as score from nodes)"
    for i in range(iterations):
        s += f", g{i} as (select dst, sum(score / n) as got from l join r{i} on l.src = r{i}.id group by 1), r{i + 1} as (select id, 0.15::double + 0.85::double * coalesce(got, 0) as score from nodes left join g{i} on dst = id)"
    return s + f" select id, round(score, 6) as score from r{iterations}"


@query(_pagerank_sql(8))
def pagerank_fixed_iterations(spark, d):
    nodes, edges = graph_view(spark, d)
    return graph.pagerank(nodes, edges, 8, 0.85).select("id", F.round("score", 6).alias("score"))


@query(GRAPH + ", c as (select id, split_part(id, ':', 1) as c from nodes), e as (select a.c as ca, b.c as cb from edges join c a on a.id = src join c b on b.id = dst), m as (select count(*)::double as m from e), v as (select c, count(*)::double as vol from (select ca as c from e union all select cb from e) group by 1), i as (select ca as c, count(*) filter (ca = cb) as ins from e group by 1) select round(sum(coalesce(ins, 0) / m - (vol / (2 * m)) * (vol / (2 * m))), 6) as modularity from v left join i using (c) cross join m")
def modularity_of_partition(spark, d):
    nodes, edges = graph_view(spark, d)
    return graph.modularity(edges, nodes.select("id", F.col("label").alias("community")))


@query()
def communities(spark, d):
    nodes, edges = graph_view(spark, d)
    return graph.communities(nodes, edges.filter("type <> 'SELLS_TO'"))


@query("select 'n' || n_nationkey as id, 'n' || n_nationkey as ancestor, 0 as depth from nation union all select 'n' || n_nationkey, 'r' || n_regionkey, 1 from nation union all select 'n' || n_nationkey, 'world', 2 from nation union all select 'r' || r_regionkey, 'r' || r_regionkey, 0 from region union all select 'r' || r_regionkey, 'world', 1 from region union all select 'world', 'world', 0")
def taxonomy_ancestors(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("world").alias("parent"))
    return graph.ancestors(n.unionAll(r))


# -- evaluation ---------------------------------------------------------------------------


@query("""with p as (select distinct l_suppkey, l_partkey from lineitem where l_quantity > 20), g as (select distinct l_suppkey, l_partkey from lineitem where l_discount > 0.03), n as (select count(*) filter (p.l_suppkey is not null and g.l_suppkey is not null) as tp, count(*) filter (g.l_suppkey is null) as fp, count(*) filter (p.l_suppkey is null) as fn from p full join g on p.l_suppkey = g.l_suppkey and p.l_partkey = g.l_partkey)
select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2.0::double * tp / (2 * tp + fp + fn), 6) as f1 from n""")
def construction_prf(spark, d):
    li = table(spark, d, "lineitem")
    return retrieval.set_prf(li.filter("l_quantity > 20"), li.filter("l_discount > 0.03"), ["l_suppkey", "l_partkey"])


@query("""with m as (select event_type as metric, avg(value) as value from events where user_id % 2 = 0 group by 1), b as (select event_type as metric, avg(value) as base from events group by 1)
select metric, base, value, round(value - base, 6) as delta, coalesce(base - value <= greatest(0.02, base * 0.03) + 1e-9, false) as passed from (select metric, round(base, 6) as base, round(value, 6) as value from b left join m using (metric))""")
def regression_gate(spark, d):
    e = table(spark, d, "events")
    mean = lambda df: df.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return retrieval.compare(mean(e.filter("user_id % 2 = 0")), mean(e))


@query("""with a as (select user_id as qid, max(value) as a from events where event_type = 'click' group by 1), b as (select user_id as qid, max(value) as b from events where event_type = 'view' group by 1), j as (select a - b as d from a join b using (qid)) select count(*) filter (d > 1e-9) as wins, count(*) filter (abs(d) <= 1e-9) as ties, count(*) filter (d < -1e-9) as losses from j""")
def win_loss_tie(spark, d):
    e = table(spark, d, "events")
    best = lambda kind: e.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("qid")).agg(F.max("value").alias("value"))
    return retrieval.win_loss(best("click"), best("view"))


# -- agent ------------------------------------------------------------------------------------


@query("""select case when contains(t, 'earlier') or contains(t, 'previous') or contains(t, 'last time') then 'memory' when contains(t, 'overall') or contains(t, 'summary') or contains(t, 'trend') then 'global' when contains(t, 'community') or contains(t, 'cluster') then 'community' when contains(t, 'path') or contains(t, 'between') or contains(t, 'connect') then 'path' else 'local' end as route, count(*) as n from (select lower(text) as t from conversations) group by 1""")
def route_questions(spark, d):
    return knowledge.histogram(table(spark, d, "conversations").select(agent.route(F.col("text")).alias("route")), "route")


@query(r"""with c as (select conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9가-힣]+') as t from conversations), p as (select a.conv_id, a.turn, list_distinct(a.t) as q, list_distinct(b.t) as r from c a join c b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
g as (select conv_id, turn, len(q) as nq, case when len(q) = 0 then 0.4 else len(list_intersect(q, r)) / len(q) end as share from p)
select conv_id, turn, round(share, 6) as overlap, case when nq = 0 then 'ambiguous' when share >= 0.5 then 'relevant' when share <= 0.15 then 'irrelevant' else 'ambiguous' end as grade from g""")
def grade_overlap(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", text.tokens_alnum(F.col("text")).alias("t"))
    j = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("r")), ["conv_id", "turn"])
    share, g = agent.grade(F.col("t"), F.col("r"))
    return j.select("conv_id", "turn", F.round(share, 6).alias("overlap"), g.alias("grade"))


@query("""with recursive e as (select user_id || ':' || event_type as key, epoch_us(ts) as t from events), nx as (select a.key, a.t, min(b.t) as n from (select distinct key, t from e) a left join e b on b.key = a.key and b.t >= a.t + 3600000000 group by all),
m(key, t) as (select key, min(t) from e group by 1 union all select m.key, nx.n from m join nx using (key, t) where nx.n is not null) select false as hit, count(*) as n from m union all select true, (select count(*) from e) - (select count(*) from m)""")
def ttl_cache_hits(spark, d):
    e = table(spark, d, "events").withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return agent.ttl_cache(e, "key", "ts", "event_id", 3600).groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select conv_id, turn, sum(greatest(1, length(text) // 4)) over w as used, row_number() over w as step from conversations window w as (partition by conv_id order by turn)), h as (select *, case when used > 300 then 'tokens' when step > 6 then 'tool_calls' end as limit_hit from r)
select conv_id, min(step)::int as step, arg_min(used, step)::bigint as used, arg_min(limit_hit, step) as limit_hit from h where limit_hit is not null group by 1""")
def budget_first_breach(spark, d):
    c = table(spark, d, "conversations").withColumn("tokens", text.estimate_tokens_quarter(F.col("text")))
    return agent.budget_breach(c, "conv_id", ["turn"], "tokens", 300, 6)


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id)::int as seq from events")
def audit_sequence(spark, d):
    return agent.audit_sequence(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "seq")


@query("""select qid, id, pos, id in (select doc_id from labels where quality = 1) as ok from (select user_id as qid, event_id % 97 as id, min(event_id) as pos from events group by all)""")
def citation_audit(spark, d):
    cited = table(spark, d, "events").select(F.col("user_id").alias("qid"), (F.col("event_id") % 97).alias("id"), F.col("event_id").alias("pos"))
    good = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return agent.verify_citations(cited, cited.select("qid", "id").distinct().join(good, "id", "left_semi"))


@query("select date_trunc('hour', ts) as \"start\", event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def windowed_event_counts(spark, d):
    return windowed_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query()
def chunk_documents(spark, d):
    return chunks.chunk_documents(table(spark, d, "documents"))
