"""Further queries: linking, events, dashboards, rule and policy reports, evaluation tables, the corrective loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import agent, answering, graph, knowledge, retrieval
from graphloom.plans.catalog import BM25, GRAPH, _bm25, _gold, _pagerank_sql, query
from graphloom.sources.tables import full_graph_view, graph_view, table


@query(r"""with w as (select doc_id as id, unnest(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_-]+')) as w from documents) select w as surface, count(*) as n from w where w in ('the', 'der', 'que', 'idiot') group by 1""")
def lexicon_counts(spark, d):
    lex = spark.createDataFrame([(w, w.upper()) for w in ("the", "der", "que", "idiot")], "surface string, name string")
    return answering.lexicon_mentions(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), lex).groupBy("surface").agg(F.count(F.lit(1)).alias("n"))


@query("""with m as (select distinct case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then upper(p_name) else 'zz' || p_partkey end as mention from part), e as (select 'p' || p_partkey as id, p_name as name from part),
x as (select mention, min(id) as id from m join e on mention = name group by 1), a as (select mention, min(id) as id from m join e on lower(mention) = name where mention not in (select mention from x) group by 1)
select mention, 'exact' as stage, id, 1.0::double as score from x union all select mention, 'alias', id, 0.9::double from a union all select mention, 'none', null, 0.0::double from m where mention not in (select mention from x union select mention from a)""")
def link_mentions(spark, d):
    p = table(spark, d, "part")
    m = p.select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.lit("zz"), F.col("p_partkey").cast("string"))).alias("mention"))
    e = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return answering.link(m, e)


@query("select 'e' || event_id as event_id, r.role, case r.role when 'when' then ts::date::varchar when 'who' then 'u' || user_id else event_type end as value from events cross join (values ('when'), ('who'), ('what')) r(role)")
def reified_events(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), "event_type").alias("participants"), F.date_format("ts", "yyyy-MM-dd").alias("time"))
    return answering.reify(e, ["when", "who", "what"], "when")


@query(GRAPH + "select dst as id, src as source, name from edges join nodes on id = src where type = 'IN_REGION' and name <> dst order by 1, 2")
def single_hop_pattern(spark, d):
    nodes, edges = graph_view(spark, d)
    return edges.filter("type = 'IN_REGION'").join(nodes.select(F.col("id").alias("src"), "name"), "src").select(F.col("dst").alias("id"), F.col("src").alias("source"), "name")


@query("select 'self_loops' as metric, 0::bigint as n union all select 'duplicate_names', count(*) from (select n_regionkey from nation group by 1 having count(*) > 1)")
def graph_defects(spark, d):
    nodes, edges = graph_view(spark, d)
    same = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("name"), F.col("n_nationkey").alias("id"))
    loops = edges.filter("src = dst").agg(F.count(F.lit(1)).alias("n")).select(F.lit("self_loops").alias("metric"), "n")
    return loops.unionByName(graph.duplicate_names(same).agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_names").alias("metric"), "n"))


@query(GRAPH + """, l as (select src, dst from edges where type <> 'SELLS_TO') select 'nation:3' as "start", id, hops::int as hops from (select id, min(h) as hops from (
 select dst as id, 1 as h from l where src = 'nation:3' union all select src, 1 from l where dst = 'nation:3' union all select b.src, 2 from l a join l b on a.dst = b.dst where a.src = 'nation:3') where id <> 'nation:3' group by 1)""")
def shortest_path_lengths(spark, d):
    return graph.distances(graph_view(spark, d)[1].filter("type <> 'SELLS_TO'"), spark.createDataFrame([("nation:3",)], "id string"), 2)


@query("select 'n' || n_nationkey as id from nation where n_regionkey = 2")
def is_a_semi_join(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    return graph.ancestors(n).filter("ancestor = 'r2' and depth > 0").select("id")


@query("""select lang, source, count(*) as n from documents where n_chars < 1000 group by cube (lang, source)""")
def decision_log_cube(spark, d):
    return table(spark, d, "documents").filter("n_chars < 1000").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""select round(count(*) filter (p_size between 1 and 40 and p_name is not null) / count(*), 6) as conformance, round((count(*) - count(distinct p_name)) / count(*), 6) as duplicate_rate, round(count(*) filter (p_partkey not in (select l_partkey from lineitem where l_quantity >= 45)) / count(*), 6) as orphan_rate from part""")
def construction_metrics(spark, d):
    p = table(spark, d, "part")
    used = table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("u", F.lit(1))
    n = F.count(F.lit(1))
    return p.join(used, "p_partkey", "left").agg(F.round(F.sum(F.when(F.col("p_size").between(1, 40) & F.col("p_name").isNotNull(), 1).otherwise(0)) / n, 6).alias("conformance"), F.round((n - F.countDistinct("p_name")) / n, 6).alias("duplicate_rate"), F.round(F.sum(F.when(F.col("u").isNull(), 1).otherwise(0)) / n, 6).alias("orphan_rate"))


@query("""with x as (select l_returnflag as kb, count(distinct l_partkey) as n from lineitem group by 1) select kb, n, round(100.0::double * n / (select count(*) from part), 1) as pct from x""")
def coverage_per_kb(spark, d):
    total = table(spark, d, "part").count()
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kb")).agg(F.countDistinct("l_partkey").alias("n")).select("kb", "n", F.round(100 * F.col("n") / F.lit(float(total)), 1).alias("pct"))


@query("""with a as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i from events), b as (select user_id, event_type, row_number() over (partition by user_id order by event_id) as i from events)
select user_id, round(count(*) filter (a.event_type = b.event_type) / count(*), 6) as accuracy from a join b using (user_id, i) group by 1""")
def tool_call_accuracy(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    a = agent.audit_sequence(e, "user_id", ["ts", "event_id"]).select("user_id", "seq", F.col("event_type").alias("called"))
    b = agent.audit_sequence(e, "user_id", ["event_id"]).select("user_id", "seq", F.col("event_type").alias("expected"))
    return a.join(b, ["user_id", "seq"]).groupBy("user_id").agg(F.round(F.avg((F.col("called") == F.col("expected")).cast("int")), 6).alias("accuracy"))


@query(BM25 + """, g as (select item_id as qid, doc_id as id from benchmark b join documents d on contains(d.text, b.text)), c as (select qid, id from bm where rank <= 3), n as (select qid, count(*) filter (c.id is not null and g.id is not null) as tp, count(c.id) as np, count(g.id) as ng from c full join g using (qid, id) group by 1)
select qid, round(case when np > 0 then tp / np else 0 end, 6) as precision, round(case when ng > 0 then tp / ng else 0 end, 6) as recall, round(case when tp > 0 then 2.0::double * tp / (np + ng) else 0 end, 6) as f1 from n""")
def citation_prf(spark, d):
    c = _bm25(spark, d, 3).select("qid", "id").withColumn("c", F.lit(1))
    g = _gold(spark, d).distinct().withColumn("g", F.lit(1))
    n = c.join(g, ["qid", "id"], "full_outer").groupBy("qid").agg(F.count(F.expr("case when c = 1 and g = 1 then 1 end")).alias("tp"), F.count("c").alias("np"), F.count("g").alias("ng"))
    p, r, f = retrieval.f1(F.col("tp"), F.col("np"), F.col("ng"))
    return n.select("qid", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


@query("""with m as (select event_type as config, avg(value) as mean, count(*)::double as n from events group by 1) select config, round(mean - (select mean from m where config = 'view'), 6) as d_mean, round(n - (select n from m where config = 'view'), 6) as d_n from m where config <> 'view'""")
def ablation_delta(spark, d):
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("config")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    full = m.filter("config = 'view'").select(F.col("mean").alias("m0"), F.col("n").alias("n0"))
    return m.filter("config <> 'view'").join(F.broadcast(full), F.lit(True)).select("config", F.round(F.col("mean") - F.col("m0"), 6).alias("d_mean"), F.round(F.col("n") - F.col("n0"), 6).alias("d_n"))


@query(r"""with q as (select conv_id, turn, 'MATCH (a)-[*1..' || (turn % 8) || ']-(b) ' || case when turn % 5 = 0 then 'SET a.x = 1 ' else '' end || 'RETURN a' as q, turn from conversations) select conv_id, turn, case when turn % 5 = 0 then 'WRITE' when turn % 8 > 5 then 'HOPS' end as reason, q || ' LIMIT 50' as limited from q""")
def read_only_guard(spark, d):
    q = table(spark, d, "conversations").withColumn("q", F.concat(F.lit("MATCH (a)-[*1.."), (F.col("turn") % 8).cast("string"), F.lit("]-(b) "), F.when(F.col("turn") % 5 == 0, "SET a.x = 1 ").otherwise(""), F.lit("RETURN a")))
    return q.select("conv_id", "turn", agent.read_only_reason(F.col("q")).alias("reason"), agent.ensure_limit(F.col("q")).alias("limited"))


@query("""with m as (select 'nation:' || n_nationkey as community, n_name as name from nation union all select 'region:' || r_regionkey, r_name from region union all select 'nation:' || c_nationkey, c_name from customer union all select 'nation:' || s_nationkey, s_name from supplier),
t as (select distinct community, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) as t from m), q as (select n_nationkey as qid, unnest(list_distinct(regexp_extract_all(lower('summary of ' || n_name), '[a-z0-9]+'))) as t from nation), n as (select qid, count(*) as n from q group by 1),
s as (select qid, community, round(10 * count(*) / n::double, 6) as score from q join t using (t) join n using (qid) group by qid, community, n) select qid, community, score, row_number() over (partition by qid order by score desc, community) as rank from s qualify rank <= 5""")
def community_report_search(spark, d):
    nodes, edges = graph_view(spark, d)
    near = edges.filter("type <> 'SELLS_TO'")
    label = nodes.join(near.filter("type = 'IN_NATION'").select(F.col("src").alias("id"), F.col("dst").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("community"))
    questions = table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("summary of "), "n_name").alias("text"))
    return answering.global_search(nodes.join(label, "id").select("community", F.col("name").alias("text")), questions)


@query()
def corrective_answers(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")

    def retrieve(q):
        return retrieval.bm25(docs, q, 3).join(docs, "id").select("qid", "id", "text", "rank")

    return answering.corrective_loop(asked, retrieve, 2)


@query("select doc_id, 'src-' || source as source_id, (source ~ '^src[0-9]+$') as ok, regexp_replace(lower(lang || '_' || source), '[_ ]', '-', 'g') as tag from documents")
def source_ids(spark, d):
    sid = text.source_id_from_stem(F.concat(F.lit("src-"), "source"))
    return table(spark, d, "documents").select("doc_id", sid.alias("source_id"), text.is_source_id(sid).alias("ok"), text.normalize_tag(F.concat_ws("_", "lang", "source")).alias("tag"))


@query("select mk, count(*) as n from (select unnest(case when n_chars < 200 then ['SHORT'] else [] end || case when lang <> 'en' then ['LANG'] else [] end || case when contains(text, chr(10)) then [] else ['ONE_LINE'] end) as mk from documents) group by 1")
def all_violations(spark, d):
    rules = [("SHORT", F.col("n_chars") < 200), ("LANG", F.col("lang") != "en"), ("ONE_LINE", ~F.col("text").contains("\n"))]
    return knowledge.histogram(table(spark, d, "documents").select(F.explode(knowledge.all_reasons(rules)).alias("mk")), "mk")


# -- the graph of all relations ---------------------------------------------------------

FULL = """with nodes as (select 'region:' || r_regionkey as id, 'region' as label, r_name as name from region union all select 'nation:' || n_nationkey, 'nation', n_name from nation union all select 'customer:' || c_custkey, 'customer', c_name from customer union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier union all select 'part:' || p_partkey, 'part', p_name from part),
edges as (select 'nation:' || n_nationkey as src, 'IN_REGION' as type, 'region:' || n_regionkey as dst from nation union all select 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey from customer union all select 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey from supplier
 union all select distinct 'customer:' || o_custkey, 'ORDERED', 'part:' || l_partkey from lineitem join orders on l_orderkey = o_orderkey union all select distinct 'supplier:' || l_suppkey, 'SUPPLIES', 'part:' || l_partkey from lineitem join orders on l_orderkey = o_orderkey) """


@query(FULL + "select a.dst as a, count(*) as n from edges a join edges b on b.src = a.src where a.type = 'IN_NATION' and b.type = 'ORDERED' group by 1")
def two_hop_pattern_full(spark, d):
    edges = full_graph_view(spark, d)[1]
    home = edges.filter("type = 'IN_NATION'").select(F.col("dst").alias("src"), F.lit("HOME_OF").alias("type"), F.col("src").alias("dst"))
    return knowledge.histogram(graph.two_hop(home.unionByName(edges.filter("type = 'ORDERED'").select("src", "type", "dst")), "HOME_OF", "ORDERED"), "a")


@query(FULL + "select id, label, count(*) as in_degree from nodes join edges on dst = id group by all order by in_degree desc, id limit 5")
def in_degree_topk_full(spark, d):
    return graph.in_degree_top(*full_graph_view(spark, d), 5)


@query(FULL + "select id, label, name from nodes where id not in (select src from edges where type in ('ORDERED', 'SUPPLIES') union select dst from edges where type in ('ORDERED', 'SUPPLIES'))")
def isolated_nodes_full(spark, d):
    nodes, edges = full_graph_view(spark, d)
    return graph.isolated(nodes, edges.filter("type in ('ORDERED', 'SUPPLIES')"))


@query(FULL + ", deg as (select id, label, count(e) as degree from nodes left join (select src as e from edges union all select dst from edges) on e = id group by all) select label, max(degree) as max_degree, round(avg(degree), 6) as avg_degree from deg group by 1")
def degree_stats_full(spark, d):
    return graph.degrees(*full_graph_view(spark, d)).groupBy("label").agg(F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"))


@query(FULL + "select dst as id, count(distinct src) as n, min(src) as first_src from edges where type = 'SUPPLIES' group by 1 having count(distinct src) > 1")
def collect_improvers_full(spark, d):
    return full_graph_view(spark, d)[1].filter("type = 'SUPPLIES'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n"), F.min("src").alias("first_src")).filter("n > 1")


@query()
def connected_components_full(spark, d):
    return graph.components(*full_graph_view(spark, d))


@query(_pagerank_sql(8).replace(GRAPH, FULL))
def pagerank_full(spark, d):
    return graph.pagerank(*full_graph_view(spark, d), 8, 0.85).select("id", F.round("score", 6).alias("score"))


@query(FULL + ", c as (select id, split_part(id, ':', 1) as c from nodes), e as (select a.c as ca, b.c as cb from edges join c a on a.id = src join c b on b.id = dst), m as (select count(*)::double as m from e), v as (select c, count(*)::double as vol from (select ca as c from e union all select cb from e) group by 1), i as (select ca as c, count(*) filter (ca = cb) as ins from e group by 1) select round(sum(coalesce(ins, 0) / m - (vol / (2 * m)) * (vol / (2 * m))), 6) as modularity from v left join i using (c) cross join m")
def modularity_full(spark, d):
    nodes, edges = full_graph_view(spark, d)
    return graph.modularity(edges, nodes.select("id", F.col("label").alias("community")))


@query()
def communities_full(spark, d):
    return graph.communities(*full_graph_view(spark, d))
