"""Queries for Markdown, vocabularies, the store, paths, evaluation and the harness, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import markdown as md
from graphloom.operators import evaluation as ev
from graphloom.operators import harness as hs
from graphloom.operators import graph, knowledge, store
from graphloom.operators import vocabulary as vo
from graphloom.plans.catalog import query
from graphloom.sources.tables import table

c, lit = F.col, F.lit

# -- Markdown ---------------------------------------------------------------------
# Wiki pages made of documents: frontmatter, three levels of headings, a closing mark, an empty section.

WIKI = r"""with wiki as (select doc_id, '---' || chr(10) || 'title: Doc ' || doc_id || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || '---' || chr(10) || chr(10) ||
  case when doc_id % 3 = 0 then 'Preface.' || chr(10) else '' end || '# ' || lang || ' #' || chr(10) || chr(10) || replace(text, '#', '') || chr(10) || '### Deep' || chr(10) || 'x' || chr(10) || '## ' || source || chr(10) || 'see [[src-' || source || '|' || lang || ']] and [[src-a]]' || chr(10) || '### Notes' || chr(10) || '# End' as page from documents where text is not null) """


def wiki(spark, d):
    n = lit("\n")
    page = F.concat(lit("---\ntitle: Doc "), c("doc_id").cast("string"), lit("\ntags: ["), c("lang"), lit(", "), c("source"), lit("]\n---\n\n"), F.when(c("doc_id") % 3 == 0, "Preface.\n").otherwise(""), lit("# "), c("lang"), lit(" #\n\n"), F.replace(c("text"), lit("#"), lit("")), lit("\n### Deep\nx\n## "), c("source"), lit("\nsee [[src-"), c("source"), lit("|"), c("lang"), lit("]] and [[src-a]]"), n, lit("### Notes"), n, lit("# End"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", page.alias("page"))


BODY = WIKI + r""", parts as (select doc_id, page, substr(page, strpos(page, chr(10) || '---' || chr(10)) + 5) as rest from wiki), body as (select doc_id, page, case when starts_with(rest, chr(10)) then substr(rest, 2) else rest end as body from parts) """


@query(BODY + r"""select doc_id, 'Doc ' || doc_id as title, regexp_extract(page, 'tags: \[([^,]*), ', 1) as first_tag, 2::bigint as n_tags, sha256(body) as body_hash,
 (select string_agg(x, ' ') from (select distinct on (x) x from (select unnest(list_transform(regexp_extract_all(body, '\[\[([^\[\]|]+)', 1), lambda v: trim(v))) as x) order by x)) as targets from body""")
def wiki_frontmatter(spark, d):
    rows = wiki(spark, d).withColumn("p", md.split_frontmatter(c("page")))
    tags = md.listed(c("p.block"), "tags")
    return rows.select("doc_id", md.scalar(c("p.block"), "title").alias("title"), F.get(tags, lit(0)).alias("first_tag"), F.size(tags).cast("long").alias("n_tags"), F.sha2("p.body", 256).alias("body_hash"), F.array_join(F.sort_array(md.unique_targets(c("p.body"))), " ").alias("targets"))


@query(BODY + r""", lines as (select doc_id, body, unnest(string_split(body, chr(10))) as s, generate_subscripts(string_split(body, chr(10)), 1) as line from body),
lined as (select *, coalesce(sum(length(s) + 1) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0)::bigint as pos from lines),
heads as (select doc_id, line, pos, length(body) as size, length(regexp_extract(s, '^(#{1,3})[ \t]+', 1)) as level, trim(regexp_extract(s, '^#{1,3}[ \t]+(.+?)[ \t]*#*\s*$', 1)) as heading, least(pos + length(s) + 1, length(body)) as start from lined where regexp_matches(s, '^#{1,3}[ \t]+.+?[ \t]*#*\s*$')),
pathed as (select *, lead(pos) over w as nxt, (select h1.heading from heads h1 where h1.doc_id = h.doc_id and h1.level = 1 and h1.line < h.line order by h1.line desc limit 1) as one, (select h1.line from heads h1 where h1.doc_id = h.doc_id and h1.level = 1 and h1.line < h.line order by h1.line desc limit 1) as l1,
 (select h2.heading from heads h2 where h2.doc_id = h.doc_id and h2.level = 2 and h2.line < h.line order by h2.line desc limit 1) as two, (select h2.line from heads h2 where h2.doc_id = h.doc_id and h2.level = 2 and h2.line < h.line order by h2.line desc limit 1) as l2 from heads h window w as (partition by doc_id order by line)),
found as (select doc_id, level, heading, concat_ws(' > ', case when level > 1 then one end, case when level > 2 and l2 > coalesce(l1, -1) then two end, heading) as path, start, coalesce(nxt, size) as "end" from pathed
 union all select b.doc_id, 0, '', '', 0, coalesce(min(h.pos), length(b.body)) from body b left join heads h using (doc_id) group by b.doc_id, b.body having trim(substr(b.body, 1, coalesce(min(h.pos), length(b.body))), ' ' || chr(9) || chr(10)) <> '')
select doc_id, row_number() over (partition by doc_id order by start, level) - 1 as section, level, heading, path, start, "end" from found""")
def section_paths(spark, d):
    rows = wiki(spark, d).select("doc_id", md.split_frontmatter(c("page"))["body"].alias("body"))
    return md.sections(rows).select("doc_id", c("section").cast("long").alias("section"), "level", "heading", F.concat_ws(" > ", "section_path").alias("path"), "start", "end")


@query(r"""with t as (select doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as l from (select doc_id, text || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || 'x $y$ and \[z\] 한글' as text from documents where text is not null)),
e as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as i from t), r as (select doc_id, i, regexp_matches(s, '^\s*\|.*\|\s*$') as is_row, s from e),
g as (select doc_id, i - row_number() over (partition by doc_id order by i) as k, count(*) over (partition by doc_id) as m from r where is_row), b as (select doc_id, count(*) as n from (select doc_id, k, count(*) as n from g group by all having count(*) >= 2) group by 1)
select doc_id, n as table_blocks, len(regexp_extract_all(text || ' x $y$ and \[z\] 한글', '\$[^$\n]+\$|\\\[[^\]]+?\\\]')) as formulas, len(regexp_extract_all(text || '한글', '[가-힣]')) as hangul, round(len(regexp_extract_all(text || '한글', '[가-힣]')) / 4.0, 2) as ratio from b join documents using (doc_id)""")
def parser_metrics(spark, d):
    text = F.concat(c("text"), lit("\n| a | b |\n|---|---|\nx $y$ and \\[z\\] 한글"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", md.parse_metrics(text, lit(4)).alias("m")).select("doc_id", "m.table_blocks", "m.formulas", "m.hangul", c("m.hangul_ratio").alias("ratio"))


@query(r"""select p_partkey, '---' || chr(10) || 'title: ' || p_name || chr(10) || 'source_id: src-' || p_partkey || chr(10) || 'tags:' || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_type || chr(10) || 'aliases: []' || chr(10) || 'links:' || chr(10) || '- src-' || p_brand || chr(10) || '---' || chr(10) || chr(10) ||
 'The [[src-' || 'x|part]] ' || p_name || ' part' as page, false as links_bad, 'done' as kept from part""")
def wiki_pages(spark, d):
    body = md.inject_links(F.concat(lit("\n The part "), c("p_name"), lit(" part")), [("part", "src-x", "part"), ("absent phrase", "src-y", "y")])
    links = F.array(F.concat(lit("src-"), c("p_brand")))
    page = md.to_wiki(c("p_name"), F.concat(lit("src-"), c("p_partkey").cast("string")), F.array("p_brand", "p_type"), F.array().cast("array<string>"), links, body)
    return table(spark, d, "part").select("p_partkey", page.alias("page"), (~md.links_valid(links)).alias("links_bad"), md.strip_score_lines(lit("SCORE: 7\ndone\n")).alias("kept"))


# -- vocabularies ------------------------------------------------------------------
# Types are regions, concepts nations; suppliers name them loosely, some not at all.

RAW = """with raw as (select s_suppkey as id, case when s_suppkey % 7 = 0 then 'unknown' else lower(r_name) end as raw_type, case when s_suppkey % 5 = 0 then 'nowhere' when s_suppkey % 3 = 0 then 'land-of_' || lower(n_name) else replace(lower(n_name), ' ', '_') end as raw_label, n_nationkey, n_name, r_regionkey, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) """


def vocab(spark, d):
    types = table(spark, d, "region").select(c("r_regionkey").alias("id"), c("r_name").alias("label"), F.array().cast("array<string>").alias("alt_labels"))
    concepts = table(spark, d, "nation").select(c("n_nationkey").alias("id"), c("n_name").alias("label"), F.array(F.concat(lit("Land of "), c("n_name"))).alias("alt_labels"), c("n_regionkey").alias("broader"))
    s = table(spark, d, "supplier").join(concepts.select(c("id").alias("s_nationkey"), "label", "broader"), "s_nationkey").join(types.select(c("id").alias("broader"), c("label").alias("region")), "broader")
    loose = F.when(c("s_suppkey") % 5 == 0, "nowhere").when(c("s_suppkey") % 3 == 0, F.concat(lit("land-of_"), F.lower("label"))).otherwise(F.replace(F.lower("label"), lit(" "), lit("_")))
    return types, concepts, s.select(c("s_suppkey").alias("id"), F.when(c("s_suppkey") % 7 == 0, "unknown").otherwise(F.lower("region")).alias("raw_type"), loose.alias("raw_label"))


@query(RAW + """select id, case when id % 7 <> 0 then r_regionkey end as type_id, case when id % 5 <> 0 then n_nationkey end as concept_id, case when id % 5 <> 0 then n_name end as concept_label, concat_ws('+', case when id % 7 = 0 then 'type' end, case when id % 5 = 0 then 'label' end) as reasons from raw""")
def normalise_entities(spark, d):
    types, concepts, rows = vocab(spark, d)
    return vo.normalize_entities(rows, types, concepts).select("id", "type_id", "concept_id", "concept_label", F.array_join("reasons", "+").alias("reasons"))


@query(RAW + """select 'urn:kb:concept:' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') as canonical_id, count(*) as merged_count, min(id) as first_alias, max(id) as last_alias from raw where id % 5 <> 0 group by n_name
 union all select 'unresolved', count(*), min(id), max(id) from raw where id % 5 = 0""")
def canonical_merge(spark, d):
    _, concepts, rows = vocab(spark, d)
    nodes, lost = vo.merge_raw_nodes(rows.select(c("id").alias("raw_id"), c("raw_label").alias("surface"), "raw_type", lit("s").alias("source_doc")), concepts)
    out = nodes.select("canonical_id", "merged_count", F.get("aliases", lit(0))["raw_id"].alias("first_alias"), F.element_at("aliases", -1)["raw_id"].alias("last_alias"))
    return out.unionByName(lost.agg(lit("unresolved").alias("canonical_id"), F.count(lit(1)).alias("merged_count"), F.min("raw_id").alias("first_alias"), F.max("raw_id").alias("last_alias")))


@query("""select 'duplicate id' as kind, '24' as value union all select 'ambiguous label', replace(lower(n_name), '_', ' ') from nation where n_nationkey = 18 union all select 'urn', 'urn:kb:concept:' || replace(lower(n_name), '_', '-') from nation where n_nationkey = 18""")
def vocabulary_conflicts(spark, d):
    _, concepts, _ = vocab(spark, d)
    twice = concepts.unionByName(concepts.filter("id = 24")).unionByName(concepts.filter("id = 18").withColumn("id", lit(99).cast(dict(concepts.dtypes)["id"])).withColumn("alt_labels", F.array().cast("array<string>")))
    _, urns = vo.issue_ids(concepts.unionByName(concepts.filter("id = 18")))
    return vo.label_conflicts(twice).unionByName(urns.select(lit("urn").alias("kind"), c("canonical_id").alias("value")))


@query("""with m as (select n_nationkey + case when n_nationkey = 3 then 100 else 0 end as internal, case when n_nationkey = 5 then 'nil' else 'kb' end as kb, 'exact' as match from nation union all select 7, 'kb', 'exact')
select 'unknown concept' as kind, internal, kb from m where internal > 24 union all select 'unknown base', internal, kb from m where kb = 'nil' union all select 'several exact', internal, kb from m group by all having count(*) > 1""")
def alignment_problems(spark, d):
    _, concepts, _ = vocab(spark, d)
    m = concepts.select((c("id") + F.when(c("id") == 3, 100).otherwise(0)).cast("long").alias("internal"), F.when(c("id") == 5, "nil").otherwise("kb").alias("kb"), lit("exact").alias("match"))
    m = m.unionByName(spark.sql("select 7L as internal, 'kb' as kb, 'exact' as match"))
    return vo.alignment_problems(m, concepts.select(c("id").cast("long").alias("id")), spark.sql("select 'kb' as kb"))


@query("""select n_nationkey as id, 'https://kb.example.org/' || n_name as url, n_name as bare from nation""")
def external_urls(spark, d):
    n = table(spark, d, "nation")
    return n.select(c("n_nationkey").alias("id"), vo.external_url(lit("https://kb.example.org/{id}"), c("n_name")).alias("url"), vo.external_url(lit(None).cast("string"), c("n_name")).alias("bare"))


@query("""with m as (select c_custkey as name, case when c_custkey % 10 = 0 then c_custkey - 10 else c_custkey - c_custkey % 10 end as target from customer), f as (select a.name, a.target, b.target as onward from m a join m b on a.target = b.name where b.target <> a.target)
select 'chain' as kind, count(*) as n, min(name) as first from f union all select 'misjoin', count(*), min(target) from (select target from m where name in (11, 12, 25) group by target having count(*) > 1)""")
def merge_map_checks(spark, d):
    k = c("c_custkey")
    m = table(spark, d, "customer").select(k.alias("name"), F.when(k % 10 == 0, k - 10).otherwise(k - k % 10).alias("target"))
    bad, mis = vo.not_fixpoints(m), vo.misjoined(m, [11, 12, 25])
    return bad.agg(lit("chain").alias("kind"), F.count(lit(1)).alias("n"), F.min("name").alias("first")).unionByName(mis.agg(lit("misjoin").alias("kind"), F.count(lit(1)).alias("n"), F.min("target").alias("first")))


@query("""with e as (select o_orderkey as id, o_custkey % 50 as source_id, case when o_orderkey % 2 = 0 then replace(o_orderpriority, '-', '_') else upper(o_orderpriority) end as name, o_orderstatus as type from orders),
k as (select id, min(id) over (partition by source_id, trim(regexp_replace(regexp_replace(lower(name), '[-_/]', ' ', 'g'), '\\s+', ' ', 'g')), type) as first from e) select first, id from k where id <> first""")
def coreferences(spark, d):
    o = table(spark, d, "orders")
    name = F.when(c("o_orderkey") % 2 == 0, F.replace("o_orderpriority", lit("-"), lit("_"))).otherwise(F.upper("o_orderpriority"))
    return vo.coreferences(o.select(c("o_orderkey").alias("id"), (c("o_custkey") % 50).alias("source_id"), name.alias("name"), c("o_orderstatus").alias("type")))


@query("""with w as (select p_partkey, string_split(p_name, ' ')[1] as a, p_name as b from part), t as (select p_partkey, a as s, b as l, string_split(b, ' ') as ws from w) select p_partkey, s <> l and list_contains(ws, s) and len(ws) > 1 as word, contains(l, substr(s, 2)) and not list_contains(ws, substr(s, 2)) and length(s) > 1 as glued from t""")
def substring_traps(spark, d):
    first = F.get(F.split("p_name", " "), lit(0))
    return table(spark, d, "part").select("p_partkey", vo.substring_trap(first, c("p_name")).alias("word"), (vo.substring_trap(F.substring(first, F.lit(2), F.length(first)), c("p_name")) & (F.length(first) > 1)).alias("glued"))


MOCK = """with t as (select n_nationkey, sha256(lower(trim(n_name)) || '#0') || sha256(lower(trim(n_name)) || '#1') as h from nation), v as (select n_nationkey, i, ('0x' || substr(h, 2 * i + 1, 2))::int / 255.0::double * 2.0 - 1.0 as x from t, range(0, 64) r(i)) """


@query(MOCK + "select n_nationkey, i, round(x / sqrt(sum(x * x) over (partition by n_nationkey)), 6) as value from v")
def mock_embeddings(spark, d):
    e = table(spark, d, "nation").select("n_nationkey", F.posexplode(vo.mock_embedding(c("n_name"))).alias("i", "value"))
    return e.select("n_nationkey", c("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


@query(MOCK + """, u as (select n_nationkey, i, x / sqrt(sum(x * x) over (partition by n_nationkey)) as x from v), s as (select a.n_nationkey as m, b.n_nationkey as k, round(sum(a.x * b.x), 6) as score from u a join u b using (i) where a.n_nationkey % 5 = b.n_nationkey % 5 and a.n_nationkey <> b.n_nationkey group by all)
select x.n_name as mention, y.n_name as name, score from s join nation x on x.n_nationkey = m join nation y on y.n_nationkey = k qualify row_number() over (partition by m order by score desc, y.n_name) = 1""")
def link_by_embedding(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(c("n_name").alias("mention"), c("n_nationkey").alias("x")), n.select(c("n_name").alias("name"), c("n_nationkey").alias("y"), (c("n_nationkey") % 5).alias("g"))
    pairs = a.withColumn("g", c("x") % 5).join(b, "g").filter("x <> y")
    return vo.best_candidate(a, pairs.select("mention", "name"))


SHAPES = [
    {"id": "any", "target_class": "*", "properties": [{"path": "phone", "min_count": 1, "pattern": r"Customer#[0-9]*[02468]$"}]},
    {"id": "building", "target_class": "BUILDING", "properties": [{"path": "nation", "datatype": "int", "in": ["1", "2", "3"]}, {"path": "extra", "pattern": "x"}]},
]


@query("""with c as (select c_custkey as node_id, c_mktsegment as label, case when c_custkey % 9 = 0 then '' else c_name end as phone, case when c_custkey % 4 = 0 then 'n/a' else c_nationkey::varchar end as nation from customer)
select node_id, 'any' as rule_id, 'phone' as path, 'missing' as problem from c where phone = '' union all select node_id, 'any', 'phone', 'pattern' from c where phone <> '' and not regexp_matches(phone, '^Customer#[0-9]*[02468]$')
 union all select node_id, 'building', 'nation', 'datatype' from c where label = 'BUILDING' and nation = 'n/a' union all select node_id, 'building', 'nation', 'in' from c where label = 'BUILDING' and nation not in ('1', '2', '3')""")
def node_shapes(spark, d):
    k = c("c_custkey")
    nodes = table(spark, d, "customer").select(k.alias("node_id"), c("c_mktsegment").alias("label"), F.when(k % 9 == 0, "").otherwise(c("c_name")).alias("phone"), F.when(k % 4 == 0, "n/a").otherwise(c("c_nationkey").cast("string")).alias("nation"), lit(None).cast("string").alias("extra"))
    return vo.node_violations(nodes, SHAPES)


@query("""select n_regionkey as id, string_agg(n_nationkey::varchar, ',' order by n_nationkey) as narrower from nation group by 1""")
def narrower_concepts(spark, d):
    _, concepts, _ = vocab(spark, d)
    return vo.narrower(concepts).select("id", F.concat_ws(",", F.transform("narrower", lambda x: x.cast("string"))).alias("narrower"))


@query("""with k as (select n_nationkey::varchar as id, n_name as label, n_regionkey::varchar as broader from nation)
select id as s, 'rdf:type' as p, 'skos:Concept' as o from k union all select id, 'skos:prefLabel', label from k union all select id, 'skos:broader', broader from k union all select id, 'skos:altLabel', 'Land of ' || label from k union all select broader, 'skos:narrower', id from k
 union all select r_name, 'rdf:type', 'rdfs:Class' from region union all select 'supplies', 'rdf:type', 'rdf:Property' union all select 'supplies', 'rdfs:domain', 'ASIA' union all select 'supplies', 'rdfs:range', 'EUROPE'""")
def vocabulary_triples(spark, d):
    _, concepts, _ = vocab(spark, d)
    classes = table(spark, d, "region").select(c("r_name").alias("id"), lit(None).cast("string").alias("parent"))
    return vo.skos_triples(concepts).unionByName(vo.rdfs_triples(classes, spark.sql("select 'supplies' as id, 'ASIA' as domain, 'EUROPE' as range")))


# -- the store ---------------------------------------------------------------------


@query("""with a as (select distinct o_custkey::varchar as name, o_orderstatus as label from orders where o_orderkey % 2 = 0), b as (select distinct o_custkey::varchar as name, o_orderstatus as label from orders where o_orderkey % 2 = 1),
l as (select name, label, 1 as k from a union all select name, label, 2 from b), o as (select name, label, min(k) as k from l group by all)
select name, string_agg(label, ',' order by k, label) as labels, case when name in (select name from a) then 'b1' else 'b2' end as first_seen, case when name in (select name from b) then 'b2' else 'b1' end as last_seen from o group by name""")
def node_upserts(spark, d):
    rows = lambda r: table(spark, d, "orders").filter(c("o_orderkey") % 2 == r).select(c("o_custkey").cast("string").alias("name"), c("o_orderstatus").alias("label"))
    none = spark.createDataFrame([], "name string, labels array<string>, first_seen string, last_seen string")
    state = store.merge_nodes(store.merge_nodes(none, rows(0), "b1"), rows(1), "b2")
    return state.select("name", F.array_join("labels", ",").alias("labels"), "first_seen", "last_seen")


@query("""select c_custkey as id, case when c_custkey % 2 = 0 then upper(c_name) else c_name end as name, case when c_custkey % 3 = 0 then 'second' else 'first' end as created, 'd' || c_custkey as note from customer where c_custkey % 3 <> 0 or c_custkey % 2 = 0""")
def keyed_upserts(spark, d):
    cu = table(spark, d, "customer")
    state = cu.filter("c_custkey % 3 <> 0").select(c("c_custkey").alias("id"), c("c_name").alias("name"), lit("first").alias("created"), lit(None).cast("string").alias("note"))
    merged = store.upsert(state, cu.filter("c_custkey % 2 = 0").select(c("c_custkey").alias("id"), F.upper("c_name").alias("name")), "id", {"created": lit("second")})
    return store.attach(merged, cu.select(c("c_custkey").alias("id"), F.concat(lit("d"), c("c_custkey").cast("string")).alias("note")), "id", ["note"])


REL = """with e as (select distinct 'c' || o_custkey as src, 'ORDERED' as type, 'p' || l_partkey as dst, o_orderkey as source_id from orders join lineitem on o_orderkey = l_orderkey) """


def relation_keys(spark, d):
    """Relations with bare keys as ends, made distinct before texts are made of them."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), c("o_orderkey") == c("l_orderkey"))
    return j.select(c("o_custkey").alias("src"), c("l_partkey").alias("dst"), c("o_orderkey").alias("source_id")).distinct().select("src", lit("ORDERED").alias("type"), "dst", "source_id")


def named_ends(rows):
    return rows.withColumn("src", F.concat(lit("c"), c("src").cast("string"))).withColumn("dst", F.concat(lit("p"), c("dst").cast("string")))


def relations(spark, d):
    return named_ends(relation_keys(spark, d))


@query(REL + """select src, type, dst, count(*) as n, string_agg(source_id::varchar, ',' order by source_id) as source_ids from e group by src, type, dst having count(*) > 1""")
def bulk_relation_rows(spark, d):
    return named_ends(store.bulk_rows(relation_keys(spark, d)).filter("n > 1")).select("src", "type", "dst", "n", F.concat_ws(",", F.transform("source_ids", lambda x: x.cast("string"))).alias("source_ids"))


@query(REL + """select distinct src, type, dst from e where substr(src, 2)::int % 10 = 1 and substr(dst, 2)::int % 2 = 0""")
def link_known_ends(spark, d):
    ids = table(spark, d, "customer").filter("c_custkey % 10 = 1").select(F.concat(lit("c"), c("c_custkey").cast("string")).alias("id"))
    parts = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.concat(lit("p"), c("p_partkey").cast("string")).alias("id"))
    return store.link_existing(relations(spark, d), ids.unionByName(parts))


@query(REL + """, m as (select 'c' || c_custkey as id, c_custkey % 5 as g from customer union all select 'p' || p_partkey, p_partkey % 5 from part) select a.g as "group", count(*) as n from (select distinct src, type, dst from e) e join m a on a.id = src join m b on b.id = dst where a.g = b.g group by 1""")
def community_internal_edges(spark, d):
    m = table(spark, d, "customer").select(F.concat(lit("c"), c("c_custkey").cast("string")).alias("id"), (c("c_custkey") % 5).alias("group")).unionByName(table(spark, d, "part").select(F.concat(lit("p"), c("p_partkey").cast("string")).alias("id"), (c("p_partkey") % 5).alias("group")))
    return store.internal_edges(relations(spark, d), m).groupBy("group").agg(F.count(lit(1)).alias("n"))


@query("""with e as (select distinct c_custkey as src, 'LIVES' as type, c_nationkey as dst from customer union all select distinct c_custkey, 'PLACED', o_orderstatus::varchar from orders join customer on o_custkey = c_custkey)
select c_custkey as id, c_name || '.' || coalesce(' ' || string_agg(distinct type || ' ' || dst, '; ' order by type || ' ' || dst), '') as description from customer left join e on src = c_custkey group by c_custkey, c_name""")
def node_descriptions(spark, d):
    cu = table(spark, d, "customer")
    e = cu.select(c("c_custkey").alias("src"), lit("LIVES").alias("type"), c("c_nationkey").cast("string").alias("dst")).unionByName(table(spark, d, "orders").join(cu, c("o_custkey") == c("c_custkey")).select(c("c_custkey").alias("src"), lit("PLACED").alias("type"), c("o_orderstatus").alias("dst")))
    return store.descriptions(cu.select(c("c_custkey").alias("id"), c("c_name").alias("name")), e)


@query("""select source, count(distinct doc_id) as n, min(doc_id) as first, max(doc_id) as last from documents group by 1""")
def source_index(spark, d):
    return store.inverted(table(spark, d, "documents"), "source", "doc_id").select("source", F.size("doc_id").cast("long").alias("n"), F.get("doc_id", lit(0)).alias("first"), F.element_at("doc_id", -1).alias("last"))


SUP = """with e as (select distinct 's' || l_suppkey as src, 'SUPPLIES' as type, 'p' || l_partkey as dst from lineitem), p as (select 's' || x.s_suppkey as a, 's' || y.s_suppkey as b from supplier x join supplier y on x.s_suppkey < y.s_suppkey where x.s_suppkey <= 3 and y.s_suppkey <= 8) """


def supplies(spark, d):
    return table(spark, d, "lineitem").select(F.concat(lit("s"), c("l_suppkey").cast("string")).alias("src"), lit("SUPPLIES").alias("type"), F.concat(lit("p"), c("l_partkey").cast("string")).alias("dst")).distinct()


def supplier_pairs(spark, d):
    s = table(spark, d, "supplier").filter("s_suppkey <= 8")
    a, b = s.filter("s_suppkey <= 3").select(c("s_suppkey").alias("x")), s.select(c("s_suppkey").alias("y"))
    name = lambda k: F.concat(lit("s"), c(k).cast("string"))
    return a.join(b, c("x") < c("y")).select(name("x").alias("a"), name("y").alias("b"))


@query(SUP + """select a, b, 2 as hops, a || '>' || x.dst || '>' || b as nodes, 'SUPPLIES,SUPPLIES' as relations from p join e x on x.src = a join e y on y.src = b and y.dst = x.dst""")
def all_shortest_paths(spark, d):
    p = store.shortest_paths(supplies(spark, d), supplier_pairs(spark, d), 2)
    return p.select("a", "b", "hops", F.array_join("nodes", ">").alias("nodes"), F.array_join("relations", ",").alias("relations"))


@query(SUP + """, f as (select a, b, min(x.dst) as mid from p join e x on x.src = a join e y on y.src = b and y.dst = x.dst group by a, b) select a, b, 0 as step, a as "from", 'SUPPLIES' as relation, mid as "to" from f union all select a, b, 1, mid, 'SUPPLIES', b from f""")
def path_edges(spark, d):
    return store.path_rows(store.shortest_paths(supplies(spark, d), supplier_pairs(spark, d), 2))


@query(SUP + """select src as seed, dst as neighbour, type as relation, 'out' as direction from e where src in ('s1', 's2') union all select dst, src, type, 'in' from e where dst in ('p1', 'p5')""")
def neighbour_rows(spark, d):
    return store.neighbour_rows(supplies(spark, d), spark.sql("select explode(array('s1', 's2', 'p1', 'p5')) as id"))


@query(SUP + """select src, type, dst from e where src in ('s1', 's2') or dst in ('p1', 'p5')""")
def edges_touching(spark, d):
    return store.edges_touching(supplies(spark, d), spark.sql("select explode(array('s1', 's2', 'p1', 'p5')) as id"))


@query("""with e as (select distinct 'n' || l_suppkey as src, 'n' || l_partkey as dst from lineitem) select src as id from e where src = dst""")
def self_loops(spark, d):
    n = lambda k: F.concat(lit("n"), c(k).cast("string"))
    return graph.self_loops(table(spark, d, "lineitem").select(n("l_suppkey").alias("src"), n("l_partkey").alias("dst")).distinct()).select(c("src").alias("id"))


@query("""with o as (select o_orderkey as k, lead(o_orderkey) over (order by o_orderkey) as n from orders), s as (select k, case when lag(k % 7) over (order by k) = 0 or lag(k) over (order by k) is null then 1 else 0 end as new from o),
g as (select k, sum(new) over (order by k) as g from s) select k as id, min(k) over (partition by g) as component from g""")
def components_of_runs(spark, d):
    """Orders linked to the next one, but for every seventh key: as many components as runs."""
    o = table(spark, d, "orders").select(c("o_orderkey").alias("id"))
    edges = graph.following(o, "id").select(c("id").alias("src"), c("next").alias("dst")).filter("dst is not null and src % 7 <> 0")
    return graph.components(o, edges.withColumn("type", lit("NEXT")).withColumn("edge_id", c("src")))


@query("""select p_partkey as id, min(p_partkey) over (partition by p_partkey // 10) as component from part""")
def alias_components_of_decades(spark, d):
    """Parts chained by keys that each two neighbours share, within runs of ten ids."""
    k = c("p_partkey")
    key = lambda name, x, keep: table(spark, d, "part").filter(keep).select(k.alias("id"), F.concat(lit(name), x.cast("string")).alias("key"))
    keys = key("x", F.floor(k / 2), lit(True)).unionByName(key("y", F.floor((k + 1) / 2), (k % 10 != 9) & (k % 10 != 0)))
    return knowledge.alias_components(keys)


@query("""with p as (select a.s_suppkey as h, b.s_suppkey as t, 'x' || a.s_suppkey || '-' || b.s_suppkey as prov from supplier a join supplier b on a.s_nationkey % 5 = b.s_nationkey % 5 where a.s_suppkey <= 60 and b.s_suppkey <= 60)
select 's' || lpad(least(h, t)::varchar, 6, '0') as head, 's' || lpad(greatest(h, t)::varchar, 6, '0') as tail, 'PEER_OF' as type, count(*) as support from p where h <> t group by 1, 2 union all select 'rejected', reason, 'n', n from (select 'SELF_LOOP' as reason, count(*) as n from p where h = t)""")
def symmetric_relations(spark, d):
    """Peers given both ways are one edge with both provenances; an edge to itself is rejected."""
    s = table(spark, d, "supplier").filter("s_suppkey <= 60").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 5).alias("g"))
    name = lambda x: F.concat(lit("s"), F.lpad(x.cast("string"), 6, "0"))
    j = s.alias("a").join(s.alias("b"), F.col("a.g") == F.col("b.g"))
    rel = j.select(name(F.col("a.k")).alias("head"), lit("peer").alias("type"), name(F.col("b.k")).alias("tail"), F.concat(lit("x"), F.col("a.k").cast("string"), lit("-"), F.col("b.k").cast("string")).alias("prov"))
    ok, bad = knowledge.normalize_relations(rel, spark.createDataFrame([("peer", "PEER_OF", "symmetric", None)], "synonym string, canonical string, symmetry string, inverse string"))
    out = ok.select("head", "tail", "type", F.col("support").cast("long").alias("support"))
    return out.unionByName(bad.groupBy("reason").agg(F.count(lit(1)).alias("support")).select(lit("rejected").alias("head"), F.col("reason").alias("tail"), lit("n").alias("type"), "support"))


@query("""with e as (select user_id, ts, event_id from events) select user_id % 10 as community, count(distinct user_id) as size, min(user_id) as first, max(user_id) as last from e group by 1""")
def community_members(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return graph.group_members(u.withColumn("community", F.col("id") % 10))


# -- evaluation --------------------------------------------------------------------

CASES = """with k as (select o_orderkey as "case", count(*) as walked, count(distinct l_suppkey) as sup, o_orderkey % 4 as req, list(distinct l_suppkey) as s, list(distinct l_linestatus) as st from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey),
m as (select "case", case when req <= 0 then 1.0 else least(1.0::double, walked / req::double) end as hit, len(list_filter(s, lambda x: x % 2 = 0)) / len(s)::double as ground, len(list_intersect(['o', 'f'], list_transform(st, lambda x: lower(x)))) / 2.0::double as ent from k) """


def cases(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), c("o_orderkey") == c("l_orderkey"))
    k = j.groupBy(c("o_orderkey").alias("case")).agg(F.collect_list("l_linenumber").alias("edges"), F.collect_set("l_suppkey").alias("reference"), F.collect_set(F.concat(lit(" "), F.lower("l_linestatus"))).alias("entities"))
    return ev.score_cases(k.withColumn("required_hops", c("case") % 4).withColumn("connected", F.filter("reference", lambda x: x % 2 == 0)).withColumn("gold_entities", F.array(lit("O"), lit("F "))))


@query(CASES + 'select "case", round(hit, 6) as hit, round(ground, 6) as ground, round(ent, 6) as ent from m')
def graph_case_scores(spark, d):
    return cases(spark, d).select("case", F.round("multihop_path_hit", 6).alias("hit"), F.round("graph_grounding_coverage", 6).alias("ground"), F.round("entity_coverage", 6).alias("ent"))


@query(CASES + "select round(avg(hit), 6) as multihop_path_hit, round(avg(ground), 6) as graph_grounding_coverage, round(avg(ent), 6) as entity_coverage from m")
def graph_macro_scores(spark, d):
    return ev.macro(cases(spark, d), ["multihop_path_hit", "graph_grounding_coverage", "entity_coverage"])


@query("""select c_custkey, case when c_custkey % 2 = 0 and c_custkey % 3 = 0 then 'tp' when c_custkey % 2 = 0 then 'fp' when c_custkey % 5 = 0 then 'false_reject' else 'fn' end as outcome from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0""")
def extraction_outcomes(spark, d):
    k = table(spark, d, "customer").select("c_custkey")
    return ev.confusion(k.filter("c_custkey % 2 = 0"), k.filter("c_custkey % 3 = 0"), k.filter("c_custkey % 5 = 0"), ["c_custkey"])


@query("""select round(avg((o_orderstatus = 'F')::int), 6) as success_rate from orders""")
def task_success(spark, d):
    return ev.success_rate(table(spark, d, "orders").select((c("o_orderstatus") == "F").alias("ok")), "ok")


@query("""with f as (select o_custkey as qid, o_orderkey as id, round(o_totalprice / 1000, 2) as score, o_orderpriority || ' ' || o_orderstatus as text from orders), r as (select *, row_number() over (partition by qid order by score desc, id) as rank from f)
select qid, string_agg('[' || id || '] ' || substr(text, 1, 6), chr(10) order by rank) as context from r where rank <= 3 group by qid""")
def reranked_contexts(spark, d):
    o = table(spark, d, "orders")
    fused = o.select(c("o_custkey").alias("qid"), c("o_orderkey").alias("id"), F.round(c("o_totalprice") / 1000, 2).alias("score"))
    texts = o.select(c("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    return ev.render_context(ev.with_texts(ev.rerank_identity(fused, 3), texts), 6)


@query("""with q as (select item_id as qid, unnest(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) as w from benchmark where item_id % 20 = 0), p as (select p_partkey as id, p_name || ' ' || p_type as text from part),
s as (select qid, id, count(*) as score from q join p on contains(text, w) group by all) select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from s qualify rank <= 3""")
def word_hit_search(spark, d):
    q = table(spark, d, "benchmark").filter("item_id % 20 = 0").select(c("item_id").alias("qid"), "text")
    return ev.substring_search(q, table(spark, d, "part").select(c("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), 3)


@query("""select conv_id as trace, count(*) as spans, round(sum(case when role = 'user' then length(text) / 1e6 * 3.0 + 10 / 1e6 * 15.0 else 0 end), 6) as cost, sum(turn) as latency from conversations group by 1""")
def trace_costs(spark, d):
    t = table(spark, d, "conversations")
    price = ev.cost(F.when(c("role") == "user", "small").otherwise("none"), F.length("text"), lit(10), {"small": (3.0, 15.0)})
    return ev.trace_totals(t.select(c("conv_id").alias("trace"), price.alias("cost"), c("turn").alias("latency")))


@query("""select o_orderpriority as metric, case when avg(o_totalprice) <= 150000 then 'PASS ' else 'FAIL ' end || o_orderpriority || ' ' || printf('%.4f', 150000.0::double) || ' -> ' || printf('%.4f', round(avg(o_totalprice), 2)::double) as line from orders group by 1""")
def gate_report(spark, d):
    m = table(spark, d, "orders").groupBy(c("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("v"))
    return m.select("metric", ev.report_line(c("metric"), lit(150000.0), F.round("v", 2), c("v") <= 150000).alias("line"))


# -- the harness -------------------------------------------------------------------
# Questions are conversation turns with a signal by turn.

SIGNALS = ["", "요약", "관계", "스키마", "사이", "공통", "트렌드 delete", "secret"]
QUESTIONS = "with q as (select conv_id, turn, ['" + "', '".join(SIGNALS) + "'][(conv_id + turn) % 8 + 1] as h, (conv_id + turn) % 8 as k, case when conv_id % 3 = 0 then 'Alpha and beta ' when conv_id % 3 = 1 then 'beta ' else '' end || h || ' x' as question from conversations) "


def questions(spark, d):
    k = (c("conv_id") + c("turn")) % 8
    hint = F.get(F.array(*[lit(s) for s in SIGNALS]), k.cast("int"))
    names = F.when(c("conv_id") % 3 == 0, "Alpha and beta ").when(c("conv_id") % 3 == 1, "beta ").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(names, hint, lit(" x")).alias("question"))


@query(QUESTIONS + """, r as (select *, case when k = 3 then 'schema' when k = 1 then 'broad' when k in (2, 4) or conv_id % 3 = 0 then 'relation' else 'simple' end as route from q)
select conv_id, turn, route, case when conv_id % 3 = 0 then 'Alpha,Beta' when conv_id % 3 = 1 then 'Beta' else '' end as entities, case route when 'schema' then 'ontology_check' when 'simple' then 'docs_search' else 'graph_query' end as tool,
 case when route = 'relation' then case when conv_id % 3 = 0 then 'path_between' else 'neighbors' end end as template, case when route = 'relation' then case when conv_id % 3 = 0 then 'Alpha' when conv_id % 3 = 1 then 'Beta' else 'Root' end end as source,
 case when route = 'relation' and conv_id % 3 = 0 then 'Beta' end as target, case when k in (1, 5, 6) then 'global-summary' when k in (2, 4) then 'multi-hop' else 'simple-fact' end as kind, case when k in (1, 5, 6) then 'global' when k in (2, 4) then 'local' else 'naive' end as mode from r""")
def routed_tools(spark, d):
    rows = questions(spark, d).withColumn("e", hs.known_entities(c("question"), ["Beta", "Alpha", "Gamma"])).withColumn("route", hs.route(c("question"), c("e")))
    rows = rows.withColumn("t", hs.tool_input(c("route"), c("question"), c("e"), "Root")).withColumn("kind", hs.guess_type(c("question")))
    return rows.select("conv_id", "turn", "route", F.array_join("e", ",").alias("entities"), "t.tool", "t.template", "t.source", "t.target", "kind", hs.mode_of(c("kind")).alias("mode"))


@query(QUESTIONS + """, a as (select conv_id, turn, concat_ws('+', case when turn % 2 = 1 then 'low score' end, case when k = 6 then 'write-like' end, case when k = 7 then 'sensitive' end) as reasons from q) select conv_id, turn, reasons, case when reasons = '' then 'not-needed' else 'auto-approve' end as verdict from a""")
def checkpoints(spark, d):
    rows = questions(spark, d).withColumn("r", hs.assess(c("question"), lit("an answer"), F.when(c("turn") % 2 == 1, 0.4).otherwise(0.9)))
    return rows.select("conv_id", "turn", F.array_join("r", "+").alias("reasons"), hs.approval(c("r")).alias("verdict"))


@query("""select o_orderkey, case when o_orderkey % 5 in (0, 1, 2, 3) then 'fallback' else 'primary' end as used, case when o_orderkey % 5 = 4 then 'p ' || o_orderstatus || ' a b' else 'backup' end as text from orders""")
def fallback_results(spark, d):
    k = c("o_orderkey") % 5
    row = F.to_json(F.struct(F.array(F.struct(F.concat(lit("p "), c("o_orderstatus")).alias("text"), lit("a").alias("from"), lit("b").alias("to"))).alias("rows")))
    primary = F.when(k == 0, lit(None).cast("string")).when(k == 1, '{"error": "x"}').when(k == 2, '{"rows": []}').when(k == 3, '{"blocked": true, "rows": [{"text": "z"}]}').otherwise(row)
    got = table(spark, d, "orders").withColumn("f", hs.with_fallback(primary, lit('[{"text": "backup"}]')))
    return got.select("o_orderkey", "f.used", hs.row_text(F.get(hs.rows_of(c("f.result")), lit(0))).alias("text"))


@query("""with e as (select o_custkey as question, o_orderkey, o_orderstatus from orders where o_orderkey % 2 = 0), k as (select o_custkey as question, o_orderkey, o_orderpriority from orders where o_orderkey % 2 = 1),
i as (select question, 'c' || question || ' -[' || o_orderstatus || ']-> o' as id, 'graph' as kind, 's' || min(o_orderkey) as source from e group by 1, o_orderstatus, 2 union all select question, 's' || o_orderkey, 'graph', 's' || o_orderkey from e
 union all select question, o_orderpriority, 'chunk', 'd' || min(o_orderkey) from k group by 1, 2) select * from i""")
def evidence_citations(spark, d):
    path = F.to_json(F.struct(F.concat(lit("c"), c("o_custkey").cast("string")).alias("from"), c("o_orderstatus").alias("relation"), lit("o").alias("to"), F.concat(lit("s"), c("o_orderkey").cast("string")).alias("source")))
    chunk = F.to_json(F.struct(c("o_orderpriority").alias("chunk_id"), F.concat(lit("d"), c("o_orderkey").cast("string")).alias("source_id"), lit("t").alias("text")))
    row = F.when(c("o_orderkey") % 2 == 0, path).otherwise(chunk)
    results = table(spark, d, "orders").select(c("o_custkey").alias("question"), c("o_orderkey").alias("seq"), F.concat(lit("["), row, lit("]")).alias("result"))
    return hs.evidence_index(results)


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'unknown_label:Ghost' else '' end || case when c_custkey % 2 = 0 then case when c_custkey % 3 = 0 then '+' else '' end || 'unknown_relation:HAUNTS' else '' end as unknown, case when c_custkey % 5 = 0 then 2 else 1 end::bigint as statements,
 case when c_custkey % 5 = 0 then 'apoc.create' end as procedure, 'MATCH (n {name: ''' || c_name || '''})-[r]-(m) RETURN m.name, type(r) LIMIT 25' as generated, '{"a": 1}' as json, 'x' || c_custkey as kept, 'nil' as lost from customer""")
def query_text_checks(spark, d):
    k = c("c_custkey")
    label = F.when(k % 3 == 0, "Ghost").otherwise("person")
    rel = F.when(k % 2 == 0, "HAUNTS").otherwise("KNOWS")
    text = F.concat(lit("MATCH (a:"), label, lit(")-[r:"), rel, lit("]->(:City) RETURN a"), F.when(k % 5 == 0, "; CALL apoc.create.node()").otherwise(";"))
    own = F.concat(lit("x"), k.cast("string"))
    cited = hs.split_citations(F.array(own, lit("nil"), own), F.array(own))
    return table(spark, d, "customer").select(
        "c_custkey", F.array_join(F.transform(hs.unknown_terms(text, ["Person", "City"], ["KNOWS"]), lambda x: F.concat_ws(":", x["kind"], x["item"])), "+").alias("unknown"),
        hs.statements(text).alias("statements"), hs.dangerous_procedure(text).alias("procedure"), hs.mock_query(F.concat(lit("who knows '"), c("c_name"), lit("'?"))).alias("generated"),
        hs.first_json(lit('so: {"a": 1} ok')).alias("json"), F.array_join(cited["kept"], ",").alias("kept"), F.array_join(cited["unknown"], ",").alias("lost"),
    )
