"""Knowledge-graph construction: contracts, gates, normalisation, resolution, the versioned store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose violation holds, else null."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules whose violation holds, in order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def split_by_reason(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``)."""
    judged = rows.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Distinct values of ``column`` without a row in ``known``."""
    return rows.select(F.col(column).alias("value")).filter("value is not null").distinct().join(known.select(F.col(key).alias("value")).distinct(), "value", "left_anti")


def normalize_relations(rel: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rel (head, type, tail, prov) by vocab (synonym, canonical, symmetry, inverse) to (normalised, rejected).

    Unknown predicates are rejected first; symmetric ends are sorted; inverse
    types are flipped to their canonical direction; self-loops are rejected;
    provenances of equal edges are gathered.
    """
    v = vocab.select(F.lower("synonym").alias("syn"), "canonical", "symmetry", "inverse")
    j = rel.join(v, F.lower(F.col("type")) == F.col("syn"), "left")
    sym, flip = F.col("symmetry") == "symmetric", (F.col("symmetry") == "inverse") & F.col("inverse").isNotNull()
    h = F.when(sym, F.least("head", "tail")).when(flip, F.col("tail")).otherwise(F.col("head"))
    t = F.when(sym, F.greatest("head", "tail")).when(flip, F.col("head")).otherwise(F.col("tail"))
    canon = j.select(h.alias("head"), F.when(flip, F.col("inverse")).otherwise(F.col("canonical")).alias("type"), t.alias("tail"), F.when(sym, F.lit("undirected")).otherwise(F.lit("directed")).alias("direction"), "prov", F.col("canonical").isNull().alias("unknown"))
    ok, bad = split_by_reason(canon, first_reason([("UNKNOWN_PREDICATE", F.col("unknown")), ("SELF_LOOP", F.col("head") == F.col("tail"))]))
    grouped = ok.groupBy("head", "type", "tail", "direction").agg(F.sort_array(F.collect_list("prov")).alias("provenances"))
    return grouped.withColumn("support", F.size("provenances")), bad.drop("unknown")


def quality_gate(edges: DataFrame, known_types: list[str], entities: DataFrame, conflicts: list[tuple[str, str]], min_support: int = 1) -> DataFrame:
    """edges (head, type, tail, support) with ``reason``: the first of unknown type, head or tail unknown, support too low, conflict, in this order.

    Conflicting types between the same ends are looked for among all inputs,
    those rejected for another reason included.
    """
    types = edges.groupBy("head", "tail").agg(F.collect_set("type").alias("types"))
    e = entities.select("id")
    j = edges.join(types, ["head", "tail"]).join(e.select(F.col("id").alias("head"), F.lit(1).alias("h")), "head", "left").join(e.select(F.col("id").alias("tail"), F.lit(1).alias("t")), "tail", "left")
    pairs = conflicts + [(b, a) for a, b in conflicts]
    clash = reduce(lambda x, y: x | y, [(F.col("type") == a) & F.array_contains("types", b) for a, b in pairs], F.lit(False))
    reason = first_reason([("UNKNOWN_TYPE", ~F.col("type").isin(*known_types)), ("UNKNOWN_HEAD", F.col("h").isNull()), ("UNKNOWN_TAIL", F.col("t").isNull()), ("LOW_SUPPORT", F.col("support") < min_support), ("CONFLICT", clash)])
    return j.select("head", "type", "tail", "support", reason.alias("reason"))


EDGE_KEY = ["head", "type", "tail"]


def merge_batch(store: DataFrame, batch: DataFrame, label: str) -> DataFrame:
    """Upserts ``batch`` (head, type, tail, provs) into ``store`` (…, provs, first_seen, last_seen, ingested_in, tombstone).

    New edges keep their provenances as given; known ones add those not there
    yet; a tombstoned edge that gains provenance lives again. ``status`` is
    created, accumulated, revived or untouched.
    """
    s, b = store.drop("status"), batch.select(*EDGE_KEY, F.col("provs").alias("new"))
    j = s.join(b, EDGE_KEY, "full_outer")
    old, new = F.col("provs"), F.col("new")
    fresh = F.array_except(new, F.coalesce(old, F.array().cast(dict(batch.dtypes)["provs"])))
    created, hit = old.isNull(), new.isNotNull()
    status = F.when(created, "created").when(hit & F.col("tombstone"), "revived").when(hit, "accumulated").otherwise("untouched")
    return j.select(
        *EDGE_KEY,
        F.when(created, new).when(hit, F.concat(old, fresh)).otherwise(old).alias("provs"),
        F.coalesce("first_seen", F.lit(label)).alias("first_seen"),
        F.when(hit, F.lit(label)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(created, F.array(F.lit(label))).when(hit, F.array_union("ingested_in", F.array(F.lit(label)))).otherwise(F.col("ingested_in")).alias("ingested_in"),
        (F.coalesce("tombstone", F.lit(False)) & ~hit).alias("tombstone"),
        status.alias("status"),
    )


def empty_store(batch: DataFrame) -> DataFrame:
    kind = dict(batch.dtypes)["provs"]
    return batch.limit(0).select(*EDGE_KEY, F.col("provs").cast(kind), F.lit("").alias("first_seen"), F.lit("").alias("last_seen"), F.array(F.lit("")).alias("ingested_in"), F.lit(False).alias("tombstone"))


def retract(store: DataFrame, gone: Column) -> DataFrame:
    """Removes provenances for which ``gone`` (over the lambda variable named by F.col on an element) holds; an edge that loses its last one is tombstoned."""
    left = F.filter("provs", lambda p: ~gone(p))
    return store.withColumn("kept", left).withColumn("tombstone", F.col("tombstone") | ((F.size("provs") > 0) & (F.size("kept") == 0))).withColumn("provs", F.col("kept")).drop("kept")


def store_stats(store: DataFrame) -> DataFrame:
    live = ~F.col("tombstone")
    return store.agg(F.sum(live.cast("int")).alias("live"), F.sum(F.col("tombstone").cast("int")).alias("tombstoned"), F.sum(F.when(live, F.size("provs")).otherwise(0)).alias("support"))


def alias_components(keys: DataFrame) -> DataFrame:
    """Entity resolution by shared keys: (id, key) to (id, component), through the graph package's components.

    Entities that share a key are linked to the key's smallest id, so a key
    held by very many entities makes as many links, not pairs.
    """
    from graphloom.operators.graph import components

    hub = keys.groupBy("key").agg(F.min("id").alias("dst"))
    edges = keys.join(hub, "key").filter("id <> dst").select(F.col("id").alias("src"), F.lit("ALIAS").alias("type"), "dst", F.xxhash64("id", "dst").alias("edge_id")).distinct()
    return components(keys.select("id").distinct(), edges)


def canonical_name(members: DataFrame) -> DataFrame:
    """(component, name, pos) to the most frequent, then longest, then first seen name of each component."""
    n = members.groupBy("component", "name").agg(F.count(F.lit(1)).alias("freq"), F.min("pos").alias("first"))
    w = Window.partitionBy("component").orderBy(F.desc("freq"), F.desc(F.length("name")), "first")
    return n.withColumn("n", F.row_number().over(w)).filter("n = 1").select("component", F.col("name").alias("canonical"))


def rewire(rel: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relation ends looked up in (surface, canonical), falling back to themselves."""
    h, t = mapping.select(F.col("surface").alias("head"), F.col("canonical").alias("ch")), mapping.select(F.col("surface").alias("tail"), F.col("canonical").alias("ct"))
    j = rel.join(h, "head", "left").join(t, "tail", "left")
    return j.select(F.coalesce("ch", "head").alias("head"), "type", F.coalesce("ct", "tail").alias("tail"), *[c for c in rel.columns if c not in EDGE_KEY])


def vocabulary_index(labels: DataFrame) -> DataFrame:
    """(norm, concept) from (norm, concept, preferred, pos): preferred labels win over alternatives, the later of equals wins."""
    w = Window.partitionBy("norm").orderBy(F.desc("preferred"), F.desc("pos"))
    return labels.withColumn("n", F.row_number().over(w)).filter("n = 1").select("norm", "concept")


def best_mapping(crosswalk: DataFrame) -> DataFrame:
    """One external id per concept and knowledge base: exact before close before others, then confidence, then id."""
    rank = F.when(F.col("match") == "exact", 0).when(F.col("match") == "close", 1).otherwise(2)
    w = Window.partitionBy("concept", "kb").orderBy(rank, F.desc("confidence"), "external_id")
    return crosswalk.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def check_triples(triples: DataFrame, nodes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Violations (subject, rel, object, rule): dangling ends stop, unknown relations stop, then domain and range."""
    n = nodes.select("id", "label")
    j = triples.join(n.select(F.col("id").alias("subject"), F.col("label").alias("sl")), "subject", "left").join(n.select(F.col("id").alias("object"), F.col("label").alias("ol")), "object", "left").join(shapes, "rel", "left")
    missing, unknown = F.col("sl").isNull() | F.col("ol").isNull(), F.col("domain").isNull()
    rules = F.when(missing, F.array(F.lit("DANGLING"))).when(unknown, F.array(F.lit("UNKNOWN_RELATION"))).otherwise(all_reasons([("DOMAIN_MISMATCH", F.col("sl") != F.col("domain")), ("RANGE_MISMATCH", F.col("ol") != F.col("range"))]))
    return j.select("subject", "rel", "object", F.explode(rules).alias("rule"))


def check_cardinality(nodes: DataFrame, triples: DataFrame, label: str, rel: str, min_count: int) -> DataFrame:
    """Nodes of a class with fewer than ``min_count`` triples of a relation, those with none included."""
    n = triples.filter(F.col("rel") == rel).groupBy(F.col("subject").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.filter(F.col("label") == label).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < min_count)


def answer_time_gates(items: DataFrame, role: str, tenant: str, min_confidence: float) -> DataFrame:
    """The first gate that denies or masks an item, else allow: semantic (unknown concept), access (role, then tenant, which binds public items too), policy (provenance, deprecation, confidence, mask).

    items: id, concept_known, deprecated, visibility, roles, tenants, provenance, confidence, sensitive.
    """
    decision = F.coalesce(
        F.when(~F.col("concept_known"), F.lit("semantic:deny")),
        F.when((F.col("visibility") != "public") & ~F.array_contains("roles", role), F.lit("access:deny")),
        F.when((F.size("tenants") > 0) & ~F.array_contains("tenants", tenant), F.lit("access:deny")),
        F.when(F.coalesce(F.col("provenance"), F.lit("")) == "", F.lit("policy:deny")),
        F.when(F.col("deprecated"), F.lit("policy:deny")),
        F.when(F.coalesce("confidence", F.lit(1.0)) < min_confidence, F.lit("policy:deny")),
        F.when(F.col("sensitive"), F.lit("policy:mask")),
        F.lit("policy:allow"),
    )
    return items.select("id", F.substring_index(decision, ":", 1).alias("gate"), F.substring_index(decision, ":", -1).alias("decision"))


def mask_fields(fields: Column, sensitive: list[str], token: str = "***") -> Column:
    """Values of sensitive keys of a map replaced."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*sensitive), F.lit(token)).otherwise(v))


def verify_spans(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, quote) with ``reason``: the range's order, its end within the text, and the quote itself."""
    j = spans.join(docs.select("doc_id", "text"), "doc_id", "left")
    return j.select("doc_id", "start", "end", first_reason([
        ("UNKNOWN_SOURCE", F.col("text").isNull()), ("BAD_RANGE", F.col("start") >= F.col("end")), ("OUT_OF_TEXT", F.col("end") > F.length("text")),
        ("QUOTE_MISMATCH", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("quote")),
    ]).alias("reason"))
