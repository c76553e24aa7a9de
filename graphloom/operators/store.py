"""Node and edge upserts, ingestion in order, inverted indexes, JSON sinks, shortest paths with their nodes and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_nodes(state: DataFrame, batch: DataFrame, name: str) -> DataFrame:
    """state (name, labels, first_seen, last_seen) after a batch (name, label): new nodes are made, known ones get new labels at the end and the batch as last_seen."""
    new = batch.groupBy("name").agg(F.array_sort(F.collect_set("label")).alias("__gl_new"))
    both = state.join(new, "name", "full")
    none = F.array().cast("array<string>")
    labels = F.array_distinct(F.concat(F.coalesce("labels", none), F.coalesce("__gl_new", none)))
    return both.select("name", labels.alias("labels"), F.coalesce("first_seen", F.lit(name)).alias("first_seen"), F.when(F.col("__gl_new").isNotNull(), F.lit(name)).otherwise(F.col("last_seen")).alias("last_seen"))


def upsert(state: DataFrame, rows: DataFrame, key: str, on_create: dict[str, Column]) -> DataFrame:
    """MERGE by ``key``: columns of ``rows`` overwrite where they aren't null, those of ``on_create`` are set for new keys only.

    ``rows`` has one row per key; keys that only ``state`` has stay as they are.
    """
    given = rows.select(key, F.struct(*[c for c in rows.columns if c != key]).alias("__gl_r"))
    kept = state.select(key, F.struct(*[c for c in state.columns if c != key]).alias("__gl_s"))
    both = kept.join(given, key, "full")
    cols = []
    for c in state.columns:
        if c == key:
            cols.append(F.col(key))
        elif c in rows.columns:
            cols.append(F.coalesce(F.col(f"__gl_r.{c}"), F.col(f"__gl_s.{c}")).alias(c))
        elif c in on_create:
            cols.append(F.when(F.col("__gl_s").isNull(), on_create[c]).otherwise(F.col(f"__gl_s.{c}")).alias(c))
        else:
            cols.append(F.col(f"__gl_s.{c}").alias(c))
    return both.select(*cols)


def attach(nodes: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets properties of nodes by key; nodes without a value keep theirs, values without a node are left out."""
    given = values.select(key, *[F.col(c).alias(f"__gl_{c}") for c in columns])
    joined = nodes.join(given, key, "left")
    return joined.select(*[F.coalesce(f"__gl_{c}", c).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def link_existing(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (src, type, dst) of rows whose ends are both nodes (id): no end is made."""
    ids = nodes.select("id").distinct()
    return rows.select("src", "type", "dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def internal_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(group, src, type, dst): edges with both ends in one group; members has id and group."""
    a = members.select(F.col("id").alias("src"), "group")
    b = members.select(F.col("id").alias("dst"), "group")
    return edges.select("src", "type", "dst").distinct().join(a, "src").join(b, ["dst", "group"]).select("group", "src", "type", "dst")


def bulk_rows(relations: DataFrame) -> DataFrame:
    """(src, type, dst, source_ids, n): relations (src, type, dst, source_id) gathered by edge, distinct sources in order."""
    return relations.groupBy("src", "type", "dst").agg(F.sort_array(F.collect_set("source_id")).alias("source_ids"), F.count(F.lit(1)).alias("n"))


def descriptions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, description): ``name. type target; type target`` of each node with edges (src, type, dst), in order of type and target, and how many."""
    said = edges.groupBy("src").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "type", F.col("dst").cast("string")))).alias("said"))
    return nodes.join(said, nodes["id"] == said["src"], "left").select("id", F.concat(F.col("name"), F.lit("."), F.when(F.size("said") > 0, F.concat(F.lit(" "), F.array_join("said", "; "))).otherwise(F.lit(""))).alias("description"))


def inverted(rows: DataFrame, key: str, members: str) -> DataFrame:
    """(key, members): distinct members by key, in order; the index of tags or of sources."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(members)).alias(members))


def neighbour_rows(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, neighbour, relation, direction): each edge at a seed, once; seeds has id."""
    s = seeds.select(F.col("id").alias("seed")).distinct()
    out = edges.join(s, edges["src"] == s["seed"]).select("seed", F.col("dst").alias("neighbour"), F.col("type").alias("relation"), F.lit("out").alias("direction"))
    back = edges.join(s, edges["dst"] == s["seed"]).select("seed", F.col("src").alias("neighbour"), F.col("type").alias("relation"), F.lit("in").alias("direction"))
    return out.unionByName(back).distinct()


def edges_touching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges with an end among seeds (id)."""
    s = seeds.select(F.col("id")).distinct()
    a = edges.join(s, edges["src"] == s["id"], "left_semi")
    return a.unionByName(edges.join(s, edges["dst"] == s["id"], "left_semi")).distinct()


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int) -> DataFrame:
    """(a, b, hops, nodes, relations): every shortest undirected path of up to ``max_hops`` edges of each pair (a, b); a pair of one node gives none.

    Paths grow from ``a`` one edge at a time without repeating a node; what
    has reached its ``b`` stops, and so do the other paths of that pair.
    """
    both = edges.select("src", "type", "dst").unionByName(edges.select(F.col("dst").alias("src"), "type", F.col("src").alias("dst"))).distinct()
    paths = pairs.select("a", "b").distinct().filter("a <> b").select("a", "b", F.array("a").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    done = None
    for hop in range(1, max_hops + 1):
        step = paths.withColumn("src", F.element_at("nodes", -1)).join(both, "src").filter(~F.array_contains("nodes", F.col("dst")))
        step = step.select("a", "b", F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("relations", F.array("type")).alias("relations"))
        there = step.filter(F.element_at("nodes", -1) == F.col("b")).withColumn("hops", F.lit(hop))
        done = there if done is None else done.unionByName(there)
        paths = step.join(there.select("a", "b").distinct(), ["a", "b"], "left_anti")
    return done.select("a", "b", "hops", "nodes", "relations")


def path_rows(paths: DataFrame) -> DataFrame:
    """(a, b, step, from, relation, to): one row per edge of the first path (by nodes and relations) of each pair."""
    first = paths.groupBy("a", "b").agg(F.min(F.struct("nodes", "relations")).alias("p"))
    steps = F.posexplode(F.arrays_zip(F.slice("p.nodes", F.lit(1), F.size("p.relations")).alias("f"), F.col("p.relations").alias("r"), F.slice("p.nodes", F.lit(2), F.size("p.relations")).alias("t")))
    return first.select("a", "b", steps.alias("step", "e")).select("a", "b", "step", F.col("e.f").alias("from"), F.col("e.r").alias("relation"), F.col("e.t").alias("to"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per row."""
    rows.write.mode("overwrite").json(path)
