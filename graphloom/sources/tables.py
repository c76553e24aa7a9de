"""Scans and sinks: driver tables, the graph view over them, text files, JSONL with quarantine, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import content_hash, extract_title, source_id_from_stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the relational tables: regions, nations, customers and suppliers, with IN_REGION, IN_NATION and SELLS_TO."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, label, key, name: df.select(F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"))
    nodes = node(t("region"), "region", "r_regionkey", "r_name").unionByName(node(t("nation"), "nation", "n_nationkey", "n_name")).unionByName(node(t("customer"), "customer", "c_custkey", "c_name")).unionByName(node(t("supplier"), "supplier", "s_suppkey", "s_name"))
    ref = lambda label, key: F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))
    edge = lambda df, src, kind, dst: df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
    edges = edge(t("nation"), ref("nation", "n_nationkey"), "IN_REGION", ref("region", "n_regionkey"))
    edges = edges.unionByName(edge(t("customer"), ref("customer", "c_custkey"), "IN_NATION", ref("nation", "c_nationkey"))).unionByName(edge(t("supplier"), ref("supplier", "s_suppkey"), "IN_NATION", ref("nation", "s_nationkey")))
    sales = t("lineitem").filter("l_quantity >= 50").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = edges.unionByName(edge(sales, ref("supplier", "l_suppkey"), "SELLS_TO", ref("customer", "o_custkey")).distinct())
    return nodes, edges.withColumn("edge_id", F.xxhash64("src", "type", "dst"))


def full_graph_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all relations: those of ``graph_view`` without SELLS_TO, and parts, with ORDERED and SUPPLIES of every pair in lineitem and orders."""
    nodes, edges = graph_view(spark, sf_dir)
    ref = lambda label, key: F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))
    nodes = nodes.unionByName(table(spark, sf_dir, "part").select(ref("part", "p_partkey").alias("id"), F.lit("part").alias("label"), F.col("p_name").alias("name")))
    sales = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    # made distinct as keys, before the ids' texts are made of them
    pairs = lambda label, key, kind: sales.select(key, "l_partkey").distinct().select(ref(label, key).alias("src"), F.lit(kind).alias("type"), ref("part", "l_partkey").alias("dst"))
    edges = edges.filter("type <> 'SELLS_TO'").select("src", "type", "dst").unionByName(pairs("customer", "o_custkey", "ORDERED")).unionByName(pairs("supplier", "l_suppkey", "SUPPLIES"))
    return nodes, edges.withColumn("edge_id", F.xxhash64("src", "type", "dst"))


def supply_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provenance view: relation rows (head, type, tail, prov) of lineitem, the type a surface predicate of its two flags."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("head"), F.concat("l_returnflag", "l_linestatus").alias("type"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("tail"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("prov"),
    )


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Source records of all matching files below ``path``, readme files left out: source_id, title, path, sha256, bytes, text, hash."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    text = F.decode("content", "UTF-8")
    return raw.filter(F.lower(name) != "readme.md").select(source_id_from_stem(F.lower(stem)).alias("source_id"), extract_title(text, stem).alias("title"), "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), text.alias("text"), content_hash(text).alias("hash"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Typed JSON lines. Strict: a malformed line fails the scan; else (rows, quarantined lines)."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt_record string")
    if strict:
        return reader.option("mode", "FAILFAST").json(path), None
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).cache()
    return rows.filter("_corrupt_record is null").drop("_corrupt_record"), rows.filter("_corrupt_record is not null").select("_corrupt_record")


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One tagged table of both kinds, partitioned by kind."""
    nodes.withColumn("kind", F.lit("node")).unionByName(edges.withColumn("kind", F.lit("edge")), allowMissingColumns=True).write.mode("overwrite").partitionBy("kind").json(path)


def read_snapshot(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(node_schema).json(f"{path}/kind=node"), spark.read.schema(edge_schema).json(f"{path}/kind=edge")


def load_sources(spark: SparkSession, forced: str | None, wiki: str, sources: str) -> DataFrame:
    """Forced path, else the wiki folder if it has files, else the sources folder."""
    if forced:
        return read_markdown(spark, forced)
    try:
        if not (found := read_markdown(spark, wiki)).isEmpty():
            return found
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return read_markdown(spark, sources)
