"""Property-graph operators over (nodes, edges) DataFrames: patterns, paths, components, ranks, communities, dashboard.

nodes (id, label, name); edges (src, type, dst, edge_id). Undirected means each
edge both ways with one edge_id. Iterations write their tables to the shared
checkpoint folder.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.skew import HOT, join_hot


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage.

    The folder is that of ``spark.checkpoint.dir`` or of the context; where
    none is, one is set if driver and executors are one process, else this
    raises. The optimizer takes sizes from the files: those that a checkpoint
    carries on are products over all joins before it, whose digits double with
    each round of a loop.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/{spark.sparkContext.applicationId}/settled-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*settled: DataFrame) -> None:
    """Removes the files of settled tables that nothing reads any more."""
    for df in settled:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, path)


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions, ``dir`` ``->`` as stored or ``<-``; a self-loop once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), "type", F.col("src").alias("dst"), "edge_id", F.lit("<-").alias("dir"))
    return edges.select("src", "type", "dst", "edge_id", F.lit("->").alias("dir")).unionByName(back)


def two_hop(edges: DataFrame, first: str, second: str) -> DataFrame:
    """a -first-> b -second-> c: distinct (a, b, c), which are those of distinct edges."""
    a = edges.filter(F.col("type") == first).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    b = edges.filter(F.col("type") == second).select(F.col("src").alias("b"), F.col("dst").alias("c")).distinct()
    return a.join(b, "b").select("a", "b", "c")


def paths(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """Undirected paths of 1..max_hops edges from ``seeds`` (id): (start, end, hops, nodes, edge_ids). No edge repeats within a path; nodes may."""
    und = both_ways(edges).select("src", "dst", "edge_id")
    step = seeds.select(F.col("id").alias("start")).join(und, F.col("start") == F.col("src")).select("start", F.col("dst").alias("end"), F.array("start", "dst").alias("nodes"), F.array("edge_id").alias("edge_ids"))
    out = step
    for _ in range(max_hops - 1):
        step = step.join(und, F.col("end") == F.col("src")).filter(~F.array_contains("edge_ids", F.col("edge_id"))).select("start", F.col("dst").alias("end"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"))
        out = out.unionByName(step)
    return out.withColumn("hops", F.size("edge_ids"))


def distances(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(start, id, hops): shortest undirected distance from each seed, up to ``max_hops``; the seed itself is left out."""
    und = both_ways(edges).select("src", "dst").distinct()
    reached = seeds.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"))
    frontier = reached
    for hop in range(1, max_hops + 1):
        nxt = frontier.join(und, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        frontier = settle(nxt.join(reached, ["start", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached.filter("hops > 0")


def in_degree_top(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    deg = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.join(deg, "id").orderBy(F.desc("in_degree"), "id").limit(k).select("id", "label", "in_degree")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, degree) of all nodes; a self-loop counts twice."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))


def duplicate_names(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("name").agg(F.countDistinct("id").alias("n_ids")).filter("n_ids > 1")


def coded(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, v) and edges (a, b) with a long for each id: the id itself if it is an integer, else a hash under which no two nodes fall together.

    Ends that are no node keep their hash; that one meets a node's is left to
    chance, one in 2**64 for each pair of such an end and a node.
    """
    if nodes.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        code = lambda c: F.col(c).cast("long")
        return nodes.select("id", code("id").alias("v")), edges.select(code("src").alias("a"), code("dst").alias("b"))
    for seed in range(16):
        code = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(seed), c))  # noqa: B023, E731
        ids = settle(nodes.select("id", code("id").alias("v")))
        n = ids.select("id").distinct().groupBy(F.xxhash64(F.lit(seed), "id")).count().filter("count > 1")
        if n.isEmpty():
            return ids, edges.select(code("src").alias("a"), code("dst").alias("b"))
        forget(ids)
    raise RuntimeError("no hash tells the nodes apart")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, score) on the undirected projection, after a fixed number of iterations; scores start at (1 - d) and are not normalised; nodes without edges keep it.

    A node's links lie in rows of up to 4096, dealt out and sorted by node
    once; an iteration deals only the scores and what they give, which is
    summed before it is shuffled, so a node with very many links is no hot key.
    """
    ids, ends = coded(nodes, edges)
    und = ends.select(F.col("a").alias("v"), F.col("b").alias("to")).unionAll(ends.filter("a <> b").select("b", "a")).filter("v is not null and to is not null")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = Window.partitionBy("v")
    links = und.repartition(parts, "v").select("v", "to", F.floor((F.row_number().over(by.orderBy("to")) - 1) / 4096).alias("piece"))
    links = links.groupBy("v", "piece").agg(F.collect_list("to").alias("to")).withColumn("n", F.sum(F.size("to")).over(by)).drop("piece")
    links = _kept(links.sortWithinPartitions("v"))
    base = ids.select("v").distinct()
    ranks = base.select("v", F.lit(1.0 - damping).alias("score"))
    for i in range(iterations):
        give = links.join(ranks, "v").select(F.explode("to").alias("v"), (F.col("score") / F.col("n")).alias("part")).groupBy("v").agg(F.sum("part").alias("got"))
        ranks = base.join(give, "v", "left").select("v", (1.0 - damping + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if i % 4 == 3:
            ranks = settle(ranks)
    return ids.join(ranks, "v").select("id", "score")


def _kept(df: DataFrame) -> DataFrame:
    """A checkpoint, which keeps how its rows are dealt out and sorted."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, by contraction.

    In a round each node falls to the one of least random number among itself
    and its neighbours, nodes that fall to the same become one, and edges are
    carried over; the number of nodes with edges shrinks by a constant factor
    in expectation, and so do the edges that are left. Links of nodes with very
    many meet the node's code by a broadcast.
    """
    ids, ends = coded(nodes, edges)
    left, falls = settle(ends.filter("a <> b")), []
    for r in range(max_rounds):
        if left.isEmpty():
            break
        near = _fall(left, r)
        if r == 0:  # an end that is no node links nothing
            lost = settle(near.select("v").join(ids, "v", "left_anti"))
            if not lost.isEmpty():
                kept = settle(left.join(lost.withColumnRenamed("v", "a"), "a", "left_anti").join(lost.withColumnRenamed("v", "b"), "b", "left_anti"))
                forget(near, left)
                left, near = kept, _fall(kept, r)
        total = 2 * left.count()
        moved = _meet(_meet(left, near.select(F.col("v").alias("a"), F.col("to").alias("x"), "links"), "a", "links", total), near.select(F.col("v").alias("b"), F.col("to").alias("y"), "links"), "b", "links", total)
        moved = settle(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        forget(left)
        left = moved
        falls.append(near.select("v", "to"))
    else:
        raise RuntimeError("components did not settle")
    root = None
    for fall in reversed(falls):
        if root is None:
            root = fall
            continue
        many = fall.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
        onward = settle(root.select(F.col("v").alias("to"), F.col("to").alias("end")).join(many, "to", "right").select("to", F.coalesce("end", "to").alias("end"), "n"))
        root = settle(_meet(fall, onward, "to", "n", fall.count()).select("v", F.col("end").alias("to")))
    if root is None:
        return nodes.select("id", F.col("id").alias("component"))
    placed = settle(ids.join(root, "v", "left").select("id", F.coalesce("to", "v").alias("root")))
    first = settle(placed.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")))
    return _meet(placed, first, "root", "n", placed.count()).select("id", "component")


def _fall(edges: DataFrame, r: int) -> DataFrame:
    """(v, to, links): where each end of edges (a, b) falls, and its number of edges."""
    number = lambda c: F.struct(F.xxhash64(F.lit(r), c), F.col(c).alias("to"))
    both = edges.select("a", "b").unionAll(edges.select("b", "a"))
    near = both.groupBy(F.col("a").alias("v")).agg(F.min(number("b")).alias("low"), F.count(F.lit(1)).alias("links"))
    return settle(near.select("v", F.least("low", number("v"))["to"].alias("to"), "links"))


def _meet(rows: DataFrame, side: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join with ``side`` (settled, one row per key, with the key's ``count`` of rows), by ``join_hot`` where a key is hot."""
    if side.filter(F.col(count) > max(1.0, total * HOT)).isEmpty() or total < 2 / HOT:
        return rows.join(side.drop(count), key)
    return join_hot(rows, side, [key], count, total)


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, community): connected communities by synchronous weighted label propagation with modularity gain.

    A node moves to the neighbouring community of the highest gain (links into
    it less the expected ones), ties to the smallest label; even and odd nodes
    move in turn, so two can't swap for ever. At the end a community that has
    come apart is split into its connected parts, named by their smallest id.
    """
    und = settle(both_ways(edges).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    deg = settle(und.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    total = deg.agg(F.sum("k")).first()[0] or 1.0
    label = settle(nodes.select("id", F.col("id").alias("community")))
    for r in range(rounds):
        member = label.join(deg, "id")
        size = member.groupBy("community").agg(F.sum("k").alias("vol"))
        into = und.join(label, F.col("dst") == F.col("id")).groupBy("src", "community").agg(F.sum("w").alias("links"))
        own = member.select(F.col("id").alias("src"), F.col("community").alias("own"), "k")
        gain = F.col("links") - F.col("k") * (F.col("vol") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)) / total
        best = into.join(size, "community").join(own, "src").withColumn("gain", F.round(gain, 9))
        best = best.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("gain"), "community"))).filter("n = 1 and gain > 0").select(F.col("src").alias("id"), F.col("community").alias("to"))
        moves = F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2
        label = settle(label.join(best, "id", "left").select("id", F.when(moves, F.coalesce("to", "community")).otherwise(F.col("community")).alias("community")))
    inside = edges.join(label.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").filter("a = b").select("src", "type", "dst", "edge_id")
    return components(nodes, inside).select("id", F.col("component").alias("community"))


def following(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and ``next``, the key of the row after it in the order of all rows (null for the last), without a task that sorts them all.

    Rows are dealt by ranges of the key; the last of a range takes the first of the next range that has rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.select(key).repartitionByRange(parts, key).withColumn("__gl_p", F.spark_partition_id()))
    first = dealt.groupBy("__gl_p").agg(F.min(key).alias("__gl_first"))
    after = settle(first.select("__gl_p", F.lead("__gl_first").over(Window.orderBy("__gl_p")).alias("__gl_first")))
    within = dealt.withColumn("next", F.lead(key).over(Window.partitionBy("__gl_p").orderBy(key)))
    return within.join(F.broadcast(after), "__gl_p").select(key, F.coalesce("next", "__gl_first").alias("next"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src = dst")


def group_members(label: DataFrame) -> DataFrame:
    """(community, size, first, last): members of every community, counted and by their least and greatest id."""
    return label.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"), F.max("id").alias("last"))


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One row: modularity of a partition (id, community) of the undirected multigraph.

    Edges are counted by their ends' communities once, and all sums are of those counts.
    """
    ids, ends = coded(label, edges)
    member = ids.distinct().join(label, "id")
    a, b = member.select(F.col("v").alias("a"), F.col("community").alias("ca")), member.select(F.col("v").alias("b"), F.col("community").alias("cb"))
    e = settle(ends.join(a, "a").join(b, "b").groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("k")))
    inside = e.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("k")).otherwise(0)).alias("ins")).withColumnRenamed("ca", "c")
    vol = e.select(F.col("ca").alias("c"), "k").unionAll(e.select("cb", "k")).groupBy("c").agg(F.sum("k").alias("vol"))
    m = e.agg(F.sum("k").alias("m"))
    return vol.join(inside, "c", "left").crossJoin(F.broadcast(m)).agg(F.round(F.sum(F.coalesce("ins", F.lit(0)) / F.col("m") - (F.col("vol") / (2 * F.col("m"))) ** 2), 6).alias("modularity"))


def ancestors(broader: DataFrame, max_depth: int = 32) -> DataFrame:
    """(id, ancestor, depth): reflexive-transitive closure of (id, parent), each step one join until nothing is new."""
    ids = broader.select("id").union(broader.filter("parent is not null").select(F.col("parent").alias("id"))).distinct()
    out = frontier = ids.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    up = broader.filter("parent is not null").select(F.col("id").alias("ancestor"), "parent")
    for depth in range(1, max_depth + 1):
        nxt = frontier.join(up, "ancestor").select("id", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"))
        frontier = settle(nxt.join(out, ["id", "ancestor"], "left_anti").distinct())
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out
