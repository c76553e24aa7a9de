"""K-d tree sharding: weighted medians along the widest metadata dimension.

A tree node holds a share of the shards. It is cut at the weighted quantile
that gives each side its share of the bytes, along the metadata dimension
that is widest in that node, until a node has one shard. Every row has one
63-bit key per dimension: the scaled value in the high bits, then a hash of
the text, a hash of the id, and a hash of the row's own number. The text hash
keeps equal texts together where a cut allows it; the id hash lets a cut run
through a group of copies that outweighs a shard, the row hash through rows
equal in all they hold. So a cut comes as near to its target as 1/16384 of
such a group permits, whatever one value, text or row weighs. Keys are
written once, so every pass and repeated task sees the same ones.

The medians are found by histograms: each pass sums the bytes of 4,096 equal
intervals of the range left in each node and goes on inside the interval
that holds the target. A pass sends the driver at most 4,096 sums per node,
whatever the size of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import salted_rank, staged

#: Bits of a key for the value and the hashes of text, id and row.
VALUE_BITS, TEXT_BITS, ID_BITS, ROW_BITS = 15, 17, 17, 14
KEY_BITS = VALUE_BITS + TEXT_BITS + ID_BITS + ROW_BITS
BINS = 4096


@dataclass
class Node:
    """A node of the tree: ``shards`` shards from ``first`` on."""

    first: int
    shards: int
    dim: int | None = None
    cut: int | None = None


def sizes(docs: DataFrame, overhead: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus ``overhead``; null text: none), text_crc32, and the dimensions' values."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (size + overhead).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.log1p(size.cast("double")).alias("v0"),
        # share of the bytes that are not the first byte of a character: rises with accents and scripts
        ((size - F.length(text)) / F.greatest(size, F.lit(1))).cast("double").alias("v1"),
        F.pmod(F.xxhash64(F.coalesce(F.col("lang"), F.lit(""))), F.lit(9973)).cast("double").alias("v2"),
        F.xxhash64(text).alias("th"),
    )


def _keys(rows: DataFrame, dims: list[str]) -> DataFrame:
    lo_hi = rows.agg(*[f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()

    text = F.shiftleft(F.pmod(F.col("th"), F.lit(1 << TEXT_BITS)), ID_BITS + ROW_BITS)
    doc = F.shiftleft(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "th"), F.lit(1 << ID_BITS)), ROW_BITS)
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))

    def key(d: str) -> Column:
        lo, hi = lo_hi[f"lo{d}"] or 0.0, lo_hi[f"hi{d}"] or 0.0
        top = (1 << VALUE_BITS) - 1
        value = F.lit(0) if hi <= lo else F.floor((F.col(d) - lo) / (hi - lo) * top)
        return F.shiftleft(value.cast("long"), KEY_BITS - VALUE_BITS) + text + doc + F.col("own")

    rows = rows.withColumn("own", own)
    return rows.select("doc_id", "size", "text_crc32", *[key(d).alias(f"k{i}") for i, d in enumerate(dims)])


def _leaf(nodes: list[tuple[int, int, int]]) -> Column:
    """nodes: (from, cut key's dimension, cut) by the node's first shard; the expression that moves a row on."""
    out = F.col("__gl_node")
    for first, dim, cut, right in nodes:
        out = F.when((F.col("__gl_node") == first) & (F.col(f"k{dim}") >= cut), F.lit(right)).otherwise(out)
    return out


def kd_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, overhead: int = 8) -> DataFrame:
    """Deal ``docs`` into ``shards`` shards of nearly equal bytes.

    Returns doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless
    from 0 within a shard). ``tolerance`` is how far a cut may miss its target,
    as a share of a shard's bytes, before it runs through a group of equal
    texts. Null text counts as empty and null metadata as the empty string;
    equal rows are dealt singly and may fall on either side of a cut; an empty
    table gives no rows; other columns are ignored.
    """
    dims = ["v0", "v1", "v2"]
    raw = staged(sizes(docs, overhead), "kd-sizes")
    rows = staged(_keys(raw, dims), "kd-keys").withColumn("__gl_node", F.lit(0))
    total = rows.agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).first()
    n_rows, target = total["n"], (total["s"] or 0) / shards
    widest = (1 << KEY_BITS) - 1
    level = [Node(0, shards)]
    while any(n.shards > 1 for n in level) and n_rows:
        open_nodes = [n for n in level if n.shards > 1]
        stats = {
            r["__gl_node"]: r
            for r in rows.filter(F.col("__gl_node").isin([n.first for n in open_nodes]))
            .groupBy("__gl_node")
            .agg(F.sum("size").alias("s"), *[f(f"k{i}").alias(f"{m}{i}") for i in range(len(dims)) for m, f in (("lo", F.min), ("hi", F.max))])
            .collect()
        }
        search = {}
        for n in open_nodes:
            if (r := stats.get(n.first)) is None:
                n.dim, n.cut = 0, widest
                continue
            n.dim = max(range(len(dims)), key=lambda i, r=r: (r[f"hi{i}"] - r[f"lo{i}"], -i))
            # bytes of the node's own range below lo; [lo, hi) still holds the cut
            search[n.first] = {"n": n, "lo": r[f"lo{n.dim}"], "hi": r[f"hi{n.dim}"] + 1, "below": 0, "want": r["s"] * (n.shards // 2) / n.shards}
        while search:
            step = F.lit(None).cast("struct<node:int,bin:int>")
            for first, s in search.items():
                k, width = F.col(f"k{s['n'].dim}"), -(-(s["hi"] - s["lo"]) // BINS)
                step = F.when((F.col("__gl_node") == first) & (k >= s["lo"]) & (k < s["hi"]), F.struct(F.lit(first).alias("node"), F.floor((k - s["lo"]) / F.lit(width)).cast("int").alias("bin")) if width > 1 else F.struct(F.lit(first).alias("node"), (k - s["lo"]).cast("int").alias("bin"))).otherwise(step)
            sums: dict[int, dict[int, int]] = {}
            for r in rows.select(step.alias("b"), "size").filter("b is not null").groupBy("b").agg(F.sum("size").alias("s")).collect():
                sums.setdefault(r["b"]["node"], {})[r["b"]["bin"]] = r["s"]
            for first, s in list(search.items()):
                width, below, hit = -(-(s["hi"] - s["lo"]) // BINS), s["below"], None
                for b, w in sorted(sums.get(first, {}).items()):
                    hit, at = (b, w), below
                    if below + w >= s["want"]:
                        break
                    below += w
                lo = s["lo"] + hit[0] * width
                near = min(((abs(at - s["want"]), lo), (abs(at + hit[1] - s["want"]), lo + width)), key=lambda x: x[0])
                if near[0] <= tolerance * target or width == 1:
                    s["n"].cut = near[1]
                    del search[first]
                else:
                    s |= {"lo": lo, "hi": min(lo + width, s["hi"]), "below": at}
        moves, level_next = [], [n for n in level if n.shards == 1]
        for n in open_nodes:
            left = n.shards // 2
            moves.append((n.first, n.dim, n.cut, n.first + left))
            level_next += [Node(n.first, left), Node(n.first + left, n.shards - left)]
        rows = rows.withColumn("__gl_node", _leaf(moves))
        level = level_next
    out = rows.select("doc_id", "size", "text_crc32", F.col("__gl_node").cast("int").alias("shard"))
    return salted_rank(out, ["shard"], ["doc_id", "text_crc32"], "slot", n_rows)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents in 24 shards by the law of near-equal bytes."""
    from graphloom.llm.common import table

    return kd_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
