"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has a bit set where more than half of its shingles'
hashes have it set. Fingerprints at ``radius`` or fewer differing bits are
linked, and groups are the connected components of the links.

Covering: each bit position gets a random non-zero vector of radius + 1 bits;
each non-zero vector v of that length is a table whose mask keeps the
positions whose vector has odd inner product with v. The vectors of at most
``radius`` differing positions leave some v orthogonal to all of them, so in
that table the masks hide every difference: each pair within the radius meets
in at least one of the 2^(radius + 1) - 1 tables, with no chance of a miss.

Only distinct fingerprints enter the tables, so a group of exact copies of any
size is one row. Buckets with one member are dropped after a count; members of
a bucket are compared in blocks of bounded size, and a bucket of several
blocks is dealt out as pairs of blocks to as many tasks. A task returns links
that span the components it found, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import arrow_rows, discard, join_hot, staged, table

#: Largest block of a bucket that one group compares.
BLOCK = 1024
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint of a whole text; without words it is zero."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    if n == 1:
        spans = [joined]
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[:n].tolist()
        spans = [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint's bits as a signed long) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "th", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), text.alias("text")).mapInArrow(of, "doc_id long, th long, fp long")


def masks(radius: int, seed: int = 1) -> list[int]:
    """The tables' masks, as signed longs."""
    vectors = np.random.default_rng(seed).integers(1, 1 << (radius + 1), 64)
    out = []
    for v in range(1, 1 << (radius + 1)):
        bits = sum(1 << i for i, m in enumerate(vectors.tolist()) if (m & v).bit_count() & 1)
        out.append(bits - (1 << 64) if bits >> 63 else bits)
    return out


def _spanning(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of the pairs within ``radius``, between two blocks or within one."""
    nodes = left if right is None else np.concatenate([left, right])
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, other, shift = [], (left if right is None else right), 0 if right is None else len(left)
    step = max(1, 4_000_000 // max(1, len(other)))
    for at in range(0, len(left), step):
        near = np.bitwise_count(left[at : at + step, None] ^ other[None, :]) <= radius
        for i, j in np.argwhere(np.triu(near, at + 1) if right is None else near).tolist():
            a, b = root(at + i), root(j + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[at + i]), int(nodes[j + shift])))
    return out


def links(fps: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints (column fp) whose components are those of all pairs within ``radius``."""
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))]))
    rows = fps.select("fp", tables.alias("t")).select("fp", "t.tab", "t.key")
    sizes = rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the optimizer takes the exploded rows to be as small as the fingerprints they come from, so it must not choose to broadcast them
    shared = rows.hint("merge").join(sizes, ["tab", "key"]).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    one = shared.filter("parts = 1").select("tab", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "fp")
    # each block meets every other once: as the left side of (own, y >= own), as the right side of (x < own, own)
    many = shared.filter("parts > 1").withColumn("own", part)
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(F.col("own"), p).alias("x"), F.greatest(F.col("own"), p).alias("y"), F.when(p < F.col("own"), 1).otherwise(0).alias("side"))))
    many = many.select("tab", "key", "fp", pairs.alias("p")).select("tab", "key", "p.x", "p.y", "p.side", "fp")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        side = pdf["side"].to_numpy()
        found = _spanning(fp, None, radius) if pdf["x"].iat[0] == pdf["y"].iat[0] else _spanning(fp[side == 0], fp[side == 1], radius)
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": ends.min(axis=1), "b": ends.max(axis=1)})

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows, group by group; a group is bounded by two blocks."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            tag = pdf[["tab", "key", "x", "y"]].to_numpy()
            cuts = np.flatnonzero((tag[1:] != tag[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist()]
            yield from _compared(pdf, bounds, compare, radius)
            rest = pdf.iloc[bounds[-1] :]
        if rest is not None and len(rest):
            yield compare(rest)

    keys = ["tab", "key", "x", "y"]
    dealt = one.unionByName(many).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(runs, "a long, b long").distinct()


def _compared(pdf: pd.DataFrame, bounds: list[int], compare, radius: int) -> Iterator[pd.DataFrame]:
    """All groups but the last, which may go on in the next batch. Pairs, by far the most common groups, are compared at once."""
    if len(bounds) < 2:
        return
    starts, stops = np.array(bounds[:-1]), np.array(bounds[1:])
    two = (stops - starts == 2) & (pdf["x"].to_numpy()[starts] == pdf["y"].to_numpy()[starts])
    fp = pdf["fp"].to_numpy()
    left, right = fp[starts[two]], fp[starts[two] + 1]
    near = np.bitwise_count(left.view(np.uint64) ^ right.view(np.uint64)) <= radius
    yield pd.DataFrame({"a": np.minimum(left, right)[near], "b": np.maximum(left, right)[near]})
    for a, b in zip(starts[~two].tolist(), stops[~two].tolist(), strict=True):
        yield compare(pdf.iloc[a:b])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the component's smallest node.

    Alternating large-star and small-star: each round hooks every node's
    neighbours to its smallest one, until nothing changes. Minima are
    aggregated before rows move, and links of a node with very many meet its
    minimum by a broadcast, so no such node is a task of its own; rounds are
    staged in the shared folder, and the round before is removed.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    n, last = edges.count(), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "minima")
        # large star: every larger neighbour of a node goes to the node's minimum
        large = staged(join_hot(both.filter("v > u"), low, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large-star")
        # small star: every smaller neighbour, and the node, go to the smallest
        small = staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "minima")
        joined = join_hot(large, small, ["u"], "n", 2 * n)
        done = staged(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        for old in (edges, low, large, small):
            discard(old)
        edges = done
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last, n = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """doc_id, th (hash of the text), fp, component_id and root (the component's smallest fingerprint) of every row."""
    with arrow_rows(docs.sparkSession, 1000):
        rows = staged(fingerprints(docs, words), "fingerprints")
    firsts = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = staged(components(links(firsts.select("fp"), radius)), "components")
    linked = roots.join(firsts, roots["node"] == firsts["fp"])
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_fp = join_hot(roots, staged(ids, "component-ids"), ["root"], "n", roots.count()).select(F.col("node").alias("fp"), "component_id", "root")
    named = firsts.join(of_fp, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return join_hot(rows, staged(named, "named"), ["fp"], "n", rows.count())


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the row's component) for every row of ``docs``.

    Null text counts as empty; empty texts share fingerprint zero; a null
    doc_id never names a component, unless all of a component's are null; equal
    rows share a component; an empty table gives no rows; other columns are
    ignored. Within a bucket all distinct fingerprints are compared, in blocks:
    the work is the square of a bucket's distinct fingerprints.
    """
    return _grouped(docs, words, radius).select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: of its smallest doc_id, and of different texts under that id the one of the least hash; of rows equal in both one.

    Rows without doc_id can't be told apart by it and all stay. Unlike texts
    under one doc_id are in components of their own and each keep a row.
    """
    known = docs.filter("doc_id is not null")
    member = F.struct("doc_id", "th")
    kept = _grouped(known, words, radius).groupBy("root").agg(F.min(member).alias("m")).select(F.col("m.doc_id").alias("__gl_id"), F.col("m.th").alias("__gl_th")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__gl_row")
    rows = known.select(F.col("doc_id").cast("long").alias("__gl_id"), text_hash(F.col("text")).alias("__gl_th"), row).join(kept, ["__gl_id", "__gl_th"], "left_semi")
    first = F.row_number().over(Window.partitionBy("__gl_id", "__gl_th").orderBy("__gl_id"))
    one = rows.withColumn("__gl_n", first).filter("__gl_n = 1").select("__gl_row.*")
    return one.unionByName(docs.filter("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's fingerprint and component."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
