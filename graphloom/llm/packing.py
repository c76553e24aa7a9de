"""Vector best-fit packing of documents into training sequences.

A piece of a document is a vector of demands: its tokens, one document, and
its attention cost (tokens squared). A sequence has a capacity in each. Pieces
are placed longest first, each into the open sequence that it fits under every
constraint and that scores best: by the weighted norm of what remains, or by
the weighted dot product of demand and residual (smallest: tightest).

A piece's vector depends on its length alone, so pieces of one length are
interchangeable and the plan needs only how many there are of each. That
histogram has at most ``tokens`` rows, whatever the size of the input; the
driver plans over it, with runs of equal sequences as one row, and every piece
finds its place from its rank among the pieces of its length. So the packing
is global, without moving texts and without a step that grows with the input.

With the default capacities tokens are what binds; ``Capacity`` takes smaller
limits for documents and attention cost, and the plan keeps all three.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, salted_rank, staged, table
from graphloom.llm.tokens import encoder, tokenizer_path

PIECES = "doc_id long, piece int, start long, length int, "
#: Texts that a worker takes at once.
BATCH = 500


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, and attention cost (sum of squared lengths)."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


def pieces(docs: DataFrame, path: str, tokens: int = 2048, end_id: int | None = 0, digest: bool = False) -> DataFrame:
    """Token ids of each text, cut after every ``tokens``: doc_id, piece, start, length, ids, staged.

    ``ids`` are little-endian unsigned 32-bit integers, or with ``digest``
    their crc32 in their place (ids_crc32); ``end_id`` follows each document.
    Only documents of more than ``tokens`` are cut. Null text counts as empty;
    a document without ids (no text, no end id) has no piece.
    """
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), b"" if end_id is None else end_id.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), last])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                parts = [ids[at : at + 4 * tokens] for at in range(0, len(ids), 4 * tokens)]
                rows += [(doc_id, i, i * tokens, len(part) // 4, zlib.crc32(part) if digest else part) for i, part in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema, strict=True)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, BATCH):
        return staged(texts.mapInArrow(cut, PIECES + ("ids_crc32 long" if digest else "ids binary")), "pieces")


def plan(counts: dict[int, int], cap: Capacity = Capacity(), score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.02, 0.02)) -> tuple[np.ndarray, int]:
    """Place ``counts[length]`` pieces of each length, longest first.

    Returns rows (length, first rank, first sequence, pieces per sequence,
    offset of the first piece), sorted by length and rank: from that rank on,
    pieces fill one sequence after another. Also the number of sequences. A
    piece over a capacity by itself raises ValueError. Ties go to the sequence
    opened first.
    """
    full = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.int64)
    w = np.array(weights)
    rows: list[tuple[int, int, int, int, int]] = []
    # open runs of equal sequences: residual tokens, documents, attention; first sequence; how many
    res, first, many = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens does not fit into {cap}")
        while left:
            fits = (res >= need).all(axis=1)
            if fits.any():
                rest = (res[fits] - need) / full
                value = (w * rest * rest).sum(axis=1) if score == "norm" else (w * (res[fits] / full) * (need / full)).sum(axis=1)
                i = int(np.flatnonzero(fits)[np.argmin(value)])
                r, f, m = res[i], int(first[i]), int(many[i])
                keep = np.arange(len(many)) != i
                res, first, many = res[keep], first[keep], many[keep]
            else:
                r, f, m = full, opened, max(1, -(-left // int((full // need).min())))
                opened += m
            per = int((r // need).min())
            whole, over = divmod(min(left, per * m), per)
            rows.append((length, rank, f, per, int(full[0] - r[0])))
            new = [(r - per * need, f, whole)] * bool(whole) + [(r - over * need, f + whole, 1)] * bool(over)
            if (unused := m - whole - bool(over)) > 0:
                new.append((r, f + whole + bool(over), unused))
            placed = whole * per + over
            left, rank = left - placed, rank + placed
            new = [x for x in new if x[0].min() > 0]  # nothing fits where a capacity is used up
            if new:
                res = np.vstack([res, *[x[0] for x in new]])
                first, many = np.append(first, [x[1] for x in new]), np.append(many, [x[2] for x in new])
                order = np.argsort(first, kind="stable")
                res, first, many = res[order], first[order], many[order]
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), opened


def place(parts: DataFrame, cap: Capacity = Capacity(), score: str = "norm") -> DataFrame:
    """Give every row of ``parts`` (doc_id, piece, length, …) its sequence_id and offset; other columns stay.

    ``parts`` is read twice; stage it if it is dear. Equal rows are pieces of
    their own. sequence_id runs from 0 without gaps; offsets are gapless.
    """
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps, _ = plan(counts, cap, score)
    ranked = salted_rank(parts, ["length"], ["doc_id", "piece"], "__gl_rank", sum(counts.values()))
    # the plan as a table: a length's steps in one row, at most cap.tokens rows
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, rank, first, per, offset in steps.tolist():
        by.setdefault(length, []).append((rank, first, per, offset))
    table = parts.sparkSession.createDataFrame(list(by.items()), "`__gl_length` int, `__gl_steps` array<struct<rank:bigint,first:bigint,per:bigint,offset:bigint>>")
    step = F.element_at(F.filter("__gl_steps", lambda s: s["rank"] <= F.col("__gl_rank")), -1)
    found = ranked.join(F.broadcast(table), F.col("length") == F.col("__gl_length")).withColumn("__gl_step", step)
    nth = F.col("__gl_rank") - F.col("__gl_step.rank")
    found = found.withColumn("sequence_id", F.col("__gl_step.first") + F.floor(nth / F.col("__gl_step.per")).cast("long"))
    found = found.withColumn("offset", F.col("__gl_step.offset") + nth % F.col("__gl_step.per") * F.col("length"))
    return found.drop("__gl_rank", "__gl_length", "__gl_steps", "__gl_step")


def pack(docs: DataFrame, path: str, cap: Capacity = Capacity(), end_id: int | None = 0, score: str = "norm") -> DataFrame:
    """Pack ``docs`` into sequences: doc_id, piece, start, length, ids, sequence_id, offset.

    Null text counts as empty (its end id is packed); equal rows are packed
    each; an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    return place(pieces(docs, path, cap.tokens, end_id), cap, score)


def pack_digests(docs: DataFrame, path: str, cap: Capacity = Capacity(), end_id: int | None = 0, score: str = "norm") -> DataFrame:
    """As ``pack``, with a digest of each piece's ids, made as they are encoded, in place of the ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = pieces(docs, path, cap.tokens, end_id, digest=True)
    return place(parts, cap, score).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents in sequences of 2048 tokens."""
    return pack_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
