"""Token ids in files of fixed-width bit-packed blocks.

File: 36 bytes left zero, the packed blocks, then indexes of 64-bit integers:
for each block its byte offset, for each document its first id's place in the
file and its doc_id; at the end 36 bytes that tell the rest (magic ``GLBP``,
version, bits per id, ids per block, documents, documents without an id, which
come first, ids, blocks). Every block starts at a byte and holds ``BLOCK`` ids
(the last one fewer), so an id's place is known without reading what is before
it: readers fetch the blocks they need by offset and unpack them by numpy.

Texts are dealt over files of about ``FILE_BYTES`` of text by ranges of doc_id
and written in that order, one file per task under a name of its own that is
moved into place when it is complete; a task that is run again writes the same
file, and what failed attempts leave is removed. Files are read back by as
many tasks as there are files, each holding one file's index and a few blocks.
"""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import arrow_rows, scratch_path, staged, table
from graphloom.llm.tokens import encoder, tokenizer_path, vocabulary_size

MAGIC = b"GLBP"
HEADER = np.dtype([("magic", "S4"), ("version", "<u2"), ("bits", "<u2"), ("block", "<u4"), ("docs", "<u4"), ("nulls", "<u4"), ("ids", "<u8"), ("blocks", "<u8")])
#: Ids per block: a multiple of 8, so that blocks end at whole bytes.
BLOCK = 4096
#: UTF-8 bytes of text that make a file, about.
FILE_BYTES = 64 << 20
#: Ids that a reader unpacks at once, about.
READ_IDS = 1 << 20
MANIFEST = "part int, file string, first_doc long, n_docs long, n_ids long"


def width(vocabulary: int) -> int:
    """The minimum bits that hold every id of the vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, ``bits`` bits each, lowest bit first; the last byte is filled with zeros."""
    ids = ids.astype("<u4", copy=False)
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    as_bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=None)[:, :bits]
    return np.packbits(as_bits.ravel(), bitorder="little").tobytes()


def unpack_bits(packed: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes: each is cut from the eight bytes around it."""
    if bits in (8, 16, 32):
        return packed[: count * bits // 8].view(f"<u{bits // 8}").astype("<u4")
    padded = np.concatenate([packed, np.zeros(8, np.uint8)])
    at = np.arange(count, dtype=np.int64) * bits
    byte = at >> 3
    word = np.zeros(count, np.uint64)
    for i in range((bits + 14) // 8):
        word |= padded[byte + i].astype(np.uint64) << np.uint64(8 * i)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Writes documents' ids into one file, block by block."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.rest, self.size = np.empty(0, "<u4"), HEADER.itemsize
        self.offsets, self.starts, self.docs, self.nulls, self.ids = [], [], [], 0, 0
        # the counts go to the end: streams of stores can't be written twice
        stream.write(np.zeros(1, HEADER).tobytes())

    def _blocks(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), self.block):
            packed = pack_bits(ids[at : at + self.block], self.bits)
            self.offsets.append(self.size)
            self.size += len(packed)
            self.stream.write(packed)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Append a document; those without an id come before all others."""
        if doc_id is None:
            if self.nulls < len(self.docs):
                raise ValueError("documents without an id come first")
            self.nulls += 1
        self.docs.append(0 if doc_id is None else doc_id)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.block * self.block
        self._blocks(self.rest[:whole])
        self.rest = self.rest[whole:]

    def close(self) -> None:
        self._blocks(self.rest)
        for index in (self.offsets, self.starts, self.docs):
            self.stream.write(np.array(index, "<i8").tobytes())
        self.stream.write(np.array([(MAGIC, 2, self.bits, self.block, len(self.docs), self.nulls, self.ids, len(self.offsets))], HEADER).tobytes())


class Reader:
    """Random access to a file's documents and blocks; ``fetch(offset, length)`` gives bytes of the file, ``size`` is its length."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int):
        head = np.frombuffer(fetch(size - HEADER.itemsize, HEADER.itemsize), HEADER)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a bit-packed token file")
        self.fetch = fetch
        self.bits, self.block, self.n_docs, self.nulls, self.n_ids, blocks = (int(head[x]) for x in ("bits", "block", "docs", "nulls", "ids", "blocks"))
        length = 8 * (blocks + 2 * self.n_docs)
        index = np.frombuffer(fetch(size - HEADER.itemsize - length, length), "<i8")
        self.offsets, self.starts, self.doc_ids = np.split(index, [blocks, blocks + self.n_docs])
        self.ends = np.append(self.starts[1:], self.n_ids)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``, reading and unpacking only the blocks they lie in."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        count = min((last + 1) * self.block, self.n_ids) - first * self.block
        packed = np.frombuffer(self.fetch(int(self.offsets[first]), -(-count * self.bits // 8)), np.uint8)
        return unpack_bits(packed, self.bits, count)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.ends[i]))

    def runs(self, ids: int = READ_IDS) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, end, their ids in a row) of runs of documents with about ``ids`` ids, a longer document alone."""
        first = 0
        while first < self.n_docs:
            end = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + ids, side="right")))
            yield first, end, self.ids(int(self.starts[first]), int(self.ends[end - 1]))
            first = end


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` into files under ``folder`` (a URI of a shared store) in ascending doc_id order; returns the manifest.

    ``end_id`` follows each document. Null text counts as empty, null doc_ids
    sort first and stay null, equal rows are written each, an empty table
    writes no file; other columns are ignored.
    """
    spark, bits = docs.sparkSession, width(vocabulary_size(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # a file per task, and tasks enough for the cluster
    files = max(-(-total // file_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def to_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        encode, end, out, first = encoder(path), b"" if end_id is None else end_id.to_bytes(4, "little"), None, None
        tmp = f"{base}/.{uuid.uuid4().hex}.tmp"
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        stream, first = store.open_output_stream(tmp), doc_id
                        out, crc = Writer(stream, bits), 0
                    ids = encode(text.as_py()) + end
                    crc = zlib.crc32(ids, crc)
                    out.add(doc_id, np.frombuffer(ids, "<u4"))
            if out is not None:
                out.close()
                stream.close()
                # the name tells the content, so a repeated task moves the same file to the same place
                name = f"{base}/ids-{'null' if first is None else first}-{len(out.docs)}-{crc:08x}-{TaskContext.get().partitionId()}.glbp"
                store.move(tmp, name)
                yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "first_doc": pa.array([first], pa.int64()), "n_docs": [len(out.docs)], "n_ids": [out.ids]})
        except BaseException:
            with contextlib.suppress(OSError):
                store.delete_file(tmp)
            raise

    with arrow_rows(spark, 500):
        manifest = staged(dealt.mapInArrow(to_file, MANIFEST), "manifest")
    # attempts on lost executors could not remove theirs
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/.*.tmp")
    store = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for left in store.globStatus(jpath) or []:
        store.delete(left.getPath(), False)
    return manifest


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit).

    One task per file; it holds the file's index and about ``READ_IDS`` ids,
    or one longer document.
    """
    return _read(manifest, folder, "ids binary", lambda parts: pa.array([p.tobytes() for p in parts], pa.binary()))


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """As ``read``, with the crc32 of a document's ids in their place (ids_crc32)."""
    return _read(manifest, folder, "ids_crc32 long", lambda parts: pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()))


def _read(manifest: DataFrame, folder: str, last: str, column: Callable[[list[np.ndarray]], pa.Array]) -> DataFrame:
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"), F.row_number().over(Window.orderBy("part")).alias("k"))
    files = staged(files, "files")
    n = max(1, files.count())
    # one file per partition: the k-th range of k
    files = files.repartitionByRange(n, "k").select("file", "base")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(file) as f:
                    reader = Reader(lambda offset, length, f=f: f.read_at(length, offset), f.size())
                    for first, end, ids in reader.runs():
                        parts = np.split(ids, reader.starts[first + 1 : end] - reader.starts[first])
                        doc_ids = [None if first + i < reader.nulls else x for i, x in enumerate(reader.doc_ids[first:end].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, pa.int64()), pa.array(reader.starts[first:end] + base), pa.array([len(p) for p in parts], pa.int64()), column(parts)],
                            names=["doc_id", "start", "n_tokens", last.split()[0]],
                        )

    return files.mapInArrow(documents, f"doc_id long, start long, n_tokens long, {last}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: writes all documents' ids to files and returns digests of what the files hold."""
    folder = scratch_path(spark, "bitpacked")
    manifest = write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder)
    return read_digests(manifest, folder)
