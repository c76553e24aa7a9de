"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items come in blocks of a bounded number of words, each block a query set
held against all documents. Seeds are word trigrams, bigrams, and pairs with a
word between them. A first pass counts in how many documents each stands; an
item keeps its rarest ones among those that stand anywhere (rarest among its
own, so an item that leaked into a third of the corpus keeps its seeds). A
second pass finds the seeds in every text. One seed is enough: the words around
it, as far as a passage over the threshold can reach, are aligned with the item
if they hold as many of its words as such a passage must. Local alignment of
words scores exact, edited and partly paraphrased copies alike, as a share of
the item's own score. Texts are never moved; a task holds one block's tables
and one text.

What is found: every passage at the threshold that holds one of its item's
kept seeds. Recall against full alignment of every text with every item is
tested in tests/llm/test_decontamination.py for random and evenly spaced edits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, staged, table

MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of items per block; a block's tables are some hundreds of bytes per word.
BLOCK_WORDS = 200_000
#: Seeds: the words after the first that belong to one, by kind.
SEEDS = ((1, 2), (1,), (2,))
#: An aligned window is at most so many times as long as its item; longer ones are cut, overlapping by the reach of a passage.
WINDOW = 12
#: Items whose word tables a task keeps at once.
OWN_ITEMS = 16
#: Bytes of windows whose alignments a task remembers.
MEMO_BYTES = 8 << 20
#: A word: a run of letters and digits, or one character of a script without spaces.
_WORDS = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]|[^\W_\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+")
#: The same for texts without such characters, which is faster.
_SPACELESS, _RUNS = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]").search, re.compile(r"[^\W_]+")
#: A seed's number modulo this looks it up in a table of bits before it is searched for.
SIEVE = (1 << 20) - 1
HITS = "doc_id long, item_id long, score double, start long, end long"


def words_of(text: str) -> list[str]:
    low = text.lower()
    return (_WORDS if _SPACELESS(low) else _RUNS).findall(low)


class Block:
    """One block of test items: word numbers, seeds, and where each seed stands."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        number = lambda w: self.vocab.setdefault(w, len(self.vocab) + 1)
        self.items = [(i, np.array([number(w) for w in words_of(t)], np.int64)) for i, t in items]
        self.items = [(i, w) for i, w in self.items if len(w)]
        self.base = len(self.vocab) + 1
        places = [(c, k, p) for k, (_, w) in enumerate(self.items) for q, codes in self.codes(w) for c, p in zip(codes.tolist(), q.tolist(), strict=True)]
        # a single word is its own seed
        places += [(-int(w[0]), k, 0) for k, (_, w) in enumerate(self.items) if len(w) == 1]
        self._index(places)

    def _index(self, places: list[tuple[int, int, int]]) -> None:
        places.sort()
        codes = np.array([c for c, _, _ in places], np.int64)
        self.seeds, first = np.unique(codes, return_index=True)
        self.first = np.append(first, len(places))
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[codes % SIEVE] = True
        self.item, self.at = np.array([k for _, k, _ in places], np.int64), np.array([p for _, _, p in places], np.int64)

    def own(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(for every word its number among item ``k``'s own, others being 0; how often the item has each); of the last items asked for."""
        if (got := self.kept.get(k)) is None:
            if len(self.kept) >= OWN_ITEMS:
                self.kept.clear()
            words, counts = np.unique(self.items[k][1], return_counts=True)
            local = np.zeros(self.base, np.int32)
            local[words] = np.arange(1, len(words) + 1)
            got = self.kept[k] = local, np.append(0, counts)
        return got

    def codes(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each kind of seed (positions, numbers) where all its words are known."""
        for kind, offsets in enumerate(SEEDS):
            n = len(words) - offsets[-1]
            if n > 0:
                code, known = words[:n], words[:n] > 0
                for o in offsets:
                    w = words[o : o + n]
                    code, known = code * self.base + w, known & (w > 0)
                pos = np.flatnonzero(known)
                yield pos, code[pos] * len(SEEDS) + kind

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, seed numbers) of the seeds in a text's word numbers."""
        if not len(words) or not len(self.seeds):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = list(self.codes(words))
        if self.seeds[0] < 0:
            one = np.flatnonzero(words)
            found.append((one, -words[one]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pos, codes = np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])
        may = np.flatnonzero(self.sieve[codes % SIEVE])
        pos, codes = pos[may], codes[may]
        seed = np.searchsorted(self.seeds, codes)
        seed[seed == len(self.seeds)] = 0
        ok = self.seeds[seed] == codes
        return pos[ok], seed[ok]

    def keep_rare(self, seen: np.ndarray, share: float) -> None:
        """Leave each item the rarest ``share`` of the places of each kind of seed (four at least, and those as rare as the last), of those in any document; ``seen`` has documents per seed."""
        own: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for s, code in enumerate(self.seeds.tolist()):
            for j in range(self.first[s], self.first[s + 1]) if seen[s] else ():
                own.setdefault((int(self.item[j]), code % len(SEEDS) if code > 0 else -1), []).append((int(seen[s]), s, j))
        kept = []
        for found in own.values():
            found.sort()
            last = found[min(len(found), max(4, math.ceil(share * len(found)))) - 1][0]
            kept += [(int(self.seeds[s]), int(self.item[j]), int(self.at[j])) for n, s, j in found if n <= last]
        self._index(kept)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word-number sequences: (score, start, end) in ``text``; number 0 equals nothing.

    Rows are vectors: gaps along a row are a running maximum of the row plus
    the gap's slope.
    """

    def ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        slope = np.arange(len(b) + 1) * -GAP
        row, best, at = np.zeros(len(b) + 1, np.int64), 0, 0
        for x in a:
            step = np.empty_like(row)
            step[0] = 0
            np.maximum(row[:-1] + np.where((b == x) & (x != 0), MATCH, MISMATCH), row[1:] + GAP, out=step[1:])
            np.maximum(step, 0, out=step)
            row = np.maximum.accumulate(step + slope) - slope
            top = int(row.argmax())
            if row[top] > best:
                best, at = int(row[top]), top
        return best, at

    score, end = ends(item, text)
    if not score:
        return 0, 0, 0
    _, back = ends(item[::-1], text[:end][::-1])
    return score, end - back, end


def _windows(starts: np.ndarray, size: int, reach: int, end: int) -> Iterator[tuple[int, int]]:
    """The text around seeds, ``starts`` being where their item would begin: unions of windows, cut to WINDOW items with an overlap of a passage's reach."""
    a, longest = None, WINDOW * size
    for at in starts.tolist():
        lo, hi = max(0, at - reach), min(end, at + size + reach)
        if a is None:
            a, b = lo, hi
        elif lo <= b and hi - a <= longest:
            b = max(b, hi)
        else:
            yield a, b
            # a passage that this seed belongs to lies within its own reach
            a, b = lo, hi
    if a is not None:
        yield a, b


def passages(block: Block, text: str, memo: dict, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(item number, score, first word, end word) of the best alignment of each seeded item in a text, at the threshold or more.

    A passage that scores a share t of an item of n words matches t n of its
    words at least, and gaps cost it at most 2 n (1 - t) words.
    """
    words = block.numbers(text)
    pos, seed = block.hits(words)
    if not len(pos):
        return
    many = block.first[seed + 1] - block.first[seed]
    j = np.repeat(block.first[seed], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item_no, diag = block.item[j], np.repeat(pos, many) - block.at[j]
    order = np.lexsort((diag, item_no))
    item_no, diag = item_no[order], diag[order]
    cuts = [0, *(np.flatnonzero(np.diff(item_no)) + 1).tolist(), len(item_no)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        k = int(item_no[lo])
        item = block.items[k][1]
        least, reach = threshold * len(item), math.ceil(2 * len(item) * (1 - threshold)) + 1
        local, own = block.own(k)
        best = (0, 0, 0)
        for a, b in _windows(np.unique(diag[lo:hi]), len(item), reach, len(words)):
            window = words[a:b]
            # words in common, each as often as the item has it at most
            if np.minimum(np.bincount(local[window], minlength=len(own)), own).sum() < least:
                continue
            key = (k, window.tobytes())
            if (got := memo.get(key)) is None:
                memo["bytes"] = memo.get("bytes", 0) + len(key[1]) + 200
                if memo["bytes"] > MEMO_BYTES:
                    memo.clear()
                got = memo[key] = align(item, window)
            best = max(best, (got[0], a + got[1], a + got[2]))
        if best[0] >= threshold * MATCH * len(item):
            yield k, best[0] / (MATCH * len(item)), best[1], best[2]


def _spans(text: str, first: int, end: int) -> tuple[int, int]:
    """Code-point span of words first..end of a text."""
    low = text.lower()
    if len(low) != len(text):  # a lower case of another length: let the words of the text itself count
        low = text
    start = stop = 0
    for i, m in enumerate((_WORDS if _SPACELESS(low) else _RUNS).finditer(low)):
        if i == first:
            start = m.start()
        if i == end - 1:
            stop = m.end()
            break
    return start, stop


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of about ``block_words`` words; items without text or id are left out, equal texts stay."""
    out, size = [], 0
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    for r in items.toLocalIterator():
        out.append((r["item_id"], r["text"]))
        size += len(words_of(r["text"]))
        if size >= block_words:
            yield out
            out, size = [], 0
    if out:
        yield out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, rare: float = 0.67, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start, end): the best passage of every document for every item it holds a copy of.

    ``score`` is the alignment's score over that of the item with itself, at
    least ``threshold``; start and end are code points of the text. Null and
    empty texts hold nothing, items without a word name no passage; equal
    rows give equal hits; without documents or items there are none; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in blocks_of(benchmark, block_words):
        block = Block(items)
        if not block.items:
            continue
        everywhere = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], everywhere=everywhere) -> Iterator[pa.RecordBatch]:
            block = everywhere.value
            seen = np.zeros(len(block.seeds), np.int64)
            for batch in batches:
                for text in batch.column(0):
                    if text.is_valid:
                        seen[np.unique(block.hits(block.numbers(text.as_py()))[1])] += 1
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some], pa.int64())], names=["seed", "n"])

        seen = np.zeros(len(block.seeds), np.int64)
        with arrow_rows(spark, 1000):
            for r in rows.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():
                seen[r["seed"]] = r["n"]
        block.keep_rare(seen, rare)
        seeded = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], seeded=seeded) -> Iterator[pa.RecordBatch]:
            block, memo = seeded.value, {}
            for batch in batches:
                hits = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if text.is_valid:
                        text = text.as_py()
                        hits += [(doc_id, block.items[k][0], score, *_spans(text, a, b)) for k, score, a, b in passages(block, text, memo, threshold)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits) if hits else [[]] * 5, [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "item_id", "score", "start", "end"])

        with arrow_rows(spark, 1000):
            found = staged(rows.mapInArrow(search, HITS), "contaminated")
        everywhere.destroy()
        seeded.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], HITS) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` without a contaminated passage, with all their columns. Rows without doc_id can't be named by a hit and stay."""
    bad = contaminated(docs.filter("doc_id is not null"), benchmark, threshold).select(F.col("doc_id").alias("__gl_id")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["__gl_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document against all benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("score", F.round("score", 6))
