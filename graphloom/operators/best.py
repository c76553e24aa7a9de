"""The best rows of each of many questions, kept while batches of scores go by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Half a unit of the last place that scores are rounded to, and what sums in another order can differ by.
SLACK = 0.5e-6 + 1e-9
#: Scores worked out at once, so that a task holds a few of these blocks whatever the numbers of rows and questions.
CELLS = 1 << 21


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero."""
    return np.trunc(x * 1e6 + np.copysign(0.5, x)) / 1e6


class Best:
    """The ``k`` best (question, id, score) for each of ``n`` questions: score down, NaN before all and null after, then id up.

    Scores come rounded; the order is that of a window over all rows, so the
    best of a part hold all of that part that can be among the best of the whole.
    """

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.parts, self.held = k, np.full(n, -np.inf), [], 0
        self.limit = max(4 * n * k, CELLS // 8)

    def add(self, q: np.ndarray, ids: pa.Array, score: np.ndarray, kind: int = 1) -> None:
        """Candidates; ``kind`` 2 is null, whose score isn't read."""
        order = np.where(np.isnan(score), 0, 1) if kind == 1 else np.full(len(q), kind)
        down = np.where(order == 1, -score, 0.0)
        self.parts.append(pa.table({"q": pa.array(q, pa.int32()), "kind": pa.array(order, pa.int8()), "down": pa.array(down, pa.float64()), "id": ids}))
        self.held += len(q)
        if self.held > self.limit:
            self.fold()

    def fold(self) -> pa.Table:
        """Drops all but the best, and raises the floor under which nothing can be one of them."""
        if not self.parts:
            return None
        t = pa.concat_tables(self.parts).combine_chunks()
        t = t.take(pa.compute.sort_indices(t, sort_keys=[(c, "ascending") for c in ("q", "kind", "down", "id")], null_placement="at_start"))
        q = t["q"].to_numpy()
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        t = t.filter(pa.array(place < self.k))
        last = t.filter(pa.array(place[place < self.k] == self.k - 1))
        plain = last["kind"].to_numpy() == 1
        self.floor[last["q"].to_numpy()[plain]] = -last["down"].to_numpy()[plain] - SLACK
        self.parts, self.held = [t], len(t)
        return t

    def rows(self, qids: pa.Array) -> pa.Table | None:
        """(qid, id, score) of what is left."""
        if (t := self.fold()) is None:
            return None
        kind, down = t["kind"].to_numpy(), t["down"].to_numpy()
        score = pa.array(np.where(kind == 0, np.nan, -down), pa.float64(), mask=kind == 2)
        return pa.table({"qid": qids.take(t["q"].combine_chunks()), "id": t["id"], "score": score})


def raise_floor(scores: np.ndarray, floor: np.ndarray, k: int) -> None:
    """For questions that have no floor yet: the k-th best of a block of ``scores`` (rows by questions) is one."""
    new = np.isneginf(floor)
    if len(scores) >= k and new.any():
        some = np.partition(scores[:, new], len(scores) - k, axis=0)[len(scores) - k]
        floor[new] = np.where(np.isnan(some), -np.inf, some - 2 * SLACK)
