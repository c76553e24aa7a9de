"""Joins that a hot key doesn't turn into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; fewer than 1 / HOT keys can be.
HOT = 0.0005


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``side`` (one row per ``keys``, read twice), whose column ``count`` tells how many of the ``total`` rows have its keys.

    Keys with more than a share ``HOT`` of the rows are at most 1 / HOT in
    number, whatever the data, so they are broadcast; only the rest is dealt
    by key, and no task gets more than that share of one key. ``how`` may be
    left, which keeps rows without a partner. ``count`` is left out.
    """
    hot = F.col(count) > max(1.0, total * HOT)
    few = side.filter(hot).drop(count)
    marked = rows.join(F.broadcast(few.select(*keys).withColumn("__gl_hot", F.lit(True))), keys, "left")
    light = marked.filter("__gl_hot is null").drop("__gl_hot").join(side.filter(~hot).drop(count), keys, how)
    return rows.join(F.broadcast(few), keys).unionByName(light)
