"""String similarity that the built-ins lack: indel ratio of sorted tokens, as an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit) | (row - hit)
    return (~row & ((1 << len(a)) - 1)).bit_count()


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """100 * 2 LCS / (|a| + |b|) of the texts with their tokens sorted."""
    x, y = " ".join(sorted((a or "").split())), " ".join(sorted((b or "").split()))
    return 100.0 if x == y else 200.0 * lcs(x, y) / (len(x) + len(y))


@F.pandas_udf(DoubleType())
def token_sort_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x, y) for x, y in zip(a, b, strict=True)])


def fuzzy_pairs(names: DataFrame, percent: int = 90) -> DataFrame:
    """(type, a, b, ratio): pairs of different names (type, name) of one type whose sorted tokens are alike to ``percent`` or more.

    At a ratio r two strings differ by at most (1 - r) (|a| + |b|) letters put
    in or left out, which is d = floor(2 |a| (1 - r) / r) for the longest
    partner. Each breaks two bigrams at most, so a pair shares one of the
    2 d + 1 rarest bigrams of either (repeats of a bigram are told apart): only
    names that meet in one are compared.
    """
    r = percent / 100
    rows = names.filter("name is not null").distinct().withColumn("s", F.array_join(F.array_sort(F.filter(F.split("name", r"\s+"), lambda w: w != "")), " "))
    n = F.length("s")
    grams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring("s", i, F.lit(2)))
    one = rows.select("type", "name", n.alias("n"), F.posexplode(F.when(n > 1, grams).otherwise(F.array("s"))).alias("pos", "g"))
    one = one.withColumn("g", F.concat_ws("#", "g", F.row_number().over(Window.partitionBy("type", "name", "g").orderBy("pos")).cast("string")))
    seen = one.groupBy("type", "g").agg(F.count(F.lit(1)).alias("seen"))
    ranked = one.join(seen, ["type", "g"]).withColumn("k", F.row_number().over(Window.partitionBy("type", "name").orderBy("seen", "g")))
    prefix = ranked.filter(F.col("k") <= 2 * F.floor(2 * F.col("n") * (1 - r) / r + 1e-9) + 1).select("type", "g", "name", "n")
    a, b = prefix.select("type", "g", F.col("name").alias("a"), F.col("n").alias("la")), prefix.select("type", "g", F.col("name").alias("b"), F.col("n").alias("lb"))
    pairs = a.join(b, ["type", "g"]).filter((F.col("a") < F.col("b")) & (2 * F.least("la", "lb") >= r * (F.col("la") + F.col("lb")) - 1e-9)).select("type", "a", "b").distinct()
    return pairs.withColumn("ratio", F.round(token_sort_ratio_udf("a", "b"), 4)).filter(F.col("ratio") >= percent)
