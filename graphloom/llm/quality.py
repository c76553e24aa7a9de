"""Quality rules with risk-controlled thresholds.

Fixed base rules reject outright. Beyond them, a stratum (language) has a rule
set: cutoffs on text features, any of which rejects. A set may reject only if
an exact binomial (Clopper-Pearson) bound shows that it falsely rejects at
most a share ``risk`` of the stratum's good documents, all its cutoffs taken
together, at a confidence that holds over all strata (Bonferroni); within a
stratum the sets tested grow by one cutoff at a time in a fixed order and the
first that fails ends the tests, which needs no further correction.

Labelled texts are split by a hash of the text, so that copies are one draw
and lie on one side: a third proposes the cutoffs and their order, the rest,
untouched by that choice, certifies. Strata too small for any certificate are
pooled, and if the pool is too small as well, all strata are one; the bound
then holds for the pool as a whole.

Everything per document is one projection over JVM functions; what reaches
the driver is a histogram of labelled texts by stratum, feature and bin.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WS, staged, table

#: Bins of a feature's histogram; every feature is scaled to 0..1.
BINS = 50
#: Features that a cutoff may reject: at this value or above.
FEATURES = ("f_symbols", "f_dup_lines", "f_repeats", "f_long_words", "f_short_words", "f_few_marks")
#: One in so many labelled texts proposes cutoffs; the others certify them.
PROPOSE = 3
#: Languages; all others, and null, form one more stratum.
STRATA = ("de", "en", "es", "fr")
WINDOW = 5
MIN_WORDS = 10


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WS), "")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, th (hash of the text) and the features of every whole text: the counts of the contract and the scaled features of the cutoffs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.col("lang").alias("lang"), F.xxhash64(text).alias("th"), text.alias("__gl_t"), words_of(text).alias("__gl_w"))
    return _measured(base, ("doc_id", "lang", "th"))


def _measured(base: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Adds the features. Repeated words: a sort by window hash brings equal
    windows together; the positions of those with an equal neighbour, sorted,
    cover five words each, less the overlap with the next.
    """
    n = F.size("__gl_w") - (WINDOW - 1)
    shifted = F.arrays_zip(*[F.slice("__gl_h", F.lit(k + 1), F.col("__gl_n")) for k in range(WINDOW)])
    windows = F.transform(shifted, lambda x: F.xxhash64(x))
    lines = F.filter(F.split(F.col("__gl_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = base.select(
        *keep,
        F.size("__gl_w").cast("long").alias("n_words"),
        F.length(F.array_join("__gl_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__gl_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("__gl_t", r"[^.,;:?!]+", "")).cast("long").alias("n_marks"),
        lines.alias("__gl_l"),
        F.when(n > 1, F.transform("__gl_w", lambda w: F.xxhash64(w))).alias("__gl_h"),
        n.alias("__gl_n"),
    )
    step = step.select("*", F.when(F.col("__gl_n") > 1, windows).alias("__gl_x")).drop("__gl_h")
    # a text without equal windows, as most are, needs no sort
    step = step.withColumn("__gl_x", F.when(F.size(F.array_distinct("__gl_x")) < F.size("__gl_x"), F.col("__gl_x")))
    pairs = F.sort_array(F.transform("__gl_x", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    step = step.withColumn("__gl_s", pairs).drop("__gl_x")
    near = F.filter("__gl_s", lambda x, i: (F.get(F.col("__gl_s"), i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(F.col("__gl_s"), i - 1)["h"] == x["h"])))
    step = step.withColumn("__gl_p", F.sort_array(F.transform(near, lambda x: x["p"]))).drop("__gl_s")
    cover = F.transform("__gl_p", lambda p, i: F.least(F.coalesce(F.get(F.col("__gl_p"), i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("__gl_p")
    step = step.withColumn("n_lines", F.size("__gl_l").cast("long")).withColumn("n_dup_lines", (F.size("__gl_l") - F.size(F.array_distinct("__gl_l"))).cast("long")).drop("__gl_l", "__gl_n")
    w, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    step = step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return step.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        clip(F.col("n_symbols") / c * 5).alias("f_symbols"),
        clip(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("f_dup_lines"),
        clip(F.col("n_repeat_words") / w).alias("f_repeats"),
        clip((c / w - 3) / 12).alias("f_long_words"),
        clip((8 - c / w) / 8).alias("f_short_words"),
        clip(1 - F.col("n_marks") / w * 4).alias("f_few_marks"),
    )


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a share, k of n seen, at confidence 1 - delta."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _binomial_cdf(k, n, mid) > delta else (lo, mid)
    return hi


def _binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) = I_{1-p}(n - k, k + 1), by Lentz's continued fraction."""
    return _incomplete_beta(n - k, k + 1, 1 - p)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * f


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled distinct texts that pass the base rules, by stratum: s, th, q (1 good, 0 bad), proposing, and the features' bins.

    ``labels`` has doc_id and quality (1 good, 0 bad; other values and nulls
    are left out); a text is good if any of its labels says so.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id"), F.col("quality").alias("__gl_q"))
    bins = [F.floor(F.col(f) * BINS).cast("int").alias(f) for f in FEATURES]
    rows = measured.filter("not base_failed").select("doc_id", "th", stratum(F.col("lang")).alias("s"), *bins).join(known, "doc_id")
    return rows.groupBy("s", "th").agg(F.max("__gl_q").alias("q"), *[F.max(f).alias(f) for f in FEATURES]).withColumn("proposing", F.pmod("th", F.lit(PROPOSE)) == 0)


def pools(good: dict[str, int], risk: float, delta: float) -> dict[str, list[str]]:
    """Strata by the pool they are tested in, from their numbers of certifying good texts.

    A stratum stands alone if it could certify a set without any false
    rejection at the level that as many pools as strata leave; the others are
    pooled ("pooled"); if these can't either, all strata are one ("all").
    """
    able = lambda n, k: n and binomial_upper(0, n, delta / max(1, k)) <= risk
    alone = [s for s in sorted(good) if able(good[s], len(good))]
    rest = [s for s in sorted(good) if s not in alone]
    if rest and not able(sum(good[s] for s in rest), len(alone) + 1):
        return {"all": sorted(good)}
    return {**{s: [s] for s in alone}, **({"pooled": rest} if rest else {})}


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, gain: float = 0.9) -> dict[str, dict[str, int]]:
    """Certified rule sets: stratum to feature to the smallest rejected bin; strata without a certified cutoff have an empty set.

    On the proposing part a feature's cutoff is the lowest bin whose false
    rejections stay under ``risk`` / 2 while at least a share ``gain`` of what
    it rejects is bad; cutoffs are ordered by how many bad texts they reject.
    On the certifying part the exact bound of the union of the first k cutoffs,
    at ``delta`` over the number of pools, must not exceed ``risk``; the
    largest k before the first failure holds.
    """
    rows = staged(labelled(measured, labels), "quality-labelled")
    good = {r["s"]: r["n"] for r in rows.groupBy("s").agg(F.sum(((F.col("q") == 1) & ~F.col("proposing")).cast("long")).alias("n")).collect()}
    sets = pools(good, risk, delta)
    pool = F.lit(None).cast("string")
    for name, members in sets.items():
        pool = F.when(F.col("s").isin(members), F.lit(name)).otherwise(pool)
    rows = rows.withColumn("pool", pool)
    bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x")
    counts: dict = {}
    for r in rows.filter("proposing").select("pool", "q", bins).groupBy("pool", "q", "x").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault((r["pool"], r["x"]["f"]), {}).setdefault(r["q"], [0] * (BINS + 1))[r["x"]["b"]] += r["n"]
    tail = lambda c, q, b: sum(c.get(q, ())[b:])
    proposed: dict[str, list[tuple[int, str, int]]] = {}
    for (name, f), c in sorted(counts.items()):
        for b in range(1, BINS + 1):
            false, bad = tail(c, 1, b), tail(c, 0, b)
            if bad and bad >= gain * (false + bad) and false <= risk / 2 * max(1, tail(c, 1, 0)):
                proposed.setdefault(name, []).append((-bad, f, b))
                break
    order = {name: [(f, b) for _, f, b in sorted(found)] for name, found in proposed.items()}
    # false rejections by the first k cutoffs of a pool's order, in one pass
    unions = []
    for k in range(len(FEATURES)):
        hit = F.lit(False)
        for name, found in order.items():
            if k < len(found):
                hit = hit | ((F.col("pool") == name) & reduce(lambda a, x: a | x, [F.col(f) >= b for f, b in found[: k + 1]]))
        unions.append(F.sum(hit.cast("long")).alias(f"u{k}"))
    out: dict[str, dict[str, int]] = {s: {} for s in good}
    for r in rows.filter("q = 1 and not proposing").groupBy("pool").agg(F.count(F.lit(1)).alias("n"), *unions).collect():
        for k, (f, b) in enumerate(order.get(r["pool"], [])):
            if binomial_upper(r[f"u{k}"], r["n"], delta / len(sets)) > risk:
                break
            for s in sets[r["pool"]]:
                out[s][f] = b
    return out


def rejects(cutoffs: dict[str, dict[str, int]]) -> Column:
    """True where a certified cutoff of the row's stratum is reached."""
    s = stratum(F.col("lang"))
    hits = [(s == k) & (F.floor(F.col(f) * BINS) >= b) for k, found in cutoffs.items() for f, b in found.items()]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def certified(cutoffs: dict[str, dict[str, int]]) -> Column:
    """Whether the row's stratum has a certified rule set."""
    return stratum(F.col("lang")).isin([s for s, found in cutoffs.items() if found])


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, certified (whether a certified rule set judged it beside the base rules).

    Null text counts as no words and fails; null or unknown languages share a
    stratum; equal rows get equal verdicts; without labels only the base rules
    reject; an empty table gives no rows; other columns are ignored.
    """
    measured = staged(features(docs), "quality")
    cutoffs = thresholds(measured, labels, risk, delta)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejects(cutoffs)).alias("kept"), certified(cutoffs).alias("certified"),
    )


def filter_documents(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Rows are written once beside their measures, and both the cutoffs and the
    filter read that table: each text is measured once, no join brings
    verdicts back to the texts, and no predicate repeats the measures.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__gl_row")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(row, F.col("doc_id"), F.col("lang"), F.xxhash64(text).alias("th"), text.alias("__gl_t"), words_of(text).alias("__gl_w"))
    measured = staged(_measured(base, ("__gl_row", "doc_id", "lang", "th")).select("__gl_row", "doc_id", "lang", "th", "base_failed", *FEATURES), "quality-rows")
    cutoffs = thresholds(measured, labels, risk, delta)
    return measured.filter(~F.col("base_failed") & ~rejects(cutoffs)).select("__gl_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document, cutoffs from all labels."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
