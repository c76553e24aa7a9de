"""The deterministic question-answering harness as set operations: routing, grading, guards, cache, budget, audit, citations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import blank_string_literals

#: Routes and their signals, in order of priority: fixed values.
ROUTES = (("memory", ("earlier", "previous", "last time")), ("global", ("overall", "summary", "trend")), ("community", ("community", "cluster")), ("path", ("path", "between", "connect")), ("local", ()))
WRITE_WORDS = ("create", "merge", "delete", "set", "remove", "drop", "detach", "foreach", "load")
HOP_CAP, LIMIT_CAP = 5, 50


def route(question: Column, routes=ROUTES) -> Column:
    """The first route, by priority, one of whose signals stands in the question; the last is the default."""
    q, out = F.lower(question), F.lit(routes[-1][0])
    for name, signals in reversed(routes[:-1]):
        hit = F.lit(False)
        for s in signals:
            hit = hit | q.contains(s)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def grade(question_terms: Column, row_terms: Column) -> tuple[Column, Column]:
    """(overlap, grade) of two term arrays: the share of the question's terms; at least .5 relevant, at most .15 irrelevant, else ambiguous; without terms ambiguous at .4."""
    q = F.array_distinct(question_terms)
    share = F.when(F.size(q) == 0, F.lit(0.4)).otherwise(F.size(F.array_intersect(q, row_terms)) / F.size(q))
    return share, F.when(F.size(q) == 0, "ambiguous").when(share >= 0.5, "relevant").when(share <= 0.15, "irrelevant").otherwise("ambiguous")


def read_only_reason(query: Column) -> Column:
    """Why a graph query is refused, else null: empty, several statements, a write word, no reading entry, too many hops."""
    bare = F.lower(blank_string_literals(query))
    hops = F.aggregate(F.transform(F.regexp_extract_all(bare, F.lit(r"\*\s*(?:[0-9]+)?\s*\.\.\s*([0-9]+)"), F.lit(1)), lambda x: x.cast("int")), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.coalesce(
        F.when(F.trim(bare) == "", F.lit("EMPTY")),
        F.when(F.regexp_replace(F.trim(bare), r";\s*$", "").contains(";"), F.lit("MULTI_STATEMENT")),
        F.when(bare.rlike(r"\b(" + "|".join(WRITE_WORDS) + r")\b"), F.lit("WRITE")),
        F.when(~F.trim(bare).rlike(r"^(match|optional match|with|unwind|return|call)\b"), F.lit("NO_READ_ENTRY")),
        F.when((hops > HOP_CAP) | bare.rlike(r"\*\s*(?:[0-9]+\s*)?\.\.\s*\]|\*\s*\]"), F.lit("HOPS")),
    )


def ensure_limit(query: Column) -> Column:
    return F.when(F.lower(query).rlike(r"\blimit\s+[0-9]+"), query).otherwise(F.concat(F.regexp_replace(query, r"[;\s]+$", ""), F.lit(f" LIMIT {LIMIT_CAP}")))


def ttl_cache(calls: DataFrame, key: str, ts: str, order: str, ttl_s: int = 300) -> DataFrame:
    """Marks each call a hit or a miss of a cache whose entries live ``ttl_s`` seconds from the miss that made them.

    A miss is where the last miss of the key is at least the time to live ago:
    a fold over a key's calls in order. Calls are sorted within partitions and
    folded as they stream by, holding one time, so a key with very many calls
    needs no memory of its own. Calls without a time are left out.
    """
    rows = calls.filter(F.col(ts).isNotNull()).select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("__gl_t"), F.col(order))
    types = dict(calls.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = object(), 0
        for batch in batches:
            hits = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hit = k == at and t - made < ttl_s * 1_000_000
                if not hit:
                    at, made = k, t
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hits, pa.bool_())], names=[key, order, "hit"])

    dealt = rows.repartition(key).sortWithinPartitions(key, "__gl_t", order)
    return dealt.mapInArrow(fold, f"{key} {types[key]}, {order} {types[order]}, hit boolean")


def budget_breach(steps: DataFrame, run: str, order: list[str], tokens: str, max_tokens: int, max_calls: int) -> DataFrame:
    """The first step of each run at which tokens, then calls, exceed their limit (strictly)."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = steps.withColumn("used", F.sum(tokens).over(w)).withColumn("step", F.row_number().over(Window.partitionBy(run).orderBy(*order)))
    why = F.when(F.col("used") > max_tokens, "tokens").when(F.col("step") > max_calls, "tool_calls")
    hit = r.withColumn("limit_hit", why).filter("limit_hit is not null")
    return hit.groupBy(run).agg(F.min_by(F.struct("step", "used", "limit_hit"), "step").alias("x")).select(run, "x.step", "x.used", "x.limit_hit")


def audit_sequence(rows: DataFrame, run: str, order: list[str]) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def verify_citations(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, id, pos) with ``ok``: first mentions only, whether the evidence of the question holds the id."""
    first = cited.groupBy("qid", "id").agg(F.min("pos").alias("pos"))
    return first.join(evidence.select("qid", "id").distinct().withColumn("ok", F.lit(True)), ["qid", "id"], "left").select("qid", "id", "pos", F.coalesce("ok", F.lit(False)).alias("ok"))
