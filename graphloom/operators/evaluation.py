"""Graph-aware evaluation, set metrics, reranking and context rendering, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def multihop_hit(required: Column, walked: Column) -> Column:
    """Edges walked over hops required, one at most; one where none is required."""
    return F.when(required <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), walked / required))


def coverage(gold: Column, found: Column) -> Column:
    """Share of the distinct gold items that were found; zero without gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, found)) / F.size(g)).otherwise(F.lit(0.0))


def entity_coverage(gold: Column, found: Column) -> Column:
    """``coverage`` without case and outer blanks."""
    norm = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    return coverage(norm(gold), norm(found))


def score_cases(cases: DataFrame) -> DataFrame:
    """Per case: case, multihop_path_hit, graph_grounding_coverage, entity_coverage; cases has required_hops, edges, reference, connected, gold_entities, entities."""
    return cases.select(
        "case", multihop_hit(F.col("required_hops"), F.size("edges")).alias("multihop_path_hit"),
        coverage(F.col("reference"), F.col("connected")).alias("graph_grounding_coverage"), entity_coverage(F.col("gold_entities"), F.col("entities")).alias("entity_coverage"),
    )


def macro(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Means of the columns over all cases; zeros without cases."""
    return scores.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in columns])


def confusion(predicted: DataFrame, gold: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of ``predicted`` or ``gold`` once with its outcome: tp, fp, fn, or false_reject for a gold one that was rejected."""
    p, g = predicted.select(*keys).distinct().withColumn("p", F.lit(True)), gold.select(*keys).distinct().withColumn("g", F.lit(True))
    r = rejected.select(*keys).distinct().withColumn("r", F.lit(True))
    both = p.join(g, keys, "full").join(r, keys, "left")
    outcome = F.when(F.col("p") & F.col("g"), "tp").when(F.col("p"), "fp").when(F.col("r"), "false_reject").otherwise("fn")
    return both.select(*keys, outcome.alias("outcome"))


def success_rate(results: DataFrame, column: str) -> DataFrame:
    return results.agg(F.round(F.coalesce(F.avg(F.col(column).cast("double")), F.lit(0.0)), 6).alias("success_rate"))


def rerank_identity(fused: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each question by fused score, ties by id: qid, id, score, rank."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return fused.select("qid", "id", "score", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


def with_texts(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """Joins results back to their texts (id, text)."""
    return ranked.join(texts, "id")


def render_context(ranked: DataFrame, snippet: int = 160) -> DataFrame:
    """(qid, context): ``[id] text`` lines of the ranked rows (qid, id, rank, text) in rank order, texts cut to ``snippet`` characters."""
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.substring("text", 1, snippet))
    return ranked.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def substring_search(questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank: documents by how many of a question's words (white-space parts, repeats counted) they contain.

    Words meet documents through the documents' own distinct words only where
    equal; a word inside another counts as well, so the words of all questions
    (a stated query set) are held against each text once.
    """
    words = questions.select("qid", F.explode(F.split(F.trim("text"), r"\s+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.collect_list("qid").alias("qids"))
    hits = docs.join(words, F.col("text").contains(F.col("w"))).select("id", F.explode("qids").alias("qid"))
    scored = hits.groupBy("qid", "id").agg(F.count(F.lit(1)).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Price of a call, ``prices`` being (in, out) per million tokens by model; unknown models cost nothing."""
    out = F.lit(0.0)
    for name, (a, b) in prices.items():
        out = F.when(model == name, tokens_in / 1e6 * a + tokens_out / 1e6 * b).otherwise(out)
    return out


def trace_totals(spans: DataFrame) -> DataFrame:
    """(trace, spans, cost, latency): spans of each trace (trace, cost, latency) added up."""
    return spans.groupBy("trace").agg(F.count(F.lit(1)).alias("spans"), F.round(F.sum("cost"), 6).alias("cost"), F.sum("latency").alias("latency"))


def report_line(metric: Column, before: Column, after: Column, ok: Column) -> Column:
    """``PASS metric 0.5000 -> 0.6000`` or FAIL."""
    f = lambda v: F.format_string("%.4f", v.cast("double"))
    return F.concat(F.when(ok, F.lit("PASS ")).otherwise(F.lit("FAIL ")), metric, F.lit(" "), f(before), F.lit(" -> "), f(after))
