"""Mention extraction and linking, event reification, graph-context retrieval, and the bounded corrective loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import norm_label, tokens_alnum
from graphloom.operators import agent
from graphloom.operators.graph import settle


#: Rows of a lexicon that are broadcast.
FEW = 100_000


def lexicon_mentions(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, start, end, surface, name) of lexicon words (surface, name) at word or hyphen boundaries, by start.

    A text is cut into runs of letters, digits, marks and hyphens with their
    offsets; runs meet the lexicon by hash, so no pattern per entry is tried.
    A lexicon of up to ``FEW`` rows goes to the texts, which aren't dealt out.
    """
    few = lexicon.limit(FEW + 1).count() <= FEW
    run = r"[\p{L}\p{N}\p{M}_-]+"
    words, gaps = F.regexp_extract_all("text", F.lit(run), F.lit(0)), F.split("text", run, -1)
    rows = docs.filter("text is not null").select("id", F.posexplode(F.arrays_zip(words.alias("w"), gaps.alias("g"))).alias("pos", "x"))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("x.g") + F.coalesce(F.length("x.w"), F.lit(0))).over(w)
    placed = rows.select("id", F.col("x.w").alias("surface"), end.cast("int").alias("end"))
    return placed.join(F.broadcast(lexicon) if few else lexicon, "surface").select("id", (F.col("end") - F.length("surface")).alias("start"), "end", "surface", "name")


def link(mentions: DataFrame, entities: DataFrame, k: int = 3) -> DataFrame:
    """(mention, stage, id, score): exact name, else alias, else the ``k`` best by shared tokens, else stage none.

    entities (id, name, aliases); each stage sees only what the one before
    left. Entities of one name, one alias or one set of tokens are gathered
    before mentions meet them: only the first of them by id, or the first
    ``k``, can be an answer, so a name that very many have is one row.
    """
    m = mentions.select("mention").distinct()
    named = entities.groupBy(F.col("name").alias("mention")).agg(F.min("id").alias("id"))
    exact = settle(m.join(named, "mention").select("mention", F.lit("exact").alias("stage"), "id", F.lit(1.0).alias("score")))
    left = m.join(exact, "mention", "left_anti")
    alias = entities.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a")).groupBy("a").agg(F.min("id").alias("id")).groupBy(norm_label(F.col("a")).alias("key")).agg(F.min("id").alias("id"))
    by_alias = settle(left.select("mention", norm_label(F.col("mention")).alias("key")).join(alias, "key").select("mention", F.lit("alias").alias("stage"), "id", F.lit(0.9).alias("score")))
    left = settle(left.join(by_alias, "mention", "left_anti"))
    mt = left.select("mention", F.explode(F.array_distinct(tokens_alnum(F.col("mention")))).alias("t"))
    words = F.array_join(F.array_sort(F.array_distinct(tokens_alnum(F.col("name")))), " ").alias("words")
    first = Window.partitionBy("words").orderBy("id")
    sets = settle(entities.select("id", words).distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).groupBy("words").agg(F.collect_list("id").alias("ids")))
    et = sets.filter("words <> ''").select("words", F.split("words", " ").alias("all")).select("words", F.size("all").alias("n"), F.explode("all").alias("t"))
    size = left.select("mention", F.size(F.array_distinct(tokens_alnum(F.col("mention")))).alias("m"))
    hits = mt.join(et, "t").groupBy("mention", "words", "n").agg(F.count(F.lit(1)).alias("both")).join(size, "mention").withColumn("score", F.round(2 * F.col("both") / (F.col("n") + F.col("m")), 6))
    hits = hits.join(sets, "words").select("mention", "score", F.explode("ids").alias("id"))
    top = Window.partitionBy("mention").orderBy(F.desc("score"), "id")
    text = hits.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k).select("mention", F.lit("fulltext").alias("stage"), "id", "score")
    none = left.join(text, "mention", "left_anti").select("mention", F.lit("none").alias("stage"), F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("score"))
    return exact.unionByName(by_alias).unionByName(text).unionByName(none)


def reify(events: DataFrame, roles: list[str], time_role: str) -> DataFrame:
    """(event_id, participants, time) to (event_id, role, value): time takes its role first, the other roles follow the participants in order; the shorter list ends it."""
    rest = [r for r in roles if r != time_role]
    open_roles = F.when(F.col("time").isNotNull(), F.array(*[F.lit(r) for r in rest])).otherwise(F.array(*[F.lit(r) for r in roles]))
    n = F.least(F.size(open_roles), F.size("participants"))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(open_roles, i).alias("role"), F.element_at("participants", i).alias("value")))
    timed = F.when(F.col("time").isNotNull(), F.array(F.struct(F.lit(time_role).alias("role"), F.col("time").alias("value")))).otherwise(F.array().cast("array<struct<role:string,value:string>>"))
    return events.select("event_id", F.explode(F.concat(timed, F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<role:string,value:string>>")))).alias("x")).select("event_id", "x.role", "x.value")


def measurements(claims: DataFrame) -> DataFrame:
    """Claims with a numeric value as MEASUREMENT events: subject, metric, value."""
    return claims.filter(F.col("value").rlike(r"^[0-9]")).select(F.concat_ws("-", F.lit("ev"), F.lower("subject"), F.lower("predicate")).alias("event_id"), F.lit("MEASUREMENT").alias("type"), F.create_map(F.lit("subject"), "subject", F.lit("metric"), "predicate").alias("roles"), "value")


def community_reports(nodes: DataFrame, edges: DataFrame, label: DataFrame) -> DataFrame:
    """(community, size, n_edges, text): a deterministic report of each community's inner structure; members are listed up to twenty, counts cover all."""
    a, b = label.select(F.col("id").alias("src"), "community"), label.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    inner = edges.join(a, "src").join(b, "dst").filter("community = c2").groupBy("community").agg(F.count(F.lit(1)).alias("n_edges"))
    named = nodes.join(label, "id")
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("name"))).filter("r <= 20").groupBy("community").agg(F.sort_array(F.collect_list("name")).alias("names"))
    size = named.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return size.join(first, "community").join(inner, "community", "left").select("community", "size", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.concat_ws(", ", "names").alias("text"))


def global_search(reports: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Map-reduce over reports: a report's score is the question's terms it holds, 0..10; positive ones, best first, up to ``k``.

    ``reports`` has community and text, and may have many rows of a community,
    such as one per member: their terms count once.
    """
    q = questions.select("qid", F.explode(F.array_distinct(tokens_alnum(F.col("text")))).alias("t"))
    n = questions.select("qid", F.size(F.array_distinct(tokens_alnum(F.col("text")))).alias("n"))
    r = reports.select("community", F.explode(F.array_distinct(tokens_alnum(F.col("text")))).alias("t")).distinct()
    scored = q.join(r, "t").groupBy("qid", "community").agg(F.count(F.lit(1)).alias("hit")).join(n, "qid").withColumn("score", F.round(10 * F.col("hit") / F.col("n"), 6))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "community")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "community", "score", "rank")


def corrective_loop(questions: DataFrame, retrieve, attempts: int = 3) -> DataFrame:
    """All questions at once: route, then up to ``attempts`` rounds of retrieve, grade and rewrite; one row per question and round.

    ``retrieve`` maps (qid, text) to (qid, id, text, rank). A round's best row
    grades it; a question graded relevant leaves the loop; the rest go on
    without their commonest word. Only questions are carried between rounds,
    and each round is written before the next reads it. Of rows that grade
    alike the first by rank counts.
    """
    todo, out = questions.select("qid", "text", agent.route(F.col("text")).alias("route")), None
    for attempt in range(1, attempts + 1):
        got = retrieve(todo.select("qid", "text")).select("qid", "id", "rank", F.col("text").alias("row"))
        share, _ = agent.grade(tokens_alnum(F.col("text")), tokens_alnum(F.col("row")))
        best = todo.join(got, "qid", "left").withColumn("overlap", F.coalesce(F.round(share, 6), F.lit(0.05))).groupBy("qid", "text", "route").agg(F.max(F.struct("overlap", (-F.col("rank")).alias("r"), "id")).alias("b"))
        best = settle(best.select("qid", "text", "route", "b.overlap", "b.id"))
        grade = F.when(F.col("overlap") >= 0.5, "relevant").when(F.col("overlap") <= 0.15, "irrelevant").otherwise("ambiguous")
        done = best.withColumn("grade", grade).withColumn("attempt", F.lit(attempt))
        out = done if out is None else out.unionByName(done)
        words = F.split("text", " ")
        todo = done.filter("grade <> 'relevant'").select("qid", F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))), " ").alias("text"), "route")
    return out.select("qid", "attempt", "route", "grade", "overlap", "id")
