"""Agent control flow as columns: routes, modes, tool inputs, checkpoints, fallbacks, evidence and citations, query text checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signals of the router, the mode selector and the checkpoint: fixed values.
SCHEMA_HINTS = ("스키마", "온톨로지", "타당", "허용된 관계", "방향이 맞", "관계가 맞")
BROAD_HINTS = ("요약", "개괄", "전체", "전반", "무엇들", "어떤 것들", "정리해", "개요", "landscape")
RELATION_HINTS = ("관계", "연결", "경로", "사이", "이웃", "어떻게 이어", "무엇과", "연관")
MULTIHOP_HINTS = ("어떻게 이어", "관계", "거쳐", "사이", "연결", "통해 ")
GLOBAL_HINTS = ("전체", "전반", "요약", "공통", "트렌드", "한눈에", "정리해")
MODES = {"simple-fact": "naive", "multi-hop": "local", "global-summary": "global"}
WRITE_LIKE = r"(?iU)\b(delete|remove|drop|create|merge|set|detach|update|insert|삭제|제거|변경|생성|수정)\b"
SENSITIVE = r"(?i)(비밀번호|password|주민등록|계좌|결제|카드번호|개인정보|api[_\s-]?key|secret|token)"
DANGEROUS = r"(?i)\bapoc\.(create|merge|refactor|periodic|trigger|load|export|do)\b|\bdbms\.|\bdb\.(create|drop|clear)"
LABEL = r"\(\s*(?:[A-Za-z_][A-Za-z0-9_]*)?\s*:\s*([A-Za-z_][A-Za-z0-9_]*)"
RELATION = r"\[\s*[A-Za-z_]*\s*:\s*([A-Za-z_][A-Za-z0-9_]*)"
ROW_TEXT_KEYS = ("text", "from", "to", "neighbor", "relation", "entity", "path", "answer", "name", "reason")
LOW_CONFIDENCE = 0.5


def _any(text: Column, hints: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | text.contains(h)
    return out


def known_entities(question: Column, names: list[str]) -> Column:
    """Those of ``names`` that a question contains, without case, by their first place in it."""
    low = F.lower(question)
    found = F.array_compact(F.array(*[F.when(low.contains(n.lower()), F.struct(F.locate(n.lower(), low).alias("at"), F.lit(i).alias("i"), F.lit(n).alias("name"))) for i, n in enumerate(names)]))
    return F.transform(F.array_sort(found), lambda x: x["name"])


def route(question: Column, entities: Column) -> Column:
    """schema, broad, relation or simple, by the first signal that holds; two known entities ask for a relation."""
    return F.when(_any(question, SCHEMA_HINTS), "schema").when(_any(question, BROAD_HINTS), "broad").when(_any(question, RELATION_HINTS) | (F.size(entities) >= 2), "relation").otherwise("simple")


def tool_input(kind: Column, question: Column, entities: Column, default: str) -> Column:
    """struct<tool, template, source, target, mode, k> of a route."""
    two = (kind == "relation") & (F.size(entities) >= 2)
    return F.struct(
        F.when(kind == "schema", "ontology_check").when(kind == "simple", "docs_search").otherwise("graph_query").alias("tool"),
        F.when(two, "path_between").when(kind == "relation", "neighbors").alias("template"),
        F.when(kind == "relation", F.coalesce(F.get(entities, F.lit(0)), F.lit(default))).alias("source"),
        F.when(two, F.get(entities, F.lit(1))).alias("target"),
        F.when(kind == "broad", "global").alias("mode"),
        F.when(kind == "simple", 3).alias("k"),
    )


def guess_type(question: Column) -> Column:
    return F.when(_any(question, GLOBAL_HINTS), "global-summary").when(_any(question, MULTIHOP_HINTS), "multi-hop").otherwise("simple-fact")


def mode_of(kind: Column) -> Column:
    """The mode of a question type; ``mix`` for any other."""
    out = F.lit("mix")
    for name, mode in MODES.items():
        out = F.when(kind == name, mode).otherwise(out)
    return out


def assess(question: Column, answer: Column, score: Column) -> Column:
    """Reasons for a person to approve an answer first: low score, words of writing, sensitive words."""
    both = F.concat(question, F.lit("\n"), answer)
    return F.array_compact(F.array(F.when(score < LOW_CONFIDENCE, "low score"), F.when(both.rlike(WRITE_LIKE), "write-like"), F.when(both.rlike(SENSITIVE), "sensitive")))


def approval(reasons: Column, automatic: bool = True) -> Column:
    return F.when(F.size(reasons) == 0, "not-needed").otherwise("auto-approve" if automatic else "ask")


def empty_or_error(result: Column) -> Column:
    """Whether a tool's JSON result is missing, an error, blocked, or has no rows."""
    rows = F.get_json_object(result, "$.rows")
    return result.isNull() | F.get_json_object(result, "$.error").isNotNull() | F.coalesce(F.get_json_object(result, "$.blocked") == "true", F.lit(False)) | F.coalesce(rows == "[]", F.lit(False)) | (F.trim(result) == "[]")


def with_fallback(primary: Column, fallback: Column) -> Column:
    """struct<result, used>: the primary result, or the fallback's where that is empty or an error."""
    bad = empty_or_error(primary)
    return F.struct(F.when(bad, fallback).otherwise(primary).alias("result"), F.when(bad, "fallback").otherwise("primary").alias("used"))


def rows_of(result: Column) -> Column:
    """Rows of a JSON result as JSON strings: a list, the list under ``rows``, or an object as one row."""
    body = F.coalesce(F.get_json_object(result, "$.rows"), F.when(F.trim(result).startswith("["), result), F.concat(F.lit("["), result, F.lit("]")))
    return F.filter(F.from_json(body, "array<string>"), lambda x: F.trim(x).startswith("{"))


def _field(row: Column, name: str) -> Column:
    value = F.get_json_object(row, f"$.{name}")
    return F.when(value != "", value)


def row_text(row: Column) -> Column:
    """The known text fields of a row, in their order, joined by spaces."""
    return F.concat_ws(" ", *[F.get_json_object(row, f"$.{k}") for k in ROW_TEXT_KEYS])


def graph_key(row: Column) -> Column:
    """``a -[R]-> b`` of a path row, ``a ~ b`` of a neighbour row, the path of others, else null."""
    arrow = lambda a, r, b: F.when(_field(row, a).isNotNull() & _field(row, b).isNotNull(), F.concat(_field(row, a), F.lit(" -["), F.coalesce(F.get_json_object(row, f"$.{r}"), F.lit("REL")), F.lit("]-> "), _field(row, b)))
    near = F.when(_field(row, "neighbor").isNotNull(), F.concat(F.coalesce(_field(row, "entity"), _field(row, "name"), F.lit("?")), F.lit(" ~ "), _field(row, "neighbor")))
    return F.coalesce(arrow("from", "relation", "to"), arrow("source", "relation", "target"), near, _field(row, "path"))


def citations(row: Column) -> Column:
    """array<struct<id, kind, source>> of a row: its chunk, else its graph key and its source."""
    chunk, key, source = _field(row, "chunk_id"), graph_key(row), F.coalesce(_field(row, "source"), _field(row, "source_id"))
    c = lambda i, kind, s: F.struct(i.alias("id"), kind.alias("kind"), s.alias("source"))
    document = c(chunk, F.lit("chunk"), F.coalesce(_field(row, "source_id"), _field(row, "source")))
    graph = F.array_compact(F.array(F.when(key.isNotNull(), c(key, F.lit("graph"), _field(row, "source"))), F.when(source.isNotNull(), c(source, F.when(key.isNotNull(), "graph").otherwise("source"), source))))
    return F.when(chunk.isNotNull(), F.array(document)).otherwise(graph)


def evidence_index(results: DataFrame) -> DataFrame:
    """(question, id, kind, source): the citations of all results (question, seq, result) of a question, the first of each id."""
    rows = results.select("question", "seq", F.posexplode(rows_of(F.col("result"))).alias("row", "r"))
    each = rows.select("question", "seq", "row", F.posexplode(citations(F.col("r"))).alias("n", "c"))
    first = each.groupBy("question", F.col("c.id").alias("id")).agg(F.min(F.struct("seq", "row", "n", "c.kind", "c.source")).alias("f"))
    return first.select("question", "id", "f.kind", "f.source")


def shorten(value: Column, size: int = 200) -> Column:
    return F.when(F.length(value) > size, F.concat(F.substring(value, 1, size), F.lit("…"))).otherwise(value)


def labels_in(query: Column) -> Column:
    """Node labels of a query text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(LABEL), F.lit(1)))


def relations_in(query: Column) -> Column:
    """Relation types of a query text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(RELATION), F.lit(1)))


def unknown_terms(query: Column, labels: list[str], relations: list[str]) -> Column:
    """array<struct<kind, item>>: labels and relation types of a query text that the ontology does not have, without case."""
    lost = lambda found, known, kind: F.transform(F.filter(found, lambda x: ~F.lower(x).isin([k.lower() for k in known])), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))
    return F.concat(lost(labels_in(query), labels, "unknown_label"), lost(relations_in(query), relations, "unknown_relation"))


def statements(query: Column) -> Column:
    """Parts of a query text between semicolons that aren't blank."""
    return F.size(F.filter(F.split(query, ";"), lambda s: F.trim(s) != "")).cast("long")


def dangerous_procedure(query: Column) -> Column:
    """The first procedure name part that a reader must not call, else null."""
    found = F.regexp_extract(query, DANGEROUS, 0)
    return F.when(found != "", F.lower(found))


def first_json(text: Column) -> Column:
    """From the first brace to the last, else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def split_citations(claimed: Column, allowed: Column) -> Column:
    """struct<kept, unknown>: claimed ids in order, each once, by whether they are allowed."""
    ids = F.array_distinct(claimed)
    return F.struct(F.filter(ids, lambda x: F.array_contains(allowed, x)).alias("kept"), F.filter(ids, lambda x: ~F.array_contains(allowed, x)).alias("unknown"))


def mock_query(question: Column) -> Column:
    """Query text for the neighbours of the first quoted name of a question, else null."""
    name = F.regexp_extract(question, r"['\"]([^'\"]+)['\"]", 1)
    return F.when(name != "", F.concat(F.lit("MATCH (n {name: '"), name, F.lit("'})-[r]-(m) RETURN m.name, type(r) LIMIT 25")))
