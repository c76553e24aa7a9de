"""Wiki Markdown as Column functions and windows: frontmatter, links, tables, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import wikilinks

#: A heading of up to three levels, a table row, a formula.
HEADING = r"^(#{1,3})[ \t]+(.+?)[ \t]*#*\s*$"
TABLE_ROW = r"^\s*\|.*\|\s*$"
FORMULA = r"\$[^$\n]+\$|\\\[[^\]]+?\\\]"
HANGUL = r"[\x{AC00}-\x{D7A3}]"


def split_frontmatter(text: Column) -> Column:
    """struct<block, body>: the lines between a first line ``---`` and the next such line, and what follows less one empty line; null block and the whole text where there is none."""
    rest = F.concat(F.lit("\n"), F.substring(text, F.lit(5), F.length(text)), F.lit("\n"))
    close = F.when(text.startswith("---\n"), F.locate("\n---\n", rest)).otherwise(F.lit(0))
    after = F.substring(rest, close + 5, F.length(rest))
    after = F.when(F.length(after) > 0, F.substring(after, F.lit(1), F.length(after) - 1)).otherwise(F.lit(""))
    body = F.when(after.startswith("\n"), F.substring(after, F.lit(2), F.length(after))).otherwise(after)
    block = F.when(close > 1, F.substring(rest, F.lit(2), close - 1)).otherwise(F.lit(""))
    return F.when(close > 0, F.struct(block.alias("block"), body.alias("body"))).otherwise(F.struct(F.lit(None).cast("string").alias("block"), text.alias("body")))


def strict_frontmatter(text: Column) -> Column:
    """struct<block, body, error>: as a text cut at its first two ``---``; an unclosed one is an error."""
    n, opened = F.size(F.split(text, "---", 3)), text.startswith("---")
    part = lambda i: F.get(F.split(text, "---", 3), F.lit(i))
    return F.struct(
        F.when(opened & (n == 3), F.trim(F.regexp_replace(part(1), r"^\n+|\n+$", ""))).alias("block"),
        F.when(opened & (n == 3), F.regexp_replace(part(2), r"^\s+", "")).otherwise(text).alias("body"),
        F.when(~opened, F.lit("missing")).when(n < 3, F.lit("unclosed")).alias("error"),
    )


def scalar(block: Column, key: str) -> Column:
    """The value of ``key: value`` in a block, without quotes; null if absent."""
    found = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(block.rlike(rf"(?m)^{key}:"), F.regexp_replace(found, r"^['\"]|['\"]$", ""))


def listed(block: Column, key: str) -> Column:
    """The items of ``key: [a, b]`` or of the ``- item`` lines after ``key:``; empty if absent."""
    inline = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[(.*?)\]", 1)
    below = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*- .*(?:\n|$))*)", 1)
    items = F.when(inline != "", F.split(inline, ",")).otherwise(F.transform(F.regexp_extract_all(below, F.lit(r"(?m)^[ \t]*- (.*)$"), F.lit(1)), lambda x: x))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")), lambda x: x != "")


def to_wiki(title: Column, source_id: Column, tags: Column, aliases: Column, links: Column, body: Column) -> Column:
    """Frontmatter and body as one Markdown text; the body loses its leading white space."""
    some = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{name}:\n- "), F.array_join(a, "\n- "))).otherwise(F.lit(f"{name}: []"))
    head = F.concat_ws("\n", F.concat(F.lit("title: "), title), F.concat(F.lit("source_id: "), source_id), some("tags", tags), some("aliases", aliases), some("links", links))
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), F.regexp_replace(body, r"^\s+", ""))


def unique_targets(text: Column) -> Column:
    """Targets of the wiki links of a text, each once, in order."""
    return F.array_distinct(F.transform(wikilinks(text), lambda w: w["target"]))


def links_valid(links: Column) -> Column:
    return F.forall(links, lambda x: x.startswith("src-"))


def inject_links(body: Column, rules: list[tuple[str, str, str]]) -> Column:
    """For each (phrase, target, display) in turn: its first place becomes a wiki link, unless that link is there already."""
    for phrase, target, display in rules:
        link = f"[[{target}|{display}]]"
        at = F.locate(phrase, body)
        put = F.concat(F.substring(body, F.lit(1), at - 1), F.lit(link), F.substring(body, at + len(phrase), F.length(body)))
        body = F.when((at > 0) & ~body.contains(link), put).otherwise(body)
    return body


def table_blocks(md: Column) -> Column:
    """Runs of two or more lines that are table rows."""
    step = lambda a, x: F.when(x.rlike(TABLE_ROW), F.struct((a["run"] + 1).alias("run"), (a["n"] + F.when(a["run"] == 1, 1).otherwise(0)).alias("n"))).otherwise(F.struct(F.lit(0).alias("run"), a["n"].alias("n")))
    return F.aggregate(F.split(md, r"\r?\n"), F.struct(F.lit(0).alias("run"), F.lit(0).alias("n")), step, lambda a: a["n"]).cast("long")


def parse_metrics(md: Column, reference_hangul: Column) -> Column:
    """struct<table_blocks, formulas, hangul, hangul_ratio> of a parser's output."""
    hangul = F.regexp_count(md, F.lit(HANGUL)).cast("long")
    ratio = F.when(reference_hangul > 0, F.round(hangul / reference_hangul, 2))
    return F.struct(table_blocks(md).alias("table_blocks"), F.regexp_count(md, F.lit(FORMULA)).cast("long").alias("formulas"), hangul.alias("hangul"), ratio.alias("hangul_ratio"))


def strip_score_lines(text: Column) -> Column:
    """A text without its ``SCORE:`` lines, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?im)^\s*SCORE:.*(?:\n|$)", ""), r"^\s+|\s+$", "")


def sections(docs: DataFrame, text: str = "body") -> DataFrame:
    """doc_id, section (from 0), level, heading, section_path, start, end of the sections of every document.

    A section runs from the line after its heading to the next heading. Text
    before the first heading is a section of level 0 if it isn't blank, and so
    is the whole of a text without headings. A heading's path is the last
    heading of each higher level that no still higher one has closed. A text's
    lines are read where the text is, and only headings leave it.
    """
    t, none = F.col(text), F.array().cast("array<struct<line:int,at:int,level:int,heading:string,start:int>>")
    level = lambda s: F.length(F.regexp_extract(s, HEADING, 1))

    def step(a: Column, s: Column) -> Column:
        after = a["at"] + F.length(s) + 1
        head = F.struct(a["line"].alias("line"), a["at"].alias("at"), level(s).alias("level"), F.trim(F.regexp_extract(s, HEADING, 2)).alias("heading"), F.least(after, F.length(t)).alias("start"))
        return F.struct((a["line"] + 1).alias("line"), after.alias("at"), F.when(s.startswith("#") & s.rlike(HEADING), F.concat(a["heads"], F.array(head))).otherwise(a["heads"]).alias("heads"))

    read = F.aggregate(F.split(t, "\n"), F.struct(F.lit(0).alias("line"), F.lit(0).alias("at"), none.alias("heads")), step, lambda a: a["heads"])
    heads = docs.select("doc_id", F.length(t).alias("size"), t.alias("__gl_t"), F.coalesce(read, none).alias("heads"))
    blank = (F.size("heads") > 0) & ~F.coalesce(F.substring(F.col("__gl_t"), F.lit(1), F.get("heads", F.lit(0))["at"]).rlike(r"\S"), F.lit(False))
    root = F.array(F.struct(F.lit(-1).alias("line"), F.lit(0).alias("at"), F.lit(0).alias("level"), F.lit("").alias("heading"), F.lit(0).alias("start")))
    rows = heads.select("doc_id", "size", F.explode(F.concat(F.when(blank, none).otherwise(root), "heads")).alias("h")).select("doc_id", "size", "h.*")
    starts = Window.partitionBy("doc_id").orderBy("line")
    before = starts.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda level, value: F.last(F.when(F.col("level") == level, F.col(value)), ignorenulls=True).over(before)
    rows = rows.select("*", F.lead("at").over(starts).alias("next"), *[last(k, v).alias(f"{v}{k}") for k in (1, 2) for v in ("heading", "line")])
    no = F.array().cast("array<string>")
    one = F.when((F.col("level") > 1) & F.col("heading1").isNotNull(), F.array("heading1")).otherwise(no)
    two = F.when((F.col("level") > 2) & F.col("heading2").isNotNull() & (F.coalesce("line1", F.lit(-1)) < F.col("line2")), F.array("heading2")).otherwise(no)
    path = F.when(F.col("level") == 0, no).otherwise(F.concat(one, two, F.array("heading")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "level")) - 1
    return rows.select("doc_id", "level", "heading", path.alias("section_path"), "start", F.coalesce("next", "size").alias("end")).withColumn("section", number)
