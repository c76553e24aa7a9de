"""Section-bounded chunks: sentences gathered under a token budget, with exact offsets.

A section that fits the budget is one chunk; else prefix sums of its sentences'
tokens tell, by binary search, how far each chunk reaches. Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the token estimate, the sentence end and the heading.
CJK = re.compile("[　-〿぀-ヿ㐀-䶿一-鿿가-힣]")
WORD = re.compile("[A-Za-z0-9]+")
SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+")
HEADING = re.compile(r"^(#{1,3})[ \t]+(.+?)[ \t]*#*\s*$")
QUOTE = 60
SCHEMA = "doc_id long, chunk_id string, version string, heading string, section_path array<string>, start int, end int, tokens int, text string, quote string"


def tokens(text: str) -> int:
    """CJK characters plus 1.3 for each run of Latin letters and digits, halves to even."""
    return len(CJK.findall(text)) + round(len(WORD.findall(text)) * 1.3)


def sections(body: str) -> list[tuple[str, tuple[str, ...], int, int]]:
    """(heading, path, start, end) of each section; what is before the first heading, or all of a text without one, has no heading."""
    lines = body.splitlines(keepends=True)
    starts = list(accumulate(map(len, lines), initial=0))
    heads = [(at, at + len(line), m) for at, line in zip(starts, lines, strict=False) if (m := HEADING.match(line.rstrip("\n")))]
    first = heads[0][0] if heads else len(body)
    out = [("", (), 0, first)] if not heads or body[:first].strip() else []
    above: dict[int, str] = {}
    for (_, start, m), end in zip(heads, [*[at for at, _, _ in heads[1:]], len(body)], strict=False):
        level, title = len(m[1]), m[2].strip()
        above = {k: v for k, v in above.items() if k < level} | {level: title}
        out.append((title, tuple(above[k] for k in sorted(above)), start, end))
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences, without the white space between them."""
    gaps = [m.span() for m in SENTENCE_END.finditer(text)]
    edges = zip([0, *[b for _, b in gaps]], [*[a for a, _ in gaps], len(text)], strict=True)
    return [(a, b) for a, b in edges if b > a] or [(0, len(text))]


def spans(text: str, budget: int, overlap: int = 1) -> list[tuple[int, int]]:
    """Spans of the chunks of a stripped section: as many whole sentences as the budget holds, one at least; each begins ``overlap`` sentences before the end of the last, but moves on."""
    if not text or tokens(text) <= budget:
        return [(0, len(text))] if text else []
    parts = sentences(text)
    total = list(accumulate((tokens(text[a:b]) for a, b in parts), initial=0))
    out, i, j = [], 0, 0
    while j < len(parts):
        j = max(i + 1, bisect_right(total, total[i] + budget) - 1)
        out.append((parts[i][0], parts[j - 1][1]))
        i = max(j - overlap, i + 1)
    return out


def chunk(body: str, name: str, budget: int, overlap: int = 1) -> Iterator[tuple]:
    """(chunk id, heading, path, start, end, tokens, text, quote) of a document's chunks, section by section."""
    for s, (heading, path, a, b) in enumerate(sections(body)):
        inner = body[a:b].strip()
        base = a + len(body[a:b]) - len(body[a:b].lstrip())
        for n, (x, y) in enumerate(spans(inner, budget, overlap)):
            yield f"{name}#s{s}-{n}", heading, list(path), base + x, base + y, tokens(inner[x:y]), inner[x:y], inner[x:y][:QUOTE]


def chunk_documents(docs: DataFrame, budget: int = 220, overlap: int = 1) -> DataFrame:
    """docs (doc_id, text, and version if there is one) to chunks, whose text is the document's between start and end.

    Null text counts as empty and gives no chunk; rows without doc_id are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (doc_id, chunk_id, version, *rest)
                for doc_id, text, version in zip(pdf["doc_id"], pdf["text"], pdf["version"], strict=True)
                for chunk_id, *rest in chunk(text or "", str(doc_id), budget, overlap)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "version", "heading", "section_path", "start", "end", "tokens", "text", "quote"])

    version = "version" if "version" in docs.columns else "cast(null as string) as version"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text", version).filter("doc_id is not null").mapInPandas(run, SCHEMA)
