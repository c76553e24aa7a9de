"""Information-theoretic sanitisation of personal data.

Base spans are e-mail addresses, IP addresses, payment cards and phone
numbers. Every mention names two protected entities: the value itself, and the
group it belongs to (an address's domain, a network of 256 addresses, a card's
issuer digits, a number's leading digits). Around each mention the words nearby
are its context terms; over the whole corpus, term t discloses entity e by its
pointwise mutual information with it, log p(e|t)/p(e), as a share of e's
information content, -log p(e). A term whose share reaches the disclosure
threshold, seen with e in enough different texts, nearly names the entity: it
is generalised to ``<TERM>``, or removed where it never stands without the
entity; its places are added to the spans.

All probabilities count distinct texts, told by a 64-bit hash, so copies change
none of them. Entities, terms and pairs travel as 64-bit hashes.

Patterns: every pattern may begin only where a match of it could begin
(a run's first character, or the end of the match before) and uses possessive
repeats, so no text takes more than a linear number of steps or a deep stack.
All work is done by JVM functions. Positions come from cutting a text at its
matches: what lies between and the matches themselves, in turn, give every
start as a running sum of lengths, made in blocks of bounded length; parts of a
text are cut from blocks of it. So the work is linear in a text's mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import HOT, join_hot, staged, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that they run in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Words around a mention that count as its context, and the letters a term has at least.
CONTEXT, TERM_LETTERS = 6, 4
#: Different texts that must show a term beside an entity, in a corpus of any size: one alone would make every word found once a disclosure of what stands beside it.
SUPPORT = 2
SPAN = "array<struct<kind:string,start:int,end:int>>"
WORD = r"\p{L}+"
#: Elements of a block of a running sum; code points of a block of a text.
RUN, PART = 128, 4096


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, value(i)).otherwise(F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda match: _valid(kind, match)


def _spanner(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["p"].alias("start"), (x["p"] + F.length(x["m"])).alias("end"), _valid(kind, x["m"]).alias("ok"))


def running(rows: DataFrame, values: str, out: str, largest: bool = False) -> DataFrame:
    """Adds ``out``: for each element of the int array ``values`` the sum (or largest, at least 0) of those before it; null gives an empty array.

    Blocks of RUN elements are summed, the blocks' sums run, and each block
    runs from its own start, so no array is copied more than RUN times.
    """
    join = (lambda a, x: F.greatest(a, x)) if largest else (lambda a, x: a + x)
    n, empty = F.size(values), F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))
    run = lambda items, start: F.aggregate(
        items, F.struct(start.alias("at"), empty.alias("out")), lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]
    )
    rows = rows.withColumn("__gl_blocks", F.when(n > 0, blocks).otherwise(F.array().cast("array<array<int>>")))
    rows = rows.withColumn("__gl_carry", run(F.transform("__gl_blocks", lambda b: F.aggregate(b, F.lit(0), join)), F.lit(0)))
    # columns enter a lambda as its arguments: the optimizer may put the expression of one used once inside in its place, to be made anew for each element
    each = F.arrays_zip(F.col("__gl_blocks").alias("b"), F.col("__gl_carry").alias("c"))
    return rows.withColumn(out, F.flatten(F.transform(each, lambda x: run(x["b"], x["c"])))).drop("__gl_blocks", "__gl_carry")


def _starts(rows: DataFrame, gaps: str, matches: str, out: str) -> DataFrame:
    """Adds ``out``: the start of every match, the running sum over the gaps and matches before it and its own gap."""
    rows = rows.withColumn("__gl_len", F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), F.col(matches).alias("m")), lambda x: F.length(x["g"]) + F.length(x["m"])))
    rows = running(rows, "__gl_len", out)
    return rows.withColumn(out, F.transform(F.arrays_zip(F.col(out).alias("p"), F.slice(gaps, F.lit(1), F.size(out)).alias("g")), lambda x: x["p"] + F.length(x["g"]))).drop("__gl_len")


def _parts(text: Column) -> Column:
    """A text in blocks of PART code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}+"), F.lit(0))


def _cut(parts: str, start: Column, end: Column) -> Column:
    """Code points start..end of the text in ``parts`` (to its end at most), reading only the blocks they lie in."""
    first, last = F.floor(start / PART).cast("int"), F.floor((end - 1) / PART).cast("int")
    return F.when(end > start, F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), start - first * PART + 1, end - start)).otherwise(F.lit(""))


def with_base_spans(rows: DataFrame, text: str = "__gl_t") -> DataFrame:
    """Adds ``spans_<kind>``: the valid matches of each kind in ``text``, by start; array<struct<kind, start, end>>, code points, end exclusive."""
    found = rows
    for kind in KINDS:
        pattern, need = PATTERNS[kind], NEEDS[kind]
        may = F.col(text).contains(need) if need else F.col(text).rlike("[0-9][- ]?[0-9]")
        found = found.withColumn(f"__gl_m_{kind}", F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    for kind in KINDS:
        m = f"__gl_m_{kind}"
        # texts without one valid match, nearly all, are not cut
        ok = F.exists(m, _checker(kind))
        found = found.withColumn(f"__gl_g_{kind}", F.when(F.coalesce(ok, F.lit(False)), F.split(text, PATTERNS[kind], -1)))
    for kind in KINDS:
        m, g, p = f"__gl_m_{kind}", f"__gl_g_{kind}", f"__gl_p_{kind}"
        found = _starts(found, g, m, p)
        spans = F.filter(F.transform(F.arrays_zip(F.col(m).alias("m"), F.col(p).alias("p")), _spanner(kind)), lambda x: x["ok"])
        plain = F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        found = found.withColumn(f"spans_{kind}", F.when(F.col(g).isNotNull(), plain).otherwise(F.array().cast(SPAN)))
    return found.drop(*[f"__gl_{x}_{k}" for k in KINDS for x in ("m", "g", "p")])


def may_match(text: Column) -> Column:
    """False only for texts without base spans. A filter on the spans themselves would make them twice, once in the filter."""
    return text.contains("@") | text.rlike(r"\+[0-9]|[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[\x20-]?[0-9]){12}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def base_spans() -> Column:
    """All base spans, by kind as listed, then start."""
    return F.concat(*[F.col(f"spans_{k}") for k in KINDS])


def _entities(kind: Column, value: Column) -> Column:
    """What a mention names, as hashes: its value without case and separators, and the group the value belongs to."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    whole = F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(digits)
    group = F.when(kind == "email", F.substring_index(F.lower(value), "@", -1)).when(kind == "ip", F.substring_index(value, ".", 3)).when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 7))
    return F.array(F.xxhash64(kind, F.lit("value"), whole), F.xxhash64(kind, F.lit("group"), group))


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def mentions(found: DataFrame) -> DataFrame:
    """One row per distinct text with base spans: hash, and for every mention its entities and the hashes of its context terms.

    A term is a word of letters within ``CONTEXT`` words of a mention, so a
    mention gives a bounded number of pairs. ``found`` has __gl_t and spans.
    """
    reach = 16 * CONTEXT
    rows = found.filter(F.size(base_spans()) > 0).select(F.xxhash64("__gl_t").alias("hash"), _parts(F.col("__gl_t")).alias("parts"), base_spans().alias("spans"))
    near = lambda before, after: F.array_distinct(F.filter(F.concat(F.slice(F.reverse(before), 1, CONTEXT), F.slice(after, 1, CONTEXT)), lambda w: F.length(w) >= TERM_LETTERS))
    terms = lambda s: near(_words(_cut("parts", F.greatest(s["start"] - reach, F.lit(0)), s["start"])), _words(_cut("parts", s["end"], s["end"] + reach)))
    each = F.transform("spans", lambda s: F.struct(_entities(s["kind"], _cut("parts", s["start"], s["end"])).alias("e"), F.transform(terms(s), lambda w: F.xxhash64(w)).alias("t")))
    return rows.select("hash", each.alias("m")).groupBy("hash").agg(F.any_value("m").alias("m"))


def disclosures(docs: DataFrame, threshold: float, support: int) -> tuple[DataFrame, DataFrame]:
    """(terms, occurrences).

    terms: term (lower case) and removed, whether it never stands without an
    entity that it discloses. occurrences: hash of each distinct text with such
    terms, those generalised (terms) and those removed (dropped) in it, and n,
    its copies. A pair of entity and term needs ``support`` different texts.
    Pairs that fail by the counts within texts that may have base spans, which
    are no higher, fail over the whole of ``docs`` too and go before that count.
    """
    some = docs.filter(may_match(F.col("text"))).select(F.col("text").alias("__gl_t"))
    found = staged(with_base_spans(some), "pii-found")
    hashed = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    copies = staged(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "pii-texts")
    n_texts, n_rows = copies.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    said = staged(mentions(found), "pii-mentions")
    # distinct texts by entity, then by pair; hot entities meet their counts by a broadcast
    once = said.select("hash", F.explode(F.array_distinct(F.flatten(F.transform("m", lambda x: x["e"])))).alias("e"))
    known = staged(once.groupBy("e").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= support), "pii-entities")
    pairs = said.select("hash", F.explode("m").alias("m")).select("hash", "m.t", F.explode("m.e").alias("e"))
    met = join_hot(pairs, known.withColumn("n", F.col("n_e")), ["e"], "n", max(1, once.count()))
    pairs = met.select("e", "n_e", "hash", F.explode("t").alias("t")).distinct().groupBy("e", "n_e", "t").agg(F.count(F.lit(1)).alias("n_et"))
    pairs = staged(pairs.filter(F.col("n_et") >= support), "pii-pairs")

    def occurs(texts: DataFrame, terms: DataFrame) -> DataFrame:
        """(hash, term, t) for the distinct texts that hold a term."""
        return texts.select("hash", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).withColumn("t", F.xxhash64("term")).join(_small(terms), "t").distinct()

    share = F.log(F.col("n_et") * F.lit(float(max(n_texts, 1))) / (F.col("n_t") * F.col("n_e"))) / F.greatest(F.log(F.lit(float(max(n_texts, 2))) / F.col("n_e")), F.lit(1e-9))
    scored = lambda seen: pairs.join(seen.groupBy("t").agg(F.count(F.lit(1)).alias("n_t")), "t").filter(share >= threshold - 1e-9)
    within = occurs(found.select(F.col("__gl_t").alias("text"), F.xxhash64("__gl_t").alias("hash")), pairs.select("t").distinct())
    possible = staged(scored(within).select("t").distinct(), "pii-possible")
    everywhere = staged(occurs(hashed, possible), "pii-occurrences")
    kept = scored(everywhere).groupBy("t").agg(F.max(F.col("n_et") == F.col("n_t")).alias("removed"))
    kept = staged(kept.join(everywhere.select("t", "term").distinct(), "t").select("t", "term", "removed"), "pii-terms")
    of_text = everywhere.select("hash", "t").join(_small(kept), "t").groupBy("hash").agg(
        F.collect_set(F.when(~F.col("removed"), F.col("term"))).alias("terms"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("dropped")
    )
    hot = copies.filter(F.col("n") > max(1.0, n_rows * HOT))
    marked = of_text.join(hot, "hash", "full").select("hash", "terms", "dropped", F.coalesce("n", F.lit(0)).alias("n"))
    return kept.select("term", "removed"), staged(marked, "pii-hits")


def _small(terms: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marks a table of terms for a broadcast if it has at most ``rows`` of them (some MB); a larger one is joined by a shuffle."""
    return F.broadcast(terms) if terms.limit(rows + 1).count() <= rows else terms


def term_spans(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds ``spans_term``: the places in ``__gl_t`` of terms to generalise (kind term) or remove (kind dropped), by ``hits`` of its text.

    Texts with very many copies (``hits.n`` over 0) meet their hits by a
    broadcast; they are fewer than 1 / HOT. The others may move by their hash.
    """
    if hits.isEmpty():
        return rows.withColumn("spans_term", F.array().cast(SPAN))
    own = F.struct("terms", "dropped")
    hot = hits.filter("n > 0").select(F.col("hash").alias("__gl_hash"), own.alias("__gl_a"), F.lit(True).alias("__gl_hot"))
    light = hits.filter("n = 0").select(F.col("hash").alias("__gl_key"), own.alias("__gl_b"))
    both = rows.withColumn("__gl_hash", F.xxhash64("__gl_t")).join(F.broadcast(hot), "__gl_hash", "left")
    both = both.withColumn("__gl_key", F.when(F.col("__gl_hot"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("__gl_hash"))).join(light, "__gl_key", "left")
    both = both.withColumn("__gl_x", F.when(F.col("__gl_hot"), F.col("__gl_a")).otherwise(F.col("__gl_b"))).drop("__gl_a", "__gl_b", "__gl_hot", "__gl_key", "__gl_hash")
    some = F.col("__gl_x.terms").isNotNull()
    both = both.withColumn("__gl_m", F.when(some, F.regexp_extract_all("__gl_t", F.lit(WORD), F.lit(0)))).withColumn("__gl_g", F.when(some, F.split("__gl_t", WORD, -1)))
    both = _starts(both, "__gl_g", "__gl_m", "__gl_p")
    kind = lambda m: F.when(F.array_contains("__gl_x.terms", F.lower(m)), "term").when(F.array_contains("__gl_x.dropped", F.lower(m)), "dropped")
    spans = F.filter(
        F.transform(F.arrays_zip(F.col("__gl_m").alias("m"), F.col("__gl_p").alias("p")), lambda x: F.struct(kind(x["m"]).alias("kind"), x["p"].alias("start"), (x["p"] + F.length(x["m"])).alias("end"))),
        lambda x: x["kind"].isNotNull(),
    )
    return both.withColumn("spans_term", F.coalesce(spans, F.array().cast(SPAN))).drop("__gl_m", "__gl_g", "__gl_p", "__gl_x")


def _sanitised(rows: DataFrame) -> DataFrame:
    """Adds ``__gl_new``: ``__gl_t`` with its spans replaced, a base span by its kind in angle brackets, a term by ``<TERM>``, a removed one by nothing; a span that begins inside another extends it."""
    spans = F.sort_array(F.transform(F.concat(base_spans(), F.col("spans_term")), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    rows = rows.withColumn("__gl_s", spans).withColumn("__gl_e", F.transform("__gl_s", lambda s: -s["less"]))
    rows = running(rows, "__gl_e", "__gl_at", largest=True).withColumn("__gl_parts", F.when(F.size("__gl_s") > 0, _parts(F.col("__gl_t"))))
    sign = lambda s: F.when(s["kind"] == "dropped", F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    each = F.arrays_zip(F.col("__gl_s").alias("s"), F.col("__gl_at").alias("at"))
    pieces = F.transform(each, lambda x: F.when(x["s"]["start"] >= x["at"], F.concat(_cut("__gl_parts", x["at"], x["s"]["start"]), sign(x["s"]))).otherwise(F.lit("")))
    tail = _cut("__gl_parts", F.array_max("__gl_e"), F.length("__gl_t"))
    return rows.withColumn("__gl_new", F.when(F.size("__gl_s") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("__gl_t"))).drop("__gl_s", "__gl_e", "__gl_at", "__gl_parts")


def find(docs: DataFrame, threshold: float = 0.95, support: int = SUPPORT) -> DataFrame:
    """doc_id, text and the spans of every row of ``docs``: spans_email, spans_ip, spans_card, spans_phone, spans_term.

    Null text counts as empty; equal rows get equal spans; an empty table gives
    no rows; other columns are ignored. ``threshold`` is the share of an
    entity's information content that a term may disclose; ``support`` the
    different texts that must show it, the same for every size of ``docs``.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__gl_t"))
    found = with_base_spans(rows)
    _, hits = disclosures(docs, threshold, support)
    return term_spans(found, hits).withColumnRenamed("__gl_t", "text")


def disclosing_terms(docs: DataFrame, threshold: float = 0.95, support: int = SUPPORT) -> DataFrame:
    """The terms (term, removed) that disclose an entity of ``docs``."""
    return disclosures(docs, threshold, support)[0]


def sanitise(docs: DataFrame, threshold: float = 0.95, support: int = SUPPORT) -> DataFrame:
    """``docs`` with its personal data and disclosing terms replaced in ``text``; rows and other columns stay; null text stays null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__gl_row"), F.coalesce(F.col("text"), F.lit("")).alias("__gl_t"))
    found = with_base_spans(rows)
    _, hits = disclosures(docs, threshold, support)
    done = _sanitised(term_spans(found, hits))
    new = F.when(F.col("__gl_row.text").isNotNull(), F.col("__gl_new"))
    return done.select(*[(new if c == "text" else F.col(f"__gl_row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: personal data in every whole text."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base_spans()), 256).alias("base_sha256"),
        joined(F.concat(base_spans(), F.col("spans_term"))).alias("spans"),
        F.size("spans_term").cast("long").alias("n_term"),
    )
