"""Text scalars as Column functions: normalisers, slugs, hashes, tokens, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{AC00}-\x{D7A3}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]"
#: Trailing particles that the router strips: fixed values.
JOSA = "은는이가을를의에와과도로"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """Line ends become LF, lines lose trailing blanks, trailing blank lines go, one LF ends the text."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    lines = F.regexp_replace(unix, r"(?m)[ \t\f\x0B]+$", "")
    return F.concat(F.regexp_replace(lines, r"\n+$", ""), F.lit("\n"))


def content_hash(text: Column) -> Column:
    """``sha256:`` and the first eight hex digits of the normalised text's digest."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(normalize_text(text), 256), 1, 8))


def make_version(revision: Column, digest: Column) -> Column:
    return F.concat(F.lit("v"), revision.cast("string"), F.lit("@"), digest)


def estimate_tokens_mixed(text: Column) -> Column:
    """CJK characters plus 1.3 tokens for each other word, halves to even."""
    cjk = F.regexp_count(text, F.lit(CJK))
    rest = F.filter(F.split(F.regexp_replace(text, CJK, " "), r"\s+"), lambda w: w != "")
    return (cjk + F.bround(F.size(rest) * F.lit(1.3).cast("double"))).cast("long")


def estimate_tokens_quarter(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def dedup_key(text: Column) -> Column:
    """Lower case, collapsed white space, the first 50 characters."""
    return F.substring(collapse(F.lower(text)), 1, 50)


def tokens_alnum(text: Column) -> Column:
    """Lower-cased runs of Latin letters, digits and Hangul syllables."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9\x{AC00}-\x{D7A3}]+"), F.lit(0))


def tokens_latin_then_cjk(text: Column) -> Column:
    """Latin runs (inner ``._-`` kept, lower-cased), then every CJK character."""
    latin = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[._-][a-z0-9]+)*"), F.lit(0))
    return F.concat(latin, F.regexp_extract_all(text, F.lit(CJK), F.lit(0)))


def norm_compact(text: Column) -> Column:
    """Trim, lower, hyphens to spaces, then no white space at all."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "-", " "), r"(?U)\s+", "")


def norm_label(text: Column) -> Column:
    """Lower; ``-``, ``_`` and ``/`` become spaces; collapsed."""
    return collapse(F.regexp_replace(F.lower(text), r"[-_/]", " "))


def norm_boundary(text: Column) -> Column:
    """As ``norm_label``, with a space where Hangul and Latin meet."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[-_/]", " "), r"([\x{AC00}-\x{D7A3}])([a-z0-9])", "$1 $2"), r"([a-z0-9])([\x{AC00}-\x{D7A3}])", "$1 $2")
    return collapse(spaced)


def normalize_tag(tag: Column) -> Column:
    return F.regexp_replace(F.lower(tag), r"[_ ]", "-")


def slug_ascii(text: Column) -> Column:
    """Runs outside a-z and 0-9 become a hyphen, ends trimmed, ``x`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit("x")).otherwise(s)


def slug_unicode(text: Column) -> Column:
    """Letters and digits of any script stay, runs of others become a hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "-"), r"^-+|-+$", "")


def unresolved_id(text: Column) -> Column:
    return F.concat(F.lit("ent-unresolved-"), slug_ascii(text))


def canonical_urn(text: Column) -> Column:
    return F.concat(F.lit("urn:kb:concept:"), slug_ascii(text))


def extract_title(text: Column, stem: Column) -> Column:
    """The first ``# `` heading, else the stem."""
    title = F.trim(F.regexp_extract(text, r"(?m)^# (.+)$", 1))
    return F.when(title == "", stem).otherwise(title)


def source_id_from_stem(stem: Column) -> Column:
    return F.when(stem.startswith("src-"), stem).otherwise(F.concat(F.lit("src-"), stem))


def is_source_id(value: Column) -> Column:
    return value.rlike(r"^src-[\p{Ll}\p{Nd}-]+$")


def is_sha256(value: Column) -> Column:
    return F.lower(value).rlike(r"^[0-9a-f]{64}$")


def strip_josa(word: Column) -> Column:
    """Drops a trailing particle from words of three characters or more."""
    return F.when((F.length(word) >= 3) & F.substring(word, -1, 1).isin(*JOSA), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def parse_score(text: Column) -> Column:
    """``SCORE: n`` clamped to 0..10, else 0."""
    n = F.regexp_extract(text, r"(?i)SCORE:\s*(-?[0-9]{1,9})", 1)
    return F.when(n == "", F.lit(0)).otherwise(F.least(F.greatest(n.try_cast("int"), F.lit(0)), F.lit(10)))


def wikilinks(text: Column) -> Column:
    """array<struct<target, alias, raw>> of ``[[target|alias]]``."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[[^\[\]]+\]\]"), F.lit(0))

    def parse(r: Column) -> Column:
        body = F.substring(r, F.lit(3), F.length(r) - 4)
        alias = F.trim(F.substring_index(body, "|", -1))
        return F.struct(F.trim(F.substring_index(body, "|", 1)).alias("target"), F.when(body.contains("|"), alias).alias("alias"), r.alias("raw"))

    return F.transform(raw, parse)


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def blank_string_literals(query: Column) -> Column:
    return F.regexp_replace(query, r"'[^']*'|\"[^\"]*\"", "''")


def hash_feature(token: Column) -> tuple[Column, Column]:
    """(bucket of 256, sign) of a token: the last two hex digits of its SHA-1, and the parity of the digit before them."""
    digest = F.sha1(token)
    nibble = F.conv(F.substring(digest, 38, 1), 16, 10).cast("int")
    return F.conv(F.substring(digest, 39, 2), 16, 10).cast("int"), F.when(nibble % 2 == 0, F.lit(1)).otherwise(F.lit(-1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; a zero norm counts as one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) > 0, F.sqrt(dot(x, x))).otherwise(F.lit(1.0))
    return dot(a, b) / (norm(a) * norm(b))
