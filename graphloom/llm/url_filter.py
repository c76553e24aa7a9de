"""URL filter: longest-match rules, then a listed-URL test by a blocked Bloom filter and an exact hash join.

The list holds canonical URLs: a host, a slash and a path, without scheme,
query, fragment, a leading ``www.`` or a trailing slash. Each url of a page
is tested under its lookup keys: its canonical URL, and the bare host with all
its parent domains that have no more labels than some list entry. Distinct keys pass a blocked Bloom filter (one
256-bit block of eight 32-bit lanes per key, one bit in each lane); possible
hits go to an exact join with the list, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import join_hot, staged, table

#: (action, host, path) of the contract's rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Hosts whose pages are unwanted whatever their path; a list entry is a canonical URL, so a whole host is the host and a slash.
LISTED_HOSTS = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
LANES = 8


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up to ``?``, ``#`` or end. Null or no ``://``: both empty."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rules(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls; a rule fits its host and all subdomains, if the path starts with its own."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def canonical(host: Column, path: Column) -> Column:
    """Canonical URL: host without ``www.`` and port, a path without a trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^www\.", "")
    return F.concat(bare, F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"/+$", ""))


def parent_keys(host: Column, longest: int) -> Column:
    """Keys of a host and its parent domains of two to ``longest`` labels, the most that a list entry has."""
    bare = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^www\.", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.greatest(n - max(longest, 2), F.lit(0)), F.greatest(n - 2, F.lit(0))), lambda i: F.concat(F.array_join(F.slice(labels, i + 1, n - i), "."), F.lit("/")))
    return F.filter(parents, lambda k: F.length(k) > 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit in each lane, five bits of a second hash per lane."""
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(LANES)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: block, lane0 … lane7."""
    rows = listed.select(_block(F.col("entry"), blocks).alias("block"), *[b.alias(f"lane{i}") for i, b in enumerate(_bits(F.col("entry")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def listed_keys(keys: DataFrame, listed: DataFrame, keys_per_block: int = 16) -> DataFrame:
    """Those of ``keys`` (column ``entry``) that ``listed`` (column ``entry``) holds: Bloom filter first, exact join after."""
    listed = listed.filter("entry is not null").distinct()
    blocks = max(1, -(-listed.count() // keys_per_block))
    bloom = bloom_blocks(listed, blocks)
    possible = keys.withColumn("block", _block(F.col("entry"), blocks)).join(bloom, "block")
    for i, b in enumerate(_bits(F.col("entry"))):
        possible = possible.filter(F.col(f"lane{i}").bitwiseAND(b) == b)
    return possible.select("entry").join(listed, "entry", "left_semi")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Judge every url of ``pages`` (page_id, url).

    Returns page_id, host, path, rule, verdict, listed (the list entries that
    the url hits, sorted). The verdict is that of the longest rule that fits;
    without one it is block for listed urls and allow for the rest. Null urls
    and urls without ``://`` have empty host and path, fit nothing and are
    allowed; equal rows are judged one by one; other columns are ignored.
    Keys are made distinct before they meet the list, so a host that holds a
    third of the rows costs one lookup.
    """
    host, path = host_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = match_rules(F.col("host"), F.col("path"), rules)
    split = split.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    open_rows = split.filter("rule is null and host <> ''")
    urls = staged(open_rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    longest = listed.agg(F.max(F.size(F.split(F.substring_index("entry", "/", 1), r"\.")))).first()[0] or 0
    hosts = urls.groupBy("host").agg(F.sum("n").alias("n"))
    of_host = hosts.select("host", "n", F.explode(parent_keys(F.col("host"), longest)).alias("entry"))
    of_url = urls.select("host", "path", "n", canonical(F.col("host"), F.col("path")).alias("entry"))
    hits = staged(listed_keys(of_host.select("entry").union(of_url.select("entry")).distinct(), listed), "listed-keys")
    found = lambda pairs, *keys: pairs.join(hits, "entry").groupBy(*keys).agg(F.sort_array(F.collect_set("entry")).alias("listed"), F.max("n").alias("n"))
    by_host = found(of_host, "host")
    by_url = found(of_url, "host", "path").withColumnRenamed("listed", "listed_url")
    rows = staged(by_host.withColumnRenamed("listed", "listed_host"), "listed-hosts")
    total = urls.agg(F.sum("n")).first()[0] or 0
    split = join_hot(join_hot(split, rows, ["host"], "n", total, "left"), staged(by_url, "listed-urls"), ["host", "path"], "n", total, "left")
    both = F.sort_array(F.array_distinct(F.concat(F.coalesce("listed_host", F.array().cast("array<string>")), F.coalesce("listed_url", F.array().cast("array<string>")))))
    ruled = F.col("rule").isNotNull()
    return split.withColumn("listed", F.when(~ruled, both)).select(
        "page_id", "host", "path", "rule",
        F.when(ruled, F.col("action")).otherwise(F.when(F.size("listed") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "listed",
    )


def listed_hosts(spark: SparkSession, hosts=LISTED_HOSTS) -> DataFrame:
    return spark.sql("select concat(h, '/') as entry from (select explode(array(" + ",".join(f"'{h}'" for h in hosts) + ")) as h)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every url of ``pages``."""
    return judge_urls(table(spark, sf_dir, "pages"), listed_hosts(spark)).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """DuckDB SQL for ``query``."""
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    hosts = ", ".join(f"('{h}')" for h in LISTED_HOSTS)
    return rf"""
with rules(action, rhost, rpath) as (values {rules}),
listed(entry) as (values {hosts}),
rest as (select row_number() over () as rid, page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as r from pages),
parts as (select rid, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
best as (select rid, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(action, length(rhost || rpath)) as action
  from parts join rules on (host = rhost or suffix(host, '.' || rhost)) and starts_with(path, rpath) group by rid),
bare as (select rid, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^www\.', '') as b from parts),
hit as (select distinct rid from bare join listed on b = entry or suffix(b, '.' || entry))
select page_id, host, path, rule, coalesce(action, case when hit.rid is not null then 'block' else 'allow' end) as verdict
from parts left join best using (rid) left join hit using (rid)
"""
