import collections
import re

import duckdb
import pytest

from graphloom.llm import quality, sharding, url_filter

from .helpers import awkward, docs, empty


def test_shards_are_even_and_slots_gapless(spark):
    d = "/root/testdata/sf0.01"
    rows = sharding.query(spark, d).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    total = sum(r["size"] for r in rows)
    assert sorted(by) == list(range(24)) and len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    largest = max(r["size"] for r in rows)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 24) <= max(0.02 * total / 24, largest)


def test_one_group_of_copies_is_dealt_out(spark):
    frame = docs(spark, ["the same text again"] * 300 + [f"text {i}" for i in range(100)])
    sizes = collections.Counter()
    for r in sharding.kd_shards(frame, 8).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) <= 1.05 * min(sizes.values()) + 60


def test_one_row_repeated_is_dealt_out(spark):
    """Rows equal in doc_id and text, alone and beside others."""
    for rows in ([(7, "one row again")] * 2400, [(7, "one row again")] * 1200 + [(i, f"text {i}") for i in range(1200)]):
        sizes, slots = collections.Counter(), collections.defaultdict(list)
        for r in sharding.kd_shards(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string"), 24).collect():
            sizes[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert len(sizes) == 24 and max(sizes.values()) <= 1.05 * min(sizes.values()) + 100
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_kd(rows, shards, dims):
    """Shard by row: cut at the weighted median of the widest dimension, by exact cumulative sums over sorted keys."""
    out, level = {}, [(list(rows), 0, shards)]
    while level:
        part, first, n = level.pop()
        if n == 1 or not part:
            out.update((r["at"], first) for r in part)
            continue
        spread = [max(r[f"k{i}"] for r in part) - min(r[f"k{i}"] for r in part) for i in range(dims)]
        dim = f"k{spread.index(max(spread))}"
        want, below, best = sum(r["size"] for r in part) * (n // 2) / n, 0, None
        weights = collections.Counter()
        for r in part:
            weights[r[dim]] += r["size"]
        for k in sorted(weights):
            for cut, left in ((k, below), (k + 1, below + weights[k])):
                if best is None or abs(left - want) < best[0]:
                    best = (abs(left - want), cut)
            below += weights[k]
        left = [r for r in part if r[dim] < best[1]]
        level += [(left, first, n // 2), ([r for r in part if r[dim] >= best[1]], first + n // 2, n - n // 2)]
    return out


def test_shards_against_brute_force(spark, sf_dir, monkeypatch):
    """Every row's shard, and so every cut, equals that of a k-d tree built by sorting."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    keys = sharding._keys

    def keep(rows, dims):
        # of rows with unique ids only the row hash depends on the row's place; leave it out, so that keys can be made again
        kept["rows"] = keys(rows, dims).selectExpr("doc_id", "size", "text_crc32", *[f"k{i} - pmod(k{i}, {1 << sharding.ROW_BITS}) as k{i}" for i in range(len(dims))])
        return kept["rows"]

    monkeypatch.setattr(sharding, "_keys", keep)
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(d, 24, tolerance=0.0).collect()}
    rows = [{**r.asDict(), "at": r["doc_id"]} for r in kept["rows"].collect()]
    assert got == brute_kd(rows, 24, 3)


@pytest.mark.parametrize("make,n", [(awkward, 9), (empty, 0)])
def test_shards_awkward(spark, make, n):
    assert sharding.kd_shards(make(spark), 4).count() == n


def test_url_filter_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = sorted(map(tuple, con.sql(url_filter.oracle()).fetchall()), key=str)
    assert sorted(map(tuple, url_filter.query(spark, sf_dir).collect()), key=str) == want


def test_url_filter_cases(spark):
    urls = ["HTTP://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "http://notexample.com", "x://org/es/", "no scheme", None, "://", "http://www.bad.org/p/", "http://sub.bad.org", "http://host.net/listed/page?x=1", "http://host.net/listed", "http://EXAMPLE.net/de/81", "http://a.net/de/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.org/",), ("host.net/listed/page",), (None,)], "entry string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, listed).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2] == ("notexample.com", "", None, "allow") and got[3][2:] == ("org/es/", "block")
    assert got[4] == got[5] == got[6] == ("", "", None, "allow")
    assert got[7][3] == got[8][3] == got[9][3] == "block" and got[10][3] == "allow"
    assert got[11][2:] == ("example.net/de/8", "block") and got[12][2:] == ("net/de/", "allow")
    assert url_filter.judge_urls(pages.limit(0), listed.limit(0)).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('h', id, '.org/') as entry")
    assert url_filter.listed_keys(keys, keys.filter("hash(entry) % 3 = 0"), 4).count() == keys.filter("hash(entry) % 3 = 0").count()


def brute_quality(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    n = collections.Counter(grams)
    covered = {j + k for j, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_counts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = quality.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == brute_quality(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(awkward(spark), labels).collect()
    assert len(rows) == 9
    for r, text in zip(sorted(rows, key=lambda r: (r["doc_id"] or -1, r["n_words"])), [r["text"] for r in sorted(awkward(spark).collect(), key=lambda r: (r["doc_id"] or -1, len((r["text"] or "").split())))], strict=True):
        assert tuple(r)[1:7] == brute_quality(text)
    assert quality.judge(empty(spark), labels).count() == 0


def test_any_number_of_labels_before_a_listed_host(spark):
    urls = ["http://a.b.c.d.e.spam-farm.example.com/x", "http://" + "a." * 300 + "spam-farm.example.com", "http://a.b.c.d.e.f.farm.example.com/", "http://localhost/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, url_filter.listed_hosts(spark)).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_binomial_bound_is_exact():
    for k, n, delta in ((0, 10, 0.05), (3, 50, 0.01), (20, 4000, 0.001)):
        p = quality.binomial_upper(k, n, delta)
        from math import comb

        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - delta) < 1e-6


def brute_features(t):
    n, chars, symbols, dup, covered, failed = brute_quality(t)
    marks = sum(c in ".,;:?!" for c in t or "")
    lines = sum(bool(re.search(r"[^\x20\x09-\x0d]", x)) for x in (t or "").split("\n"))
    w, c = max(n, 1), max(chars, 1)
    values = (symbols / c * 5, dup / max(lines, 1), covered / w, (c / w - 3) / 12, (8 - c / w) / 8, 1 - marks / w * 4)
    return failed, [int(min(max(v, 0.0), 1.0) * quality.BINS) for v in values]


def exact_upper(k, n, delta):
    """Clopper-Pearson by summing the binomial distribution in rationals of floats."""
    from math import comb

    lo, hi = 0.0, 1.0
    for _ in range(50):
        p = (lo + hi) / 2
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        lo, hi = (p, hi) if tail > delta else (lo, p)
    return hi


def brute_kept(rows, labels, hashes, risk=0.02, delta=0.05, gain=0.9):
    """(kept, certified) by doc_id, straight from the definition."""
    lang = lambda x: x if x in quality.STRATA else "other"
    feats = {i: brute_features(t) for i, t, _ in rows}
    texts = {}
    for i, _, g in rows:
        for q in labels.get(i, ()):
            if not feats[i][0]:
                old = texts.get((lang(g), hashes[i]))
                texts[lang(g), hashes[i]] = (max(q, old[0]) if old else q, feats[i][1])
    part = lambda keep: [(s, q, f) for (s, h), (q, f) in texts.items() if (h % quality.PROPOSE == 0) == keep]
    first, second = part(True), part(False)
    strata = sorted({s for s, _ in texts})
    good = {s: sum(1 for t, q, _ in second if t == s and q) for s in strata}
    can = lambda n, k: n and (1 - (delta / k) ** (1 / n)) <= risk
    alone = [s for s in strata if can(good[s], len(strata))]
    rest = [s for s in strata if s not in alone]
    sets = [[s] for s in alone] + ([rest] if rest else [])
    if rest and not can(sum(good[s] for s in rest), len(alone) + 1):
        sets = [strata]
    rules = {s: [] for s in strata}
    for members in sets:
        mine = [(q, f) for s, q, f in first if s in members]
        proposed = []
        for j, name in enumerate(quality.FEATURES):
            for b in range(1, quality.BINS + 1):
                false, bad = (sum(1 for q, f in mine if q == x and f[j] >= b) for x in (1, 0))
                if bad and bad >= gain * (false + bad) and false <= risk / 2 * max(1, sum(q for q, _ in mine)):
                    proposed.append((-bad, name, j, b))
                    break
        held = [f for s, q, f in second if s in members and q]
        for k, (_, _, j, b) in enumerate(sorted(proposed)):
            union = sum(any(f[i] >= c for _, _, i, c in sorted(proposed)[: k + 1]) for f in held)
            if not held or exact_upper(union, len(held), delta / len(sets)) > risk:
                break
            for s in members:
                rules[s].append((j, b))
    return {i: (not feats[i][0] and not any(feats[i][1][j] >= b for j, b in rules.get(lang(g), ())), bool(rules.get(lang(g)))) for i, _, g in rows}


def test_kept_against_brute_force(spark):
    """On tables large enough for certificates: each verdict of the method."""
    d = "/root/testdata/sf0.01"
    from pyspark.sql import functions as F

    frame = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in frame.collect()]
    hashes = {r["doc_id"]: r["h"] for r in frame.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    labels = collections.defaultdict(list)
    for r in spark.read.parquet(f"{d}/labels.parquet").filter("quality in (0, 1)").collect():
        labels[r["doc_id"]].append(r["quality"])
    want = brute_kept(rows, labels, hashes)
    got = {r["doc_id"]: (r["kept"], r["certified"]) for r in quality.query(spark, d).collect()}
    assert got == want
    assert any(c for _, c in got.values())


def test_pools():
    assert quality.pools({"en": 2000, "de": 900, "fr": 100, "es": 200}, 0.02, 0.05) == {"de": ["de"], "en": ["en"], "pooled": ["es", "fr"]}
    assert quality.pools({"en": 2000, "fr": 10}, 0.02, 0.05) == {"all": ["en", "fr"]}
    assert quality.pools({}, 0.02, 0.05) == {}


def test_cutoffs_hold_the_risk(spark):
    """Bad texts with many symbols are cut; good ones of a language without bad ones are left alone."""
    good = [" ".join(f"w{(i * 7 + k) % 97}{k}" for k in range(30)) + f" n{i}" for i in range(1200)]
    bad = [" ".join(f"w{(i * 5 + k) % 89}{k}###" for k in range(30)) + f" n{i}" for i in range(200)]
    frame = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1200), 0) for i in range(1400)], "doc_id long, quality int, toxic int")
    rows = quality.judge(frame, labels).collect()
    assert all(r["kept"] for r in rows if r["doc_id"] < 1200)
    assert not any(r["kept"] for r in rows if r["doc_id"] >= 1200)


def test_copies_are_one_draw(spark):
    """1200 labels on 97 different good texts are too few to certify anything."""
    good = [" ".join(f"w{(i * 7 + k) % 97}{k}" for k in range(30)) for i in range(1200)]
    bad = [" ".join(f"w{(i * 5 + k) % 89}{k}###" for k in range(30)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 1200), 0) for i in range(1400)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] and not r["certified"] for r in quality.judge(docs(spark, good + bad), labels).collect())
