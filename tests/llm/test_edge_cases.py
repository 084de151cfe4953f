"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every operator."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, mixing, minhash, quality_mil, quality_rules, sharding, token_counts, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string, shard string, n_tokens string, v string, n string, key string"
PROSE = " ".join(f"word{i % 97} and thing{i % 89}" for i in range(60))


def docs(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, l, s, 0, "x", "x", "x", "x", "x", "x", "x", "x") for i, t, l, s in rows], SCHEMA)


ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "en", None), (None, "short text", None, "c"),
    (6, "one", "en", "a"), (7, "long " * 30_000 + "end", "en", "a"), (8, "x" * 200_000, "en", "a"), (9, "É <|endoftext|> ü " + PROSE.upper(), "fr", "b"),
]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")


def no_rows(spark):
    return docs(spark, []).where("false")


def test_token_counts(spark):
    out = {r.doc_id: r for r in token_counts.query(docs(spark)).collect()}
    assert (out[3].n_bytes, out[3].n_tokens, out[3].over_limit) == (0, 0, False)
    assert out[7].over_limit and out[8].n_bytes == 200_000
    assert token_counts.query(no_rows(spark)).count() == 0


def test_quality_rules(spark):
    out = {r.doc_id: r for r in quality_rules.query(docs(spark)).collect()}
    assert len(out) == 10
    assert (out[3].n_words, out[3].word_chars, out[3].base_failed, out[3].kept) == (0, 0, True, False)
    assert out[7].n_repeat_words == 30_000 and out[7].base_failed
    assert out[1].kept
    assert quality_rules.query(no_rows(spark)).count() == 0


def test_quality_fences_change_little_by_little(spark):
    """One document more never moves a small group's fences at once; a large group has its own, a tiny one nearly its language's."""
    base = [(i, " ".join(f"w{(i * 7 + j) % 500}{'#' if (i + j) % 40 == 0 else ''}" for j in range(80)), "en", "big") for i in range(300)]
    odd = [(1000 + i, " ".join(f"w{(i * 11 + j) % 700}{'##' if j % 3 == 0 else ''}" for j in range(80)), "en", "odd") for i in range(60)]
    fence = []
    for n in (1, 20, 49, 50, 51, 60):
        out = quality_rules.judge(docs(spark, base + odd[:n])).where("source = 'odd'").agg(F.max("hi_symbol")).first()[0]
        fence.append(out)
    big = quality_rules.judge(docs(spark, base)).agg(F.max("hi_symbol")).first()[0]
    assert fence == sorted(fence) and abs(fence[3] - fence[2]) < 0.03 * fence[3] and abs(fence[4] - fence[3]) < 0.03 * fence[3]
    assert abs(fence[0] - big) < 0.2 * big and fence[-1] > 1.5 * big


def test_quality_classifier(spark, labels):
    out = {r.doc_id: r for r in quality_mil.query(docs(spark), labels).collect()}
    assert out[3].score == out[4].score == out[5].score == 0.0 and all(0 <= r.score <= 1 for r in out.values())
    none = quality_mil.query(docs(spark), labels.where("false")).where("doc_id = 1").first()
    assert (none.score, none.predicted) == (0.5, 1)
    assert quality_mil.query(no_rows(spark), labels).count() == 0


def test_toxicity(spark, labels):
    out = {r.doc_id: r for r in toxicity.query(docs(spark), labels).collect()}
    assert out[3].score == 0.0 and all(0 <= r.score <= 1 for r in out.values())
    assert toxicity.query(docs(spark), labels.where("false")).where("doc_id = 1").first().score == 0.0
    assert toxicity.query(no_rows(spark), labels).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(1, PROSE), (2, PROSE), (3, None), (4, ""), (5, "one"), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.query(docs(spark), items).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (6, 5), (9, 1), (9, 2)}
    assert decontaminate.query(no_rows(spark), items).count() == 0
    assert decontaminate.query(docs(spark), items.where("false")).count() == 0
    assert decontaminate.drop_leaks(docs(spark), items).columns == docs(spark).columns


def test_decontamination_by_items_without_id(spark):
    items = spark.createDataFrame([(None, PROSE), (None, "short text"), (5, "one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.query(docs(spark), items).collect()}
    assert got == {(1, None), (2, None), (9, None), (None, None), (6, 5)}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs(spark), items).collect()} == {3, 4, 5, 7, 8}


def test_near_dedup(spark):
    out = minhash.query(docs(spark)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 11
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert (by[3].n_shingles, by[3].component_id, by[3].kept) == (0, 3, True)
    assert by[4].component_id == 4 and by[5].component_id == 5 and by[6].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    assert minhash.query(no_rows(spark)).count() == 0
    assert [r.doc_id for r in minhash.drop_near_duplicates(docs(spark)).where("doc_id <= 2").collect()] == [1]


def test_url_filter(spark, labels):
    urls = ["http://A.Example.com/en/7x?q", "https://b.com/en/1#f", "x.net/de/1", None, "http://net/de/", "http://sub.example.net/de/81", "http://xnet/de/1", "http://e.org?x=/es/", "http://e.org/es/", "://", "http://HOST"]
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.query(pages, labels).collect()}
    assert out[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert out[1] == ("b.com", "/en/1", "com/en/", "block")
    assert out[2] == out[3] == ("", "", None, "allow")
    assert out[4] == ("net", "/de/", "net/de/", "block")
    assert out[5][2:] == ("example.net/de/8", "allow")
    assert out[6][2] is None and out[7] == ("e.org", "", None, "allow") and out[8][2:] == ("org/es/", "block")
    assert out[9][:2] == ("", "") and out[10][:2] == ("host", "")
    assert url_filter.query(pages.where("false"), labels).count() == 0


def test_url_rules_are_mined(spark):
    rows = [(f"http://{'spam-' if i % 3 == 0 else ''}site{i}.example.org/{'win' if i % 3 == 0 else 'news'}/{i}", i % 3 == 0) for i in range(300)]
    mined = url_filter.mine(spark.createDataFrame(rows, "url string, blocked boolean"))
    assert mined.blocks("http://spam-new.example.org/x") and not mined.blocks("http://other.example.org/news/5") and not mined.blocks(None)


def test_url_rules_from_all_labels(spark):
    """A hot URL whose hash comes first does not push the others out."""
    hot = spark.range(100_000).select(F.concat(F.lit("http://hot.example.org/"), "id").alias("u")).agg(F.min_by("u", F.xxhash64("u")).alias("u")).first().u
    rows = [(f"http://spam-site{i}.example.org/x", True) for i in range(400)]
    labelled = spark.range(51_000).select(F.lit(hot).alias("url"), F.lit(False).alias("blocked")).union(spark.createDataFrame(rows, "url string, blocked boolean"))
    mined = url_filter.mine(labelled)
    assert mined.blocks("http://spam-new.example.org/y") and not mined.blocks(hot)


def test_url_rules_from_whole_paths(spark):
    long = "x" * 250
    parts = [("a/b/c/{}/d", "casino", "news"), ("{}24", "win", "day"), ("{}", long, "y" * 250), ("{}9/b/c/d/e/f/g7", "p", "q")]
    for k, (path, bad, good) in enumerate(parts):
        rows = [(f"http://site{i}.example.org/{path.format(bad if i % 3 == 0 else good)}", i % 3 == 0) for i in range(90)]
        mined = url_filter.mine(spark.createDataFrame(rows, "url string, blocked boolean"))
        assert mined.blocks(f"http://other.example.org/{path.format(bad)}") and not mined.blocks(f"http://other.example.org/{path.format(good)}"), k


@pytest.mark.parametrize("wide", [16, 1])
def test_url_rules_are_all_least_sets(spark, wide):
    """Against brute force, with a rule of five tokens; by FP-growth and level by level."""
    rng = random.Random(5)
    rows = [(f"http://h.org/?{'&'.join(k for k in 'abcdefg' if rng.random() < 0.8)}", i) for i in range(600)]
    rows = [(u, set("abcde") <= set(u) or (i % 7 == 0 and "f" not in u)) for u, i in rows]
    mined = url_filter.mine(spark.createDataFrame(rows, "url string, blocked boolean"), wide=wide)
    sets = [(frozenset(url_filter.tokens(u)), b) for u, b in rows]
    want: list[frozenset[str]] = []
    every = sorted(frozenset().union(*(s for s, _ in sets)))
    for size in range(1, len(every) + 1):
        for c in map(frozenset, itertools.combinations(every, size)):
            hit = [b for s, b in sets if c <= s]
            if sum(hit) >= 20 and sum(hit) >= 0.95 * len(hit) and not any(w <= c for w in want):
                want.append(c)
    assert set(mined.rules) == set(want) and max(map(len, mined.rules)) == 5
    assert all(r["lift"] > 1 and r["confidence"] >= 0.95 for r in mined.report())


def planted_pages(spark):
    """Pages of bad documents stand on two patterns that no given rule fits; one pattern alone is clean."""
    rows, bad = [], []
    for i in range(600):
        spam, casino = i % 6 == 0, i % 6 == 1
        host = f"spam-{i % 5}.shop.biz" if spam else f"site{i % 9}.biz" if i % 6 < 4 else f"site{i % 9}.net"
        path = "casino/deep/er" if casino or i % 6 == 5 else "news"
        rows.append((i, f"http://{host}/{path}/{i}.html"))
        bad.append((i, 0 if spam or casino else 1, 0))
    rows += [(1000, "http://spam-77.new.biz/x"), (1001, "http://other.biz/casino/deep/er/"), (1002, "http://other.net/casino/deep/er/"), (1003, "http://a.com/en/9"), (1004, None), (1004, "nothing")]
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad + [(0, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


def test_mined_rules_block_pages_that_no_given_rule_fits(spark):
    import duckdb

    pages, labels = planted_pages(spark)
    got = url_filter.query(pages, labels).toPandas()
    out = {r.page_id: (r.rule, r.verdict) for r in got.itertuples()}
    assert out[1000] == (None, "block") and out[1001] == (None, "block") and out[1002] == (None, "allow")
    assert out[1003] == ("com/en/", "block") and out[1004] == (None, "allow")
    assert all(out[i][1] == ("block" if i % 6 < 2 else "allow") for i in range(600))
    c = duckdb.connect()
    c.register("pages", pages.toPandas())
    c.register("labels", labels.toPandas())
    want = c.sql(url_filter.oracle()).df()
    key = lambda d: sorted(str([None if v != v else v for v in r]) for r in d[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False))
    assert key(got) == key(want)


def test_mixing(spark):
    out = mixing.query(docs(spark)).collect()
    assert len(out) == 11 and all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in out)
    assert sum({(r.source_size, r.target): r.target for r in out}.values()) > 0
    again = mixing.query(docs(spark)).collect()
    key = lambda rs: sorted((r.doc_id or -1, r.size, r.taken) for r in rs)
    assert key(out) == key(again)
    assert mixing.query(no_rows(spark)).count() == 0
    assert mixing.mix(docs(spark)).columns == docs(spark).columns


def test_warc(spark):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (None, "u", big), (6, "u", "\r\n\r\n" * 300)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    out = {r.page_id: r for r in warc.query(pages).collect()}
    assert len(out) == 7
    assert (out[2].record_type, out[2].refers_to) == ("response", None)
    assert (out[1].record_type, out[1].refers_to) == ("revisit", 2) and (out[None].record_type, out[None].refers_to) == ("revisit", 2)
    assert out[3].payload_bytes == 0 and out[4].record_type == out[5].record_type == "response"
    assert warc.query(pages.where("false")).count() == 0


def test_sharding(spark):
    out = sharding.query(docs(spark)).collect()
    assert len(out) == 11
    for s in {r.shard for r in out}:
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.query(no_rows(spark)).count() == 0
    assert "virtual_slot" in sharding.assign(docs(spark)).columns and sharding.assign(docs(spark)).where(F.col("shard").isNull()).count() == 0
