"""Histogram sort by its laws; the URL filter against plain code."""

import zlib
from collections import defaultdict

from threadloom.llm import histogram_sort, url_bloom

from . import cases


def check_shards(rows, docs, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    expected = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == expected
    return [sum(r.size for r in by[i]) for i in range(shards)]


def test_shards_have_nearly_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = histogram_sort.shards_digest(docs).collect()
    plain = docs.select("doc_id", "text").collect()
    sizes = check_shards(rows, plain, 40)
    largest = max(len((r.text or "").encode()) + 16 for r in plain)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_shards_cut_a_hot_group_of_copies(spark):
    docs = cases.docs(spark, [(i, "hot " * 20 if i % 3 else f"text {i} " * 12, "en", "a", 1) for i in range(6000)])
    rows = histogram_sort.shards_digest(docs).collect()
    sizes = check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 40)
    assert max(sizes) < 1.05 * min(sizes)
    whole = histogram_sort.histogram_shards(docs, shards=3)
    assert whole.columns == [*docs.columns, "sharding"] and whole.count() == 6000
    order = whole.orderBy("sharding.shard", "sharding.slot").select("sharding.key").collect()
    assert order == sorted(order)


def test_shards_of_awkward_rows(spark):
    docs = cases.docs(spark)
    check_shards(histogram_sort.shards_digest(docs).collect(), [r[:2] for r in cases.ROWS], 40)
    check_shards(histogram_sort.shards_digest(cases.docs(spark, [(5, "x", None, None, 1)] * 900)).collect(), [(5, "x")] * 900, 40)
    assert histogram_sort.shards_digest(cases.empty(spark)).collect() == []


URLS = [
    None, "", "no scheme", "://", "http://", "http://A.Example.NET/en/x?y#z", "http://example.net/de/x", "http://xnet/", "http://net", "http://net/",
    "ftp://a.net?/en/", "http://example.com/de/", "http://notexample.com/de/a", "http://m.example.com/de", "http://fr.org/fr/1", "http://org#/fr/",
    "http://b.org/en/", "http://www.b.org/en", "https://m.b.org/en.html?x=1", "https://b.org/en/2", "http://ÄB.org/En/", "http://b.org/en/",
]


def plain_verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end : min((rest.index(c, end) for c in "?#" if c in rest[end:]), default=len(rest))]
    fits = [r for r in url_bloom.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    canon = host
    for prefix in ("www.", "m.", "blog."):
        if host.startswith(prefix):
            canon = host[len(prefix) :]
            break
    canon += path[:-1] if path.endswith("/") else path[:-5] if path.endswith(".html") else path
    return host, path, rule and rule.name, canon in listed, rule.verdict if rule else "block" if canon in listed else "allow"


def test_urls_against_plain_code(spark):
    listed = {"b.org/en", "example.com/de", "never.example/x"}
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, judged string")
    table = spark.createDataFrame([(x,) for x in [*listed, None, "b.org/en"]], "u string")
    rows = url_bloom.judge_urls(pages, table).collect()
    assert all(r.judged.possible for r in rows if r.judged.listed)
    assert {r.page_id: (r.judged.host, r.judged.path, r.judged.rule, r.judged.listed, r.judged.verdict) for r in rows} == {i: plain_verdict(u, listed) for i, u in enumerate(URLS)}
    assert len(rows) == len(URLS)
    assert url_bloom.judge_urls(pages.limit(0), table).count() == 0
    assert url_bloom.judge_urls(pages, table.limit(0)).filter("judged.listed").count() == 0


def test_filter_has_no_false_negative_and_few_positives(spark):
    keys = spark.range(5000).selectExpr("concat('h.example/', id) as k")
    table = url_bloom.bloom_blocks(keys, "k", 5000 * 16 // 512)
    from pyspark.sql import functions as F

    asked = spark.range(15000).selectExpr("id", "concat('h.example/', id) as k").withColumn("block", url_bloom._block(F.col("k"), 5000 * 16 // 512))
    hit = asked.join(table, "block").filter(" and ".join(["true"]))
    for i in range(url_bloom.WORDS):
        hit = hit.filter(url_bloom._bit(F.col("k"), i).bitwiseAND(F.col(f"w{i}")) != 0)
    inside, outside = hit.filter("id < 5000").count(), hit.filter("id >= 5000").count()
    assert inside == 5000 and outside < 200


def test_urls_by_hash_join_when_the_list_is_large(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    small = {tuple(r) for r in url_bloom.urls_digest(pages).collect()}
    monkeypatch.setattr(url_bloom, "size_checked", lambda table, *a, **b: table.hint("merge"))
    assert {tuple(r) for r in url_bloom.urls_digest(pages).collect()} == small


def test_a_column_with_the_result_s_name_is_replaced(spark):
    docs = cases.docs(spark).withColumnsRenamed({"kept": "sharding", "hash": "row", "key": "part", "spans": "slot"})
    found = histogram_sort.histogram_shards(docs, shards=4)
    assert found.columns == [c for c in docs.columns if c != "sharding"] + ["sharding"] and len(found.collect()) == len(cases.ROWS)
