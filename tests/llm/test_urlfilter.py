import compare
import numpy as np
from spanlab.llm import urlfilter as U


def test_pages_against_sql(spark, sf):
    compare.same(U.listed_pages(spark.read.parquet(f"{sf}/pages.parquet")), U.pages_sql(), compare.duck(sf))


def test_cascade_is_exact_and_small():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 50_000), dtype=np.uint64)
    for share in (0.0, 0.001, 0.2, 0.9, 1.0):
        listed = rng.random(len(a)) < share
        levels = U.build(a, b, listed, U.PARAMS["first_rate"], U.PARAMS["rate"])
        assert (U.contains(levels, a, b) == listed).all()
        assert sum(len(x.bits) for x in levels) < 16 + 4 * 50_000 * min(1, share * 4 + 0.01)


def test_sharded_lookup_equals_broadcast(spark):
    rows = [(k, f"https://www.host{k % 97}.example/{k % 50}/?q={k}", "x") for k in range(3000)] + [(9000, None, "x"), (9001, "", "x"), (None, "http://host1.example/", "x"), (1, "HTTP://u@M.host1.example:80/1#f", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, listed string")
    keys = spark.createDataFrame([("host5.example/5",), ("host1.example/1",), ("absent.example",), (None,)], "key string")
    want = sorted(((i, k, k in ("host5.example/5", "host1.example/1")) for i, k in U.listed_pages(pages, listed=keys).select("page_id", "key").collect()), key=repr)
    for params in ({}, {"max_broadcast_bytes": 100, "shard_keys": 50}, {"shard_keys": 200}):
        assert sorted((tuple(r) for r in U.listed_pages(pages, listed=keys, **params).collect()), key=repr) == want
    assert sum(r[2] for r in want) >= 3


def test_labels_not_parts_of_words_and_long_urls(spark):
    urls = ["http://ads-track.example.com/x", "http://uploads.example.com/x", "http://www.casino.example/y", "http://alphabets.example", "http://a.example/" + "p" * 200_000, "http://example.com/casino/"]
    got = {r.page_id: r.listed for r in U.listed_pages(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False, 5: False}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.listed_pages(none).collect() == []
    assert U.listed_pages(none, listed=spark.createDataFrame([], "key string")).collect() == []
