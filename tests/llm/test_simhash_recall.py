import random

import numpy as np
from spanlab.llm import registry, simhash
from test_dedup import groups


def test_split_family_covers():
    rng = np.random.default_rng(5)
    for radius in range(simhash.WHOLE, simhash.WIDE + 2):
        m = simhash.covering(radius)
        for _ in range(2000):
            d = np.uint64(sum(1 << int(b) for b in rng.choice(64, radius, replace=False)))
            assert ((m & d) == 0).any()


def test_registered_query_finds_copies_beyond_the_small_radius(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(120)]
        copy = list(base)
        for k in rng.sample(range(120), 6):
            copy[k] = rng.choice(words)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.kept_doc_id) for r in registry.op6_simhash(spark, str(tmp_path)).collect())
    assert got == groups(rows, simhash.WIDE, simhash.CHECK)
    assert len(got) > len(groups(rows, simhash.RADIUS, simhash.CHECK))
    assert len(got) >= 55  # of 60 copies with a word-set Jaccard of about 0.9


def test_registered_query_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r.doc_id, r.kept_doc_id) for r in registry.op6_simhash(spark, sf).collect())
    assert got and got == groups([(r.doc_id, r.text) for r in docs.collect()], simhash.WIDE, simhash.CHECK)


def test_buckets_in_blocks(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(90)] = f"x{rng.randrange(900)}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.kept_doc_id) for r in simhash.near_copies(docs, 6, 12, most=5).collect())
    assert got == groups(rows, 6, 12)
