import random
import re

import compare
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from spanlab.llm import exact_dedup, graph, registry, simhash

ODD = [(900, None), (901, ""), (902, "..."), (903, None), (904, ""), (905, "word " * 50_000)]


def prints(texts):
    h, s, some = simhash.fingerprints_of(pa.array(texts, pa.string()))
    return [(int(a), int(b)) if k else None for a, b, k in zip(h, s, some)]


def groups(rows, radius, check):
    """Every pair is compared; ids of one group share its least id."""
    p = {}
    for (i, _), x in zip(rows, prints([t for _, t in rows])):
        if i is not None and x:
            p.setdefault(i, []).append(x)
    ids, up = sorted(p), {i: i for i in p}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if any((a ^ c).bit_count() <= radius and (b ^ d).bit_count() <= check for a, b in p[i] for c, d in p[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return sorted((i, find(i)) for i in ids if find(i) != i)


def test_a_print_is_the_sum_over_words():
    from spanlab.llm.textkernel import Words, mix

    text = "One two two three, four four four four"
    w = Words(pa.array([text]))
    sums, plain = np.zeros(64), np.zeros(64)
    for h in set(w.hash.tolist()):
        n = (w.hash == np.uint64(h)).sum()
        x = mix(np.array([np.uint64(h) >> np.uint64(20)]))
        y = mix(x ^ np.uint64(0x5851F42D4C957F2D))
        for k in range(64):
            sums[k] += (1 + np.log2(n)) * (1 if int(x[0]) >> k & 1 else -1)
            plain[k] += 1 if int(y[0]) >> k & 1 else -1
    assert prints([text]) == [(sum(1 << k for k in range(64) if sums[k] > 0), sum(1 << k for k in range(64) if plain[k] > 0))]


def test_covering_masks_cover():
    rng = np.random.default_rng(3)
    m = simhash.masks(simhash.RADIUS)
    assert len(m) == 2 ** (simhash.RADIUS + 1) - 1
    for _ in range(2000):
        bits = rng.choice(64, rng.integers(1, simhash.RADIUS + 1), replace=False)
        d = np.uint64(sum(1 << int(b) for b in bits))
        assert ((m & d) == 0).any()


def test_near_copies_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r.doc_id, r.kept_doc_id) for r in simhash.near_copies(docs).collect())
    assert got and got == groups([(r.doc_id, r.text) for r in docs.collect()], simhash.RADIUS, simhash.CHECK)


def test_near_copies_of_odd_rows(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for _ in range(10):
        base = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        for _ in range(rng.randint(1, 60)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += ODD + [rows[3], (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, node int, a int, __gone string")
    want = groups(rows, 6, 12)
    assert sorted((r.doc_id, r.kept_doc_id) for r in simhash.near_copies(docs).collect()) == want
    kept = simhash.dedup(docs)
    gone = {i for i, _ in want}
    assert kept.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(i if i is not None else -1 for i, _ in rows if i not in gone)
    assert simhash.near_copies(docs.limit(0)).collect() == [] and simhash.dedup(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in up if find(i) != i}


def test_exact_dedup_against_sql(spark, sf):
    compare.same(registry.op2_exact_dedup(spark, sf), registry.ORACLE_SQL["op2_exact_dedup"], compare.duck(sf))


def test_exact_dedup_of_odd_rows(spark):
    rows = [(5, "a", 1.0), (3, "a", 2.0), (None, "a", 0.0), (7, None, 1.0), (6, None, 1.0), (8, "", 1.0), (9, "", 1.0), (10, " ", 1.0), (3, "a", 1.0), (11, "A", 1.0), (12, "x" * 200_000, 0.0), (13, "x" * 200_000, 0.0)]
    docs = spark.createDataFrame([(*r, "d", {"m": 1}) for r in rows], "doc_id long, text string, n double, d string, p map<string,int>")
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.n) for r in got.collect()) == [(3, 1.0), (6, 1.0), (8, 1.0), (10, 1.0), (11, 1.0), (12, 0.0)]
    many = spark.range(5000).select((F.col("id") + 1).alias("doc_id"), (F.col("id") % 3).cast("string").alias("text"))
    assert sorted((r.doc_id, r["n"]) for r in exact_dedup.dedup(many, copies="n").collect()) == [(1, 1667), (2, 1667), (3, 1666)]
    assert exact_dedup.dedup(docs.limit(0)).collect() == []


def test_word_of_the_kernel():
    from spanlab.llm.textkernel import Words

    texts = ["Hello, WORLD!", None, "", "ÉTÉ x1-y2", "a\x00b"]
    w = Words(pa.array(texts))
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first[:-1], w.first[1:])]
    assert got == [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
