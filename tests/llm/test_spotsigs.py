import random

import pyarrow as pa
import pytest
from spanlab.llm import spotsigs as S


def brute(rows, tau=S.PARAMS["tau"], least=S.PARAMS["least"]):
    sets = {}
    for i, t in rows:
        row, sig = S.signatures(pa.array([t]), S.PARAMS["chain"], S.PARAMS["distance"])
        if len(sig) >= least:
            sets.setdefault(i, set(sig.tolist()))
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= tau * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return sorted((i, find(i)) for i in ids if find(i) != i)


def plain_signatures(text):
    """The definition, word by word."""
    import re

    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    out = set()
    for k, w in enumerate(words):
        rest = [x for x in words[k + 1 :] if x not in S.ANCHORS]
        if w in S.ANCHORS and len(rest) >= 2:
            out.add((w, rest[0], rest[1]))
    return out


def test_signatures_are_chains_after_common_words():
    text = "The quick brown fox of the lazy dogs is the quick brown one; and a b"
    row, sig = S.signatures(pa.array([text, None, "", "the of"]), 2, 1)
    assert set(row.tolist()) == {0} and len(sig) == len(plain_signatures(text))


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r.doc_id, r.kept_doc_id) for r in S.near_copies(docs).collect())
    assert got and got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_of_near_copies_and_odd_rows(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words + ["the", "of", "and"] * 60) for _ in range(rng.randint(20, 300))]
        for _ in range(rng.randint(1, 40)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "the the the"), rows[0], (1003, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows] + [(None, rows[0][1], 0, "k")], "doc_id long, text string, node int, sigs string")
    assert sorted((r.doc_id, r.kept_doc_id) for r in S.near_copies(docs).collect()) == brute(rows)


def test_bitmaps_bound_the_difference():
    rng = random.Random(6)
    sets = [rng.sample(range(1 << 60), rng.randint(1, 400)) for _ in range(40)]
    sets += [x[: rng.randint(1, len(x))] + rng.sample(range(1 << 60), rng.randint(0, 30)) for x in sets]
    doc = [k for k, x in enumerate(sets) for _ in x]
    rows = S.bitmaps(S.np.array(doc), S.np.array([v for x in sets for v in x], S.np.uint64), S.np.array([len(x) for x in sets]))
    bits = S.Bits(pa.array(rows, pa.binary()))
    for x in range(len(sets)):
        apart = bits.apart(x, S.np.arange(len(sets)))
        assert apart[x] == 0 and all(n <= len(set(sets[x]) ^ set(y)) for n, y in zip(apart, sets))


def near_threshold(rng):
    """Pairs whose similarity lies about every threshold, and a chain of ever more distant copies."""
    words, rows = [f"w{k}" for k in range(3000)], []
    for g in range(60):
        base = [x for _ in range(rng.randint(8, 60)) for x in (rng.choice(("the", "of", "and")), rng.choice(words), rng.choice(words))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(int(len(base) * rng.random() * 0.4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.4:
                base = copy
    return rows


@pytest.mark.parametrize("tau, most", [(0.3, S.MOST), (0.5, 2), (0.7, S.MOST), (0.9, S.MOST)])
def test_no_pair_about_the_threshold_is_lost(spark, tau, most):
    rows = near_threshold(random.Random(round(tau * 10)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, tau)
    assert len(want) > 10 and sorted((r.doc_id, r.kept_doc_id) for r in S.near_copies(docs, tau=tau, most=most).collect()) == want


def test_a_very_long_text(spark):
    rng = random.Random(1)
    base = [rng.choice(["the", "of", *(f"w{k}" for k in range(500))]) for _ in range(60_000)]
    copy = [x if rng.random() > 0.01 else "other" for x in base]
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(base[:20_000]))]
    assert sorted((r.doc_id, r.kept_doc_id) for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows) == [(2, 1)]


def test_empty_table(spark):
    assert S.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
