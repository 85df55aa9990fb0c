import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from spanlab.llm import pieces as P
from spanlab.llm import toxicity as T

BAD = "idiot moron scum trash".split()


def talk(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(BAD))
        rows.append((i, " ".join(t), int(toxic)))
    return rows


def test_held_out_toxicity(spark):
    rows = talk(3000)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows if i < 1500] + [(5, None, 1)], "doc_id long, toxic int, text int")
    model = T.fit(docs, labels)
    assert 0 < len(model.index) < 2000
    got = {r.doc_id: r.toxic for r in T.score(docs, model).collect()}
    test = [(got[i], bool(y)) for i, _, y in rows if i >= 1500]
    hits = sum(a and b for a, b in test)
    assert hits / sum(b for _, b in test) > 0.95 and hits / sum(a for a, _ in test) > 0.98
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in got.items() if not t}


def test_ftrl_step_by_step():
    """The vector code against the rule written out for single coordinates."""
    p = T.PARAMS | {"bits": 6, "epochs": 2, "l1": 0.3}
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 64, rng.integers(0, 9))) for _ in range(15)]
    y = rng.integers(0, 2, 15).astype(float)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        l1 = 0.0 if i == 64 else p["l1"]
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((p["beta"] + n[i] ** 0.5) / p["alpha"] + p["l2"])

    for _ in range(p["epochs"]):
        for s, t in zip(sets, y):
            idx = [*s.tolist(), 64]
            w = {i: weight(i) for i in idx}
            g = 1 / (1 + np.exp(-sum(w.values()))) - t
            for i in idx:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p["alpha"] * w[i]
                n[i] += g * g
    m = T.fit_sets(sets, y, p)
    got = np.zeros(65)
    got[m["index"]], got[64] = m["weight"], m["bias"]
    assert np.allclose(got, [weight(i) for i in range(65)])


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (None, "fine"), (4, "fine"), (4, "fine"), (5, "w " * 300_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    none = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.toxic for r in T.score(docs, none).collect()] == [False] * 7 and {r.score for r in T.score(docs, none).collect()} == {0.5}
    model = T.fit(docs, spark.createDataFrame([(4, 0), (5, 1)], "doc_id long, toxic int"))
    got = T.score(docs, model).collect()
    assert len(got) == 7 and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert T.score(docs.limit(0), model).collect() == [] and T.drop_toxic(docs.limit(0), model).collect() == []


def plain_viterbi(v, text):
    """Best score over all cuts, and the score of the unknown characters' bytes."""
    scores = {v.out[i]: v.score[i] for i in range(len(v.out)) if np.isfinite(v.score[i])}
    s = (" " + text).replace(" ", P.MARK)
    best = [0.0] + [-np.inf] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 24) + 1):
            sc = scores.get(s[i:j].encode(), v.unknown if j == i + 1 else -np.inf)
            best[j] = max(best[j], best[i] + sc)
    return best[-1]


def score_of(v, ids):
    total, left = 0.0, 0
    for i in ids:
        if np.isfinite(v.score[i]):
            total += v.score[i]
        else:
            b = v.out[i][0]
            if left == 0:
                total += v.unknown
                left = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            left -= 1
    return total


def test_encoding_is_the_best_cut_and_decodes():
    v = P.load()
    texts = ["", "a", "  two  spaces ", "日本語😀 x\n\nline", "naïve\tq", "x" * 300]
    ids = P.Encoder(v).encode(texts)
    for t, x in zip(texts, ids):
        assert P.decode(v, x.tolist()) == t
        assert abs(score_of(v, x) - plain_viterbi(v, t)) < 1e-6


def test_double_array_trie():
    rng = random.Random(2)
    keys = sorted({bytes(rng.randrange(97, 101) for _ in range(rng.randint(1, 6))) for _ in range(300)})
    t = P.build_trie([(k, n) for n, k in enumerate(keys)])

    def look(word):
        s = 0
        for c in word:
            nxt = t.base[s] + c
            if t.check[nxt] != s:
                return -1
            s = nxt
        return t.value[s]

    have = {k: n for n, k in enumerate(keys)}
    for _ in range(3000):
        w = bytes(rng.randrange(96, 103) for _ in range(rng.randint(1, 7)))
        assert look(w) == have.get(w, -1)


def test_pieces_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "▁ mark"), (None, "x"), (4, "a" * 300_000), (5, "no spaces" * 9), (5, "no spaces" * 9), (6, "\x00�\n")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    out = P.encode(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].ids is None and got[1].n_tokens is None and got[2].exact and got[2].n_tokens == 1 and not got[3].exact and got[4].exact and got[6].exact and got[None].exact
    assert {r.doc_id: r.text for r in P.decode_ids(out).filter(F.col("doc_id") != 3).collect()} == {i: t for i, t in rows if i not in (3, None)}
    assert P.encode(docs.limit(0)).collect() == []
    assert pa.types.is_int32(pa.array(got[2].ids, pa.int32()).type)
