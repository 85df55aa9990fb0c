from spanlab.llm import pii as P

TRUE = [
    ("email", "write to ana.b@mail3.example.com today"), ("phone", "call +1 (743) 555-3824 now"), ("ip", "from 152.143.123.131 it came"),
    ("card", "pay 4539148803436467 please"), ("key", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here'),
]
FALSE = ["in 2024 there were 1,234,567 of them", "order 7086638319846193 came", "version 300.400.500.600 of it", "on 2024-05-06 at noon", "plain words only"]


def brute(text):
    """What a reader would mark, by kind."""
    for kind, t in TRUE:
        if text == t:
            return kind


def corpus():
    rows = []
    for k in range(40):
        rows += [t for _, t in TRUE] + FALSE
    return list(enumerate(rows))


def test_kinds_and_offsets(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, TRUE[0][1], "x"), (999, None, "x"), (998, "", "x"), (997, "a-1" * 200_000, "x")], "doc_id long, text string, votes string")
    got = P.find(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        assert [r.kind for r in by.get(i, [])] == [k for k in [brute(t)] if k], t
    spans = {t[r.start : r.end] for i, t in rows for r in by.get(i, [])}
    assert spans == {"ana.b@mail3.example.com", "+1 (743) 555-3824", "152.143.123.131", "4539148803436467", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"}
    assert len(by[None]) == 1 and 999 not in by and 998 not in by


def test_nothing_to_find(spark):
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert P.find(spark.createDataFrame([(1, "no such thing")], "doc_id long, text string")).collect() == []


def test_every_planted_shape_of_the_table(spark, sf):
    """Held against plain expressions over the whole table."""
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.start, r.end): r.kind for r in P.find(docs).collect()}
    sure = {"email": r"[\w.]+@mail\d+\.example\.com", "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w)", "phone": r"\+1 \(\d{3}\) 555-\d{4}(?!\w)", "key": r"(?<=token = \")[0-9a-f]{40}"}
    want = {(r.doc_id, *m.span()): k for r in docs.collect() for k, e in sure.items() for m in re.finditer(e, r.text)}
    missed = {k: v for k, v in want.items() if got.get(k) != v}
    assert len(missed) <= 0.02 * len(want), list(missed.items())[:3]


def test_em_recovers_reliabilities():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 4000)
    right = (0.95, 0.8, 0.6)
    votes = np.stack([np.where(rng.random(4000) < p, truth, 1 - truth) for p in right], axis=1)
    pats, n = np.unique(votes, axis=0, return_counts=True)
    _, chance = P.reliabilities(["".join(map(str, p)) for p in pats], n.astype(float), 400)
    got = [np.mean([chance[j][c][c] for c in (0, 1)]) for j in range(3)]
    assert got[0] > got[1] > got[2] and abs(got[1] - 0.8) < 0.1
