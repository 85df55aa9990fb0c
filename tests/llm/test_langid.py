import numpy as np
from spanlab.llm import langid as L


def test_held_out_accuracy_and_mixtures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs.filter("doc_id % 2 = 0"))
    rest = docs.filter("doc_id % 2 = 1")
    got = {r.doc_id: r for r in L.identify(rest, model).collect()}
    truth = {r.doc_id: r for r in rest.collect()}
    assert set(got) == set(truth)
    words = {i: r for i, r in truth.items() if len(r.text.split()) >= 5}
    assert np.mean([got[i].lang == r.lang for i, r in words.items()]) > 0.97
    by = {}
    for r in words.values():
        by.setdefault(r.lang, " ".join(r.text.split()[:60]))
    a, b = sorted(by)[:2]
    mixed = spark.createDataFrame([(1, by[a] + " " + by[b])], "doc_id long, text string")
    r = L.identify(mixed, model).first()
    assert set(r.languages) == {a, b} and abs(sum(r.shares) - 1) < 1e-3 and min(r.shares) > 0.2


def test_selection_equals_exhaustive_fit():
    """For two languages the greedy set is the penalised optimum over a fine grid of shares."""
    rng = np.random.default_rng(4)
    score, size = rng.normal(0, 3, (600, 2)).astype(np.float32) - 10, np.array([40, 1, 259, 300])
    shares = L.infer(score, size, 1.0, 0.5, 200)
    grid = np.linspace(0, 1, 2001)
    at = 0
    for n, s in zip(size, shares):
        p = np.exp(score[at : at + n].astype(float))
        ll = np.log(p[:, :1] * grid + p[:, 1:] * (1 - grid)).sum(0)
        single = max(ll[0], ll[-1])
        both = ll.max() - single > 1.0 + 0.5 * np.log(n)
        assert both == ((s > 0).sum() == 2)
        assert abs(s[0] - (grid[ll.argmax()] if both else float(ll[-1] > ll[0]))) < 2e-2
        at += n


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "...", None), (None, "the dog", None), (1, "the cat and the dog", ""), (6, "the " * 300_000, "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, shares int")
    got = L.identify(docs, L.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang, r.languages) for r in got}
    assert by[1] == ("en", ["en"]) and by[2] == ("de", ["de"]) and by[3] == by[4] == by[5] == (None, []) and by[None][0] == "en" and by[6][0] == "en"
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang for r in L.identify(unlabelled, L.fit(unlabelled)).collect()} == {None}
    assert L.identify(docs.limit(0), L.fit(docs.limit(0))).collect() == []
