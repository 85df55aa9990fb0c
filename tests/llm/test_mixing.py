import compare
import numpy as np
import pandas as pd
from spanlab.llm import mixing, registry


def test_sample_against_sql(spark, sf):
    compare.same(registry.op1_mixing(spark, sf), registry.ORACLE_SQL["op1_mixing"], compare.duck(sf))


def test_marginals_meet_their_targets():
    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(1, 10_000))) for a in range(5) for b in range(3) for c in range(4)], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": {f"s{k}": w for k, w in enumerate((0.4, 0.3, 0.1, 0.1, 0.1))}, "lang": {"l0": 0.2, "l1": 0.5, "l2": 0.3}, "topic": {f"t{k}": 0.25 for k in range(4)}}
    x = mixing.rake(cells, targets, 60)
    for d, want in targets.items():
        share = pd.Series(x).groupby(cells[d]).sum() / x.sum()
        assert all(abs(share[k] - w) < 1e-6 for k, w in want.items())


def test_far_fit_equals_near_fit(spark):
    rows = [(f"s{a}" if a else None, f"l{b}", "other", 10 * a + 7 * b + 1) for a in range(4) for b in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    key = lambda r: repr((r.g_source, r.g_lang))
    near = sorted(mixing.rates(cells, iterations=4).collect(), key=key)
    far = sorted(mixing.rates(cells, iterations=4, max_local_cells=1).collect(), key=key)
    assert len(near) == len(far) == 12
    assert all(abs(a.g_rate - b.g_rate) < 1e-9 and abs(a.g_ratio - b.g_ratio) < 1e-9 for a, b in zip(near, far))


def test_odd_rows(spark):
    rows = [(k, f"word {k} license", "en", "s", 1.0) for k in range(300)] + [(1000, None, "en", "s", 1.0), (1001, "", None, None, 1.0), (None, "x", "en", None, 1.0), (0, "word 0 license", "en", "s", 1.0), (1002, "y " * 200_000, "de", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, g_rate double")
    got = mixing.sample(docs).collect()
    assert 100 < len(got) <= len(rows) and all(0 < r.rate <= 1 for r in got)
    kept = mixing.resample(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got)
    assert sum(r.doc_id == 0 for r in got) in (0, 2)
    assert mixing.sample(docs.limit(0)).collect() == [] and mixing.resample(docs.limit(0)).collect() == []


def test_words_stand_alone_and_a_column_of_topics(spark):
    texts = ["the secretary's phonetic licenses", "a Secret!", "phone", "call +1 (555)", "token = x", "no token here", None]
    rows = spark.createDataFrame([(k, t, "en", "s", f"t{k % 2}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, kind string")
    got = [r.t for r in rows.select(mixing.topic_of(rows["text"]).alias("t")).collect()]
    assert got == ["other", "credential", "contact", "contact", "credential", "other", "other"]
    assert {r.topic for r in mixing.sample(rows, topic="kind", fraction=1.0, alpha=1.0).collect()} == {"t0", "t1"}


def test_rates_are_broadcast_and_no_text_moves(spark, sf):
    plan = mixing.resample(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_given_shares_are_met(spark, sf):
    """The weights of the registered query meet its language shares."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keys = docs.select(*mixing._keys(docs, None), mixing.tokens_of(docs["text"]).alias("k_tokens"))
    got = {}
    cells = mixing._cells(keys)
    tokens = {(r.source, r.lang, r.topic): r.tokens for r in cells.collect()}
    for r in mixing.rates(cells, mixing.LANG_SHARES).collect():
        got[r.g_lang] = got.get(r.g_lang, 0) + r.g_ratio * tokens[r.g_source, r.g_lang, r.g_topic]
    assert all(abs(got[k] / sum(got.values()) - v) < 1e-6 for k, v in mixing.LANG_SHARES["lang"].items())
