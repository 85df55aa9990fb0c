import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F
from spanlab.llm import exact_dedup, mixing, pieces, simhash, toxicity


def test_stages_in_a_chain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "sentencepiece"] and C.ORACLE_SQL is None
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    now = {r.doc_id: r for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.toxic}
    now = {i: r for i, r in now.items() if i not in bad}
    first = {}
    for i in sorted(now):
        first.setdefault(now[i].text, i)
    now = {i: now[i] for i in first.values()}
    frame = spark.createDataFrame(list(now.values()), docs.schema)
    gone = {r.doc_id for r in simhash.near_copies(frame).collect()}
    frame = frame.filter(~F.col("doc_id").isin(*gone)) if gone else frame
    want = {r.doc_id for r in mixing.sample(frame).collect()}
    got = C.run(spark, sf).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want) and all(r.exact for r in got)


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_each_stage_keeps_the_columns_and_stands_odd_rows(spark, sf, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", "a", 3), (3, "w " * 100_000, "en", "b", 200_000), (3, "w " * 100_000, "en", "b", 200_000), (4, "some words here", "en", "b", 15)]
    for data in (rows, []):
        out = stage(spark, spark.createDataFrame(data, schema), sf)
        if name != "sentencepiece":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert out.count() <= len(data)
    assert exact_dedup and pieces


@pytest.mark.parametrize("name, stage", C.STAGES[:-1])
def test_clashing_columns_stay(spark, sf, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, __gone int, k_id int, d int, n int"
    rows = [(k, f"document number {k} of its own kind w{k * 7} x{k * 11}", "en", "a", 9, f"k{k}", 5, 6, 7, 8, 9) for k in range(6)]
    kept = stage(spark, spark.createDataFrame(rows, schema), sf)
    assert kept.columns == [c.split()[0] for c in schema.split(", ")] and {tuple(r) for r in kept.collect()} <= set(rows)


def test_intermediate_tables_go(spark, sf):
    from spanlab.llm import common

    before = len(common._made)
    C.run(spark, sf).count()
    assert len(common._made) == before + 1  # the last stage's input
