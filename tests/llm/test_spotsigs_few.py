import re

from spanlab.llm import registry
from spanlab.llm import spotsigs as S
from test_spotsigs import plain_signatures


def groups(rows):
    sets = {}
    for i, t in rows:
        x = plain_signatures(t)
        if len(x) < S.PARAMS["least"]:
            x |= set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()))
        if x:
            sets.setdefault(i, x)
    ids = sorted(sets)
    low = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= S.PARAMS["tau"] * len(sets[i] | sets[j]) - 1e-9 and low[i] != low[j]:
                a, b = sorted((low[i], low[j]))
                low = {k: a if v == b else v for k, v in low.items()}
    return sorted((i, k) for i, k in low.items() if i != k)


def query(spark, d):
    return sorted((r.doc_id, r.kept_doc_id) for r in registry.op10_spotsigs(spark, str(d)).collect())


def test_documents_with_few_signatures_are_compared(spark, tmp_path):
    items = " ".join(f"item{k} price{k}" for k in range(60))
    rows = [(0, items), (1, items), (2, items.replace("item7 ", "item07 ")), (3, "the old mill of stone"), (4, "the old mill of stone"), (5, "the old mill"), (6, "other words altogether"), (7, None), (8, ""), (9, "...")]
    rows += [(10 + k, f"the red fox of many woods is a sly one and the {w} was in old towns by night") for k, w in enumerate(("hen", "hen", "cow"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = query(spark, tmp_path)
    assert got == groups(rows)
    assert {(1, 0), (2, 0), (4, 3)} <= set(got) and not {5, 6, 7, 8, 9} & {i for i, _ in got}


def test_registered_query_against_brute_force(spark, sf):
    assert query(spark, sf) == groups([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
