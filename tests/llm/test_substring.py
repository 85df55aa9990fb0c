import re
from collections import defaultdict

from spanlab.llm import substring

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def brute(docs, T):
    at = defaultdict(set)
    words = {}
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        words.setdefault(i, w)
        for x in range(len(w) - T + 1):
            at[tuple(w[x : x + T])].add((i, x))
    hit = defaultdict(set)
    for places in at.values():
        if len({i for i, _ in places}) > 1:
            for i, x in places:
                hit[i].add(x)
    out = []
    for i, xs in hit.items():
        run = []
        for x in sorted(xs):
            if run and x == run[1] + 1:
                run[1] = x
            else:
                if run:
                    out.append((i, run[0], run[1] + T))
                run = [x, x]
        out.append((i, run[0], run[1] + T))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.start_word, r.end_word) for r in df.collect())


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = found(substring.repeats(docs))
    assert got and got == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_small_windows_ties_and_odd_rows(spark):
    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    texts += ["Shared, passage OF seven plain words HERE!", "x shared passage of seven plain words here y", None, "", "...", "a " * 500]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, place int, h string")
    for T, k in ((7, 3), (7, 7), (9, 1)):
        assert found(substring.repeats(docs, T, k)) == brute(rows, T)
    with_null = docs.union(spark.createDataFrame([(None, texts[3], 1, "x")], docs.schema))
    assert found(substring.repeats(with_null, 7, 3)) == brute(rows, 7)


def test_only_a_document_itself_or_nothing(spark):
    schema = "doc_id long, text string"
    assert found(substring.repeats(spark.createDataFrame([], schema))) == []
    alone = spark.createDataFrame([(1, "one two three four " * 40), (2, "")], schema)
    assert found(substring.repeats(alone, 10, 4)) == []
