from spanlab.plans import queries as Q


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_of_whole_texts(spark, tmp_path):
    long = "word " * 60 + "tail"
    turns = [(0, 0, "user", long), (0, 1, "assistant", long.replace("tail", "tales")), (1, 0, "user", "naïve café ☕"), (1, 1, "assistant", "naive café"), (2, 0, "user", "alone"), (3, 0, "user", ""), (3, 1, "assistant", "x")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = {(c, t): (x, next((y for d, u, _, y in turns if d == c and u == t + 1), "")) for c, t, role, x in turns if role == "user"}
    got = {(r.conv_id, r.turn): (r.char_edits, r.ref_chars) for r in Q.char_errors(spark, str(tmp_path)).collect()}
    assert got == {k: (distance(a, b), len(a)) for k, (a, b) in pairs.items()}
    rows = [r for r in Q._pairs(spark, str(tmp_path)).collect()]
    assert {(r.conv_id, r.turn): (r.ref, r.hyp or "") for r in rows} == pairs
    assert Q.accuracy(spark, str(tmp_path)).count() > 0
