from spanlab.functions import text as T
from spanlab.plans import queries as Q

ROWS = [(0, "Plain text."), (1, "Été à l’école, “42” times"), (2, "Straße & co."), (3, "مرحبا"), (4, "日本 2024"), (5, "")]


def test_every_row_is_normalized_and_romanized(spark, tmp_path):
    spark.createDataFrame(ROWS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    normal = {r.item_id: r.normalized for r in Q.normalize_text(spark, str(tmp_path)).collect()}
    roman = {r.item_id: r.romanized for r in Q.romanize_text(spark, str(tmp_path)).collect()}
    assert normal == {i: T.py_normalize(t) for i, t in ROWS} and roman == {i: T.py_romanize(t) for i, t in ROWS}
    assert normal[0] == "plain text" and normal[1] == "été à l'école times" and normal[3]
    assert roman[0] == "p l a i n t e x t" and roman[1].startswith("e t e") and roman[3]
