from collections import defaultdict

from spanlab.plans import more, queries


def test_shares_of_all_customers(spark, sf):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/customer.parquet").collect():
        groups[r.c_nationkey].append((r.c_custkey, (r.c_custkey % 97 + 3) * 10))
    want = {}
    for nation, rows in groups.items():
        total = sum(n for _, n in rows)
        left = max(0, 1_000_000 - total)
        extra = {c: left * n // total for c, n in rows}
        extra[min(rows, key=lambda x: (-x[1], x[0]))[0]] += left - sum(extra.values())
        want |= {c: (nation, n, n + extra[c]) for c, n in rows}
    assert {r.c_custkey: (r.c_nationkey, r.n, r.granted) for r in more.leftover_shares(spark, sf).collect()} == want


def test_sides_of_all_documents(spark, sf):
    a, b = ({r.doc_id for r in spark.read.parquet(f"{sf}/{t}.parquet").select("doc_id").collect()} for t in ("documents", "labels"))
    got = {r.doc_id: r.side for r in queries.compare_files(spark, sf).collect()}
    assert got == {i: "both" if i in a & b else "archive only" if i in a else "installed only" for i in a | b}
