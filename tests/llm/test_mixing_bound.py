import pytest
from spanlab.llm import mixing

SCHEMA = "source string, lang string, topic string, tokens long"


def skewed():
    return [(f"s{a}", f"l{b}", f"t{c}", 10_000 * (a + 1) * (b + 2) * (c + 1) ** 4) for a in range(3) for b in range(2) for c in range(3)] + [("tiny", "l0", "t0", 100)]


def kept(rows):
    cells = {tuple(r[:3]): r[3] for r in skewed()}
    return sum(r.g_rate * cells[r.g_source, r.g_lang, r.g_topic] for r in rows) / sum(cells.values())


def test_one_tiny_cell_leaves_the_fraction_alone(spark):
    got = mixing.rates(spark.createDataFrame(skewed(), SCHEMA)).collect()
    assert kept(got) == pytest.approx(mixing.PARAMS["fraction"], abs=1e-6)
    assert all(0 < r.g_rate <= 1 for r in got)
    assert [r.g_rate for r in got if r.g_source == "tiny"] == [1.0]
    assert all(r.g_lacks > 0 for r in got if r.g_source == "tiny")


def test_far_bound_equals_near_bound(spark):
    cells = spark.createDataFrame(skewed(), SCHEMA)
    key = lambda r: repr(tuple(r)[:3])
    near, far = (sorted(mixing.rates(cells, iterations=2, max_local_cells=m).collect(), key=key) for m in (1000, 1))
    assert len(near) == len(far) == len(skewed())
    assert all(abs(a.g_rate - b.g_rate) < 1e-9 and abs(a.g_lacks - b.g_lacks) < 1e-3 for a, b in zip(near, far))
