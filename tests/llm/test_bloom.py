import numpy as np
from spanlab.llm import bloom


def test_all_that_was_put_in_passes(spark):
    x = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    numbers = spark.createDataFrame([(int(v),) for v in x[:10_000]], "x long")
    for most in (bloom.MAX_BYTES, 1300):
        b = bloom.build(numbers, 10_000, most)
        assert b.parts.nbytes <= most + bloom.PARTS and b.passes(x[:10_000]).all()
    assert bloom.build(numbers, 10_000).passes(x[10_000:]).mean() < 0.02
    assert not bloom.build(numbers.limit(0), 0).passes(x).any()
