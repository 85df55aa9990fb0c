import numpy as np
from pyspark.sql import functions as F
from spanlab.operators import kernels as K
from spanlab.streaming import segments


def test_result_does_not_depend_on_micro_batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    probs = {s: rng.random(90).round(3).tolist() for s in (1, 2)}
    folder = tmp_path / "in"
    for k in range(3):
        rows = [(s, i, probs[s][i]) for s in probs for i in range(k * 30, (k + 1) * 30)]
        spark.createDataFrame(rows, "stream int, frame int, prob float").coalesce(1).write.mode("append").parquet(str(folder))
    # files come in the order of their times, one a trigger
    src = spark.readStream.schema("stream int, frame int, prob float").option("maxFilesPerTrigger", 1).parquet(str(folder))
    src = src.withColumn("last", F.col("frame") == 89)
    spans = segments.speech_spans(src, "stream", "frame", "prob", "last", silence_ms=64, shortest_ms=0)
    loud = segments.energy_spans(src.withColumn("loud", F.col("prob") > 0.4), "stream", "frame", "loud", 0.1, 0.5, 0.05, ends="last")
    for name, df in (("spans", spans), ("loud", loud)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.exception()
    for s, p in probs.items():
        h, t = K.Hysteresis(silence_ms=64, shortest_ms=0), K.EnergyTokens(0.1, 0.5, 0.05)
        want = [x for v in p for x in h.push(v)] + h.close(90 * 512)
        assert sorted((r.start, r.end) for r in spark.sql(f"select * from spans where stream = {s}").collect()) == sorted(want)
        want = [x for x in [*(t.push(np.float32(v) > 0.4) for v in p), t.close()] if x]
        assert sorted((r.start, r.end) for r in spark.sql(f"select * from loud where stream = {s}").collect()) == sorted(want)
