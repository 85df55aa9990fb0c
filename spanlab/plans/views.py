"""Deterministic stand-ins for audio and model output over the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments from conversations: 0.35 s a token, 0.1 s between segments."""
    w = Window.partitionBy("file").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), "turn", "role", "text")
    rows = rows.withColumn("n", F.size(T.words(F.col("text")))).withColumn("dur", F.greatest("n", F.lit(1)) * 5600)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.col("dur") + 1600).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.select("file", (F.row_number().over(w) - 1).alias("segment_index"), "role", "text", "n", (F.col("at") / 16000.0).alias("start"), ((F.col("at") + F.col("dur")) / 16000.0).alias("end"))


SEGMENTS = r"""seg0 AS (SELECT conv_id AS file, turn, role, text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n]+'), lambda w: w <> '') AS tokens FROM conversations),
seg1 AS (SELECT *, len(tokens) AS n, greatest(len(tokens), 1) * 5600 AS dur FROM seg0),
seg2 AS (SELECT *, coalesce(sum(dur + 1600) OVER (PARTITION BY file ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, row_number() OVER (PARTITION BY file ORDER BY turn) - 1 AS segment_index FROM seg1),
segments AS (SELECT file, segment_index, role, text, tokens, n, pos / 16000.0::DOUBLE AS start, (pos + dur) / 16000.0::DOUBLE AS "end" FROM seg2)"""

WORDS = (
    SEGMENTS
    + """,
words AS (SELECT file, segment_index, k - 1 AS word_index, start + (k - 1) * (("end" - start) / n) AS start, start + k * (("end" - start) / n) AS "end", tokens[k] AS word
  FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM segments WHERE n > 0))"""
)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from embeddings, a whole vector each."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("stream"), (F.row_number().over(w) - 1).alias("frame"), F.col("embedding").alias("samples"))


FRAMES = "frames AS (SELECT label AS stream, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS samples FROM embeddings)"
_PCM = "list_transform(samples, lambda x: trunc((greatest(-1, least(1, x::DOUBLE)) * 32767.0)::FLOAT)::BIGINT)"
LOUD = FRAMES + f""",
loud AS (SELECT stream, frame, 20 * log10(greatest(sqrt(list_sum(list_transform({_PCM}, lambda p: p * p)) / len(samples)), 1e-10)) AS db FROM frames)"""


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), (F.row_number().over(w) - 1).alias("frame"), F.least(F.col("value") / 100, F.lit(1.0)).cast("float").alias("prob"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint spans in whole milliseconds from events."""
    w = Window.partitionBy("stream").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "ts", "event_id", F.floor(micros / 1000).alias("s"), "value")
    rows = rows.withColumns({"next": F.lead("s").over(w), "want": F.col("s") + F.greatest(F.floor(F.col("value") * 60000), F.lit(1000))})
    return rows.select("stream", (F.row_number().over(w) - 1).alias("idx"), F.col("s").alias("start"), F.least("want", F.coalesce("next", "want")).alias("end"))


SPANS = """sp0 AS (SELECT user_id AS stream, ts, event_id, epoch_us(ts) // 1000 AS s, value FROM events),
sp1 AS (SELECT *, lead(s) OVER w AS nxt, s + greatest(floor(value * 60000)::BIGINT, 1000) AS want, row_number() OVER w - 1 AS idx FROM sp0 WINDOW w AS (PARTITION BY stream ORDER BY ts, event_id)),
spans AS (SELECT stream, idx, s AS start, least(want, coalesce(nxt, want)) AS "end" FROM sp1)"""
