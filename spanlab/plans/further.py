"""Queries of manifests, checkpoints, timing modes, shards and alignment windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ctc, packing, profile, state, timing
from ..operators import spans as S
from ..sources import files
from . import views as V
from .queries import query

_WHY = [
    None, 'state is "draft", not published', "state marker ASR contract does not match", "state marker render contract does not match", "state marker source snapshot does not match",
    "state marker generation ID is invalid", "state marker output formats do not match", "state marker path for srt does not match", "txt output is missing or not regular", "srt output does not match its state marker",
]


@query(f"SELECT doc_id, ([{', '.join('NULL' if w is None else chr(39) + w + chr(39) for w in _WHY)}])[doc_id % 10 + 1] AS reason FROM (SELECT DISTINCT doc_id FROM documents)")
def manifest_reasons(spark, d):
    """Manifests spoiled in one way each, by the last digit of doc_id."""
    k = F.col("doc_id") % 10
    ids = V.table(spark, d, "documents").select("doc_id").distinct()
    name = lambda f: F.concat(F.col("doc_id").cast("string"), F.lit("." + f))
    entry = lambda f: F.struct(F.lit(f).alias("format"), F.when((k == 7) & F.lit(f == "srt"), "other").otherwise(name(f)).alias("name"), F.lit(7).cast("long").alias("size"), F.when((k == 9) & F.lit(f == "srt"), "y").otherwise("x").alias("sha256"))
    sources = ids.select("doc_id", F.lit("a").alias("asr_key"), F.lit("r").alias("render_key"), F.lit("s").alias("source"), F.array(F.lit("srt"), F.lit("txt")).alias("formats"), F.array(name("srt"), name("txt")).alias("names"))
    manifests = ids.select(
        "doc_id", F.when(k == 1, "draft").otherwise("published").alias("kind"), F.when(k == 2, "b").otherwise("a").alias("m_asr"), F.when(k == 3, "b").otherwise("r").alias("m_render"),
        F.when(k == 4, "b").otherwise("s").alias("m_source"), F.when(k == 5, "").otherwise("g").alias("generation"), F.when(k == 6, F.array(entry("txt"))).otherwise(F.array(entry("srt"), entry("txt"))).alias("outputs"),
    )
    found = ids.select("doc_id", F.explode(F.array(F.lit("srt"), F.lit("txt"))).alias("format")).filter(~((k == 8) & (F.col("format") == "txt")))
    found = found.select("doc_id", "format", F.lit(7).cast("long").alias("size"), F.lit("x").alias("sha256"))
    return state.manifest_reasons(sources, manifests, found, "doc_id").select("doc_id", "reason")


@query("""SELECT doc_id, doc_id % 4 = 0 AS restored, [NULL, 'state is "published", not an ASR checkpoint', 'ASR checkpoint contract does not match', 'ASR checkpoint is invalid (speech_spans contains an overlapping, out-of-order, or out-of-range row)'][doc_id % 4 + 1] AS reason FROM documents""")
def checkpoint_restore(spark, d):
    """Checkpoints that are good, of another kind, of another contract and with overlapping spans."""

    def text(k: int) -> str:
        spans = [[0, 2], [1, 3]] if k == 3 else [[0, 1.5]]
        return state.checkpoint("a" if k != 2 else "b", "s", 3.0, [[0, 1], [1, 3.0000005]], ["x", "y"], spans, kind="published" if k == 1 else "asr_complete")

    k = (F.col("doc_id") % 4).cast("int")
    rows = V.table(spark, d, "documents").select("doc_id", F.get(F.array(*[F.lit(text(x)) for x in range(4)]), k).alias("state"))
    return state.restore_checkpoints(rows, "doc_id", "state", "a", "s").select("doc_id", F.col("checkpoint").isNotNull().alias("restored"), "reason")


@query(f"""WITH {V.SEGMENTS}, s AS (SELECT file, segment_index, tokens, n, start AS a, "end" - start AS d, n * 2 // 3 + CASE WHEN n % 3 = 1 THEN 1 ELSE 0 END AS first, unnest(range(0, n)) AS k FROM segments WHERE n > 0),
t AS (SELECT *, CASE WHEN segment_index % 2 = 1 THEN a + k * (d / n) WHEN k < first THEN a + k * (d / 2 / first) ELSE a + d * 0.75 + (k - first) * (d / 4 / (n - first)) END AS start,
  CASE WHEN segment_index % 2 = 1 THEN d / n WHEN k < first THEN d / 2 / first ELSE d / 4 / (n - first) END AS step FROM s)
SELECT file, segment_index, k AS word_index, tokens[k + 1] AS word, round(start, 9) AS start, round(start + step, 9) AS "end", CASE WHEN segment_index % 2 = 1 THEN 'uniform' ELSE 'uniform_speech_spans' END AS source FROM t""")
def timing_modes(spark, d):
    """Even segments have two stretches of speech, of half and a quarter of their length; odd ones have none."""
    seg = V.segments(spark, d)
    length = F.col("end") - F.col("start")
    speech = seg.filter("segment_index % 2 = 0").select("file", "segment_index", F.explode(F.array(
        F.struct(F.col("start").alias("r_start"), (F.col("start") + length / 2).alias("r_end")), F.struct((F.col("start") + length * 0.75).alias("r_start"), F.col("end").alias("r_end")))).alias("r"))
    words = timing.words_by_mode(seg, speech.select("file", "segment_index", "r.*"), ["file", "segment_index"], "segment", merge=True)
    return words.select("file", "segment_index", "word_index", "word", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"), "source")


@query("""SELECT l_returnflag AS run, sum(l_quantity) AS elapsed_seconds, sum(l_extendedprice) AS successful_audio_seconds, max(l_partkey) AS peak, round(sum(l_extendedprice) / sum(l_quantity), 6) AS rtfx FROM lineitem GROUP BY 1""")
def chunk_rollup(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_quantity").alias("elapsed_seconds"), F.col("l_extendedprice").alias("successful_audio_seconds"), F.col("l_partkey").alias("peak"))
    return profile.roll_up(rows, ["run"], ["peak"]).withColumn("rtfx", F.round("rtfx", 6))


@query("""WITH i AS (SELECT p_name || p_partkey AS name, p_partkey % 4 AS shard FROM part WHERE p_partkey % 7 > 0), c AS (SELECT p_name || p_partkey AS name, p_partkey % 4 AS shard, p_size AS nbytes FROM part WHERE p_partkey % 5 > 0)
SELECT coalesce(i.name, c.name) AS name, coalesce(i.shard, c.shard) AS shard, nbytes, CASE WHEN c.name IS NULL THEN 'maps a missing tensor' WHEN i.name IS NULL THEN 'absent from the index' END AS error FROM i FULL OUTER JOIN c ON i.name = c.name AND i.shard = c.shard""")
def shard_set(spark, d):
    part = V.table(spark, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 4).alias("shard"), F.col("p_size").alias("nbytes"), "p_partkey")
    return files.shard_set(part.filter("p_partkey % 7 > 0").select("name", "shard"), part.filter("p_partkey % 5 > 0").select("name", "shard", "nbytes"))


@query(f"""WITH {V.SEGMENTS} SELECT file, segment_index, greatest(round_even(start * 1000 / 20.0, 0)::BIGINT, 0) AS first_frame, least(round_even("end" * 1000 / 20.0, 0)::BIGINT, 4000) AS last_frame,
least(round_even("end" * 1000 / 20.0, 0)::BIGINT, 4000) - greatest(round_even(start * 1000 / 20.0, 0)::BIGINT, 0) < 2 OR trim(text) = '' AS fallback FROM segments""")
def frame_ranges(spark, d):
    first, last, few = ctc.frame_range(F.col("start"), F.col("end"), F.lit(4000))
    return V.segments(spark, d).select("file", "segment_index", first.alias("first_frame"), last.alias("last_frame"), (few | (F.trim("text") == "")).alias("fallback"))


@query("""WITH m AS (SELECT o_orderkey AS media, floor(o_totalprice * 10)::BIGINT AS n FROM orders), w AS (SELECT *, (n + 479999) // 480000 AS k FROM m)
SELECT media, CASE WHEN n < 480000 THEN 'direct' ELSE 'windows' END AS path, CASE WHEN n < 480000 THEN greatest(n, 400) END AS input_samples, CASE WHEN n >= 480000 THEN k * 1500 - (k * 480000 - n) // 320 END AS frames FROM w WHERE n > 0""")
def emission_frames(spark, d):
    media = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("media"), F.floor(F.col("o_totalprice") * 10).cast("long").alias("n")).filter("n > 0")
    path, samples, frames = S.emission_frames(F.col("n"))
    return media.select("media", path.alias("path"), samples.alias("input_samples"), frames.alias("frames"))


@query(f"""WITH RECURSIVE {V.SEGMENTS}, s AS MATERIALIZED (SELECT file, segment_index AS i, CASE WHEN n % 4 = 0 THEN 20000 ELSE ceil(n * 1000 * 1.05)::BIGINT END AS need FROM segments),
f AS (SELECT file, i, 0 AS grp, need AS used, 1 AS held FROM s WHERE i = 0
  UNION ALL SELECT s.file, s.i, CASE WHEN held >= 3 OR used + need > 60000 THEN grp + 1 ELSE grp END, CASE WHEN held >= 3 OR used + need > 60000 THEN need ELSE used + need END, CASE WHEN held >= 3 OR used + need > 60000 THEN 1 ELSE held + 1 END
  FROM f JOIN s ON s.file = f.file AND s.i = f.i + 1)
SELECT file, i AS segment_index, grp FROM f""")
def unknown_size_groups(spark, d):
    """Every fourth size is unknown: such an item reserves its share of the group."""
    rows = V.segments(spark, d).select("file", "segment_index", F.when(F.col("n") % 4 > 0, F.col("n") * 1000).alias("bytes"))
    return packing.groups(rows, "file", "segment_index", "bytes", 3, 60_000)


@query("""SELECT l_orderkey, l_linenumber, greatest(l_partkey * (l_linenumber % 3 + 1) * 4, (ceil(l_partkey * (16000 / (8000.0::DOUBLE * (l_linenumber % 4 + 1))))::BIGINT + 64) * 4) AS bytes FROM lineitem""")
def resampled_size(spark, d):
    k = F.col("l_linenumber")
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.resampled_bytes(F.col("l_partkey"), k % 3 + 1, (k % 4 + 1) * 8000).alias("bytes"))
