"""One query for each operator, over the stand-in views, and its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ctc, cues, packing, profile, state, timing
from ..operators import spans as S
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _r(*names: str):
    """Six digits are held against the oracle: sums of doubles may differ in the last place."""
    return [F.round(n, 6).alias(n) for n in names]


CUE_FOLD = f"""WITH RECURSIVE {V.WORDS},
w AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file ORDER BY segment_index, word_index) AS i FROM words),
fold AS (SELECT file, i, 0 AS cue, start AS cue_start, "end" AS last_end, length(word) AS chars, word AS text,
    regexp_matches(word, '[.!?؟،؛…]$') AS closed FROM w WHERE i = 1
  UNION ALL SELECT w.file, w.i, cue + CASE WHEN brk THEN 1 ELSE 0 END, CASE WHEN brk THEN w.start ELSE cue_start END, w."end",
    CASE WHEN brk THEN length(w.word) ELSE chars + 1 + length(w.word) END, w.word, regexp_matches(w.word, '[.!?؟،؛…]$')
  FROM (SELECT f.*, n.start AS ns, n."end" AS ne, n.word AS nw,
      f.closed OR f.chars + 1 + length(n.word) > {cues.CHARS} OR n."end" - f.cue_start > {cues.SECONDS} OR n.start - f.last_end > {cues.GAP} AS brk
    FROM fold f JOIN w n ON n.file = f.file AND n.i = f.i + 1) f JOIN w ON w.file = f.file AND w.i = f.i + 1),
raw AS (SELECT file, cue AS cue_index, greatest(0.0, min(cue_start)) AS start, greatest(min(cue_start), max_by(last_end, i)) AS "end", string_agg(text, ' ' ORDER BY i) AS text FROM fold GROUP BY file, cue),
cues AS (SELECT file, cue_index, start, greatest(start, least(greatest("end", start + {cues.SHORTEST}), coalesce(lead(start) OVER (PARTITION BY file ORDER BY cue_index), 'inf'::DOUBLE))) AS "end", text FROM raw)"""


def _cues(spark, d):
    words = timing.uniform_words(V.segments(spark, d), "file", "segment_index")
    return cues.bounds(cues.build(words, "file", ["segment_index", "word_index"]), "file")


@query(CUE_FOLD + ' SELECT file, cue_index, round(start, 6) AS start, round("end", 6) AS "end", text FROM cues')
def subtitle_cues(spark, d):
    return _cues(spark, d).select("file", "cue_index", *_r("start", "end"), "text")


_MS = "round_even(greatest(0.0, {x}) * 1000, 0)::BIGINT"


def _stamp(x: str, hours: bool) -> str:
    ms = _MS.format(x=x)
    if hours:
        return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"
    short = f"printf('%02d:%02d.%03d', {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"
    return f"CASE WHEN {ms} >= 3600000 THEN printf('%02d:', {ms} // 3600000) ELSE '' END || {short}"


@query(CUE_FOLD + f""" SELECT file, string_agg((cue_index + 1)::VARCHAR || chr(10) || {_stamp("start", True)} || ' --> ' || {_stamp('"end"', True)} || chr(10) || text || chr(10) || chr(10), '' ORDER BY cue_index) AS content FROM cues GROUP BY file""")
def render_srt(spark, d):
    return cues.srt(_cues(spark, d), "file")


@query(CUE_FOLD + f""" SELECT file, 'WEBVTT' || chr(10) || chr(10) || string_agg({_stamp("start", False)} || ' --> ' || {_stamp('"end"', False)} || chr(10) || text || chr(10) || chr(10), '' ORDER BY cue_index) AS content FROM cues GROUP BY file""")
def render_vtt(spark, d):
    return cues.vtt(_cues(spark, d), "file")


@query(f"""WITH {V.SEGMENTS} SELECT file, coalesce(string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10) ORDER BY segment_index) FILTER (WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''), '') || chr(10) AS content FROM segments GROUP BY file""")
def render_txt(spark, d):
    return cues.txt(V.segments(spark, d), "file", "segment_index")


@query(f"""WITH {V.SEGMENTS} SELECT file, coalesce(string_agg(text, chr(10) ORDER BY segment_index) FILTER (WHERE n > 0), '') AS text FROM segments GROUP BY file""")
def transcript_text(spark, d):
    return cues.transcript(V.segments(spark, d), "file", "segment_index")


@query()
def transcript_json(spark, d):
    return cues.transcript_json(V.segments(spark, d), "file", "segment_index")


@query(f"""WITH {V.WORDS} SELECT file, segment_index, word_index, round(start, 6) AS start, round("end", 6) AS "end", word FROM words""")
def uniform_words(spark, d):
    return timing.uniform_words(V.segments(spark, d), "file", "segment_index").select("file", "segment_index", "word_index", *_r("start", "end"), "word")


@query("""WITH m AS (SELECT o_orderkey AS media, floor(o_totalprice * 10)::BIGINT AS samples FROM orders),
w AS (SELECT media, samples, unnest(range(0, samples, 480000)) AS pos FROM m)
SELECT media, pos // 480000 AS "window", pos / 16000.0::DOUBLE AS start, least(pos + 480000, samples) / 16000.0::DOUBLE AS "end" FROM w""")
def fixed_windows(spark, d):
    media = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("media"), F.floor(F.col("o_totalprice") * 10).cast("long").alias("samples"))
    return S.fixed_windows(media, "media", "samples", 30.0)


@query("""WITH m AS (SELECT o_orderkey AS media, floor(o_totalprice * 10)::BIGINT AS samples FROM orders),
w AS (SELECT media, samples, unnest(range(0, samples, 480000)) AS pos FROM m)
SELECT media, pos // 480000 AS "window", pos - 32000 AS lo, pos + 512000 AS hi, greatest(0, 32000 - pos) AS zeros_before, greatest(0, pos + 512000 - samples) AS zeros_after FROM w""")
def overlapping_windows(spark, d):
    media = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("media"), F.floor(F.col("o_totalprice") * 10).cast("long").alias("samples"))
    return S.overlapping_windows(media, "media", "samples", 480_000, 32_000)


@query(f"""WITH RECURSIVE {V.SPANS},
sp AS MATERIALIZED (SELECT stream, idx, start, "end" FROM spans),
f AS (SELECT stream, idx, 0 AS span, start AS a, "end" AS b FROM sp WHERE idx = 0
  UNION ALL SELECT s.stream, s.idx, CASE WHEN s."end" - f.a <= 3600000 THEN f.span ELSE f.span + 1 END, CASE WHEN s."end" - f.a <= 3600000 THEN f.a ELSE s.start END, s."end"
  FROM f JOIN sp s ON s.stream = f.stream AND s.idx = f.idx + 1)
SELECT stream, span, round(min(a) / 1000, 3) AS start, round(max(b) / 1000, 3) AS "end" FROM f GROUP BY stream, span""")
def merge_spans(spark, d):
    spans = V.spans(spark, d).withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    return S.merge(spans, "stream", 3600.0).select("stream", "span", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(f"""WITH {V.SPANS}, r AS (SELECT stream, start // 3600000 * 3600000 + 600000 AS r_start, start // 3600000 * 3600000 + 1800000 AS r_end FROM spans GROUP BY ALL)
SELECT s.stream, idx, r_start, r_end, greatest(start, r_start) AS start, least("end", r_end) AS "end" FROM spans s JOIN r ON s.stream = r.stream AND "end" > r_start AND start < r_end WHERE least("end", r_end) > greatest(start, r_start)""")
def clip_spans(spark, d):
    spans = V.spans(spark, d)
    hour = F.floor(F.col("start") / 3_600_000) * 3_600_000
    regions = spans.select("stream", (hour + 600_000).alias("r_start"), (hour + 1_800_000).alias("r_end")).distinct()
    return S.clip(spans, regions, "stream").select("stream", "idx", "r_start", "r_end", "start", "end")


@query(f"""WITH {V.SPANS}, g AS (SELECT *, start - lag("end") OVER w AS before, lead(start) OVER w - "end" AS after, max("end") OVER (PARTITION BY stream) AS n FROM spans WINDOW w AS (PARTITION BY stream ORDER BY start, "end"))
SELECT stream, start AS raw_start, "end" AS raw_end, CASE WHEN before IS NULL OR before >= 60000 THEN greatest(0, start - 30000) ELSE start - before // 2 END AS start,
  CASE WHEN after IS NULL OR after >= 60000 THEN least(n, "end" + 30000) ELSE "end" + after // 2 END AS "end" FROM g""")
def pad_spans(spark, d):
    spans = V.spans(spark, d).withColumn("n", F.max("end").over(Window.partitionBy("stream")))
    return S.pad(spans, "stream", "n", 30_000)


@query(f"""WITH RECURSIVE {V.SPANS}, c AS MATERIALIZED (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY idx) AS i, greatest(0.0, least((start - t0) / 1000.0, 40000000.0)) AS a, greatest(0.0, least(("end" - t0) / 1000.0, 40000000.0)) AS b
  FROM (SELECT *, min(start) OVER (PARTITION BY stream) AS t0 FROM spans) WHERE "end" > start)
SELECT stream, i - 1 AS span, round(a, 3) AS start, round(b, 3) AS "end", NULL::VARCHAR AS error FROM c""")
def snap_spans(spark, d):
    t0 = F.min("start").over(Window.partitionBy("stream"))
    spans = V.spans(spark, d).withColumns({"start": (F.col("start") - t0) / 1000.0, "end": (F.col("end") - t0) / 1000.0, "media": F.lit(40_000_000.0)})
    return S.snap(spans, "stream", "media").select("stream", "span", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "error")


@query(f"WITH {V.LOUD} SELECT stream, frame, round(db, 6) AS db, db >= 72 AS loud FROM loud")
def energy_frames(spark, d):
    rows = V.frames(spark, d).select("stream", "frame", S.energy_db(F.col("samples")).alias("db"))
    return rows.select("stream", "frame", F.round("db", 6).alias("db"), (F.col("db") >= 72).alias("loud"))


@query()
def energy_spans(spark, d):
    last = F.max("frame").over(Window.partitionBy("stream")) == F.col("frame")
    rows = V.frames(spark, d).select("stream", "frame", (S.energy_db(F.col("samples")) >= 72).alias("loud"), F.when(last, 300).otherwise(800).alias("n"))
    return S.energy_spans(rows, "stream", "frame", "loud", 0.1, 0.6, 0.05, length="n")


@query()
def speech_spans(spark, d):
    probs = V.probs(spark, d).withColumn("media", F.count("*").over(Window.partitionBy("stream")) * 512 - 100)
    return S.speech_spans(probs, "stream", "frame", "prob", "media", threshold=0.5, shortest_ms=0, silence_ms=64, pad_ms=16, longest_s=1.0)


@query(f"""WITH {V.FRAMES} SELECT stream, frame, list_concat(CASE WHEN lag(samples) OVER w IS NULL THEN [0, 0, 0]::FLOAT[] ELSE (lag(samples) OVER w)[62:64] END, samples) AS frame_samples FROM frames WINDOW w AS (PARTITION BY stream ORDER BY frame)""")
def frame_contexts(spark, d):
    return S.frame_contexts(V.frames(spark, d).withColumnRenamed("frame", "k"), "stream", "k", "samples", 3).select("stream", F.col("k").alias("frame"), F.col("frame").alias("frame_samples"))


@query("""WITH e AS (SELECT vec_id, embedding AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS top FROM e),
t AS (SELECT vec_id, v, top, ln(list_sum(list_transform(v, lambda x: exp((x - top)::DOUBLE)))) AS total FROM m)
SELECT vec_id, list_append(list_transform(v, lambda x: round(((x - top) - total)::FLOAT::DOUBLE, 5)), 0.0::DOUBLE) AS logp FROM t""")
def log_softmax(spark, d):
    out = ctc.log_softmax(F.col("embedding"))
    return V.table(spark, d, "embeddings").select("vec_id", F.transform(out, lambda x: F.round(x.cast("double"), 5)).alias("logp"))


def _emissions(spark, d):
    """Blocks of twenty frames, each value of a vector a class, to three targets."""
    w = Window.partitionBy("stream").orderBy("frame")
    frames = V.frames(spark, d).withColumn("block", F.floor((F.row_number().over(w) - 1) / 20))
    rows = frames.groupBy("stream", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "samples"))), lambda x: ctc.log_softmax(x["samples"], False)).alias("emissions"))
    return rows.withColumn("targets", F.array((F.col("block") % 7 + 1).cast("int"), F.lit(2), F.lit(2)))


@query()
def ctc_alignment(spark, d):
    return ctc.align(_emissions(spark, d), "stream", "block")


@query()
def aligned_words(spark, d):
    rows = _emissions(spark, d)
    done = ctc.align(rows, "stream", "block").select("stream", "block", "path")
    first = (F.col("block") % 7 + 1).cast("int")
    ready = done.withColumns({"tokens": F.array(F.array(first), F.array(F.lit(2), F.lit(2))), "words": F.array(F.lit("one"), F.lit("two")), "start": F.lit(0.0), "end": F.lit(0.4)})
    return ctc.word_spans(ready, "stream", "block").select("stream", "block", "word_index", *_r("start", "end"), "word", "fallback")


@query("""WITH e AS (SELECT user_id AS stream, event_type AS label, row_number() OVER w - 1 AS pos, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN label IS NOT DISTINCT FROM was AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY pos) AS run FROM e)
SELECT stream, run, any_value(label) AS label, min(pos) AS "first", max(pos) AS "last" FROM r GROUP BY stream, run""")
def label_runs(spark, d):
    rows = V.table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return ctc.runs(rows.withColumnRenamed("user_id", "stream"), "stream", "o", "event_type")


_ALLOC = """g AS (SELECT user_id, event_type, round(sum(value), 2)::DOUBLE AS w FROM events GROUP BY ALL),
x AS (SELECT *, 7 * (w / sum(w) OVER (PARTITION BY user_id)) AS exact FROM g),
y AS (SELECT *, 7 - sum(floor(exact)) OVER (PARTITION BY user_id) AS rest, row_number() OVER (PARTITION BY user_id ORDER BY floor(exact) - exact, w DESC, event_type) AS rk FROM x),
shares AS (SELECT user_id, event_type, w, (floor(exact) + CASE WHEN rk <= rest THEN 1 ELSE 0 END)::BIGINT AS share FROM y)"""


def _weights(spark, d):
    return V.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("w"))


@query(f"WITH {_ALLOC} SELECT user_id, event_type, w, share FROM shares")
def largest_remainder(spark, d):
    return timing.allocate(_weights(spark, d).withColumn("n", F.lit(7)), ["user_id"], "event_type", "n", "w").select("user_id", "event_type", "w", "share")


@query(f"""WITH {_ALLOC}, z AS (SELECT *, coalesce(sum(w) OVER o, 0) AS a, coalesce(sum(share) OVER o, 0) AS before FROM shares WINDOW o AS (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, unnest(range(0, share)) AS k FROM z)
SELECT user_id, before + k AS word_index, round(a + k * (w / share), 4) AS start, round(a + (k + 1) * (w / share), 4) AS "end", ['a', 'b', 'c', 'd', 'e', 'f', 'g'][(before + k + 1)::BIGINT] AS word FROM k""")
def words_across_spans(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_type").rowsBetween(Window.unboundedPreceding, -1)
    rows = _weights(spark, d).withColumn("start", F.coalesce(F.sum("w").over(w), F.lit(0.0)))
    rows = rows.withColumns({"end": F.col("start") + F.col("w"), "tokens": F.array(*[F.lit(c) for c in "abcdefg"])})
    return timing.words_across_spans(rows, ["user_id"], "event_type", "tokens").select("user_id", "word_index", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "word")


@query("""WITH e AS (SELECT user_id, row_number() OVER w - 1 AS k, row_number() OVER w * 3 AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT user_id, k, f * 20 / 1000.0::DOUBLE AS start, (f + 4 + 1) * 20 / 1000.0::DOUBLE AS "end" FROM e)
SELECT user_id, k, round(greatest(start, coalesce(lag("end") OVER (PARTITION BY user_id ORDER BY k), start)), 6) AS start, round("end", 6) AS "end" FROM t""")
def span_times(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = V.table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).alias("k"), (F.row_number().over(w) * 3).alias("first")).withColumn("last", F.col("first") + 4)
    return timing.span_times(rows, ["user_id"], "k", 20.0).select("user_id", "k", *_r("start", "end"))


def _tokens(spark, d):
    """Every third event type as a continuation, times by event number."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = V.table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).alias("k"), "event_type", "value")
    text = F.when(F.col("k") % 7 == 0, " ").when(F.col("k") % 11 == 0, "").when(F.col("k") % 5 == 0, " ,").when(F.col("k") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), "event_type"))
    return rows.select("user_id", "k", text.alias("text"), (F.col("k") * 10).alias("t0"), (F.col("k") * 10 + 9).alias("t1"), (F.col("value") / 1000).alias("p"))


_TOKENS = """t0 AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_type, value FROM events),
tokens AS (SELECT user_id, k, CASE WHEN k % 7 = 0 THEN ' ' WHEN k % 11 = 0 THEN '' WHEN k % 5 = 0 THEN ' ,' WHEN k % 3 = 0 THEN event_type ELSE ' ' || event_type END AS text, k * 10 AS t0, k * 10 + 9 AS t1, value / 1000 AS p FROM t0)"""


@query(f"""WITH {_TOKENS}, f AS (SELECT *, lag(text) OVER w AS was, row_number() OVER w AS rn FROM tokens WHERE text <> '' WINDOW w AS (PARTITION BY user_id ORDER BY k)),
g AS (SELECT *, sum(CASE WHEN rn = 1 OR was = ' ' OR (text[1] = ' ' AND NOT regexp_full_match(text, ' [!-/:-@\\[-`{{-~]+')) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) AS wd FROM f),
h AS (SELECT user_id, wd, string_agg(regexp_replace(text, '^ ', ''), '' ORDER BY k) AS word, min_by(t0, k) AS t0, max_by(t1, k) AS t1, avg(p) AS p FROM g WHERE text <> ' ' GROUP BY user_id, wd)
SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY wd) - 1 AS word_index, word, t0, t1, round(p, 10) AS p FROM h""")
def token_words(spark, d):
    return timing.token_words(_tokens(spark, d), ["user_id"], "k").select("user_id", "word_index", "word", "t0", "t1", F.round("p", 10).alias("p"))


@query(f"""WITH {_TOKENS}, s AS (SELECT user_id, k, text, octet_length(encode(text)) AS b, sum(octet_length(encode(text))) OVER (PARTITION BY user_id ORDER BY k) AS upto, sum(octet_length(encode(text))) OVER (PARTITION BY user_id) AS total FROM tokens)
SELECT user_id, k, text, trunc((upto - b) / total * 9000)::BIGINT AS t0, trunc(upto / total * 9000)::BIGINT AS t1 FROM s""")
def byte_times(spark, d):
    rows = _tokens(spark, d).select("user_id", "k", "text").withColumn("cs", F.lit(9000).cast("long"))
    return timing.byte_times(rows, ["user_id"], "k", "cs").select("user_id", "k", "text", "t0", "t1")


@query("""SELECT o_orderkey, o_totalprice, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS stamp,
CASE WHEN t >= 3600 THEN printf('%dh%02dm%02ds', t // 3600, t % 3600 // 60, t % 60) WHEN t >= 60 THEN printf('%dm%02ds', t // 60, t % 60) ELSE printf('%ds', t) END AS length, (n * 100) // 16000 AS hundredths
FROM (SELECT o_orderkey, o_totalprice, round_even(greatest(0.0, o_totalprice / 7) * 1000, 0)::BIGINT AS ms, round(o_totalprice / 7)::BIGINT AS t, floor(o_totalprice)::BIGINT AS n FROM orders)""")
def timestamps(spark, d):
    x = F.col("o_totalprice") / 7
    return V.table(spark, d, "orders").select("o_orderkey", "o_totalprice", T.timestamp(x, True, ",").alias("stamp"), T.duration(x).alias("length"), timing.sample_hundredths(F.floor("o_totalprice")).alias("hundredths"))


@query(f"""WITH {V.SEGMENTS} SELECT role AS kind, count(*) AS n, min(d) AS least, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.99), 6) AS p99, max(d) AS most FROM (SELECT role, round("end" - start, 6) AS d FROM segments) GROUP BY role""")
def duration_quantiles(spark, d):
    rows = V.segments(spark, d).select(F.col("role").alias("kind"), F.round(F.col("end") - F.col("start"), 6).alias("d"))
    return profile.quantiles(rows, "d", "kind").select("kind", "n", "least", *_r("p50", "p90", "p99"), "most")


_RESULTS = "results AS (SELECT o_orderkey, o_orderpriority AS engine, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status, o_totalprice AS duration FROM orders)"


def _results(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return V.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("engine"), status.alias("status"), F.col("o_totalprice").alias("duration"))


@query(f"""WITH {_RESULTS} SELECT count(*) AS n_files, count_if(status = 'completed') AS n_completed, count_if(status = 'failed') AS n_failed, count_if(status = 'skipped') AS n_skipped,
round(coalesce(sum(duration) FILTER (WHERE status = 'completed'), 0), 2) AS audio_seconds, round(coalesce(sum(duration) FILTER (WHERE status = 'completed'), 0) / 1000, 4) AS rtfx, count_if(status = 'failed') = 0 AS ok FROM results""")
def run_statistics(spark, d):
    out = profile.run_statistics(_results(spark, d), F.lit(1000.0))
    return out.withColumns({"audio_seconds": F.round("audio_seconds", 2), "rtfx": F.round("rtfx", 4)})


@query(f"""WITH {_RESULTS} SELECT status, count(*) AS n, list_sort(list(DISTINCT engine)) AS engines FROM results GROUP BY status""")
def status_histogram(spark, d):
    return _results(spark, d).groupBy("status").agg(F.count("*").alias("n"), profile.distinct_sorted("engine").alias("engines"))


@query(f"""WITH {_RESULTS} SELECT o_orderkey, engine, duration FROM results WHERE status = 'failed'""")
def failed_results(spark, d):
    return profile.by_status(_results(spark, d), "failed").select("o_orderkey", "engine", "duration")


@query("""SELECT l_returnflag AS lane, sum(l_linenumber) AS batches, max(l_quantity) AS peak, coalesce(min(nullif(l_quantity::INT % 5, 0)), 0) AS smallest, max_by(l_partkey, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey) AS size FROM lineitem GROUP BY 1""")
def telemetry(spark, d):
    q = F.col("l_quantity").cast("int")
    rows = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("lane"), F.col("l_linenumber").alias("batches"), F.col("l_quantity").alias("peak"), (q % 5).alias("smallest"), F.col("l_partkey").alias("size"), (F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("idx"))
    return profile.merge_telemetry(rows, "lane")


@query(f"""WITH {V.SEGMENTS} SELECT file, count(*) AS n_segments, sum(n)::BIGINT AS n_tokens, round(sum("end" - start), 6) AS speech, round(max("end"), 6) AS duration,
round(CASE WHEN max("end") <> 0 THEN 1 - sum("end" - start) / max("end") ELSE 0 END, 6) AS padding FROM segments GROUP BY file""")
def file_profile(spark, d):
    speech, whole = F.sum(F.col("end") - F.col("start")), F.max("end")
    out = V.segments(spark, d).groupBy("file").agg(F.count("*").alias("n_segments"), F.sum("n").cast("long").alias("n_tokens"), speech.alias("speech"), whole.alias("duration"), profile.padding_ratio(speech, whole).alias("padding"))
    return out.select("file", "n_segments", "n_tokens", *_r("speech", "duration", "padding"))


def _pairs(spark, d):
    c = V.table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", "role", F.col("text").alias("ref"), F.lead("text").over(w).alias("hyp")).filter("role = 'user'")


@query()
def char_errors(spark, d):
    c = V.table(spark, d, "conversations")
    hyp = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = c.select("conv_id", "turn", "role", F.col("text").alias("ref"), hyp.alias("hyp")).filter("role = 'user'")
    return rows.select("conv_id", "turn", F.levenshtein("ref", "hyp").alias("char_edits"), F.length("ref").alias("ref_chars"))


@query()
def accuracy(spark, d):
    scored = profile.edits(_pairs(spark, d), "ref", "hyp").withColumns({"dataset": (F.col("conv_id") % 3).cast("string"), "domain": (F.col("turn") % 2).cast("string")})
    return profile.accuracy(scored, "dataset", "domain").withColumns({"wer": F.round("wer", 6), "cer": F.round("cer", 6)})


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'digest mismatch' END AS m_reason FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL),
c AS (SELECT doc_id, CASE WHEN quality = 1 THEN NULL ELSE 'bad spans' END AS c_reason FROM labels),
j AS (SELECT s.doc_id, m.doc_id IS NOT NULL AS has_m, m_reason, c.doc_id IS NOT NULL AS has_c, c_reason FROM (SELECT doc_id FROM documents) s LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, CASE WHEN has_m AND m_reason IS NULL THEN 'skip' WHEN has_c AND c_reason IS NULL THEN 'resume' ELSE 'process' END AS decision,
CASE WHEN has_m AND m_reason IS NULL THEN NULL WHEN has_c AND c_reason IS NULL THEN CASE WHEN has_m THEN m_reason ELSE 'no manifest' END
ELSE CASE WHEN has_m THEN m_reason ELSE 'no manifest' END || '; ' || CASE WHEN has_c THEN c_reason ELSE 'no checkpoint' END END AS reason FROM j""")
def incremental_decision(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id")
    m = docs.filter("doc_id % 3 = 0").distinct().withColumn("m_reason", F.when(F.col("doc_id") % 2 != 0, "digest mismatch"))
    c = V.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") != 1, "bad spans").alias("c_reason"))
    return state.decide(docs, m, c, "doc_id").select("doc_id", "decision", "reason")


@query("""SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents""")
def output_digests(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))


@query(f"""WITH {V.SPANS}, g AS (SELECT stream, idx, "end" >= start AND start >= 0 AND "end" <= 2e12 AND start >= coalesce(lag("end") OVER (PARTITION BY stream ORDER BY idx), 0) AS good FROM spans)
SELECT stream, bool_and(good) AND count(DISTINCT idx) = count(*) AND bool_and(idx >= 0) AS valid, count(*) AS n_spans FROM g GROUP BY stream""")
def checkpoint_validation(spark, d):
    return state.check_spans(V.spans(spark, d).withColumn("media", F.lit(2e12)), "stream", "media")


@query(f"""WITH {V.SEGMENTS} SELECT file, segment_index, row_number() OVER (PARTITION BY file ORDER BY n DESC, segment_index) - 1 AS place FROM segments""")
def longest_first(spark, d):
    return packing.longest_first(V.segments(spark, d), "file", "n", "segment_index").select("file", "segment_index", "place")


@query(f"""WITH RECURSIVE {V.SEGMENTS}, s AS MATERIALIZED (SELECT file, segment_index, "end" - start AS d, row_number() OVER (PARTITION BY file ORDER BY "end" - start DESC, segment_index) AS i FROM segments),
f AS (SELECT file, segment_index, i, 0 AS batch, 1 AS k, CASE WHEN d > 35 THEN 1 ELSE least(4, greatest(1, floor(60.0 / greatest(d, 1 / 16000.0))::INT)) END AS room FROM s WHERE i = 1
  UNION ALL SELECT s.file, s.segment_index, s.i, CASE WHEN f.k < f.room THEN f.batch ELSE f.batch + 1 END, CASE WHEN f.k < f.room THEN f.k + 1 ELSE 1 END,
    CASE WHEN f.k < f.room THEN f.room ELSE CASE WHEN d > 35 THEN 1 ELSE least(4, greatest(1, floor(60.0 / greatest(d, 1 / 16000.0))::INT)) END END FROM f JOIN s ON s.file = f.file AND s.i = f.i + 1)
SELECT file, segment_index, batch FROM f""")
def batch_packing(spark, d):
    rows = V.segments(spark, d).select("file", "segment_index", (F.col("end") - F.col("start")).alias("seconds"))
    return packing.pack(rows, "file", "seconds", "segment_index", 4, 60.0)


@query("""WITH x AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity DESC) AS q FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey, len(q) AS n, q, unnest(range(1, len(q))) AS i FROM x),
m AS (SELECT l_orderkey, min_by(i, (greatest(i * q[1], (n - i) * q[i + 1]), i)) AS cut FROM c GROUP BY 1)
SELECT l_orderkey, cut FROM x LEFT JOIN m USING (l_orderkey)""")
def balanced_split(spark, d):
    rows = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.reverse(F.array_sort(F.collect_list("l_quantity"))).alias("q"))
    return rows.select("l_orderkey", packing.split_point(F.col("q")).alias("cut"))


@query("""WITH x AS (SELECT p_partkey, p_size * 20 AS cur, 600 AS ceil FROM part), u AS (SELECT *, least(ceil, greatest(cur + 128, cur * 2)) AS up FROM x)
SELECT p_partkey, CASE WHEN cur < ceil THEN CASE WHEN ceil - up < 128 THEN ceil ELSE up END END AS next_limit, CASE WHEN cur % 3 <> 0 THEN 'complete' WHEN cur < ceil THEN 'retry' ELSE 'hit_token_limit' END AS outcome FROM u""")
def token_limits(spark, d):
    cur, top = F.col("p_size") * 20, F.lit(600)
    return V.table(spark, d, "part").select("p_partkey", packing.next_limit(cur, top).alias("next_limit"), packing.truncation(cur % 3 == 0, cur, top).alias("outcome"))


@query(f"""WITH RECURSIVE {V.SEGMENTS}, s AS MATERIALIZED (SELECT file, segment_index AS i, ceil(n * 1000 * 1.05)::BIGINT AS need FROM segments),
f AS (SELECT file, i, 0 AS grp, need AS used, 1 AS held FROM s WHERE i = 0
  UNION ALL SELECT s.file, s.i, CASE WHEN held >= 3 OR used + need > 60000 THEN grp + 1 ELSE grp END, CASE WHEN held >= 3 OR used + need > 60000 THEN need ELSE used + need END, CASE WHEN held >= 3 OR used + need > 60000 THEN 1 ELSE held + 1 END
  FROM f JOIN s ON s.file = f.file AND s.i = f.i + 1)
SELECT file, i AS segment_index, grp FROM f""")
def preparation_groups(spark, d):
    rows = V.segments(spark, d).select("file", "segment_index", (F.col("n") * 1000).alias("bytes"))
    return packing.groups(rows, "file", "segment_index", "bytes", 3, 60_000)


@query(f"""WITH {V.SEGMENTS} SELECT file, segment_index, (n + lead(n) OVER (PARTITION BY file ORDER BY segment_index)) * 4 <= 300 AS fits FROM segments""")
def pair_fits(spark, d):
    return packing.pairs_fit(V.segments(spark, d), "file", "segment_index", "n", 300).select("file", "segment_index", "fits")


@query(f"""WITH {V.SEGMENTS}, m AS (SELECT file, segment_index, n, (row_number() OVER (PARTITION BY file ORDER BY segment_index) - 1) // 3 AS microbatch FROM segments)
SELECT file, segment_index, n, microbatch, max(n) OVER (PARTITION BY file, microbatch) AS padded FROM m""")
def microbatches(spark, d):
    return packing.microbatches(V.segments(spark, d), "file", "segment_index", "n", 3).select("file", "segment_index", "n", "microbatch", "padded")


@query("""SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY 1""")
def latest_attempt(spark, d):
    rows = V.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return packing.latest(rows, ["user_id"], "event_id").select("user_id", "event_type", "value")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, event_type = 'error' AS oom, event_id % 40 + 1 AS n, (value * 10)::INT + 100 AS peak, event_id % 90 AS base, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 24::BIGINT AS size, 64::BIGINT AS most, 0::BIGINT AS wait FROM e GROUP BY user_id
  UNION ALL SELECT user_id, i, event_id, CASE WHEN oom THEN CASE WHEN n > 1 THEN greatest(1, least(least(most, n - 1), n // 2)) ELSE 1 END
    WHEN wait > 0 OR size >= most OR n < size OR (850 - peak) / 1000.0::DOUBLE <= 0.05 THEN size
    ELSE least(most, CASE WHEN fits > 0 THEN least(up, greatest(size, fits)) ELSE up END) END,
    CASE WHEN oom AND n > 1 THEN least(most, n - 1) ELSE most END, CASE WHEN oom THEN greatest(wait, 2) WHEN wait > 0 THEN wait - 1 ELSE 0 END
  FROM (SELECT e.*, f.size, f.most, f.wait, greatest(f.size + 1, ceil(f.size * CASE WHEN (850 - peak) / 1000.0::DOUBLE >= 0.20 THEN 1.25::DOUBLE ELSE 1.125::DOUBLE END)::BIGINT) AS up, n * greatest(0, 850 - base) // greatest(1, peak - base) AS fits
    FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, event_id, size FROM f WHERE i > 0""")
def batch_growth(spark, d):
    k = F.col("event_id")
    rows = V.table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("oom"), (k % 40 + 1).alias("rows"), (F.bround(F.col("value") * 10) + 100).cast("long").alias("peak"), (k % 90).alias("before"))
    return packing.learn(rows, "user_id", "event_id", 24, 64, 1000)


_MESSAGES = ("CUDA  out of memory at 0x7FfA", "CUDA error: memory allocation", "HIP error 12 in room", "step{} failed after {} rows", "", "CUBLAS_STATUS_ALLOC_FAILED", "DefaultCPUAllocator: item{}", "driver shutting down")
_KINDS = ("RuntimeError", "KeyError", "ArgumentError")


@query(rf"""WITH m AS (SELECT event_id, {list(_KINDS)}[event_id % 3 + 1] AS error, replace({list(_MESSAGES)}[event_id % 8 + 1], '{{}}', event_id::VARCHAR) AS message FROM events),
s AS (SELECT *, trim(regexp_replace(message, ' +', ' ', 'g')) AS t, lower(message) AS l FROM m)
SELECT event_id, CASE WHEN contains(l, 'out of memory') OR contains(l, 'cuda error: memory allocation') OR contains(l, 'cublas_status_alloc_failed') OR contains(l, 'defaultcpuallocator') THEN 'oom'
  WHEN error = 'KeyError' OR contains(l, 'hip error') OR contains(l, 'cuda error') OR contains(l, 'driver shutting down') OR contains(l, 'cublas_status') THEN 'fatal' ELSE 'error' END AS class,
  error || ': ' || regexp_replace(regexp_replace(CASE WHEN t = '' THEN '<no message>' ELSE t END, '0x[0-9a-fA-F]+', '0x*', 'g'), '\b[0-9]+\b', '#', 'g') AS fingerprint FROM s""")
def error_policy(spark, d):
    k = F.col("event_id")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (k % n).cast("int"))
    rows = V.table(spark, d, "events").select("event_id", pick(_KINDS, 3).alias("error"), F.replace(pick(_MESSAGES, 8), F.lit("{}"), k.cast("string")).alias("message"))
    return rows.select("event_id", T.error_class(F.col("message"), error=F.col("error")).alias("class"), T.error_fingerprint(F.col("error"), F.col("message")).alias("fingerprint"))


@query(r"""SELECT doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '') AS tokens FROM documents""")
def split_words(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("tokens"))


@query("""SELECT item_id, list_transform(flatten(list_transform(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> ''), lambda w: ['<star>', w])), lambda x: x) AS tokens FROM benchmark""")
def star_tokens(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", T.with_stars(T.words(F.col("text"))).alias("tokens"))


@query()
def normalize_text(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", T.normalize(F.col("text")).alias("normalized"))


@query()
def romanize_text(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", T.romanize(F.col("text")).alias("romanized"))


@query("""SELECT output, c_custkey, format, count(*) OVER (PARTITION BY output) > 1 AS collides FROM (SELECT c_custkey, f AS format, c_mktsegment || '-' || (c_custkey % 50) || '.' || f AS output FROM customer, (VALUES ('srt'), ('txt')) t(f))""")
def output_plan(spark, d):
    files = V.table(spark, d, "customer").select("c_custkey", F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("stem"))
    return state.plan_outputs(files, "stem", ["srt", "txt"]).select("output", "c_custkey", "format", "collides")


@query("""SELECT s.id, coalesce(r.status, 'worker_output_missing') AS status, coalesce(r.hypothesis, '') AS hypothesis FROM (SELECT doc_id AS id FROM documents) s LEFT JOIN (SELECT doc_id AS id, 'ok' AS status, 'q' || quality AS hypothesis FROM labels) r ON s.id = r.id""")
def samples_with_rows(spark, d):
    rows = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("ok").alias("status"), F.concat(F.lit("q"), "quality").alias("hypothesis"))
    return profile.samples_with_rows(V.table(spark, d, "documents").select(F.col("doc_id").alias("id")), rows)


@query("""SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unknown_rows(spark, d):
    return profile.unknown_rows(V.table(spark, d, "labels").select(F.col("doc_id").alias("id")), V.table(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'archive only' ELSE 'installed only' END AS side FROM (SELECT DISTINCT doc_id FROM documents) a FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id""")
def compare_files(spark, d):
    return profile.compare_files(V.table(spark, d, "documents").select("doc_id"), V.table(spark, d, "labels").select("doc_id"), "doc_id")


@query("""SELECT i AS doc_id FROM range(0, (SELECT max(doc_id) + 1 FROM labels)) t(i) WHERE i NOT IN (SELECT doc_id FROM labels) ORDER BY i LIMIT 8""")
def missing_ids(spark, d):
    ids = V.table(spark, d, "labels")
    return profile.missing_ids(ids, "doc_id", ids.agg(F.max("doc_id")).first()[0] + 1)


@query("""SELECT c_mktsegment AS key, count(DISTINCT c_nationkey) AS n_values FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1""")
def vocabulary_conflicts(spark, d):
    rows = V.table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").alias("value"))
    return profile.conflicting(rows, "key", "value")
