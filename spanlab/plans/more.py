"""Further queries: scalar operators, set operations and small decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packing, profile, recovery, state, timing
from ..operators import spans as S
from . import views as V
from .queries import query


@query("""SELECT o_orderkey, (ceil(o_totalprice * 16000) + 1)::BIGINT * 4 AS bytes, (floor(o_totalprice)::BIGINT * 16000) / 100.0::DOUBLE AS hundredths FROM orders""")
def decoded_size(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", S.decoded_bytes(F.col("o_totalprice")).alias("bytes"), T.centiseconds(F.floor("o_totalprice") * 16000).cast("double").alias("hundredths"))


_MIX = "[{}]::DOUBLE[]".format(", ".join(map(str, S.layout_weights(8))))


@query(f"""WITH f AS (SELECT vec_id, unnest(range(0, 8)) AS frame, embedding FROM embeddings), c AS (SELECT vec_id, frame, embedding[frame * 8 + 1 : frame * 8 + 8] AS ch FROM f)
SELECT vec_id, frame, round(list_sum(list_transform(range(1, 9), lambda i: ch[i]::DOUBLE * ({_MIX})[i])), 6) AS mixed, round(list_sum(list_transform(ch, lambda x: x::DOUBLE)) / 8, 6) AS mean,
  len(list_filter(ch, lambda x: NOT abs(x) > 0.3::DOUBLE)) > 0 AS bad FROM c""")
def downmix(spark, d):
    """Each vector as eight frames of eight channels; values near zero are made infinite to be found."""
    frames = V.table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("frame"), "embedding")
    ch = F.slice("embedding", F.col("frame") * 8 + 1, F.lit(8))
    w = F.array(*[F.lit(x) for x in S.layout_weights(8)])
    spoiled = F.transform(ch, lambda x: F.when(F.abs(x) > F.lit(0.3), x).otherwise(F.lit(float("inf"))))
    return frames.select("vec_id", F.col("frame").cast("long"), F.round(S.downmix(ch, w), 6).alias("mixed"), F.round(S.downmix(F.transform(ch, lambda x: x.cast("double"))), 6).alias("mean"), S.has_bad_samples(spoiled).alias("bad"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, (l_partkey - 100) / 16000.0::DOUBLE) AS start, least(5000 / 16000.0::DOUBLE, l_partkey * 2 / 16000.0::DOUBLE) AS "end" FROM lineitem
WHERE least(5000 / 16000.0::DOUBLE, l_partkey * 2 / 16000.0::DOUBLE) > greatest(0.0, (l_partkey - 100) / 16000.0::DOUBLE)""")
def samples_to_seconds(spark, d):
    a, b, left = S.to_seconds(F.col("l_partkey") - 100, F.col("l_partkey") * 2, F.lit(5000))
    return V.table(spark, d, "lineitem").filter(left).select("l_orderkey", "l_linenumber", "l_partkey", a.alias("start"), b.alias("end"))


@query(f"""WITH RECURSIVE {V.SPANS}, sp AS MATERIALIZED (SELECT stream, idx, (start % 100000000) / 1000.0::DOUBLE AS start, ("end" - start + start % 100000000) / 1000.0::DOUBLE AS "end" FROM spans),
f AS (SELECT stream, idx, 0 AS k, start AS a, "end" AS b FROM sp WHERE idx = 0
  UNION ALL SELECT s.stream, s.idx, CASE WHEN s."end" - f.a <= 7200 + 1e-9 THEN f.k ELSE f.k + 1 END, CASE WHEN s."end" - f.a <= 7200 + 1e-9 THEN f.a ELSE s.start END, s."end" FROM f JOIN sp s ON s.stream = f.stream AND s.idx = f.idx + 1)
SELECT stream, count(DISTINCT k) AS n, round(max(b - a), 3) AS widest FROM (SELECT stream, k, min(a) AS a, max_by(b, idx) AS b FROM f GROUP BY ALL) GROUP BY stream""")
def merge_fold(spark, d):
    """All spans of a stream as an array, folded inside the JVM."""
    one = F.struct("idx", (F.col("start") % 100_000_000 / 1000).alias("start"), ((F.col("end") - F.col("start") + F.col("start") % 100_000_000) / 1000).alias("end"))
    arrays = V.spans(spark, d).groupBy("stream").agg(F.array_sort(F.collect_list(one)).alias("s"))
    m = arrays.select("stream", S.merge_array(F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), 7200.0).alias("m"))
    return m.select("stream", F.size("m").cast("long").alias("n"), F.round(F.array_max(F.transform("m", lambda x: x["end"] - x["start"])), 3).alias("widest"))


@query("""SELECT s_suppkey, 24 * greatest(s_acctbal / 100, 0.25) AS budget, least(536870912, floor(s_suppkey * 10000000 / 2))::BIGINT AS group_bytes,
CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 THEN s_suppkey + 1 ELSE s_suppkey END AS generated FROM supplier""")
def budgets(spark, d):
    k = F.col("s_suppkey")
    return V.table(spark, d, "supplier").select(
        "s_suppkey", packing.audio_budget(F.lit(24), F.col("s_acctbal") / 100).alias("budget"), packing.group_bytes(k * 10_000_000).cast("long").alias("group_bytes"),
        timing.generated_tokens(k, k % 3 == 0, k % 2 == 0).alias("generated"),
    )


@query("""WITH g AS (SELECT c_nationkey, c_custkey, (c_custkey % 97 + 3) * 10 AS n FROM customer), w AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS t FROM g),
e AS (SELECT *, CASE WHEN 1000000 - t > 0 THEN floor((1000000 - t) * n / t) ELSE 0 END AS extra, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey) AS rk FROM w)
SELECT c_nationkey, c_custkey, n, (n + extra + CASE WHEN rk = 1 THEN greatest(0, 1000000 - t) - sum(extra) OVER (PARTITION BY c_nationkey) ELSE 0 END)::BIGINT AS granted FROM e""")
def leftover_shares(spark, d):
    rows = V.table(spark, d, "customer").select("c_nationkey", "c_custkey", ((F.col("c_custkey") % 97 + 3) * 10).alias("n"))
    return packing.share_leftover(rows, ["c_nationkey"], "c_custkey", "n", 1_000_000).withColumnRenamed("grant", "granted").select("c_nationkey", "c_custkey", "n", "granted")


@query("""SELECT doc_id, [{'format': 'txt', 'size': octet_length(encode(text))::BIGINT, 'sha256': sha256(text)}, {'format': 'vtt', 'size': 7::BIGINT + octet_length(encode(text)), 'sha256': sha256('WEBVTT' || chr(10) || text)}] AS outputs FROM documents""")
def manifest_outputs(spark, d):
    docs = V.table(spark, d, "documents")
    both = docs.select("doc_id", F.lit("txt").alias("format"), F.col("text").alias("content")).unionByName(docs.select("doc_id", F.lit("vtt").alias("format"), F.concat(F.lit("WEBVTT\n"), "text").alias("content")))
    return state.manifest_outputs(both, "doc_id")


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '/+', '/', 'g'), '/$', '') AS path FROM pages""")
def path_normalize(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.path(F.col("url")).alias("path"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_acctbal WHEN 1 THEN c_custkey * 1000.5 WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN c_custkey::DOUBLE END AS f,
CASE c_custkey % 5 WHEN 1 THEN NULL WHEN 3 THEN c_custkey WHEN 4 THEN c_custkey * 100000 + 10234 END AS i FROM customer""")
def parse_numbers(spark, d):
    """Plain decimals, underscores, infinity, spaces about digits, Arabic digits and what is no number."""
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    arabic = F.translate(F.concat(n, F.lit("10234")), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    given = F.when(k % 5 == 0, F.col("c_acctbal").cast("string")).when(k % 5 == 1, F.format_string("%.1f", k * 1000.5)).when(k % 5 == 2, " Infinity").when(k % 5 == 3, F.concat(F.lit(" +"), n, F.lit(" "))).otherwise(arabic)
    return V.table(spark, d, "customer").select("c_custkey", F.when(k % 5 != 4, T.parse_float(given)).alias("f"), F.when(k % 5 > 0, T.parse_int(given)).alias("i"))


@query("""SELECT user_id, list(event_type ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL) GROUP BY user_id""")
def ordered_distinct(spark, d):
    rows = V.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]).alias("kinds"))


@query("""SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels""")
def difference(spark, d):
    return V.table(spark, d, "documents").select("doc_id").exceptAll(V.table(spark, d, "labels").select("doc_id"))


@query("""SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 64 AS chunk FROM events""")
def fixed_chunks(spark, d):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return V.table(spark, d, "events").select("user_id", "event_id", F.floor((rn - 1) / 64).alias("chunk"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_outputs(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""SELECT p_partkey, lower(p_name) AS folded, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part""")
def folded_order(spark, d):
    """A total order over one small table: its window is one partition by its meaning."""
    rows = V.table(spark, d, "part").select("p_partkey", T.casefold_key(F.col("p_name")).alias("folded"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("folded", "p_partkey")))


@query("""SELECT l_returnflag AS lane, round(sum(l_quantity * 1000) / 1e6, 6) AS encode_s, round(sum(l_extendedprice) / 1e6, 6) AS decode_s, count(*) AS calls FROM lineitem GROUP BY 1""")
def phase_timings(spark, d):
    micros = V.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("lane"))
    return micros.agg(F.round(F.sum(F.col("l_quantity") * 1000) / 1e6, 6).alias("encode_s"), F.round(F.sum("l_extendedprice") / 1e6, 6).alias("decode_s"), F.count("*").alias("calls"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_partkey + (l_linenumber - 1) * (40 + l_partkey % 2) + 39 * 1 + 1 AS extent, l_partkey % 2 = 0 AS dense FROM lineitem""")
def tensor_extents(spark, d):
    shape = F.array(F.col("l_linenumber").cast("long"), F.lit(40).cast("long"))
    stride = F.array((F.col("l_partkey") % 2 + 40).cast("long"), F.lit(1).cast("long"))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", recovery.tensor_extent(F.col("l_partkey"), shape, stride).alias("extent"), recovery.is_contiguous(shape, stride).alias("dense"))


@query("""SELECT n_name AS name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) ORDER BY n_name LIMIT 8""")
def unmapped_names(spark, d):
    names = V.table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return recovery.unmapped(names, names.filter("n_nationkey % 2 = 0"), "name")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'int4' WHEN 1 THEN 'int8' ELSE 'dense' END AS kind FROM part""")
def model_kinds(spark, d):
    four, eight = (F.when(F.col("p_size") % 3 == k, "true").otherwise("false") for k in (0, 1))
    config = F.concat(F.lit('{"quantization": {"load_in_4bit": '), four, F.lit(', "load_in_8bit": '), eight, F.lit("}}"))
    return V.table(spark, d, "part").select("p_partkey", recovery.model_kind(config).alias("kind"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey * 2 END AS result, CASE WHEN c_custkey % 5 = 0 THEN 'bad row' END AS error FROM customer""")
def isolated_errors(spark, d):
    def double(rows):
        if any(x % 5 == 0 for x in rows):
            raise ValueError("bad row")
        return [x * 2 for x in rows]

    rows = V.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("v"))
    out = recovery.apply(rows, "c_custkey", "v", double, "double")
    return out.withColumn("result", F.col("result").cast("long"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","gone":null}') AS fingerprint FROM customer""")
def row_fingerprints(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", T.fingerprint_of(c_name=F.col("c_name"), c_custkey=F.col("c_custkey"), gone=F.lit(None).cast("string")).alias("fingerprint"))


@query(f"""WITH {V.SEGMENTS} SELECT '{{"n_files":' || count(DISTINCT file) || ',"n_segments":' || count(*) || ',"n_tokens":' || sum(n)::BIGINT || ',"schema_version":9}}' AS profile FROM segments""")
def profile_json(spark, d):
    rows = V.segments(spark, d).agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_segments"), F.sum("n").alias("n_tokens"))
    return rows.select(F.to_json(F.struct("n_files", "n_segments", "n_tokens", F.lit(9).alias("schema_version"))).alias("profile"))


@query("""SELECT count(*) AS resumed, count(*) FILTER (WHERE quality = 1) AS written FROM labels""")
def checkpoint_counts(spark, d):
    return V.table(spark, d, "labels").agg(F.count("*").alias("resumed"), F.count_if(F.col("quality") == 1).alias("written"))


@query("""SELECT o_orderpriority AS engine, count(*) FILTER (WHERE o_orderstatus = 'P') = 0 AS ok FROM orders GROUP BY 1""")
def run_is_ok(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("engine"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.lit(1.0).alias("duration"))
    return rows.groupBy("engine").agg((F.count_if(F.col("status") == "failed") == 0).alias("ok"))
