"""Word times: uniform, in proportion to speech, from alignment spans and from tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def uniform_words(segments: DataFrame, *keys: str) -> DataFrame:
    """The words of each segment, evenly over it; ``segments`` has text, start and end."""
    tokens = T.words(F.col("text"))
    n = F.size("tokens")
    step = F.greatest(F.lit(0.0), F.col("end") - F.col("start")) / n
    rows = segments.select(*keys, "start", "end", tokens.alias("tokens")).select(*keys, "start", step.alias("step"), F.posexplode("tokens").alias("word_index", "word"))
    return rows.select(*keys, "word_index", (F.col("start") + F.col("word_index") * F.col("step")).alias("start"), (F.col("start") + (F.col("word_index") + 1) * F.col("step")).alias("end"), "word")


def allocate(spans: DataFrame, keys: list[str], order: str, tokens: str, weight: str) -> DataFrame:
    """Largest-remainder shares of ``tokens`` in proportion to ``weight``, as ``share``.

    Whole shares first; what is left goes by remainder, then weight, then order.
    """
    group = Window.partitionBy(*keys)
    w = F.greatest(F.lit(0.0), F.col(weight))
    total = F.sum(w).over(group)
    exact = F.when(total > 0, F.col(tokens) * (w / total)).otherwise(0.0)
    rows = spans.withColumn("exact", exact).withColumn("whole", F.floor("exact"))
    rank = Window.partitionBy(*keys).orderBy((F.col("whole") - F.col("exact")), F.desc(weight), order)
    rows = rows.withColumn("left", F.when(total > 0, F.col(tokens) - F.sum("whole").over(group)).otherwise(0)).withColumn("rank", F.row_number().over(rank))
    return rows.withColumn("share", (F.col("whole") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("long")).drop("exact", "whole", "left", "rank")


def _shared(rows: DataFrame, spans: str, tokens: str, name: str) -> DataFrame:
    """``allocate`` inside one row: the spans (an array of start, end in order) that get any of ``tokens``, with length and share.

    What is left goes by remainder, then length, then order.
    """
    length = lambda s: s["end"] - s["start"]

    def part(s: Column, k: Column, total: Column) -> Column:
        exact = F.col(tokens) * (length(s) / total)
        return F.struct((F.floor(exact) - exact).alias("rest"), (-length(s)).alias("short"), k.alias("k"), s["start"].alias("start"), F.floor(exact).alias("whole"))

    parts = F.aggregate(spans, F.lit(0.0), lambda a, s: a + length(s), lambda total: F.transform(spans, lambda s, k: part(s, k, total)))
    shares = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["whole"], lambda given: F.transform(F.sort_array("parts"), lambda p, rank: F.struct(
        p["k"].alias("k"), p["start"].alias("start"), (-p["short"]).alias("length"), (p["whole"] + F.when(rank < F.col(tokens) - given, 1).otherwise(0)).alias("share"))))
    held = F.sort_array(F.filter(shares, lambda p: p["share"] > 0))
    return rows.withColumn("parts", parts).withColumn(name, F.transform(held, lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), p["share"].alias("share")))).drop("parts")


def words_across_spans(spans: DataFrame, keys: list[str], order: str, tokens: str) -> DataFrame:
    """The tokens (an array column) of each group over its spans, evenly inside each."""
    valid = spans.filter(F.col("end") > F.col("start")).withColumns({"n": F.size(tokens), "length": F.col("end") - F.col("start")})
    shared = allocate(valid, keys, order, "n", "length")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = shared.withColumn("offset", F.coalesce(F.sum("share").over(before), F.lit(0))).filter("share > 0")
    rows = rows.select(*keys, "start", (F.col("length") / F.col("share")).alias("step"), "offset", F.slice(F.col(tokens), (F.col("offset") + 1).cast("int"), F.col("share").cast("int")).alias("mine"))
    rows = rows.select(*keys, "start", "step", "offset", F.posexplode("mine").alias("k", "word"))
    return rows.select(*keys, (F.col("offset") + F.col("k")).alias("word_index"), (F.col("start") + F.col("k") * F.col("step")).alias("start"), (F.col("start") + (F.col("k") + 1) * F.col("step")).alias("end"), "word")


def words_by_mode(segments: DataFrame, speech: DataFrame, keys: list[str], mode: str, merge: bool = True, aligned: DataFrame | None = None) -> DataFrame:
    """Timed words: none, by segment, or as aligned; ``source`` tells how each was timed.

    By segment, words go over the stretches of ``speech`` (keys, r_start, r_end) that overlap
    theirs if ``merge`` is on and there are any, and else evenly over the segment.
    ``segments`` has keys, text, start and end; ``aligned`` has the columns of the result.
    """
    names = [*keys, "word_index", "start", "end", "word"]
    even = uniform_words(segments, *keys).select(*names, F.lit("uniform").alias("source"))
    if mode == "none":
        return even.limit(0)
    if mode == "word":
        return aligned.select(*names, "source")
    if mode != "segment":
        raise ValueError(f"no such mode: {mode}")
    if not merge:
        return even
    held = speech.groupBy(*keys).agg(F.collect_list(F.struct("r_start", "r_end")).alias("speech"))
    inside = F.filter("speech", lambda s: (s["r_end"] > F.col("start")) & (s["r_start"] < F.col("end")))
    inside = F.transform(inside, lambda s: F.struct(F.greatest("start", s["r_start"]).alias("start"), F.least("end", s["r_end"]).alias("end")))
    inside = F.sort_array(F.filter(inside, lambda s: s["end"] > s["start"]))
    # a segment stays one row until nothing is moved or sorted any more
    rows = segments.select(*keys, "text", "start", "end").join(held, keys, "left")
    rows = rows.select(*keys, "start", "end", T.words(F.col("text")).alias("tokens"), F.coalesce(inside, F.expr("array()")).alias("met"))
    rows = _shared(rows.withColumn("n", F.size("tokens")), "met", "n", "shared")
    whole = F.struct(F.col("start").alias("start"), F.greatest(F.lit(0.0), F.col("end") - F.col("start")).alias("length"), F.col("n").cast("long").alias("share"))
    some = F.size("met") > 0
    rows = rows.select(*keys, "tokens", F.when(some, F.col("shared")).otherwise(F.array(whole)).alias("over"), F.when(some, "uniform_speech_spans").otherwise("uniform").alias("source"))
    times = F.flatten(F.transform("over", lambda s: F.transform(F.array_repeat(s, s["share"].cast("int")), lambda x, k: F.struct(
        (x["start"] + k * (x["length"] / x["share"])).alias("start"), (x["start"] + (k + 1) * (x["length"] / x["share"])).alias("end")))))
    # outer, for Spark would work out the arrays twice to leave out the empty ones
    rows = rows.select(*keys, "source", F.posexplode_outer(F.arrays_zip("tokens", times.alias("times"))).alias("word_index", "word")).filter(F.col("word").isNotNull())
    return rows.select(*keys, F.col("word_index").cast("long").alias("word_index"), "word.times.start", "word.times.end", F.col("word.tokens").alias("word"), "source")


def span_times(spans: DataFrame, keys: list[str], order: str, stride_ms: float) -> DataFrame:
    """Frame spans to seconds; a word starts no earlier than the one before it ends."""
    start, end = F.col("first") * F.lit(float(stride_ms)) / 1000.0, (F.col("last") + 1) * F.lit(float(stride_ms)) / 1000.0
    w = Window.partitionBy(*keys).orderBy(order)
    rows = spans.withColumns({"start": start, "end": end})
    return rows.withColumn("start", F.greatest("start", F.coalesce(F.lag("end").over(w), F.col("start"))))


def token_words(tokens: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Tokens (text, t0, t1, p) to words.

    An empty token is skipped; a lone space ends a word; a leading space starts one, unless
    the rest is ASCII punctuation.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = tokens.filter(F.col("text") != "")
    punct = F.col("text").rlike(r"^ [!-/:-@\[-`{-~]+$")
    opens = (F.lag("text").over(w) == " ") | (F.col("text").startswith(" ") & ~punct) | (F.row_number().over(w) == 1)
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("word_index", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(F.col("text") != " ").withColumn("piece", F.regexp_replace("text", "^ ", ""))
    place = F.struct(F.col(order).alias("o"), "piece")
    words = rows.groupBy(*keys, "word_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda s: s["piece"]), "").alias("word"),
        F.min_by("t0", order).alias("t0"), F.max_by("t1", order).alias("t1"), F.coalesce(F.avg("p"), F.lit(1.0)).alias("p"),
    )
    return words.withColumn("word_index", F.dense_rank().over(Window.partitionBy(*keys).orderBy("word_index")) - 1)


def byte_times(tokens: DataFrame, keys: list[str], order: str, duration: str) -> DataFrame:
    """Token times in proportion to UTF-8 bytes, in whole hundredths."""
    group = Window.partitionBy(*keys)
    run = group.orderBy(order)
    n = F.octet_length("text")
    rows = tokens.withColumns({"upto": F.sum(n).over(run.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(n).over(group), "bytes": n})
    at = lambda b: F.when(F.col("total") > 0, (b / F.col("total") * F.col(duration)).cast("long"))
    return rows.withColumns({"t0": F.coalesce(at(F.col("upto") - F.col("bytes")), F.lit(0)), "t1": F.coalesce(at(F.col("upto")), F.col(duration))}).drop("upto", "total", "bytes")


def sample_hundredths(samples: Column) -> Column:
    return F.floor(samples * 100 / 16000).cast("long")


def generated_tokens(tokens: Column, ended: Column, repeated: Column) -> Column:
    """Tokens, and one for the end mark unless a repetition stopped it."""
    return tokens + F.when(ended & ~repeated, 1).otherwise(0)
