"""Subtitle cues and their rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import kernels as K

CHARS, SECONDS, GAP, SHORTEST = 42, 6.0, 0.8, 0.30


def build(words: DataFrame, stream: str, order: list[str], chars: int = CHARS, seconds: float = SECONDS, gap: float = GAP) -> DataFrame:
    """Words (start, end, word) to cues: cue_index, raw start and end, text."""
    kind = words.schema[stream].dataType.simpleString()

    def run(key, p):
        p = p.sort_values(order, kind="stable")
        got = K.cues(zip(p["start"], p["end"], p["word"]), chars, seconds, gap)
        return pd.DataFrame([(key[0], k, *c) for k, c in enumerate(got)], columns=[stream, "cue_index", "start", "end", "text"])

    return words.select(stream, *order, "start", "end", "word").groupBy(stream).applyInPandas(run, f"{stream} {kind}, cue_index int, start double, end double, text string")


def bounds(cues: DataFrame, stream: str, media: str | None = None, shortest: float = SHORTEST) -> DataFrame:
    """Clamped to the media and at least ``shortest`` long, but never into the next cue."""
    following = F.lead("start").over(Window.partitionBy(stream).orderBy("cue_index"))
    limit = F.col(media) if media else F.lit(float("inf"))
    start = F.least("start", limit)
    end = F.greatest(start, F.least("end", limit))
    upper = F.least(F.coalesce(following, F.lit(float("inf"))), limit)
    return cues.withColumns({"start": start, "end": F.greatest(start, F.least(F.greatest(end, start + shortest), upper))})


def _ordered(index: str, line: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), line.alias("s")))), lambda x: x["s"])


def srt(cues: DataFrame, stream: str) -> DataFrame:
    line = F.concat((F.col("cue_index") + 1).cast("string"), F.lit("\n"), T.timestamp(F.col("start"), True, ","), F.lit(" --> "), T.timestamp(F.col("end"), True, ","), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    return cues.groupBy(stream).agg(F.array_join(_ordered("cue_index", line), "").alias("content"))


def vtt(cues: DataFrame, stream: str) -> DataFrame:
    line = F.concat(T.timestamp(F.col("start")), F.lit(" --> "), T.timestamp(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    return cues.groupBy(stream).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(_ordered("cue_index", line), "")).alias("content"))


def txt(segments: DataFrame, stream: str, index: str) -> DataFrame:
    """Non-blank lines, each stripped, with a line break at the end."""
    lines = F.filter(_ordered(index, T.strip(F.coalesce(F.col("text"), F.lit("")))), lambda s: s != "")
    return segments.groupBy(stream).agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))


def transcript(segments: DataFrame, stream: str, index: str) -> DataFrame:
    lines = F.filter(_ordered(index, F.coalesce(F.col("text"), F.lit(""))), lambda s: ~T.is_blank(s))
    return segments.groupBy(stream).agg(F.array_join(lines, "\n").alias("text"))


def transcript_json(segments: DataFrame, stream: str, index: str) -> DataFrame:
    """The versioned transcript document: segments that aren't blank, with their own numbers."""
    item = F.struct(F.col(index).alias("index"), "start", "end", "text")
    kept = segments.filter(~T.is_blank(F.col("text"))).groupBy(stream).agg(F.array_sort(F.collect_list(item)).alias("segments"))
    every = segments.select(stream).distinct().join(kept, stream, "left")
    body = F.struct(F.lit(8).alias("schema_version"), F.col(stream).cast("string").alias("path"), F.coalesce("segments", F.array().cast("array<struct<index:bigint,start:double,end:double,text:string>>")).alias("segments"))
    return every.select(stream, F.to_json(body, {"ignoreNullFields": "false"}).alias("content"))
