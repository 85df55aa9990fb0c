"""Spans over media: windows, clipping, merging, energy and hysteresis segmentation.

Per-row operators are built-in expressions; those that look at neighbours are window
functions by stream; the state machines run once for each stream through Arrow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

RATE = K.RATE
SPANS = "array<struct<start:double,end:double>>"


def fixed_windows(df: DataFrame, stream: str, samples: str, seconds: float) -> DataFrame:
    """Tumbling windows of each stream, in seconds; the last one is short."""
    if not (math.isfinite(seconds) and seconds > 0):
        raise ValueError("seconds must be finite and positive")
    width = max(1, round(seconds * RATE))
    n = F.col(samples)
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(width).cast("long"))))
    rows = df.select(stream, samples, at.alias("at"))
    return rows.select(stream, (F.col("at") / width).cast("long").alias("window"), (F.col("at") / float(RATE)).alias("start"), (F.least(F.col("at") + width, n) / float(RATE)).alias("end"))


def to_seconds(start: Column, end: Column, samples: Column) -> tuple[Column, Column, Column]:
    """Clamped bounds in seconds, and whether anything is left."""
    a, b = F.greatest(F.lit(0.0), start / float(RATE)), F.least(samples / float(RATE), end / float(RATE))
    return a, b, b > a


def clip(spans: DataFrame, regions: DataFrame, stream: str) -> DataFrame:
    """Each span cut to each region it overlaps; touching ends don't overlap.

    An equi-join on the stream with the overlap as residual, so Spark sorts and merges (or
    broadcasts, by size) and never pairs streams.  ``regions`` has r_start and r_end.
    """
    both = spans.join(regions, stream).filter((F.col("end") > F.col("r_start")) & (F.col("start") < F.col("r_end")))
    cut = both.withColumns({"start": F.greatest("start", "r_start"), "end": F.least("end", "r_end")})
    return cut.filter("end > start")


def _per_stream(df: DataFrame, stream: str, order: list[str], fn, schema: str) -> DataFrame:
    kind = df.schema[stream].dataType.simpleString()

    def run(key, pdf):
        rows = list(fn(pdf.sort_values(order, kind="stable")))
        names = [c.split()[0] for c in schema.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, stream, key[0])
        return out

    return df.groupBy(stream).applyInPandas(run, f"{stream} {kind}, {schema}")


def merge(df: DataFrame, stream: str, longest: float) -> DataFrame:
    """Greedy merging: extend while the merged span stays within ``longest``."""
    rows = df.select(stream, "start", "end")
    return _per_stream(rows, stream, ["start", "end"], lambda p: ((k, *s) for k, s in enumerate(K.merge_greedy(zip(p["start"], p["end"]), longest))), "span int, start double, end double")


def merge_array(spans: Column, longest: float) -> Column:
    """The same over an array of spans, as a fold inside the JVM."""
    one = "struct<start:double,end:double>"
    empty = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("now"))

    def step(acc, s):
        fits = s["end"] - acc["now"]["start"] <= F.lit(longest + 1e-9)
        grown = F.struct(acc["done"].alias("done"), F.struct(acc["now"]["start"].alias("start"), s["end"].alias("end")).alias("now"))
        fresh = F.struct(F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"), F.struct(s["start"].alias("start"), s["end"].alias("end")).alias("now"))
        return F.when(acc["now"].isNotNull() & fits, grown).otherwise(fresh)

    return F.aggregate(spans, empty, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def snap(df: DataFrame, stream: str, media: str, longest: float | None = None) -> DataFrame:
    """Validated spans; an error is a row with its message, not a failed job."""

    def run(p):
        try:
            for k, (a, b) in enumerate(K.snap(zip(p["start"], p["end"]), float(p[media].iloc[0]), longest)):
                yield k, a, b, None
        except ValueError as e:
            yield None, None, None, str(e)

    return _per_stream(df.select(stream, "start", "end", media, "idx"), stream, ["idx"], run, "span int, start double, end double, error string")


def has_bad_samples(samples: Column) -> Column:
    return F.exists(samples, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


_HALF = math.sqrt(0.5)
#: what a speaker adds to the mono mix: left and right, centre, low frequencies, surround
_SPEAKERS = {"L": _HALF, "C": 1.0, "F": 0.0, "S": 0.5}
#: the speakers of the usual layouts by their number of channels
LAYOUTS = {1: "C", 2: "LL", 3: "LLF", 4: "LLCS", 5: "LLCSS", 6: "LLCFSS", 7: "LLCFSSS", 8: "LLCFSSSS"}


def layout_weights(channels: int) -> list[float] | None:
    """Weights of the mono mix for so many channels; None (the mean) where the layout isn't known."""
    return [_SPEAKERS[x] for x in LAYOUTS[channels]] if channels in LAYOUTS else None


def downmix(channels: Column, weights: Column | None = None) -> Column:
    """One sample from an array of channels: a weighted sum, or the mean."""
    if weights is None:
        return F.aggregate(channels, F.lit(0.0), lambda a, x: a + x) / F.size(channels)
    return F.aggregate(F.zip_with(channels, weights, lambda c, w: c.cast("double") * w), F.lit(0.0), lambda a, x: a + x)


def resampled_bytes(frames: Column, channels: Column, source_rate: Column, rate: Column | int = RATE) -> Column:
    """Bytes for decoding whole files: the source as float32, or the resampled mono with 64 frames to spare."""
    resampled = F.ceil(frames * (rate / source_rate.cast("double"))) + 64
    return F.greatest(frames * channels * 4, resampled * 4)


def decoded_bytes(seconds: Column, rate: Column | int = RATE) -> Column:
    return (F.ceil(seconds * rate) + 1) * 4


def energy_db(samples: Column) -> Column:
    """20 log10 of the RMS of the 16-bit samples."""
    pcm = F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767.0).cast("float").cast("int").cast("long"))
    total = F.aggregate(pcm, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return 20.0 * F.log10(F.greatest(F.sqrt(total / F.greatest(F.size(samples), F.lit(1))), F.lit(1e-10)))


def energy_spans(frames: DataFrame, stream: str, order: str, loud: str, shortest: float, longest: float, silence: float, window: float = 0.05, length: str | None = None) -> DataFrame:
    """Loud frames to spans by the energy tokenizer; ``length`` is a column of each frame's samples, of which the last may have fewer."""

    def run(p):
        t = K.EnergyTokens(shortest, longest, silence, window)
        sizes = p[length].tolist() if length else [None] * len(p)
        found = [s for s in [t.push(bool(x), n) for x, n in zip(p[loud], sizes)] + [t.close()] if s]
        return ((k, *s) for k, s in enumerate(found))

    return _per_stream(frames.select(stream, order, loud, *([length] if length else [])), stream, [order], run, "span int, start double, end double")


def speech_spans(probs: DataFrame, stream: str, order: str, prob: str, media: str | None = None, **options) -> DataFrame:
    """Hysteresis segmentation of a probability for each frame, padded; in samples.

    ``media`` is a column of the stream's samples; without it the last frame counts as full.
    """

    def run(p):
        n = int(p[media].iloc[0]) if media else len(p) * K.FRAME
        return ((k, *s) for k, s in enumerate(K.speech(p[prob].to_numpy(np.float32), n, **options)))

    return _per_stream(probs.select(stream, order, prob, *([media] if media else [])), stream, [order], run, "span int, start long, end long")


def pad(df: DataFrame, stream: str, samples: str, width: float) -> DataFrame:
    """Padding by lag and lead over whole-sample spans."""
    w = Window.partitionBy(stream).orderBy("start", "end")
    before, after = F.col("start") - F.lag("end").over(w), F.lead("start").over(w) - F.col("end")
    a = F.when(before.isNull() | (before >= 2 * width), F.greatest(F.lit(0.0), F.col("start") - F.lit(float(width))).cast("long")).otherwise(F.greatest(F.lit(0), F.col("start") - F.floor(before / 2)))
    b = F.when(after.isNull() | (after >= 2 * width), F.least(F.col(samples).cast("double"), F.col("end") + F.lit(float(width))).cast("long")).otherwise(F.col("end") + F.floor(after / 2))
    return df.select(stream, F.col("start").alias("raw_start"), F.col("end").alias("raw_end"), a.cast("long").alias("start"), b.cast("long").alias("end"))


def frame_contexts(frames: DataFrame, stream: str, order: str, samples: str, context: int) -> DataFrame:
    """Each frame behind the last ``context`` samples of the one before; zeros at the start."""
    w = Window.partitionBy(stream).orderBy(order)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), context)
    before = F.coalesce(F.lag(samples).over(w), zeros)
    return frames.withColumn("frame", F.concat(F.slice(before, -context, context), samples))


def overlapping_windows(df: DataFrame, stream: str, samples: str, window: int, context: int) -> DataFrame:
    """Sliding windows: ``window`` new samples with ``context`` on both sides; lo and hi may
    lie outside the media, where the reader pads with zeros."""
    n = F.col(samples)
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(window).cast("long"))))
    rows = df.select(stream, samples, at.alias("at"))
    lo, hi = F.col("at") - context, F.col("at") + window + context
    return rows.select(
        stream, (F.col("at") / window).cast("long").alias("window"), lo.alias("lo"), hi.alias("hi"),
        F.greatest(F.lit(0), -lo).alias("zeros_before"), F.greatest(F.lit(0), hi - n).alias("zeros_after"),
    )


def emission_frames(samples: Column, window: int = 480_000, window_frames: int = 1500, ratio: int = 320, least: int = 400) -> tuple[Column, Column, Column]:
    """How media are given to the aligner: 'direct' below a window, zero-padded to ``least`` samples, or in
    'windows', where the frames of the last one that lie beyond the media are dropped."""
    count = F.floor((samples + (window - 1)) / window)
    long = samples >= window
    frames = count * window_frames - F.floor((count * window - samples) / ratio)
    return F.when(long, "windows").otherwise("direct"), F.when(~long, F.greatest(samples, F.lit(least))), F.when(long, frames)


def window_samples(samples: Column, lo: Column, hi: Column) -> Column:
    """The samples of a window, with zeros outside the media."""
    zero = F.lit(0.0).cast("float")
    n = F.size(samples)
    inner = F.slice(samples, F.greatest(lo, F.lit(0)).cast("int") + 1, F.greatest(F.lit(0), F.least(hi, n) - F.greatest(lo, F.lit(0))).cast("int"))
    return F.concat(F.array_repeat(zero, F.greatest(F.lit(0), -lo).cast("int")), inner, F.array_repeat(zero, F.greatest(F.lit(0), hi - n).cast("int")))
