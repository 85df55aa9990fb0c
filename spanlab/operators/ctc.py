"""Alignment of emissions to targets; errors and impossible targets fall back, as rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K


def log_softmax(v: Column, wildcard: bool = True) -> Column:
    """Log-probabilities as float32, with a wildcard of 0 at the end."""
    top = F.array_max(v)
    total = F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp((x - top).cast("double"))))
    out = F.transform(v, lambda x: ((x - top) - total).cast("float"))
    return F.concat(out, F.array(F.lit(0.0).cast("float"))) if wildcard else out


def frame_range(start: Column, end: Column, frames: Column, stride_ms: float = 20.0) -> tuple[Column, Column, Column]:
    """First frame and one past the last of a segment, half-even, inside the media; and whether they are too few to align."""
    first = F.greatest(F.bround(start * 1000 / F.lit(stride_ms)).cast("long"), F.lit(0))
    last = F.least(F.bround(end * 1000 / F.lit(stride_ms)).cast("long"), frames)
    return first, last, last - first < 2


def align(segments: DataFrame, *keys: str, blank: int = 0) -> DataFrame:
    """Path of labels for each row with ``emissions`` (frames of log-probabilities) and ``targets``."""
    schema = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for p in batches:
            paths, errors = [], []
            for e, t in zip(p["emissions"], p["targets"]):
                try:
                    paths.append(K.ctc_align(np.stack([np.asarray(x, np.float32) for x in e]), t, blank))
                    errors.append(None)
                except (ValueError, TypeError) as x:
                    paths.append(None)
                    errors.append(str(x))
            out = p[list(keys)].copy()
            out["path"], out["error"] = pd.Series(paths, index=p.index, dtype=object), pd.Series(errors, index=p.index, dtype=object)
            yield out

    return segments.select(*keys, "emissions", "targets").mapInPandas(run, f"{schema}, path array<int>, error string")


def runs(frames: DataFrame, stream: str, order: str, label: str) -> DataFrame:
    """Runs of equal labels: first and last position, counted from 0."""
    w = Window.partitionBy(stream).orderBy(order)
    rows = frames.select(stream, F.col(label).alias("label"), (F.row_number().over(w) - 1).alias("at"), F.lag(label).over(w).alias("was"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("label").eqNullSafe(F.col("was")) & (F.col("at") > 0), 0).otherwise(1)).over(Window.partitionBy(stream).orderBy("at")))
    return rows.groupBy(stream, "run").agg(F.first("label").alias("label"), F.min("at").alias("first"), F.max("at").alias("last"))


def word_spans(segments: DataFrame, *keys: str, blank: int = 0, stride_ms: float = 20.0) -> DataFrame:
    """Word times of each aligned row, in seconds from its start.

    Input: path, and ``tokens`` (a label list for each word), ``start``, ``end`` and
    ``words``.  Fewer than two frames, no targets, or any error gives uniform times and
    ``fallback``.
    """
    schema = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for p in batches:
            rows = []
            for r in p.itertuples(index=False):
                words, tokens = list(r.words), [list(t) for t in r.tokens]
                key = [getattr(r, k) for k in keys]
                try:
                    if r.path is None or len(r.path) < 2 or not any(tokens) or len(words) != len(tokens):
                        raise ValueError("nothing to align")
                    got = [(a * stride_ms / 1000 + r.start, (b + 1) * stride_ms / 1000 + r.start) for a, b in K.token_spans(tokens, K.runs(r.path), blank)]
                    times, last = [], None
                    for a, b in got:
                        a = a if last is None else max(a, last)
                        last = b
                        times.append(tuple(min(max(x, r.start), r.end) for x in (a, b)))
                    bad = False
                except ValueError:
                    step = max(0.0, r.end - r.start) / max(1, len(words))
                    times, bad = [(r.start + k * step, r.start + (k + 1) * step) for k in range(len(words))], True
                rows += [(*key, k, a, b, w, bad) for k, ((a, b), w) in enumerate(zip(times, words))]
            yield pd.DataFrame(rows, columns=[*keys, "word_index", "start", "end", "word", "fallback"])

    return segments.select(*keys, "path", "tokens", "words", "start", "end").mapInPandas(run, f"{schema}, word_index int, start double, end double, word string, fallback boolean")
