"""Substring dedup by seed and extend: passages that stand in more than one document.

A *repeat* is a run of words of which every window of ``min_words`` words also stands, word
for word, in another document.  Repeats are found from seeds:

1. Seeds: every window of ``min_words`` words has as its anchor the least hash of its runs
   of ``seed`` words (winnowing; the rightmost of equal ones).  Neighbouring windows mostly
   have one anchor, so a document of n words has about 2n / (min_words - seed + 2) of them.
   The windows of one anchor together are its *block*.
2. Join and extend by blocks: occurrences meet at equal anchors.  Where whole blocks are
   equal in two documents the match extends over all of the block.
3. Extend by words: where only the anchors are equal, both ends of the match lie inside the
   block.  Only for those blocks is the text read again, and the windows around the anchor
   are compared one by one with those of the other documents at that anchor.
4. Matches that follow each other are joined to maximal repeats.

Equal windows have equal anchors, so nothing is missed; no pairs of documents are listed,
so the cost is linear even where thousands share a passage.  Groups are formed by Spark's
windows and sorts, which spill: a hot passage is a long task at worst, not a full memory.

Words are those of ``textkernel``: case and punctuation don't matter.  Defined results:
a text that is null, empty or shorter than ``min_words`` has no repeats, and rows with a
null doc_id are left out.  What a document repeats only of itself is no repeat.  Rows that
repeat a doc_id are one document.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .textkernel import Words, as_long, mix, run_sums, run_hash, slices, windows

MIN_WORDS, SEED = 50, 20
_SHIFT = 16


def least(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the rightmost least value among each ``width`` neighbours."""
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(g[b] <= g[a], b, a)
        have += step
    return at


def blocks(w: Words, min_words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window (as word positions), anchor hash and block hash."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    n = len(w.hash)
    if n < min_words:
        return none
    start = np.flatnonzero(w.row[: n - min_words + 1] == w.row[min_words - 1 :])
    if not len(start):
        return none
    grams, at = windows(w.hash, w.row, seed)
    g = np.full(n - seed + 1, np.iinfo(np.uint64).max, np.uint64)
    g[at] = grams
    own = least(g, min_words - seed + 1)[start]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)))
    first = start[new]
    last = start[np.concatenate((new[1:], [True]))]
    total = run_sums(w.hash)
    return first, last, g[own[new]], run_hash(total, first, last + min_words)


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row for each block of each document: anchor h, block hash s, doc_id and place."""

    def run(b):
        for at, part in slices(b.column("text")):
            w = Words(part)
            lo, hi, h, s = blocks(w, min_words, seed)
            row = w.row[lo]
            begin = w.first[row]
            place = ((lo - begin) << _SHIFT) | (hi - lo)
            ids = b.column("doc_id").slice(at, len(part)).take(pa.array(row))
            yield pa.record_batch([pa.array(as_long(h)), pa.array(as_long(s)), ids, pa.array(place)], ["h", "s", "doc_id", "place"])

    return map_arrow(_slim(docs), run, "h bigint, s bigint, doc_id bigint, place bigint")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).filter("doc_id is not null and text is not null")


def _windows_at(min_words: int):
    """Window hashes of the places that a document is asked for."""

    def run(b):
        places = b.column("places")
        for at, part in slices(b.column("text")):
            w = Words(part)
            n = w.counts()
            asked = places.slice(at, len(part))
            row = np.repeat(np.arange(len(part)), np.diff(asked.offsets.to_numpy()))
            place = asked.flatten().to_numpy(zero_copy_only=False)
            lo, many = place >> _SHIFT, (place & ((1 << _SHIFT) - 1)) + 1
            fits = lo + many - 1 + min_words <= n[row]  # rows of one doc_id may have several texts
            row, lo, many = row[fits], lo[fits], many[fits]
            x = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            r = np.repeat(row, many)
            start = w.first[r] + x
            h = run_hash(run_sums(w.hash), start, start + min_words)
            ids = b.column("doc_id").slice(at, len(part)).take(pa.array(r))
            yield pa.record_batch([pa.array(as_long(h)), ids, pa.array(x)], ["h", "doc_id", "x"])

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, start_word, end_word and n_words of each maximal repeat.

    Words are counted from 0; end_word is one past the last.
    """
    if not 1 <= seed <= min_words < 1 << _SHIFT:
        raise ValueError("1 <= seed <= min_words < 65536")
    anchor, block = Window.partitionBy("h"), Window.partitionBy("h", "s")
    here = F.struct("doc_id", "place")
    met = (
        occurrences(docs, min_words, seed).repartition("h")
        .select("h", "s", "doc_id", "place", F.min(here).over(block).alias("lo"), F.max(here).over(block).alias("hi"))
        .withColumn("whole", F.col("lo.doc_id") < F.col("hi.doc_id"))
        .withColumn("edge", F.col("lo").eqNullSafe(here) | F.col("hi").eqNullSafe(here))
        .select("*", F.min("doc_id").over(anchor).alias("a"), F.max("doc_id").over(anchor).alias("z"), F.max(~F.col("whole")).over(anchor).alias("part"))
        .filter("a < z")
        .select("doc_id", "place", "whole", (F.col("part") & (~F.col("whole") | F.col("edge"))).alias("ask"))
    )
    met = materialize(met, "anchors")
    asked = met.filter("ask").groupBy(F.col("doc_id").alias("i")).agg(F.collect_set("place").alias("places"))
    slim = _slim(docs)
    texts = slim.join(asked, slim["doc_id"] == asked["i"]).select("doc_id", "text", "places")
    found = map_arrow(texts, _windows_at(min_words), "h bigint, doc_id bigint, x bigint").distinct()
    same = Window.partitionBy("h")
    found = (
        found.select("doc_id", "x", F.min("doc_id").over(same).alias("a"), F.max("doc_id").over(same).alias("z"))
        .filter("a < z").select("doc_id", F.col("x").alias("lo"), F.col("x").alias("hi"))
    )
    lo = F.shiftright("place", _SHIFT)
    wide = met.filter("whole").select("doc_id", lo.alias("lo"), (lo + F.col("place").bitwiseAND((1 << _SHIFT) - 1)).alias("hi"))
    before = Window.partitionBy("doc_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("lo") > F.max("hi").over(before) + 1, F.lit(True))
    runs = (
        wide.unionByName(found).withColumn("new", new.cast("int"))
        .withColumn("run", F.sum("new").over(Window.partitionBy("doc_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "run").agg(F.min("lo").alias("start_word"), (F.max("hi") + min_words).alias("end_word"))
    )
    return runs.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
