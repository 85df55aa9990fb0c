"""Exact dedup by skew-safe combining.

1. Digests: 128 bits of every text are counted, combined in each task before the shuffle.
   A text whose digest stands once has no copy and never moves; a Bloom filter of the
   digests that stand more often, bounded in size, lets all of their rows pass on (and by
   chance a few others, which the next steps leave as they are).
2. Local: Spark's partial aggregate keeps one row per (digest, salt, text) in each task,
   before anything is shuffled.
3. Salted: the winners of the tasks for one text are spread over ``salts`` reducers by the
   number of their task, so no reducer sees a whole hot group, even of one doc_id.
4. Global: at most ``salts`` winners a text are combined.

The text itself is part of the grouping key at every stage from 2 on; the digest only places
and orders the rows, so two texts with one digest are never confused.

Defined results: the row with the smallest doc_id stays (null last; ties between rows of
one doc_id by the other columns); empty texts are equal, and null texts equal each other
as in SQL's GROUP BY.  Extra columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import discard, materialize, positional

SALTS = 16


def _sortable(kind: str) -> bool:
    return not any(x in kind for x in ("map<", "variant", "interval"))


def dedup(docs: DataFrame, salts: int = SALTS, copies: str | None = None) -> DataFrame:
    """One row for each distinct text, with the columns of docs.

    ``copies`` names a further column for the number of rows that share the text.
    """
    names = docs.columns
    rows = positional(docs)
    i, t = (f"c{names.index(x)}" for x in ("doc_id", "text"))
    rest = [c for c in rows.columns if c != t]
    order = [F.col(i).isNull(), F.col(i), *(F.col(c) for c, k in rows.dtypes if c not in (i, t) and _sortable(k))]
    once, often = _split(rows, t)
    keyed = often.select(
        F.xxhash64(t).alias("d"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("s"),
        F.col(t).alias("t"),
        F.struct(*rest).alias("p"),
        F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("o"),
        F.lit(1).cast("long").alias("n"),
    )

    def combine(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min_by("p", "o").alias("p"), F.min("o").alias("o"), F.sum("n").alias("n"))

    won = combine(combine(keyed, "d", "s", "t"), "d", "t")
    out = won.select(*[(F.col("t") if c == t else F.col(f"p.{c}")).alias(c) for c in rows.columns], "n")
    out = once.select(*rows.columns, F.lit(1).cast("long").alias("n")).unionByName(out).toDF(*names, copies or "__n")
    return out if copies else out.select(*[out[k] for k in range(len(names))])


def _split(rows: DataFrame, t: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose text surely stands once, and the others."""
    digest = [F.xxhash64(t).alias("d1"), F.xxhash64(F.lit(1), t).alias("d2")]
    again = materialize(rows.select(*digest).groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("d1", "d2").alias("x")), "digests")
    # at most bloom.MAX_BYTES
    shared = rows.sparkSession.sparkContext.broadcast(bloom.build(again, again.count()))
    discard(again)

    @F.pandas_udf("boolean")
    def passes(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.passes(x.to_numpy(np.int64)))

    marked = rows.withColumn("again", passes(F.xxhash64(F.xxhash64(t), F.xxhash64(F.lit(1), t))))
    return marked.filter(~F.col("again")).drop("again"), marked.filter("again").drop("again")
