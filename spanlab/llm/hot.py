"""Buckets that are too large for one task, cut into blocks that still meet each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: rows of a bucket that one task takes
MOST = 1_000_000
#: rows of the sample that finds large buckets; it only plans, every row is kept
SAMPLE = 4_000_000


def in_blocks(rows: DataFrame, largest: int, most: int = MOST) -> DataFrame:
    """The rows, with ``key`` changed where a bucket has more than about ``most`` rows.

    Such a bucket's rows are dealt by a hash of ``node`` to m blocks, and each pair of
    blocks, and each block, is a bucket of its own: a row stands in m of them, and any two
    rows of the old bucket stand together in one.  ``largest`` is known to bound the
    buckets; where it is within ``most`` nothing is looked for.
    """
    if largest <= most:
        return rows
    total = rows.count()
    share = min(1.0, SAMPLE / max(1, total))
    seen = rows.select("key").sample(share, 7) if share < 1 else rows.select("key")
    large = seen.groupBy(F.col("key").alias("large")).agg(F.ceil(F.count("*") / F.lit(share * most)).cast("int").alias("m")).filter("m > 1")
    dealt = rows.join(materialize(large, "large"), F.col("key") == F.col("large"), "left")
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("m")).cast("int")
    other = F.explode(F.when(F.col("m").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.withColumn("mine", mine).withColumn("other", other)
    key = F.when(F.col("m").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    return dealt.withColumn("key", key).select(*rows.columns)
