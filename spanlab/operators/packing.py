"""Batches, budgets, retries and preparation groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

SIZES = {"cuda": 24, "mps": 8, "cpu": 4}
GROUP_BYTES = 512 << 20


def longest_first(df: DataFrame, group: str, seconds: str, order: str) -> DataFrame:
    """Stable order by falling length, as ``place`` from 0."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(seconds), order)) - 1)


def pack(df: DataFrame, group: str, seconds: str, order: str, size: int, budget: float) -> DataFrame:
    """Batch number of each row: longest first, padded length within the budget."""
    kind, kind_o = (df.schema[c].dataType.simpleString() for c in (group, order))

    def run(key, p):
        p = p.sort_values([seconds, order], ascending=[False, True], kind="stable")
        return pd.DataFrame({group: key[0], order: p[order], "batch": K.pack(p[seconds].tolist(), size, budget)})

    return df.select(group, order, seconds).groupBy(group).applyInPandas(run, f"{group} {kind}, {order} {kind_o}, batch int")


def audio_budget(initial: Column, longest: Column, fixed: Column | None = None) -> Column:
    out = initial * F.greatest(longest, F.lit(0.25))
    return out if fixed is None else F.coalesce(fixed, out)


def split_point(durations: Column) -> Column:
    """Where to cut an array (longest first) for the least padded cost; the first of equal cuts."""
    n = F.size(durations)
    cost = lambda i: F.greatest(i * durations[0], (n - i) * F.element_at(durations, i + 1))
    cuts = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(cost(i).alias("cost"), i.alias("cut")))
    return F.when(n > 1, F.array_min(cuts)["cut"])


def next_limit(current: Column, ceiling: Column) -> Column:
    up = F.least(ceiling, F.greatest(current + 128, current * 2))
    return F.when(current < ceiling, F.when(ceiling - up < 128, ceiling).otherwise(up))


def truncation(stopped: Column, current: Column, ceiling: Column) -> Column:
    return F.when(~stopped, "complete").when(next_limit(current, ceiling).isNotNull(), "retry").otherwise("hit_token_limit")


def learn(events: DataFrame, stream: str, order: str, initial: int, most: int, total: int, budget: int = 0) -> DataFrame:
    """Batch size after each batch, a fold over the log: ``oom``, the ``rows`` tried, ``peak`` and ``before`` bytes."""
    kind, kind_o = (events.schema[c].dataType.simpleString() for c in (stream, order))

    def run(key, p):
        p, g = p.sort_values(order, kind="stable"), K.Growth(initial, most, total, budget)
        size = [g.oom(int(rows)) if oom else g.fitted(int(rows), int(peak), int(before)) for oom, rows, peak, before in zip(p["oom"], p["rows"], p["peak"], p["before"])]
        return pd.DataFrame({stream: key[0], order: p[order], "size": size})

    return events.select(stream, order, "oom", "rows", "peak", "before").groupBy(stream).applyInPandas(run, f"{stream} {kind}, {order} {kind_o}, size int")


def groups(df: DataFrame, run_key: str, order: str, estimate: str, workers: int, limit: int) -> DataFrame:
    """First-fit preparation groups in input order."""
    kind, kind_o = (df.schema[c].dataType.simpleString() for c in (run_key, order))

    def run(key, p):
        p = p.sort_values(order, kind="stable")
        return pd.DataFrame({run_key: key[0], order: p[order], "grp": K.group_first_fit(p[estimate].tolist(), workers, limit)})

    return df.select(run_key, order, estimate).groupBy(run_key).applyInPandas(run, f"{run_key} {kind}, {order} {kind_o}, grp int")


def group_bytes(limit: Column) -> Column:
    return F.least(F.lit(GROUP_BYTES).cast("long"), F.floor(limit / 2))


def share_leftover(df: DataFrame, keys: list[str], order: str, estimate: str, limit: int) -> DataFrame:
    """The unused bytes of each group, in proportion; the remainder goes to the largest."""
    w = Window.partitionBy(*keys)
    total, left = F.sum(estimate).over(w), F.lit(limit) - F.sum(estimate).over(w)
    extra = F.when(left > 0, F.floor(left * F.col(estimate) / total)).otherwise(0)
    rows = df.withColumn("extra", extra).withColumn("rest", F.greatest(F.lit(0), F.lit(limit) - F.sum(estimate).over(w)) - F.sum("extra").over(w))
    first = F.row_number().over(w.orderBy(F.desc(estimate), order)) == 1
    return rows.withColumn("grant", (F.col(estimate) + F.col("extra") + F.when(first, F.col("rest")).otherwise(0)).cast("long")).drop("extra", "rest")


def pairs_fit(df: DataFrame, stream: str, order: str, samples: str, limit: int) -> DataFrame:
    """Whether an item and the next fit in memory together as float32."""
    following = F.lead(samples).over(Window.partitionBy(stream).orderBy(order))
    return df.withColumn("fits", F.when(following.isNotNull(), (F.col(samples) + following) * 4 <= limit))


def microbatches(df: DataFrame, stream: str, order: str, length: str, rows: int = 8) -> DataFrame:
    """Consecutive rows in groups of ``rows``, each padded to its own longest."""
    out = df.withColumn("microbatch", F.floor((F.row_number().over(Window.partitionBy(stream).orderBy(order)) - 1) / rows))
    return out.withColumn("padded", F.max(length).over(Window.partitionBy(stream, "microbatch")))


def latest(outcomes: DataFrame, keys: list[str], attempt: str) -> DataFrame:
    """Of several attempts the last one counts."""
    rest = [c for c in outcomes.columns if c not in keys]
    return outcomes.groupBy(*keys).agg(F.max_by(F.struct(*rest), attempt).alias("r")).select(*keys, "r.*")
