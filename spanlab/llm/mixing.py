"""Mixing sources to target weights by iterative proportional fitting.

The token weights of the cells (source, language, topic) are raked until their source,
language and topic marginals are the targets; a document is then sampled with the
calibrated probability of its cell, by a hash of its doc_id, so a rerun or a lost executor
gives the same sample.

``targets`` gives shares by dimension; a value without one keeps its token share, and a
dimension without any is smoothed: a value's target share is its token share to the power
``alpha``, normalised.  Fitting ends when every marginal is within ``tolerance`` of its
target, or after ``iterations`` rounds.  The sampling rate is ``fraction`` times the cell's
weight ratio.  A cell whose rate would be beyond one is kept whole, and the others are raked
again to what is left of the targets, until none is beyond one: so ``fraction`` of the
tokens is reached whatever the smallest cells are.  What a whole cell lacks of its target
weight is reported with its rate.

A document's topic is ``topic``, a column of the caller's, or the first one of TOPICS with a
keyword that stands alone in its lower-cased text (no letter or digit beside it), else
'other'; the lexicon is a parameter.  Its tokens are the runs without white space, one at
least, so an empty or null text has the weight of one token and topic 'other'.  A null
source or language is a value of its own.  Rows that repeat a doc_id are sampled together;
a null doc_id hashes as the text 'null'.  Extra columns are ignored by ``sample`` and kept
by ``resample``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unit_hash

TOPICS = {
    "legal": ("license", "copyright", "warranty", "all rights reserved"),
    "credential": ("password", "token =", "secret"),
    "contact": ("phone", "+1 (", "http", "https"),
}
#: ``max_local_cells`` bounds what the driver holds and what is broadcast, some 100 bytes a cell
PARAMS = {"alpha": 0.9, "fraction": 0.8, "iterations": 60, "tolerance": 1e-10, "max_local_cells": 1_000_000}
DIMS = ("source", "lang", "topic")
#: the shares that the registered query rakes to; its sources and topics are smoothed
LANG_SHARES = {"lang": {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}}


def alone(word: str) -> str:
    """The word without a letter or digit beside it, as a regular expression for Spark and DuckDB."""
    low, high = (r"(^|[^a-z0-9])" if word[0].isalnum() else ""), (r"([^a-z0-9]|$)" if word[-1].isalnum() else "")
    return low + re.sub(r"([^a-z0-9 ])", r"[\1]", word) + high


def topic_of(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    low, out = F.lower(text), F.lit("other")
    for name, words in reversed(topics.items()):
        hit = F.lit(False)
        for w in words:
            # the expression is only tried where the word is found at all
            hit = hit | (low.contains(w) & low.rlike(alone(w)))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)), F.lit(1)).cast("long")


def rake(cells: pd.DataFrame, targets: dict[str, dict], iterations: int, tolerance: float = PARAMS["tolerance"]) -> np.ndarray:
    """Raked weights of the cells; a value that has no target keeps its present share."""
    x = cells.tokens.to_numpy(float).copy()
    return _fit(x, [(code, share * x.sum()) for code, share in _shares(cells, targets)], iterations, tolerance)


def _shares(cells: pd.DataFrame, targets: dict[str, dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the value of each cell, by number, and the target shares of the values."""
    x, out = cells.tokens.to_numpy(float), []
    for d in DIMS:
        code, values = pd.factorize(cells[d], use_na_sentinel=False)
        now = np.bincount(code, x, len(values)) / x.sum()
        want = np.array([targets.get(d, {}).get(None if pd.isna(v) else v, s) for v, s in zip(values, now)])
        out.append((code, want / want.sum()))
    return out


def _fit(x: np.ndarray, coded: list[tuple[np.ndarray, np.ndarray]], iterations: int, tolerance: float) -> np.ndarray:
    for _ in range(iterations):
        gap = 0.0
        for code, want in coded:
            have = np.bincount(code, x, len(want))
            scale = np.divide(want, have, out=np.zeros(len(want)), where=have > 0)
            gap = max(gap, np.abs(scale[have > 0] - 1).max(initial=0.0))
            x *= scale[code]
        if gap < tolerance:
            break
    return x


def bound(cells: pd.DataFrame, targets: dict[str, dict], x: np.ndarray, fraction: float, iterations: int, tolerance: float = PARAMS["tolerance"]) -> np.ndarray:
    """Sampling rates of the cells, one at most, that keep ``fraction`` of the tokens."""
    t, coded = cells.tokens.to_numpy(float), _shares(cells, targets)
    goal = min(fraction, 1.0) * t.sum()
    y, whole = x * (goal / x.sum()), np.zeros(len(t), bool)
    while (y[~whole] > t[~whole] * (1 + 1e-9)).any():
        whole |= y > t * (1 + 1e-9)
        y[whole] = t[whole]
        free = ~whole
        if not free.any():
            break
        rest = []
        for code, share in coded:
            have = np.bincount(code[free], y[free], len(share))
            want = np.where(have > 0, np.maximum(share * goal - np.bincount(code[whole], t[whole], len(share)), have), 0)
            rest.append((code[free], want / want.sum() * (goal - t[whole].sum())))
        y[free] = _fit(y[free], rest, iterations, tolerance)
    return np.minimum(y / t, 1)


def smooth(cells: pd.DataFrame, alpha: float) -> dict[str, dict]:
    out = {}
    for d in DIMS:
        s = cells.groupby(d, dropna=False).tokens.sum() / cells.tokens.sum()
        s = s**alpha / (s**alpha).sum()
        out[d] = {None if pd.isna(k) else k: float(v) for k, v in s.items()}
    return out


def _rake_far(cells: DataFrame, targets: dict[str, DataFrame] | None, p: dict) -> DataFrame:
    """The same fit in DataFrames, for more cells than the driver should hold."""
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("x", F.col("tokens").cast("double"))
    for d in DIMS:
        share = cells.groupBy(d).agg((F.sum("tokens") / F.lit(total)).alias("share"))
        if targets and d in targets:
            share = share.join(targets[d].toDF("v", "w"), F.col(d).eqNullSafe(F.col("v")), "left").select(d, F.coalesce("w", "share").alias("w"))
        else:
            share = share.select(d, F.pow("share", F.lit(p["alpha"])).alias("w"))
        norm = share.agg(F.sum("w")).first()[0]
        share = share.select(F.col(d).alias("k"), (F.col("w") / F.lit(norm) * F.lit(float(total))).alias(f"want_{d}"))
        now = now.join(share, F.col(d).eqNullSafe(F.col("k")), "left").drop("k")
    now = materialize(now, "cells")
    for _ in range(p["iterations"]):
        gap = F.lit(0.0)
        for d in DIMS:
            have = now.groupBy(F.col(d).alias("k")).agg(F.sum("x").alias("have"))
            now = now.join(have, F.col(d).eqNullSafe(F.col("k"))).withColumn("x", F.col("x") * F.col(f"want_{d}") / F.col("have"))
            now = now.withColumn(f"gap_{d}", F.abs(F.col(f"want_{d}") / F.col("have") - 1)).drop("k", "have")
            gap = F.greatest(gap, f"gap_{d}")
        now = materialize(now, "raked")
        if now.agg(F.max(gap)).first()[0] < p["tolerance"]:
            break
    return now.select(*DIMS, "tokens", "x", *[f"want_{d}" for d in DIMS])


def _bound_far(raked: DataFrame, p: dict) -> DataFrame:
    """``bound`` in DataFrames: the cells with their rate."""
    fraction = min(p["fraction"], 1.0)
    total, weight = raked.agg(F.sum("tokens"), F.sum("x")).first()
    if not total:
        return raked.withColumn("rate", F.lit(fraction))
    over = F.col("y") > F.col("tokens") * (1 + 1e-9)
    now = raked.withColumns({"y": F.col("x") * F.lit(fraction * float(total) / weight), "whole": F.lit(False)})
    while now.filter(over & ~F.col("whole")).limit(1).count():
        now = materialize(now.withColumn("whole", F.col("whole") | over).withColumn("y", F.when(F.col("whole"), F.col("tokens").cast("double")).otherwise(F.col("y"))), "whole")
        kept, free = now.agg(F.coalesce(F.sum(F.when(F.col("whole"), F.col("tokens"))), F.lit(0)), F.count_if(~F.col("whole"))).first()
        if not free:
            break
        for d in DIMS:
            have, fixed = F.coalesce(F.sum(F.when(~F.col("whole"), F.col("y"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("whole"), F.col("tokens"))), F.lit(0))
            rest = now.groupBy(F.col(d).alias("k")).agg(have.alias("have"), fixed.alias("fixed"), F.first(f"want_{d}").alias("want"))
            rest = rest.select("k", F.when(F.col("have") > 0, F.greatest(F.col("want") * F.lit(fraction) - F.col("fixed"), "have")).otherwise(F.lit(0.0)).alias("rest"))
            norm = rest.agg(F.sum("rest")).first()[0]
            rest = rest.select("k", (F.col("rest") / F.lit(norm) * F.lit(fraction * float(total) - float(kept))).alias(f"rest_{d}"))
            now = now.join(rest, F.col(d).eqNullSafe(F.col("k"))).drop("k")
        for _ in range(p["iterations"]):
            for d in DIMS:
                have = now.groupBy(F.col(d).alias("k")).agg(F.sum(F.when(~F.col("whole"), F.col("y"))).alias("have"))
                y = F.when(F.col("whole"), F.col("y")).otherwise(F.col("y") * F.col(f"rest_{d}") / F.col("have"))
                now = now.join(have, F.col(d).eqNullSafe(F.col("k"))).withColumn("y", y).drop("k", "have")
            now = materialize(now, "bound")
        now = now.drop(*[f"rest_{d}" for d in DIMS])
    return now.withColumn("rate", F.least(F.col("y") / F.col("tokens"), F.lit(1.0)))


def rates(cells: DataFrame, targets: dict[str, dict] | None = None, **params) -> DataFrame:
    """``rated`` without the mark of its size."""
    return _rates(cells, targets, PARAMS | params)[0]


def _rates(cells: DataFrame, targets: dict[str, dict] | None, p: dict) -> tuple[DataFrame, bool]:
    """source, lang, topic, weight ratio g and sampling rate of each cell, and the tokens that it lacks as its rate is one at most.

    ``cells`` has source, lang, topic and tokens.  Up to ``max_local_cells`` the driver
    rakes; beyond it the loop runs in DataFrames, with the same result.  The second value says
    which: the rates of so few cells may be broadcast.
    """
    spark = cells.sparkSession
    few = cells.limit(p["max_local_cells"] + 1).count() <= p["max_local_cells"]
    if few:
        pdf = pd.DataFrame([r.asDict() for r in cells.orderBy(*DIMS).collect()], columns=[*DIMS, "tokens"])
        want = smooth(pdf, p["alpha"]) | (targets or {})
        x = rake(pdf, want, p["iterations"], p["tolerance"]) if len(pdf) else []
        rate = bound(pdf, want, x, p["fraction"], p["iterations"], p["tolerance"]) if len(pdf) else []
        rows = [tuple(None if isinstance(v, float) else v for v in r) + (float(t), float(w), float(k)) for *r, t, w, k in zip(*(pdf[d] for d in DIMS), pdf.tokens, x, rate)]
        rated = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double, x double, rate double")
    else:
        frames = {d: spark.createDataFrame(list(t.items()), f"v {cells.schema[d].dataType.simpleString()}, w double") for d, t in (targets or {}).items()}
        rated = _bound_far(_rake_far(cells, frames or None, p), p)
    g = F.col("x") / F.col("tokens")
    lacks = F.greatest(F.col("x") * F.lit(p["fraction"]) - F.col("tokens"), F.lit(0.0))
    return rated.select(F.col("source").alias("g_source"), F.col("lang").alias("g_lang"), F.col("topic").alias("g_topic"), g.alias("g_ratio"), F.col("rate").alias("g_rate"), lacks.alias("g_lacks")), few


def _rated(keyed: DataFrame, rated: tuple[DataFrame, bool]) -> DataFrame:
    """Join the rates on the three keys; ``max_local_cells`` of them at most are broadcast, so that no text moves."""
    rate, few = rated
    on = [F.col(f"k_{d}").eqNullSafe(F.col(f"g_{d}")) for d in DIMS]
    return keyed.join(F.broadcast(rate) if few else rate, on[0] & on[1] & on[2])


def _keys(docs: DataFrame, topic: str | None) -> list[Column]:
    kind = topic_of(docs["text"]) if topic is None else docs[topic].cast("string")
    return [docs["source"].cast("string").alias("k_source"), docs["lang"].cast("string").alias("k_lang"), kind.alias("k_topic")]


def _cells(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy(*[F.col(f"k_{d}").alias(d) for d in DIMS]).agg(F.sum("k_tokens").alias("tokens"))


def sample(docs: DataFrame, targets: dict[str, dict] | None = None, topic: str | None = None, **params) -> DataFrame:
    """The sampled documents: doc_id, source, lang, topic, n_tokens, ratio and rate."""
    slim = materialize(docs.select(docs["doc_id"].cast("long").alias("k_id"), *_keys(docs, topic), tokens_of(docs["text"]).alias("k_tokens")), "slim")
    rated = _rated(slim, _rates(_cells(slim), targets, PARAMS | params))
    return rated.filter(unit_hash(F.col("k_id")) < F.col("g_rate")).select(
        F.col("k_id").alias("doc_id"), *[F.col(f"k_{d}").alias(d) for d in DIMS], F.col("k_tokens").alias("n_tokens"),
        F.round("g_ratio", 6).alias("ratio"), F.round("g_rate", 6).alias("rate"),
    )


def resample(docs: DataFrame, targets: dict[str, dict] | None = None, topic: str | None = None, **params) -> DataFrame:
    """The sampled rows of docs, with its columns."""
    cells = materialize(_cells(docs.select(*_keys(docs, topic), tokens_of(docs["text"]).alias("k_tokens"))), "cells")
    names = docs.columns
    keyed = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(names)], docs["doc_id"].alias("k_id"), *_keys(docs, topic))
    kept = _rated(keyed, _rates(cells, targets, PARAMS | params)).filter(unit_hash(F.col("k_id")) < F.col("g_rate"))
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def sample_sql(targets: dict[str, dict] | None = None, alpha: float = PARAMS["alpha"], fraction: float = PARAMS["fraction"], iterations: int = PARAMS["iterations"]) -> str:
    """The whole of ``sample`` in DuckDB SQL, with two recursions over the cells.

    ``raked`` scales by one dimension a step.  ``bounded`` goes through rounds: at the end of
    one (step ``last``), cells beyond their tokens are made whole if there are any; step -1
    works out what is left of the targets; the steps from 0 on scale the other cells to that.
    """
    last, hit = 3 * iterations, lambda w: f"(contains(low, {w!r}) AND regexp_matches(low, '{alone(w)}'))"
    case = " ".join(f"WHEN {' OR '.join(map(hit, ws))} THEN '{t}'" for t, ws in TOPICS.items())
    sql = f"""WITH RECURSIVE low AS (SELECT doc_id, source, lang, lower(text) AS low, text FROM documents),
slim AS MATERIALIZED (SELECT doc_id, source, lang, CASE {case} ELSE 'other' END AS topic,
  greatest(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0), 1) AS n_tokens FROM low),
x0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS x FROM slim GROUP BY ALL)"""
    for d in DIMS:
        given = " ".join(f"WHEN '{k}' THEN {v}" for k, v in (targets or {}).get(d, {}).items())
        share = f"CASE {d} {given} ELSE s END" if given else f"pow(s, {alpha})"
        sql += f""",
want_{d} AS MATERIALIZED (SELECT {d} AS k, w / sum(w) OVER () AS share, w / sum(w) OVER () * total AS want FROM (SELECT *, {share} AS w FROM
  (SELECT {d}, sum(tokens) / any_value(total) AS s, any_value(total) AS total FROM (SELECT *, sum(tokens) OVER () AS total FROM x0) GROUP BY {d})))"""
    joins = " ".join(f"JOIN want_{d} ON {d} IS NOT DISTINCT FROM want_{d}.k" for d in DIMS)

    def turn(n: str) -> str:
        return ", ".join(f"CASE WHEN {n} % 3 = {k} THEN {d} END" for k, d in enumerate(DIMS))

    def pick(n: str, name: str) -> str:
        return f"CASE {n} % 3 WHEN 0 THEN {name}{DIMS[0]} WHEN 1 THEN {name}{DIMS[1]} ELSE {name}{DIMS[2]} END"

    shares = ", ".join(f"share_{d}" for d in DIMS)
    over = "NOT whole AND y > tokens * (1 + 1e-9)"
    free, whole = "sum(CASE WHEN whole THEN 0 ELSE y END)", "sum(CASE WHEN whole THEN tokens ELSE 0 END)"
    left = {d: f"CASE WHEN {free} OVER p_{d} > 0 THEN greatest(share_{d} * goal - {whole} OVER p_{d}, {free} OVER p_{d}) ELSE 0 END" for d in DIMS}
    rest = ", ".join(f"CASE WHEN k = -1 THEN left_{d} / sum(left_{d} / n_{d}) OVER () * (goal - {whole} OVER ()) ELSE rest_{d} END AS rest_{d}" for d in DIMS)
    return sql + f""",
raked AS (SELECT 0 AS n, source, lang, topic, tokens, x, {", ".join(f"want_{d}.want AS want_{d}, want_{d}.share AS share_{d}" for d in DIMS)} FROM x0 {joins}
  UNION ALL SELECT n + 1, source, lang, topic, tokens, x * {pick("n", "want_")} / sum(x) OVER (PARTITION BY {turn("n")}), {", ".join(f"want_{d}, share_{d}" for d in DIMS)}
  FROM raked WHERE n < {last}),
bounded AS (SELECT {last} AS k, 0 AS round, source, lang, topic, tokens, x, {shares}, least({fraction}, 1) * sum(tokens) OVER () AS goal,
    x * (least({fraction}, 1) * sum(tokens) OVER () / sum(x) OVER ()) AS y, false AS whole, {", ".join(f"0::DOUBLE AS rest_{d}" for d in DIMS)} FROM raked WHERE n = {last}
  UNION ALL SELECT CASE WHEN k = {last} THEN -1 ELSE k + 1 END, round + CASE WHEN k = {last} THEN 1 ELSE 0 END, source, lang, topic, tokens, x, {shares}, goal,
    CASE WHEN k = {last} THEN CASE WHEN whole OR y > tokens * (1 + 1e-9) THEN tokens ELSE y END
      WHEN k = -1 OR whole THEN y ELSE y * {pick("k", "rest_")} / {free} OVER (PARTITION BY {turn("k")}) END,
    whole OR (k = {last} AND y > tokens * (1 + 1e-9)), {rest}
  FROM (SELECT *, bool_or({over}) OVER () AS again, {", ".join(f"count(*) OVER p_{d} AS n_{d}, {left[d]} AS left_{d}" for d in DIMS)} FROM bounded WINDOW {", ".join(f"p_{d} AS (PARTITION BY {d})" for d in DIMS)})
  WHERE k < {last} OR again),
r AS (SELECT *, x / tokens AS g, least(y / tokens, 1) AS rate FROM bounded WHERE k = {last} QUALIFY round = max(round) OVER ())
SELECT s.doc_id, s.source, s.lang, s.topic, s.n_tokens, round(g, 6) AS ratio, round(r.rate, 6) AS rate FROM slim s
JOIN r ON s.source IS NOT DISTINCT FROM r.source AND s.lang IS NOT DISTINCT FROM r.lang AND s.topic = r.topic
WHERE ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < r.rate"""
