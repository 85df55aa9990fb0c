"""URL filters by a cascade of Bloom filters: exact membership without joins.

The universe is every key of the corpus.  Level 1 holds the listed keys; level 2 holds the
keys that are not listed but pass level 1, level 3 the listed ones that pass level 2, and
so on until none is left over.  A key's depth of passing levels then tells exactly, for
every key of the universe, whether it is listed.

Keys are two 64-bit hashes.  The universe is split into shards by hash, each built in one
task of bounded size, so building scales with the cluster.  Looking up needs no join and no
shuffle at any size: shards are gathered to packs of at most ``max_broadcast_bytes`` (one
shard at least, which is bounded by ``shard_keys``), each pack is broadcast, and the rows
whose key is of its shards are looked up in it; the packs' rows together are all rows.

Without a list of keys, a key is listed whose host has one of LISTED_LABELS as a label, cut
at dots and hyphens ('ads' in 'ads-track.example.com', not in 'uploads.example.com').

A URL's key is its host and path in lower case, without scheme, user, port, 'www.' or 'm.',
query, fragment and closing slashes.  Defined results: a null or empty URL has a null key
and is not listed; repeated rows get equal results; listed keys that the corpus lacks play
no part; empty tables give empty results or false.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize
from .textkernel import mix

PARAMS = {"shard_keys": 500_000, "max_broadcast_bytes": 32 << 20, "first_rate": 0.25, "rate": 0.5}
LISTED_LABELS = ("ads", "adult", "bets", "casino", "gambling", "lottery", "pills", "porn", "track", "warez", "xxx")


def key_of(url: Column) -> Column:
    low = F.lower(F.trim(url))
    bare = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/]*)", 1), r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(.*)$", 1), r"/+$", "")
    return F.nullif(F.concat(host, path), F.lit(""))


def label_rule(labels: tuple[str, ...]) -> str:
    return f"(^|[.-])({'|'.join(map(re.escape, labels))})([.-]|$)"


def host_of(key: Column) -> Column:
    return F.regexp_extract(key, r"^([^/]*)", 1)


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # bytes
    size: int
    hashes: int


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int, hashes: int) -> np.ndarray:
    turn = lambda m: np.uint64(m * (level + 1) % (1 << 64))
    x = mix(a ^ turn(0x9E3779B97F4A7C15))
    y = mix(b ^ turn(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    return (x[:, None] + y[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(size)


def _build_level(a: np.ndarray, b: np.ndarray, level: int, rate: float) -> Level:
    hashes = max(1, round(-np.log2(rate)))
    size = max(64, int(np.ceil(len(a) * hashes / np.log(2))))
    bits = np.zeros(size, bool)
    bits[_places(a, b, level, size, hashes).ravel()] = True
    return Level(np.packbits(bits, bitorder="little"), size, hashes)


def _passes(level: Level, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = _places(a, b, n, level.size, level.hashes)
    return ((level.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def build(a: np.ndarray, b: np.ndarray, listed: np.ndarray, first_rate: float, rate: float) -> list[Level]:
    """The levels for distinct keys; none if no key is listed."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels = []
    while len(inside):
        # the first level passes few enough for the rest to be small
        want = min(0.5, max(1e-4, first_rate * len(inside) / max(1, len(outside)))) if not levels else rate
        level = _build_level(a[inside], b[inside], len(levels), want)
        levels.append(level)
        wrong = outside[_passes(level, len(levels) - 1, a[outside], b[outside])]
        inside, outside = wrong, inside
    return levels


def contains(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: an odd number of levels passed in a row."""
    out = np.zeros(len(a), bool)
    live = np.arange(len(a))
    for n, level in enumerate(levels):
        live = live[_passes(level, n, a[live], b[live])]
        out[live] = n % 2 == 0
    return out


@dataclass(frozen=True)
class Cascade:
    shards: int
    #: the shards of each pack
    packs: tuple[tuple[int, ...], ...]
    #: table of the levels
    made: DataFrame


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.col("a"), F.lit(5)), F.lit(shards)).cast("int")


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select(F.xxhash64("key", F.lit(1)).alias("a"), F.xxhash64(F.lit(2), "key").alias("b"), *[c for c in keys.columns])


def _levels(rows: list) -> dict:
    out: dict[int, list[Level]] = {}
    for shard, n, size, hashes, bits in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(shard, []).append(Level(np.frombuffer(bits, np.uint8), size, hashes))
    return out


def cascade(universe: DataFrame, **params) -> Cascade:
    """Build from ``key`` and ``listed`` of the whole universe (null keys don't count; a key is listed if any of its rows is)."""
    p = PARAMS | params
    spark = universe.sparkSession
    keys = _hashed(universe.filter("key is not null")).groupBy("a", "b").agg(F.coalesce(F.max("listed"), F.lit(False)).alias("listed"))
    keys = materialize(keys, "urls")
    shards = max(1, -(-keys.count() // p["shard_keys"]))

    def make(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        shard, a, b, listed = (t.column(c).to_numpy() for c in ("shard", "a", "b", "listed"))
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            for n, x in enumerate(build(a[part].view(np.uint64), b[part].view(np.uint64), listed[part], p["first_rate"], p["rate"])):
                yield pa.record_batch(
                    [pa.array([int(shard[part[0]])], pa.int32()), pa.array([n], pa.int32()), pa.array([x.size]), pa.array([x.hashes], pa.int32()), pa.array([x.bits.tobytes()])],
                    ["shard", "n", "size", "hashes", "bits"],
                )

    # one partition a shard, so a task holds one shard at a time (two or more where hashes meet)
    rows = keys.withColumn("shard", _shard(shards)).repartition(shards, "shard").select("shard", "a", "b", "listed")
    made = materialize(rows.mapInArrow(make, "shard int, n int, size bigint, hashes int, bits binary"), "cascade")
    discard(keys)
    packs, room = [[]], p["max_broadcast_bytes"]
    for r in made.groupBy("shard").agg(F.sum(F.length("bits")).alias("n")).orderBy("shard").toLocalIterator():
        if packs[-1] and room < r["n"]:
            packs.append([])
            room = p["max_broadcast_bytes"]
        packs[-1].append(r["shard"])
        room -= r["n"]
    return Cascade(shards, tuple(map(tuple, packs)), made)


def mark(rows: DataFrame, c: Cascade) -> DataFrame:
    """The rows (with a column ``key``) and ``listed``, for keys of the universe."""
    names, spark = rows.columns, rows.sparkSession
    hashed = rows.select(*[rows[n].alias(f"c{k}") for k, n in enumerate(names)], F.xxhash64(rows["key"], F.lit(1)).alias("a"), F.xxhash64(F.lit(2), rows["key"]).alias("b"))
    hashed = hashed.withColumn("shard", _shard(c.shards))
    null = f"c{names.index('key')}"
    schema = ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(rows.dtypes)) + ", listed boolean"

    def looked(some: DataFrame, shards: tuple[int, ...]) -> DataFrame:
        levels = c.made.filter(F.col("shard").between(shards[0], shards[-1])).collect() if shards else []
        shared = spark.sparkContext.broadcast(_levels([tuple(r) for r in levels]))  # a pack, so at most max_broadcast_bytes

        def run(b):
            a, z = (b.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in ("a", "b"))
            shard = b.column("shard").to_numpy(zero_copy_only=False)
            out = np.zeros(len(a), bool)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                out[at] = contains(shared.value.get(int(s), []), a[at], z[at])
            out[np.asarray(b.column(null).is_null())] = False
            yield pa.record_batch([*b.columns[: len(names)], pa.array(out)], [*[f"c{k}" for k in range(len(names))], "listed"])

        return map_arrow(some, run, schema)

    # a pack takes the shards from its first to before the next pack's first, so no row is left out
    ends = [pack[0] for pack in c.packs[1:]] + [c.shards]
    begins = [0, *ends[:-1]]
    parts = [looked(hashed.filter((F.col("shard") >= x) & (F.col("shard") < y)) if len(c.packs) > 1 else hashed, pack) for pack, x, y in zip(c.packs, begins, ends)]
    return functools.reduce(DataFrame.unionByName, parts).toDF(*names, "listed")


def listed_pages(pages: DataFrame, labels: tuple[str, ...] = LISTED_LABELS, listed: DataFrame | None = None, **params) -> DataFrame:
    """page_id, key and listed of each page.

    ``listed`` has a column ``key`` of listed keys; without it, those are the keys of the
    corpus whose host has one of ``labels``.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), key_of(pages["url"]).alias("key"))
    if listed is None:
        universe = rows.select("key", host_of(F.col("key")).rlike(label_rule(labels)).alias("listed"))
    else:
        known = listed.select(F.col("key"), F.lit(True).alias("listed"))
        # listed keys that the corpus lacks fall away: the universe is that of the corpus
        both = rows.select("key", F.lit(False).alias("listed"), F.lit(True).alias("here")).unionByName(known.withColumn("here", F.lit(False)))
        universe = both.groupBy("key").agg(F.max("listed").alias("listed"), F.max("here").alias("here")).filter("here").drop("here")
    return mark(rows, cascade(universe, **params))


def pages_sql(labels: tuple[str, ...] = LISTED_LABELS) -> str:
    return f"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[?#].*$', '') AS b FROM pages),
parts AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(b, '^([^/]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^(www|m)\\.', '') AS host,
  regexp_replace(regexp_extract(b, '^[^/]*(.*)$', 1), '/+$', '') AS path FROM bare),
keyed AS (SELECT page_id, nullif(host || path, '') AS key FROM parts)
SELECT page_id, key, coalesce(regexp_matches(regexp_extract(key, '^([^/]*)', 1), '{label_rule(labels)}'), false) AS listed FROM keyed"""
