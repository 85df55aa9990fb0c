"""SimHash near-dedup by covering locality-sensitive hashing.

Each document gets a 64-bit SimHash of its set of words, a word's weight being
1 + log2(its count), and a second, independent 64-bit SimHash of the same words with
weight 1.  Two documents are near copies if the first differs in at most ``radius`` bits
and the second in at most ``check`` bits: common words pull the first prints of unrelated
documents together, and the second tells those apart.

The covering family for radius r has one table for each non-zero vector v of r + 1 bits:
bit i of its mask is the inner product over GF(2) of v with a random vector m(i).  For any
two prints that differ in at most r bits some v is orthogonal to the m(i) of all of them,
so both agree under that mask: every pair within the radius meets in some table, without
exception.  Beyond WHOLE the family is split: the print has three thirds, and of r differing
bits some two thirds hold few enough that a small family over these two covers them.

Documents whose prints are equal are one node; within a bucket, all pairs are compared and
a spanning forest of the near ones is kept, which gives the same groups as all the pairs
at a linear number of edges.  A bucket of more than ``most`` prints is dealt to blocks, and
every two blocks meet in a task of their own, so a task's memory is bounded.  Groups are the
connected components.

Defined results: a document without words (null, empty, punctuation) has no print and is
never a near copy.  Rows with a null doc_id are left alone.  Rows that repeat a doc_id are
one document: they stay or go together.  The smallest doc_id of a group stays.  Extra
columns are ignored by ``near_copies`` and kept by ``dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .graph import components
from .hot import MOST, in_blocks
from .textkernel import Words, as_long, mix, slices

RADIUS, CHECK = 6, 12
#: the radius of the registered query and the pipeline: RADIUS misses near copies that the second print would confirm
WIDE = 9
#: the largest radius that one family over the whole print covers
WHOLE = 6


def masks(radius: int, seed: int = 11) -> np.ndarray:
    """The 2^(radius+1) - 1 masks of the covering family over 64 bits."""
    m = np.random.default_rng(seed).integers(0, 1 << (radius + 1), 64)
    v = np.arange(1, 1 << (radius + 1))
    bits = np.bitwise_count(v[:, None] & m[None, :]) & 1
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def covering(radius: int) -> np.ndarray:
    """The masks of all tables.

    Beyond WHOLE, each two thirds of the print get a family of their own.  The differing bits
    of the three twos add up to 2 * radius at most, so with radii that add up to 2 * radius - 2
    not all three can be exceeded.
    """
    if radius <= WHOLE:
        return masks(radius)
    thirds = [np.uint64(sum(1 << b for b in range(*ends))) for ends in ((0, 21), (21, 42), (42, 64))]
    twos = [thirds[0] | thirds[1], thirds[0] | thirds[2], thirds[1] | thirds[2]]
    return np.concatenate([masks((2 * radius - 2 + k) // 3, 11 + k) & two for k, two in enumerate(twos)])


_HASH_BITS = 44
#: what a byte of a hash adds to each of its eight bits
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") - 0.5).astype(np.float64)


def _print(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """SimHash of each document; weights are summed by byte value before they become bits."""
    out = np.zeros((docs, 8), np.uint8)
    octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.bincount((doc << 8) | octets[:, k], weight, docs << 8).reshape(docs, 256)
        out[:, k] = np.packbits(sums @ _SIGNS > 0, axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


def fingerprints_of(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both prints of each row, and whether it has any word."""
    w = Words(rows)
    prints, some = np.zeros((2, w.rows), np.uint64), w.counts() > 0
    if some.any():
        # one sort of (row, hash) in a single number
        key = np.sort((w.row.astype(np.uint64) << np.uint64(_HASH_BITS)) | (w.hash >> np.uint64(64 - _HASH_BITS)))
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        weight = 1 + np.log2(np.diff(np.append(at, len(key))))
        key = key[at]
        row = (key >> np.uint64(_HASH_BITS)).astype(np.int64)
        h = mix(key & np.uint64((1 << _HASH_BITS) - 1))
        again = mix(h ^ np.uint64(0x5851F42D4C957F2D))
        full = np.flatnonzero(some)
        doc = np.searchsorted(full, row)
        for a in range(0, len(full), 512):  # bounded memory
            x, y = np.searchsorted(doc, [a, a + 512])
            n = min(512, len(full) - a)
            prints[0, full[a : a + n]] = _print(h[x:y], doc[x:y] - a, weight[x:y], n)
            prints[1, full[a : a + n]] = _print(again[x:y], doc[x:y] - a, np.ones(y - x), n)
    return prints[0], prints[1], some


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, simhash and second of each document that has a doc_id and a word."""

    def run(b):
        for at, part in slices(b.column("text")):
            h, second, some = fingerprints_of(part)
            ids = b.column("doc_id").slice(at, len(part))
            yield pa.record_batch([ids, pa.array(as_long(h)), pa.array(as_long(second))], ["doc_id", "simhash", "second"]).filter(pa.array(some))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).filter("doc_id is not null and text is not null")
    return map_arrow(rows, run, "doc_id bigint, simhash bigint, second bigint")


def forest(h: np.ndarray, second: np.ndarray, radius: int, check: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the near pairs."""
    edges, rest = [], np.arange(len(h))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = (np.bitwise_count(h[rest] ^ h[x]) <= radius) & (np.bitwise_count(second[rest] ^ second[x]) <= check)
            hit, rest = rest[near], rest[~near]
            edges += [(x, y) for y in hit]
            queue += list(hit)
    return edges


def _bucket_edges(radius: int, check: int):
    """Batches sorted by key to the edges within each key; a run may cross batches."""

    def edges(parts):
        key, h, second, node = (np.concatenate(x) for x in zip(*parts))
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate(([0], change)), np.append(change, len(key))
        two = starts[ends - starts == 2]
        near = two[(np.bitwise_count(h[two] ^ h[two + 1]) <= radius) & (np.bitwise_count(second[two] ^ second[two + 1]) <= check)]
        a, b = [node[near]], [node[near + 1]]
        more = ends - starts > 2
        for s, e in zip(starts[more], ends[more]):
            if pairs := forest(h[s:e], second[s:e], radius, check):
                x, y = np.array(pairs).T
                a.append(node[s + x])
                b.append(node[s + y])
        return pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches):
        parts = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[1:3] = [c.view(np.uint64) for c in cols[1:3]]
            k = cols[0]
            if not len(k):
                continue
            if parts and k[-1] == parts[-1][0][-1]:  # still the run that is being gathered
                parts.append(cols)
                continue
            last = int(np.searchsorted(k, k[-1]))
            yield edges([*parts, [c[:last] for c in cols]])
            parts = [[c[last:].copy() for c in cols]]
        if parts:
            yield edges(parts)

    return run


def near_copies(docs: DataFrame, radius: int = RADIUS, check: int = CHECK, most: int = MOST) -> DataFrame:
    """(doc_id, kept_doc_id) of each document that is a near copy of one that stays.

    A document that is in no row stays.
    """
    prints = materialize(fingerprints(docs), "simhash")
    nodes = prints.groupBy("simhash", "second").agg(F.min("doc_id").alias("node"))
    tables = F.array(*[F.lit(int(m)) for m in as_long(covering(radius))])
    rows = nodes.select("simhash", "second", "node", F.posexplode(tables).alias("t", "m")).drop("m")
    # made again after the shuffle, which is cheaper than to carry it
    key = F.xxhash64(F.col("simhash").bitwiseAND(F.get(tables, F.col("t"))), "t")
    n = nodes.count()  # no bucket has more rows
    if n <= most:
        keys = rows.repartition(key).select(key.alias("key"), "simhash", "second", "node")
    else:
        keys = in_blocks(rows.select(key.alias("key"), "simhash", "second", "node"), n, most).repartition("key")
    edges = keys.sortWithinPartitions("key").mapInArrow(_bucket_edges(radius, check), "a bigint, b bigint")
    roots = components(edges)
    # a print's node is its smallest document: join on it, then carry the root to all its documents
    grouped = (
        nodes.join(roots, "node", "left")
        .select(F.col("simhash").alias("h"), F.col("second").alias("s"), F.coalesce("root", "node").alias("kept_doc_id"))
    )
    out = prints.join(grouped, (prints["simhash"] == grouped["h"]) & (prints["second"] == grouped["s"]))
    return out.filter("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id").distinct()


def dedup(docs: DataFrame, radius: int = RADIUS, check: int = CHECK) -> DataFrame:
    """The rows of docs, all columns, without those that near_copies names."""
    gone = near_copies(docs, radius, check).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
