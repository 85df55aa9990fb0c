"""Document fingerprints by SpotSigs, compared through pruned Jaccard.

A document's signatures start at common words: each common word (an anchor) is chained with
the next ``chain`` content words after it, ``distance`` content words apart; content words
are those that aren't common.  Layout and lists hold few common words, prose many, so the
set of signatures marks the prose.  Two documents are near copies if the Jaccard similarity
of their sets is ``tau`` at least.

1. Documents with one and the same set (by 128 bits of it) are one node.
2. Each set lists its rarest 1 - tau signatures, by the counts of their words over the whole
   corpus (a table of fixed size; the vocabulary hardly grows with it); sets that are similar
   enough share one of these.
3. Under such a signature, sets are sorted by length and each is compared only with the part
   of lengths that the threshold allows; the places of the signature bound the overlap, and so
   does a bitmap of one or two bits a member: each member flips one bit, so bitmaps of sets
   that differ in d members differ in d bits at most.  These tests only drop pairs that can't
   reach the threshold.  A spanning forest of the pairs that are left is kept, so thousands of
   near copies give a linear number of them.
4. Each kept pair is decided by the exact Jaccard of the whole sets, 64 bits a member.  The
   sets are made from the text again, since that is cheaper than to keep them, and only those
   of candidates are shuffled: a Bloom filter of their ids drops most of the others.
5. Where a forest had a pair that is not similar it may have hidden another.  Under those
   signatures, all pairs of sets that are in different groups by now are decided as well.

So every pair of sets that are similar enough is linked, for any tau.  Groups are the
connected components.

A document with fewer than ``least`` signatures (short text, lists, few common words) has
too few of them to tell it.  With ``few`` its set holds its words besides, so that it is
compared by its text; without, it is left out.  A set with words and one of signatures only
are never similar.

Defined results: a document without words (null, empty, punctuation) is never a near copy;
nor, without ``few``, is one with fewer than ``least`` signatures.  Rows with a null doc_id are left out.  Rows
that repeat a doc_id are one document.  The smallest doc_id of a group stays.  Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import Passing, map_arrow, materialize
from .graph import components
from .hot import MOST, in_blocks
from .textkernel import Words, as_long, mix, slices

ANCHORS = (
    "the and of to in a is that for it as was with be by on not he at from are this or an which they were has have but had "
    "der die das und in zu den mit von für ist auf ein eine des dem nicht sich als auch an es wird im "
    "le la les de des et en un une du que qui dans pour par sur est au pas ce il avec ne se sont "
    "el los las y del que una por con para es no lo al como se su más o pero sus ha"
).split()
PARAMS = {"chain": 2, "distance": 1, "tau": 0.7, "least": 4, "few": False}
COUNT_BITS, RANGES = 18, 64
#: pairs that a task holds before it hands them on
HELD = 1 << 18


def signatures(rows: pa.Array, chain: int, distance: int, anchors=tuple(ANCHORS), w: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature, sorted, each once a row."""
    return _once(*_chains(w or Words(rows), chain, distance, anchors, None))[:2]


def _chains(w: Words, chain: int, distance: int, anchors, logs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature and commonness of every chain: the sum over its words of the logs of their counts."""
    common = np.unique(Words(pa.array(anchors)).hash)
    is_common = np.isin(w.hash, common)
    at, content = np.flatnonzero(is_common), np.flatnonzero(~is_common)
    first = np.searchsorted(content, at)
    ok = first + (chain - 1) * distance < len(content)
    at, first = at[ok], first[ok]
    log = np.zeros(len(w.hash), np.int32) if logs is None else logs[_slot(w.hash)]
    sig, much = w.hash[at].copy(), log[at].copy()
    for k in range(chain):
        word = content[first + k * distance]
        same = w.row[word] == w.row[at]
        at, first, sig, much, word = at[same], first[same], sig[same], much[same], word[same]
        sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + w.hash[word])
        much += log[word]
    return w.row[at], sig, much


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _once(row: np.ndarray, sig: np.ndarray, much: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((sig, row))
    row, sig, much = row[order], sig[order], much[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (sig[1:] != sig[:-1])
    return row[keep], sig[keep], much[keep]


def set_of(rows: pa.Array, p: dict, logs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, member and commonness of each row's set: signatures, and words where these are few."""
    w = Words(rows)
    row, sig, much = _once(*_chains(w, p["chain"], p["distance"], tuple(ANCHORS), logs))
    if p["few"]:
        by_word = (np.bincount(row, minlength=len(rows)) < p["least"])[w.row]
        word = mix(w.hash[by_word] ^ np.uint64(0xD6E8FEB86659FD93))
        log = np.zeros(len(word), np.int32) if logs is None else logs[_slot(w.hash[by_word])]
        row, sig, much = _once(np.concatenate((row, w.row[by_word])), np.concatenate((sig, word)), np.concatenate((much, log)))
    return row, sig, much


def _least(p: dict) -> int:
    return 1 if p["few"] else p["least"]


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).filter("doc_id is not null and text is not null")


def word_logs(docs: DataFrame) -> np.ndarray:
    """1024 times the log of the count of words by the leading bits of their hash, over the whole corpus.

    A table of fixed size.  Tasks hand it on in RANGES parts, which as many tasks add up.
    """

    def add(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            for _, part in slices(b.column("text")):
                total += np.bincount(_slot(Words(part).hash), minlength=len(total))
        parts = total.reshape(RANGES, -1)
        yield pa.record_batch([pa.array(np.arange(RANGES, dtype=np.int32)), pa.array([x.tobytes() for x in parts])], ["k", "v"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(v.as_buffer(), np.int64)
        for k, v in total.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([v.tobytes()])], ["k", "v"])

    out = np.zeros((RANGES, (1 << COUNT_BITS) // RANGES), np.int64)
    rows = _slim(docs).select("text").mapInArrow(add, "k int, v binary").repartition(RANGES, "k").mapInArrow(merge, "k int, v binary")
    for r in rows.collect():
        out[r["k"]] = np.frombuffer(r["v"], np.int64)
    return np.round(np.log(np.maximum(out.ravel(), 1)) * 1024).astype(np.int32)


def bitmaps(doc: np.ndarray, sig: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each set a bitmap of as many bits as the next power of two, 64 at least; a member flips a bit."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    begin = np.cumsum(bits) - bits
    odd = np.bincount(begin[doc] + (sig & (bits[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[x : x + n] for x, n in zip((begin >> 3).tolist(), (bits >> 3).tolist())]


def _prints(logs, p: dict):
    """A row for each document: both halves of its set's hash, size, bitmap and rarest members."""

    def run(b):
        for at, part in slices(b.column("text")):
            row, sig, much = set_of(part, p, logs.value)
            size = np.bincount(row, minlength=len(part))
            enough = size >= _least(p)
            keep = enough[row]
            row, sig, much = row[keep], sig[keep], much[keep]
            size = size[enough]
            if not len(size):
                continue
            begin = np.cumsum(size) - size
            doc = np.repeat(np.arange(len(size)), size)
            rare = np.lexsort((sig, much, doc))
            listed = size - np.ceil(p["tau"] * size - 1e-9).astype(np.int64) + 1
            first = (np.arange(len(sig)) - begin[doc]) < listed[doc]
            whole = [np.add.reduceat(mix(sig ^ np.uint64(x)), begin) for x in (0, 0xA0761D6478BD642F)]
            ids = b.column("doc_id").slice(at, len(part)).filter(pa.array(enough))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(listed))), pa.int32()), pa.array(as_long(sig[rare][first])))
            yield pa.record_batch([ids, *(pa.array(as_long(x)) for x in (*whole, size.astype(np.uint64))), pa.array(bitmaps(doc, sig, size), pa.binary()), lists], ["doc_id", "h1", "h2", "size", "bits", "listed"])

    return run


def _sets(candidates, p: dict):
    """doc_id and members of the documents that may be candidates."""

    def run(b):
        b = b.filter(pa.array(candidates.value.passes(b.column("doc_id").to_numpy(zero_copy_only=False))))
        ids = b.column("doc_id")
        for at, part in slices(b.column("text")):
            row, sig, _ = set_of(part, p)
            cut = np.searchsorted(row, np.arange(len(part) + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(as_long(sig)))
            yield pa.record_batch([ids.slice(at, len(part)), lists], ["node", "sigs"]).filter(pa.array(np.diff(cut) >= _least(p)))

    return run


def _reach(n: np.ndarray, place: np.ndarray, m: np.ndarray, places: np.ndarray, tau: float) -> np.ndarray:
    """Whether sets of n and m members with a common one at these places can be similar enough."""
    return (np.minimum(n, m) >= tau * np.maximum(n, m) - 1e-9) & (np.minimum(n - place, m - places) >= np.ceil(tau / (1 + tau) * (n + m) - 1e-9))


class Bits:
    """The bitmaps of some sets; sets of different lengths are compared in the bits of the shorter one."""

    def __init__(self, rows: pa.Array):
        rows = rows.cast(pa.large_binary())
        offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        self.words, self.begin = np.diff(offsets) >> 3, (offsets[:-1] - offsets[0]) >> 3
        # each bitmap is some whole words of 64 bits
        self.data = np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)

    def _of(self, rows: np.ndarray, words: int, to: int) -> np.ndarray:
        out = self.data[self.begin[rows][:, None] + np.arange(words)]
        while out.shape[1] > to:
            half = out.shape[1] // 2
            out = out[:, :half] ^ out[:, half:]
        return out

    def apart(self, x: int, others: np.ndarray) -> np.ndarray:
        """No more members than these are in only one of both sets."""
        out, mine = np.zeros(len(others), np.int64), int(self.words[x])
        words = self.words[others]
        for n in np.unique(words).tolist():
            at, to = np.flatnonzero(words == n), min(n, mine)
            out[at] = np.bitwise_count(self._of(others[at], n, to) ^ self._of(np.array([x]), mine, to)).sum(1)
        return out


def _may(size, place, bits: Bits, x: int, others: np.ndarray, tau: float) -> np.ndarray:
    ok = _reach(size[x], place[x], size[others], place[others], tau)
    some = np.flatnonzero(ok)
    if len(some):
        both = size[x] + size[others[some]]
        ok[some] = both - bits.apart(x, others[some]) >= 2 * np.ceil(tau / (1 + tau) * both - 1e-9)
    return ok


def _forest(size: np.ndarray, place: np.ndarray, bits: Bits, s: int, e: int, tau: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows s to e that may be similar enough; they are sorted by size."""
    edges, rest = [], np.arange(s, e)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            lo, hi = np.searchsorted(size[rest], [tau * size[x] - 1e-6, size[x] / tau + 1e-6])
            ok = np.zeros(len(rest), bool)
            ok[lo:hi] = _may(size, place, bits, x, rest[lo:hi], tau)
            hit, rest = rest[ok], rest[~ok]
            edges += [(x, y) for y in hit]
            queue += list(hit)
    return edges


def runs(batches, key: int = 0):
    """Gathers batches that are sorted by a column, so that no run of it is cut."""
    parts = []
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        if parts and k[-1] == parts[-1][0]:
            parts.append((k[-1], batch))
            continue
        last = int(np.searchsorted(k, k[-1]))
        yield pa.Table.from_batches([p[1] for p in parts] + [batch.slice(0, last)]).combine_chunks()
        parts = [(k[-1], batch.slice(last))]
    if parts:
        yield pa.Table.from_batches([p[1] for p in parts]).combine_chunks()


def _cuts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.flatnonzero(key[1:] != key[:-1]) + 1
    return np.concatenate(([0], change)), np.append(change, len(key))


def _shared(batches):
    """The rows of every key that two or more sets have."""
    for t in runs(batches):
        starts, ends = _cuts(t.column(0).to_numpy()) if t.num_rows else (np.zeros(0, np.int64),) * 2
        if (many := np.repeat(ends - starts > 1, ends - starts)).any():
            yield from t.filter(pa.array(many)).to_batches()


def _columns(t: pa.Table):
    key, node, place, size = (t.column(k).to_numpy() for k in ("key", "node", "place", "size"))
    return key, node, place, size, Bits(t.column("bits").chunk(0))


def _candidates(tau: float):
    """Under each key the pairs to decide."""

    def run(batches):
        for t in runs(batches):
            if not t.num_rows:
                continue
            key, node, place, size, bits = _columns(t)
            keys, pairs = [], []
            for s, e in zip(*_cuts(key)):
                if found := _forest(size, place, bits, s, e, tau):
                    pairs += found
                    keys.append(np.full(len(found), key[s]))
            if pairs:
                a, b = node[np.array(pairs)].T
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["key", "a", "b"])

    return run


def _between(tau: float):
    """Under each key all pairs that may be similar enough and are of different groups."""

    def run(batches):
        for t in runs(batches):
            if not t.num_rows:
                continue
            key, node, place, size, bits = _columns(t)
            group, out, held = t.column("group").to_numpy(), [], 0
            for s, e in zip(*_cuts(key)):
                for x in range(s, e - 1):
                    # lengths rise, so the shorter ones have met x before
                    z = x + 1 + int(np.searchsorted(size[x + 1 : e], size[x] / tau + 1e-6))
                    y = np.arange(x + 1, z)
                    y = y[group[y] != group[x]]
                    y = y[_may(size, place, bits, x, y, tau)]
                    if len(y):
                        out.append((np.minimum(node[x], node[y]), np.maximum(node[x], node[y])))
                        held += len(y)
                        if held > HELD:
                            yield _pairs(out)
                            out, held = [], 0
            if out:
                yield _pairs(out)

    return run


def _pairs(out: list) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*out))
    return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def _decide(pairs: DataFrame, sets: DataFrame, tau: float) -> DataFrame:
    """a, b and whether the sets' exact Jaccard reaches tau."""
    left, right = sets.select(F.col("node").alias("a"), F.col("sigs").alias("x")), sets.select(F.col("node").alias("b"), F.col("sigs").alias("y"))
    met = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    every = F.size("x") + F.size("y") - F.col("both")
    return met.select("a", "b", (F.col("both") >= F.lit(tau) * every - 1e-9).alias("near"))


def _sets_of(slim: DataFrame, pairs: DataFrame, p: dict) -> DataFrame:
    """The sets of the documents of the pairs, and of a few others."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    shared = slim.sparkSession.sparkContext.broadcast(bloom.build(ids, ids.count()))  # at most bloom.MAX_BYTES
    return materialize(map_arrow(slim, _sets(shared, p), "node bigint, sigs array<bigint>"), "sets")


def near_copies(docs: DataFrame, most: int = MOST, **params) -> DataFrame:
    """(doc_id, kept_doc_id) of each document that is a near copy of one that stays."""
    p = PARAMS | params
    slim, spark, tau = _slim(docs), docs.sparkSession, p["tau"]
    with Passing(spark) as passing:
        # a table of fixed size, whatever the corpus
        logs = spark.sparkContext.broadcast(word_logs(docs))
        prints = map_arrow(slim, _prints(logs, p), "doc_id bigint, h1 bigint, h2 bigint, size bigint, bits binary, listed array<bigint>")
        marked = prints.withColumn("node", F.min("doc_id").over(Window.partitionBy("h1", "h2")))
        own = F.col("doc_id") == F.col("node")
        marked = materialize(marked.select("doc_id", "node", "size", *(F.when(own, F.col(c)).alias(c) for c in ("bits", "listed"))), "prints")
        rows = marked.select("node", F.posexplode("listed").alias("place", "key")).select("key", "node", "place")
        n = marked.filter("listed is not null").count()  # no key has more rows
        met = in_blocks(rows, n, most).repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key bigint, node bigint, place int")
        met = materialize(met, "met")
        about = marked.filter("bits is not null").select("node", "size", "bits")

        def by_key(some: DataFrame) -> DataFrame:
            return some.join(about, "node").repartition("key").sortWithinPartitions("key", "size", "node")

        pairs = materialize(by_key(met).mapInArrow(_candidates(tau), "key bigint, a bigint, b bigint").filter("a <> b"), "pairs")
        once = pairs.select("a", "b").distinct()
        decided = materialize(_decide(once, _sets_of(slim, once, p), tau), "decided")
        low = materialize(components(decided.filter("near").select("a", "b")), "groups")
        doubtful = pairs.join(decided.filter("not near").select("a", "b"), ["a", "b"]).select("key").distinct()
        again = met.join(doubtful, "key", "left_semi").join(low, "node", "left").select("key", "node", "place", F.coalesce("root", "node").alias("group"))
        again = by_key(again).mapInArrow(_between(tau), "a bigint, b bigint").distinct().join(decided.select("a", "b"), ["a", "b"], "left_anti")
        again = materialize(again, "again")
        if not again.isEmpty():
            more = _decide(again, _sets_of(slim, again, p), tau).filter("near").select("a", "b")
            low = components(low.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        out = marked.select("doc_id", "node").join(low, "node", "left").select("doc_id", F.coalesce("root", "node").alias("kept_doc_id"))
        return passing.keep(out.filter("doc_id <> kept_doc_id").distinct(), "near")
