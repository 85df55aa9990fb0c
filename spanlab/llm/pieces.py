"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from the file of a public tokenizer, which is never trained or copied.
That file orders its pieces by rank, so a piece's log score is the Zipf-Mandelbrot
estimate -ln(rank + 2.7) less the log of the normaliser; its own scores are negative
ranks, not logarithms.

Encoding puts a space before the text, turns spaces into the marker U+2581, and chooses
the pieces with the largest sum of log scores; among equal sums the last piece that begins
earliest.  A character that is no piece scores 10 below the least piece and is written as
its UTF-8 bytes.  No piece has the marker after another character or holds a line break,
so the text is cut there first: the best pieces of the parts are the best of the whole.
Decoding joins the pieces' bytes, reads them as UTF-8, turns markers into spaces and drops
the first one.

Defined results: a null text gives null ids, n_tokens and exact; an empty text gives the
single marker piece, which decodes to an empty text.  A text that itself holds U+2581
decodes to a space there, and ``exact`` is false.  Extra columns are ignored; repeated
rows are encoded alike.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .textkernel import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(r"\n| *[^ \n]+| +")
#: Parts beyond so many bytes are scored one at a time, and only parts up to it are remembered.
SHORT = 48
#: Remembered parts a worker; the memory is emptied when it is full.
MEMORY = 250_000


@dataclass(frozen=True)
class Trie:
    """base and check of the double array; value is the piece that ends at a state, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(keys: list[tuple[bytes, int]]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, v in keys:
        at = 0
        for c in key:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = children[at][c]
        ends[at] = v
    size = 1 << max(12, (len(children) * 4 + 4096).bit_length())
    base, check, value = (np.full(size, x, np.int32) for x in (0, -1, -1))
    used = np.zeros(size + 512, bool)
    used[:257] = True  # so that no base is negative
    check[0], value[0] = 0, ends[0]
    place, low = {0: 0}, 257
    # nodes with many children first: the rest then fill the gaps
    order = sorted((k for k in range(len(children)) if children[k]), key=lambda k: -len(children[k]))
    bases = np.zeros(len(children), np.int64)
    begin: dict[int, int] = {}  # where the last node with so many children found room
    for node in order:
        cs = np.fromiter(sorted(children[node]), np.int64)
        while used[low]:
            low += 1
        if len(cs) == 1:
            bases[node] = low - cs[0]
            used[low] = True
            continue
        at, step = max(low, begin.get(len(cs), 0)), 32
        while True:
            b = np.arange(at, min(at + step, size)) - cs[0]
            fits = np.flatnonzero(~used[b[:, None] + cs].any(1))
            if len(fits):
                break
            at, step = at + step, min(2048, step * 4)
        begin[len(cs)] = at
        bases[node] = b[fits[0]]
        used[bases[node] + cs] = True
    todo = [0]
    while todo:
        node = todo.pop()
        state = place[node]
        base[state] = bases[node]
        for c, child in children[node].items():
            place[child] = slot = int(bases[node]) + c
            check[slot], value[slot] = state, ends[child]
            todo.append(child)
    # room for every byte after the largest base, so that lookups need no bounds
    top = int(base.max()) + 257
    return Trie(*(np.concatenate((a, np.full(max(0, top - size), -1, np.int32)))[: max(top, 1)] for a in (base, check, value)))


@dataclass(frozen=True)
class Vocabulary:
    trie: Trie
    score: np.ndarray
    unknown: float
    #: id of each byte piece, and the bytes that each id stands for
    byte_id: np.ndarray
    out: tuple[bytes, ...]


@functools.lru_cache(maxsize=2)
def load(model_file: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    return vocabulary({i: sp.id_to_piece(i) for i in normal}, {i: int(sp.id_to_piece(i)[1:-1], 16) for i in range(n) if sp.is_byte(i)}, n)


def vocabulary(pieces: dict[int, str], bytes_: dict[int, int], n: int) -> Vocabulary:
    if bad := [p for p in pieces.values() if MARK in p.lstrip(MARK) or "\n" in p or " " in p]:
        raise ValueError(f"pieces across a cut: {bad[:5]}")
    byte_id = np.full(256, -1, np.int32)
    out = [b""] * n
    for i, b in bytes_.items():
        byte_id[b], out[i] = i, bytes([b])
    if (byte_id < 0).any():
        raise ValueError("byte fallback needs all 256 byte pieces")
    score = np.full(n, -np.inf)
    rank = np.arange(len(pieces)) + 2.7
    score[list(pieces)] = -np.log(rank) - np.log((1 / rank).sum())
    for i, p in pieces.items():
        out[i] = p.encode()
    return Vocabulary(build_trie([(p.encode(), i) for i, p in pieces.items()]), score, float(score[list(pieces)].min()) - 10, byte_id, tuple(out))


def _edges(v: Vocabulary, data: np.ndarray, word_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, piece (-1: bytes) and score of every piece at every character."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    char = np.diff(np.append(start, len(data)))
    alone = np.zeros(len(start), bool)
    t, at, state = v.trie, np.arange(len(start)), np.zeros(len(start), np.int32)
    found, depth = [], 0
    while len(at):
        pos = start[at] + depth
        inside = pos < word_end[start[at]]
        at, pos, state = at[inside], pos[inside], state[inside]
        nxt = t.base[state] + data[pos]
        ok = t.check[nxt] == state
        at, state = at[ok], nxt[ok]
        depth += 1
        hit = t.value[state] >= 0
        if hit.any():
            found.append((start[at[hit]], np.full(int(hit.sum()), depth), t.value[state[hit]]))
            alone[at[hit]] |= char[at[hit]] == depth
    rest = ~alone
    found.append((start[rest], char[rest], np.full(int(rest.sum()), -1, np.int32)))
    s, n, piece = (np.concatenate(x) for x in zip(*found))
    return s, s + n, piece, np.where(piece >= 0, v.score[piece], v.unknown)


def encode_parts(v: Vocabulary, parts: list[bytes]) -> list[np.ndarray]:
    """Ids of the best pieces of each (non-empty) part."""
    length = np.array([len(p) for p in parts], np.int64)
    first = np.concatenate(([0], np.cumsum(length)))
    data = np.frombuffer(b"".join(parts), np.uint8)
    word = np.repeat(np.arange(len(parts)), length)
    s, e, piece, score = _edges(v, data, first[1:][word])
    w = word[s]
    offset = s - first[w]
    order = np.argsort(offset.astype(np.int32), kind="stable")
    a, b = (s + w)[order], (e + w)[order]  # node numbers: each part has one node more than bytes
    score, offset = score[order], offset[order]
    best = np.full(len(data) + len(parts), -np.inf)
    came = np.full(len(data) + len(parts), -1, np.int64)
    best[first[:-1] + np.arange(len(parts))] = 0
    step = np.flatnonzero(np.concatenate(([True], offset[1:] != offset[:-1], [True])))
    if len(step) < 20_000:
        for x, y in zip(step[:-1], step[1:]):
            # for one offset no two edges end at one node
            to, sc = b[x:y], best[a[x:y]] + score[x:y]
            up = sc > best[to]
            best[to[up]] = sc[up]
            came[to[up]] = np.arange(x, y)[up]
    else:  # one very long part among few: a plain loop is quicker
        bl, cl = best.tolist(), came.tolist()
        for k, (i, j, sc) in enumerate(zip(a.tolist(), b.tolist(), score.tolist())):
            if bl[i] + sc > bl[j]:
                bl[j], cl[j] = bl[i] + sc, k
        came = np.array(cl, np.int64)
    node = first[1:] + np.arange(len(parts))
    begin = first[:-1] + np.arange(len(parts))
    live, picked = np.arange(len(parts)), []
    while len(live):
        k = came[node[live]]
        picked.append((k, live))
        node[live] = a[k]
        live = live[node[live] > begin[live]]
    k, who = (np.concatenate(x) for x in zip(*picked))
    back = np.lexsort((-np.repeat(np.arange(len(picked)), [len(p[0]) for p in picked]), who))
    k, who = order[k[back]], who[back]
    many = np.where(piece[k] >= 0, 1, e[k] - s[k])
    flat = np.repeat(k, many)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
    ids = np.where(piece[flat] >= 0, piece[flat], v.byte_id[data[s[flat] + inner]]).astype(np.int32)
    return np.split(ids, np.cumsum(np.bincount(who, many, len(parts)).astype(np.int64))[:-1])


class Encoder:
    """Encodes whole texts; remembers the ids of short parts."""

    def __init__(self, v: Vocabulary):
        self.v, self.seen = v, {}

    def __getstate__(self):
        return {"v": self.v, "seen": {}}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [CHUNK.findall(" " + t) for t in texts]
        new = list(set().union(*parts) - self.seen.keys())
        if len(self.seen) + len(new) > MEMORY:
            self.seen.clear()
            new = list(set().union(*parts))
        raw = [p.replace(" ", MARK).encode() for p in new]
        short = [k for k, r in enumerate(raw) if len(r) <= SHORT]
        for k, ids in zip(short, encode_parts(self.v, [raw[k] for k in short]) if short else ()):
            self.seen[new[k]] = ids.tobytes()
        long = [k for k, r in enumerate(raw) if len(r) > SHORT]
        for k in long:
            self.seen[new[k]] = encode_parts(self.v, [raw[k]])[0].tobytes()
        out = [np.frombuffer(b"".join(map(self.seen.__getitem__, p)), np.int32) for p in parts]
        for k in long:
            del self.seen[new[k]]
        return out


class Spelling:
    """The bytes of every piece, with the marker as a space, in one array."""

    def __init__(self, v: Vocabulary):
        spelled = [b.replace(MARK.encode(), b" ") for b in v.out]
        self.size = np.array([len(b) for b in spelled], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def exact(self, ids: np.ndarray, n: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether the ids of each text (``n`` of them) decode to it, byte for byte."""
        size = self.size[ids]
        end = np.concatenate(([0], np.cumsum(size)))
        first = np.concatenate(([0], np.cumsum(n)))
        got = np.diff(end[first])
        want = [b" " + t.encode() for t in texts]
        same = got == np.array([len(w) for w in want], np.int64)
        keep = np.repeat(same, n)
        ids, size = ids[keep], size[keep]
        at = np.repeat(self.begin[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        wrong = np.concatenate(([0], np.cumsum(self.data[at] != np.frombuffer(b"".join(w for w, s in zip(want, same) if s), np.uint8))))
        cut = np.concatenate(([0], np.cumsum(got[same])))
        same[same] = np.diff(wrong[cut]) == 0
        return same


def decode(v: Vocabulary, ids: list[int]) -> str:
    out = v.out
    text = b"".join([out[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens and exact (the ids decode to the very text) of each row."""
    # A vocabulary has a fixed size, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file))
    memory = {}

    def run(b):
        if "e" not in memory:
            memory["e"] = Encoder(shared.value)
            memory["s"] = Spelling(shared.value)
        enc = memory["e"]
        for at, part in slices(b.column("text")):
            texts = part.to_pylist()
            got = enc.encode([t or "" for t in texts])
            n = np.array([len(g) for g in got], np.int32)
            null = np.array([t is None for t in texts])
            n[null] = 0
            flat = np.concatenate([g for g, x in zip(got, null) if not x]) if not null.all() else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32(), mask=np.append(null, False)), pa.array(flat))
            exact = pa.array(memory["s"].exact(np.concatenate(got), np.array([len(g) for g in got], np.int64), [t or "" for t in texts]), mask=null)
            yield pa.record_batch([b.column("doc_id").slice(at, len(part)), ids, pa.array(n, mask=null), exact], ["doc_id", "ids", "n_tokens", "exact"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id bigint, ids array<int>, n_tokens int, exact boolean")


def decode_ids(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id and text of encoded documents; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_file))

    def run(b):
        ids = b.column("ids").to_pylist()
        text = pa.array([None if x is None else decode(shared.value, x) for x in ids], pa.string())
        yield pa.record_batch([b.column("doc_id"), text], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")
