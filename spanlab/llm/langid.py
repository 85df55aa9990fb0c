"""Language ID: the mixture of languages in each document, by expectation-maximisation.

Training counts byte trigrams inside words (with their edges) for each label in ``lang``,
over all documents that have one; a trigram's probability is its share under its first two
bytes, mixed with a uniform floor, which is all that an unseen trigram has.  A word's
likelihood under a language is the product over its trigrams.  The model holds the most
frequent trigrams of each language, as many as ``model_bytes`` has room for (all of them
unless there are many languages), so what is collected and broadcast is bounded for any
number of languages.

Inference treats a document's words as drawn from a mixture of languages.  The set starts
as the single best language; in each round expectation-maximisation fits the shares with
each further language added, and the best addition stays if it raises the log-likelihood
by more than the penalty, ``base`` plus ``slope`` times the log of the number of words.
The log-likelihood is concave, so a language whose derivative bound is below the penalty
is skipped without changing the result.

Defined results: a document without words (null, empty, punctuation) has a null lang and
empty lists.  Rows with a null or empty label don't train; without any label every lang is
null.  Equal likelihoods go to the language first in alphabetical order.  Repeated rows get
equal results.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import discard, map_arrow, materialize
from .textkernel import Words, mix, slices

PARAMS = {"floor": 0.02, "base": 4.0, "slope": 2.0, "iterations": 15, "model_bytes": 48 << 20}
#: a trigram of the model: code, language and log-probability over the floor's
ENTRY_BYTES = 12
#: codes of a language are added up in so many ranges; a range holds whole contexts
RANGES, CODES = 16, 1 << 24


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: sorted codes that any language has; the entries of code k are first[k] to first[k + 1]
    codes: np.ndarray
    first: np.ndarray
    #: language of each entry, and by how much its log-probability is above that of an unseen trigram
    language: np.ndarray
    over: np.ndarray
    #: log-probability of an unseen trigram
    unseen: float


def trigrams(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each trigram of some words, and which of these words it is of; a word of n bytes has n + 1."""
    start, end = w.start[words], w.end[words]
    size = end - start + 1
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    at = np.repeat(start, size) + place
    data = np.append(w.data, np.uint8(32)).astype(np.int64)
    last = place == np.repeat(size - 1, size)
    one = np.where(place > 0, data[at - 1], 32)
    two = np.where(place > 1, data[at - 2], 32)
    byte = np.where(last, 32, data[at])
    return two << 16 | one << 8 | byte, np.repeat(np.arange(len(words)), size)


def _tally(w: Words, label: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """label * CODES + code of each trigram, and how often it stands; each distinct word is taken apart once."""
    key = w.hash ^ mix(label.astype(np.uint64) + np.uint64(1))
    _, one, n = np.unique(key, return_index=True, return_counts=True)
    code, word = trigrams(w, one)
    both = label[one][word] * CODES + code
    seen, at = np.unique(both, return_inverse=True)
    return seen, np.bincount(at, n[word]).astype(np.int64)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(x) for x in zip(*parts))
    seen, at = np.unique(code, return_inverse=True)
    return seen, np.bincount(at, n, len(seen)).astype(np.int64)


def fit(docs: DataFrame, **params) -> Model:
    """Counts over all labelled documents, by trigrams that occur; added up by language and range."""
    p = PARAMS | params
    labelled = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].alias("text")).filter("lang <> '' and text is not null")
    kind, names = "lang string, part int, code binary, n binary", ["lang", "part", "code", "n"]

    def row(lang: str, part: int, code: np.ndarray, n: np.ndarray):
        return pa.record_batch([pa.array([lang]), pa.array([part], pa.int32()), pa.array([code.astype(np.int32).tobytes()]), pa.array([n.astype(np.int64).tobytes()])], names)

    def count(batches):
        held: dict[str, list] = {}
        for b in batches:
            for at, part in slices(b.column("text")):
                w = Words(part)
                if not len(w.hash):
                    continue
                labels = b.column("lang").slice(at, len(part)).dictionary_encode()
                seen, n = _tally(w, labels.indices.to_numpy()[w.row].astype(np.int64), len(labels.dictionary))
                for k, lang in enumerate(labels.dictionary.to_pylist()):
                    x, y = np.searchsorted(seen, [k * CODES, (k + 1) * CODES])
                    mine = held.setdefault(lang, [])
                    mine.append((seen[x:y] - k * CODES, n[x:y]))
                    if len(mine) > 32:
                        held[lang] = [_added(mine)]
        for lang, mine in held.items():
            code, n = _added(mine)
            cut = np.searchsorted(code, np.arange(RANGES + 1) * (CODES // RANGES))
            for r in range(RANGES):
                if cut[r] < cut[r + 1]:
                    yield row(lang, r, code[cut[r] : cut[r + 1]], n[cut[r] : cut[r + 1]])

    def add(batches):
        """One row for each language and range: its trigrams, and the log-probability of each over an unseen one's."""
        held: dict[tuple, list] = {}
        for b in batches:
            for lang, part, code, n in zip(*(b.column(x).to_pylist() for x in names)):
                mine = held.setdefault((lang, part), [])
                mine.append((np.frombuffer(code, np.int32).astype(np.int64), np.frombuffer(n, np.int64)))
                if len(mine) > 32:
                    held[lang, part] = [_added(mine)]
        for (lang, part), mine in held.items():
            yield row(lang, part, *_added(mine))

    summed = materialize(labelled.mapInArrow(count, kind).repartition("lang", "part").mapInArrow(add, kind), "trigrams")
    languages = sorted(r[0] for r in summed.select("lang").distinct().collect())
    room = p["model_bytes"] // (ENTRY_BYTES * max(1, len(languages)))
    low = np.log(p["floor"] / 256)

    def best(batches):
        """The most frequent trigrams of each language, ties by code, with what they are worth."""
        held: dict[str, list] = {}
        for b in batches:
            for lang, code, n in zip(*(b.column(x).to_pylist() for x in ("lang", "code", "n"))):
                code, n = np.frombuffer(code, np.int32).astype(np.int64), np.frombuffer(n, np.int64)
                _, context = np.unique(code >> 8, return_inverse=True)
                over = np.log((1 - p["floor"]) * n / np.bincount(context, n)[context] + p["floor"] / 256) - low
                mine = held.setdefault(lang, [])
                mine.append((code, n, over))
                held[lang] = [_top(mine, room)]
        for lang, mine in held.items():
            code, _, over = _top(mine, room)
            yield pa.record_batch([pa.array([lang]), pa.array([code.astype(np.int32).tobytes()]), pa.array([over.astype(np.float32).tobytes()])], ["lang", "code", "over"])

    got = {r["lang"]: r for r in summed.repartition("lang").mapInArrow(best, "lang string, code binary, over binary").collect()}
    discard(summed)
    code = [np.frombuffer(got[x]["code"], np.int32) for x in languages] or [np.zeros(0, np.int32)]
    over = [np.frombuffer(got[x]["over"], np.float32) for x in languages] or [np.zeros(0, np.float32)]
    language = np.repeat(np.arange(len(code), dtype=np.int32), [len(c) for c in code])
    code, over = np.concatenate(code), np.concatenate(over)
    order = np.lexsort((language, code))
    codes, first = np.unique(code[order], return_index=True)
    return Model(tuple(languages), codes, np.append(first, len(code)), language[order], over[order], float(low))


def _top(parts: list, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, n, over = (np.concatenate(x) for x in zip(*parts))
    keep = np.lexsort((code, -n))[:room]
    return code[keep], n[keep], over[keep]


def word_scores(model: Model, w: Words) -> np.ndarray:
    """Log-likelihood of each word under each language; each distinct word is looked at once."""
    _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
    out, languages = np.empty((len(one), len(model.languages)), np.float32), len(model.languages)
    step = 1 << 15  # distinct words at a time: bounded memory for a very long text
    for a in range(0, len(one), step):
        code, word = trigrams(w, one[a : a + step])
        n = len(one[a : a + step])
        at = np.minimum(np.searchsorted(model.codes, code), max(0, len(model.codes) - 1))
        known = model.codes[at] == code if len(model.codes) else np.zeros(len(code), bool)
        at, some = at[known], word[known]
        many = model.first[at + 1] - model.first[at]
        entry = np.repeat(model.first[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        total = np.bincount(np.repeat(some, many) * languages + model.language[entry], model.over[entry], n * languages)
        out[a : a + n] = total.reshape(n, languages) + np.bincount(word, minlength=n)[:, None] * model.unseen
    return out[which]


def _em(prob: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each document's allowed languages, and its log-likelihood."""
    doc = np.repeat(np.arange(len(size)), size)
    pi = allowed / allowed.sum(1, keepdims=True)
    for k in range(iterations + 1):
        mixed = prob * pi[doc]
        total = mixed.sum(1)
        if k == iterations:
            return pi, np.add.reduceat(np.log(total), first)
        mixed /= total[:, None]
        pi = np.add.reduceat(mixed, first, axis=0) / size[:, None]


def infer(score: np.ndarray, size: np.ndarray, base: float, slope: float, iterations: int) -> np.ndarray:
    """Share of each language in each document of ``size`` words (none of them 0)."""
    first = np.cumsum(size) - size
    top = score.max(1, keepdims=True)
    prob = np.maximum(np.exp((score - top).astype(np.float64)), 1e-30)
    logs = np.log(prob)
    each = np.add.reduceat(logs, first, axis=0)
    languages = each.shape[1]
    allowed = np.zeros(each.shape, bool)
    allowed[np.arange(len(size)), each.argmax(1)] = True
    shares, have = allowed.astype(np.float64), each.max(1)
    penalty = base + slope * np.log(size)
    live = np.arange(len(size))
    while len(live) and languages > 1:
        doc = np.repeat(np.arange(len(live)), size[live])
        words = np.repeat(first[live] - np.cumsum(size[live]) + size[live], size[live]) + np.arange(len(doc))
        p, n = prob[words], size[live]
        start = np.cumsum(n) - n
        now = (p * shares[live][doc]).sum(1)
        bound = np.add.reduceat(p / now[:, None], start, axis=0) - n[:, None]
        best, gain, mix = np.full(len(live), -1), np.zeros(len(live)), np.zeros((len(live), languages))
        for k in range(languages):
            some = np.flatnonzero(~allowed[live, k] & (bound[:, k] > penalty[live]))
            if not len(some):
                continue
            take = np.isin(doc, some)
            may = allowed[live[some]].astype(np.float64)
            may[:, k] = 1
            pi, ll = _em(p[take], np.cumsum(n[some]) - n[some], n[some], may, iterations)
            up = ll - have[live[some]]
            better = up > gain[some]
            at = some[better]
            best[at], gain[at], mix[at] = k, up[better], pi[better]
        won = np.flatnonzero((best >= 0) & (gain > penalty[live]))
        allowed[live[won], best[won]] = True
        shares[live[won]] = mix[won]
        have[live[won]] += gain[won]
        live = live[won]
    return shares


def identify(docs: DataFrame, model: Model, **params) -> DataFrame:
    """doc_id, lang (the largest share), languages and shares (four digits), largest first."""
    p = PARAMS | params
    # fit() bounds the model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b):
        m = shared.value
        names = np.array(m.languages, object)
        for at, part in slices(b.column("text")):
            w = Words(part)
            n = w.counts()
            full = np.flatnonzero(n > 0) if len(names) else np.zeros(0, np.int64)
            langs, shares, top = [[] for _ in range(len(part))], [[] for _ in range(len(part))], [None] * len(part)
            if len(full):
                share = infer(word_scores(m, w), n[full], p["base"], p["slope"], p["iterations"])
                order = np.argsort(-share, axis=1, kind="stable")
                for d, s, o in zip(full, share, order):
                    o = o[s[o] > 0]
                    langs[d], shares[d], top[d] = list(names[o]), np.round(s[o], 4).tolist(), names[o[0]]
            ids = b.column("doc_id").slice(at, len(part))
            yield pa.record_batch(
                [ids, pa.array(top, pa.string()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                ["doc_id", "lang", "languages", "shares"],
            )

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), run, "doc_id bigint, lang string, languages array<string>, shares array<double>")
