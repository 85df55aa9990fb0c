from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from spanlab.llm import langid as L
from spanlab.llm.textkernel import Words

ROWS = [(1, "the cat, the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "Ωμέγα και άλφα", "el"), (4, "Ãctuel CÃ", "xx"), (5, "the cat", "en"), (6, None, "en"), (7, "no label", None)]


def brute():
    """Log-probabilities by the definition: bytes of each word with a blank before and after."""
    counts = defaultdict(Counter)
    for _, t, lang in ROWS:
        for w in __import__("re").findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) if lang else ():
            b = b"  " + w.encode() + b" "
            counts[lang].update(b[k : k + 3] for k in range(len(b) - 2))
    out = {}
    for lang, c in counts.items():
        under = Counter()
        for g, n in c.items():
            under[g[:2]] += n
        out[lang] = {g: np.log(0.98 * n / under[g[:2]] + 0.02 / 256) for g, n in c.items()}
    return out


def test_fit_against_its_definition(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    m, want = L.fit(docs), brute()
    assert m.languages == tuple(sorted(want))
    got = defaultdict(dict)
    for k, code in enumerate(m.codes.tolist()):
        for e in range(m.first[k], m.first[k + 1]):
            got[m.languages[m.language[e]]][bytes([code >> 16, code >> 8 & 255, code & 255])] = m.over[e] + m.unseen
    assert {x: set(g) for x, g in got.items()} == {x: set(g) for x, g in want.items()}
    assert all(abs(got[x][g] - v) < 1e-5 for x in want for g, v in want[x].items())
    w = Words(pa.array(["the und new άλφα the"]))
    for word, score in zip(("the", "und", "new", "άλφα", "the"), L.word_scores(m, w)):
        b = b"  " + word.encode() + b" "
        for lang, s in zip(m.languages, score):
            assert abs(s - sum(want[lang].get(b[k : k + 3], np.log(0.02 / 256)) for k in range(len(b) - 2))) < 1e-3


def test_bounded_model_of_many_languages(spark):
    """Far more languages than the room has place for whole: the commonest trigrams stay, and still tell them apart."""
    rows = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}w{n}" for n in range(40)), f"l{k:03}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.fit(docs, model_bytes=500 * 12 * 20)
    assert len(m.languages) == 500 and len(m.over) <= 500 * 20
    got = {r.doc_id: r.lang for r in L.identify(docs.filter("doc_id % 25 = 0"), m).collect()}
    assert all(lang == f"l{i:03}" for i, lang in got.items())
