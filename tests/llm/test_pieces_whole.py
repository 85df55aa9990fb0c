import random

import numpy as np
from spanlab.llm import pieces as P
from test_models import plain_viterbi, score_of


def test_best_cut_of_whole_texts(spark, sf):
    """Every text up to 1,500 characters, in full, against all cuts."""
    v = P.load()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) <= 1500").collect()]
    for t, x in zip(texts, P.Encoder(v).encode(texts)):
        assert P.decode(v, x.tolist()) == t and abs(score_of(v, x) - plain_viterbi(v, t)) < 1e-6


def test_exact_is_what_decoding_says():
    v, rng = P.load(), random.Random(3)
    texts = ["", " ", "a▁b", "▁", "x" * 100, "日本語😀", "\n\n", "q\x00"] + ["".join(rng.choice("ab ▁é\n😀") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    ids = P.Encoder(v).encode(texts)
    got = P.Spelling(v).exact(np.concatenate(ids), np.array([len(x) for x in ids]), texts)
    assert got.tolist() == [P.decode(v, x.tolist()) == t for t, x in zip(texts, ids)]
    wrong = [np.append(x, x[:1]) for x in ids]
    assert not P.Spelling(v).exact(np.concatenate(wrong), np.array([len(x) for x in wrong]), texts).any()


def test_long_parts_are_not_remembered():
    e = P.Encoder(P.load())
    e.encode(["y" * 5000 + " z", "short one"])
    assert all(len(k.encode()) <= P.SHORT for k in e.seen)
