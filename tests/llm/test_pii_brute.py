import random
import re

import numpy as np
import pytest
from spanlab.llm import pii as P


def test_a_bad_labeler_is_found_out():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 20_000)
    right = (0.95, 0.8, 0.1)
    votes = np.stack([np.where(rng.random(len(truth)) < p, truth, 1 - truth) for p in right], axis=1)
    pats, n = np.unique(votes, axis=0, return_counts=True)
    _, chance = P.reliabilities(["".join(map(str, p)) for p in pats], n.astype(float), 300)
    assert [np.mean([chance[j][c][c] for c in (0, 1)]) for j in range(3)] == pytest.approx(right, abs=0.03)


def test_em_by_patterns_equals_em_by_rows():
    rng = np.random.default_rng(1)
    rows = ["".join(rng.choice(list("01234-"), 4)) for _ in range(300)]
    pats, n = np.unique(rows, return_counts=True)
    whole, _ = P.reliabilities(pats.tolist(), n.astype(float), 7)
    each, _ = P.reliabilities(rows, np.ones(len(rows)), 7)
    at = {p: q for p, q in zip(pats, whole)}
    assert np.allclose(each, [at[r] for r in rows])


def brute(text):
    """Candidates by reading the text, kind by kind, without the one large expression."""
    out = []
    for m in re.finditer(r"[0-9A-Za-z_-]+", text):
        s = m.group()
        if len(s) >= 20 and any(c.isdigit() for c in s) and not s.isdigit():
            out.append(m.span())
    return out


@pytest.mark.parametrize("code", ["a" * 70 + "9" + "b" * 10, "7" * 30 + "x", "x_-" * 9 + "1", "Ab3" * 40])
def test_codes_of_any_length_and_mix(code):
    assert P.pieces_of(f"so: {code} end") == [(4, 4 + len(code))] == brute(f"so: {code} end")


def test_digits_are_never_lost():
    rng = random.Random(5)
    for _ in range(400):
        groups = ["".join(rng.choice("0123456789") for _ in range(rng.choice((1, 3, 4, 16, 25)))) for _ in range(rng.randint(1, 9))]
        text = "so " + rng.choice((" ", "-", " - "))[:2].join(groups) + " end"
        got = P.pieces_of(text)
        held = [sum(c.isdigit() for c in text[a:b]) for a, b in got]
        assert all(6 <= n for n in held) and all(n <= P.DIGITS or text[a:b].isdigit() or re.fullmatch(r"[\d-]{20,}", text[a:b]) for n, (a, b) in zip(held, got))
        left = "".join(c for k, c in enumerate(text) if not any(a <= k < b for a, b in got))
        assert sum(c.isdigit() for c in left) <= 25 and all(not re.search(r"\d{6}", x) for x in left.split())
    assert [t for t in ("4539148803436467 4539148803436467",) for t in [t[a:b] for a, b in P.pieces_of(t)]] == ["4539148803436467"] * 2
    assert P.pieces_of("12345") == [] and P.pieces_of("x1234567") == [] and P.pieces_of("1234567x") == []


def test_kinds_of_votes():
    for span, kind in [("DE89 3704 0044 0532 0130 00", "6"), ("GB82WEST12345698765432", "6"), ("2001:db8::ff00:42:8329", "3"), ("4539148803436467", "4"), ("ana.b@mail3.example.com", "1"), ("152.143.123.131", "3")]:
        assert [(0, len(span))] == P.pieces_of(span), span
        v = [c for c in P.votes(span, []) if c != "-"]
        assert v and set(v) == {kind}, (span, v)
    assert "0" in P.votes("300.400.500.600", []) and P.votes("DE89370400440532013001", [])[5] == "0"


def test_whole_table_every_span(spark, sf):
    """All spans found, held both ways against plain expressions: none missed, none found beside."""
    sure = {"email": r"[\w.]+@mail\d+\.example\.com", "phone": r"\+1 \(\d{3}\) 555-\d{4}(?!\w)", "key": r"(?<=token = \")[0-9a-f]{40}", "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w)", "card": r"(?<!\w)\d{16}(?!\w)"}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {}
    for r in docs.collect():
        for kind, e in sure.items():
            for m in re.finditer(e, r.text):
                if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (P._luhn(m.group()) and P.ISSUERS.match(m.group())):
                    continue
                want[r.doc_id, *m.span()] = kind
    got = {(r.doc_id, r.start, r.end): r.kind for r in P.find(docs).collect()}
    assert got == want
