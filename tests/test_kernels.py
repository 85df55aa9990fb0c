import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from spanlab.operators import kernels as K


def tokens(frames, lengths=None, **k):
    t = K.EnergyTokens(**k)
    out = [t.push(bool(f), None if lengths is None else lengths[i]) for i, f in enumerate(frames)] + [t.close()]
    return [s for s in out if s]


def test_merge():
    assert K.merge_greedy([(0.2, 4), (4.4, 9.8), (15, 24), (24.5, 31)], 10) == [(0.2, 9.8), (15, 24), (24.5, 31)]
    assert K.merge_greedy([], 10) == []
    for bad in ([(0, 2), (1, 3)], [(3, 2)], [(-1, 0)]):
        with pytest.raises(ValueError):
            K.merge_greedy(bad, 10)


def test_snap():
    t = K.SNAP
    assert K.snap([(0, 0.5 + t / 2), (0.5, 0.5 + t / 4), (0.5, 1 + t / 2)], 1.0)[0][0] == 0
    got = K.snap([(-t / 2, 0.5), (0.5 - t / 2, 0.5), (0.5 - t / 2, 1 + t / 2)], 1.0)
    assert got == [(0.0, 0.5), (0.5, 0.5), (0.5, 1.0)]
    with pytest.raises(ValueError):
        K.snap([(0, 1), (0.5, 1)], 1.0)
    with pytest.raises(ValueError):
        K.snap([(0, 3)], 1.0)


def test_energy():
    assert tokens(map(int, "11010011"), shortest=0.1, longest=1, silence=0.05) == [(0, 0.25), (0.30000000000000004, 0.4)]
    assert tokens([1] * 5, [800] * 4 + [480], shortest=0.1, longest=0.2, silence=0.05) == [(0, 0.2), (0.2, 0.23)]
    assert K.frame_is_loud(np.full(800, np.float32(3 / 32767)), 20 * math.log10(3))


def test_speech():
    o = {"shortest_ms": 0, "silence_ms": 64, "pad_ms": 16}
    assert K.speech([0.1] + [0.8] * 2 + [0.1] * 4, 7 * 512, **o) == [(256, 1792)]
    assert K.speech(([0.8] * 2 + [0.1] * 4) * 2, 12 * 512, **o) == [(0, 1280), (2816, 4352)]
    assert K.speech([0.8] * 20, 20 * 512, longest_s=0.25, **o) == [(0, 3328), (3328, 6912), (6912, 10240)]
    assert K.speech([0.01, 0.0], 1024, threshold=0.01, pad_ms=0, shortest_ms=0) == [(0, 1024)]
    assert K.speech([0.01, 0.0], 1024, threshold=0.01, pad_ms=0, shortest_ms=0, silence_ms=0) == [(0, 512)]


def test_ctc():
    logp = -np.array([(1, 10, 30), (20, 1, 30), (1, 20, 30), (30, 1, 20), (1, 20, 30)]) / 10
    assert K.ctc_align(logp, [1, 1], 0) == [0, 1, 0, 1, 0]
    with pytest.raises(ValueError):
        K.ctc_align(logp[:2], [1, 1], 0)
    assert K.runs([0, 1, 1, 0, 2]) == [(0, 0, 0), (1, 1, 2), (0, 3, 3), (2, 4, 4)]
    assert K.token_spans([[1], [2]], [(0, 0, 1), (1, 2, 2), (0, 3, 6), (2, 7, 7), (0, 8, 9)], 0) == [(0, 4), (4, 9)]


@given(st.integers(1, 4), st.integers(4, 9), st.integers(0, 10_000))
def test_ctc_against_brute_force(m, n, seed):
    import itertools

    rng = np.random.default_rng(seed)
    targets = rng.integers(1, 4, m).tolist()
    if n < m + sum(a == b for a, b in zip(targets, targets[1:])) or n > 7:
        return
    logp = rng.normal(size=(n, 4)).astype(np.float32)

    def fold(path):
        return [a for a, _ in itertools.groupby(path) if a]

    best = max(sum(logp[t, c] for t, c in enumerate(p)) for p in itertools.product(range(4), repeat=n) if fold(p) == targets)
    got = K.ctc_align(logp, targets, 0)
    assert fold(got) == targets and abs(sum(logp[t, c] for t, c in enumerate(got)) - best) < 1e-4


@given(st.lists(st.booleans(), max_size=80), st.integers(1, 4), st.integers(4, 9), st.integers(0, 3))
def test_energy_spans_are_ordered_and_bounded(frames, low, high, quiet):
    got = tokens(frames, shortest=low * 0.05, longest=high * 0.05, silence=quiet * 0.05)
    assert all(b - a <= high * 0.05 + 1e-6 for a, b in got)
    assert all(x[1] <= y[0] + 1e-9 for x, y in zip(got, got[1:]))


@given(st.lists(st.floats(0, 1, width=32), max_size=120))
def test_speech_spans_are_ordered(probs):
    got = K.speech(probs, len(probs) * 512, silence_ms=64, shortest_ms=0, longest_s=1.0)
    assert all(0 <= a <= b <= len(probs) * 512 for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_packing():
    assert K.pack([40.0, 30.0, 10.0, 10.0, 1.0], 3, 60.0) == [0, 1, 1, 2, 2]
    assert K.split_point([4.0, 3.0, 1.0, 1.0]) == 2
    assert K.next_limit(448, 1024) == 896 and K.next_limit(500, 1100) == 1100 and K.next_limit(100, 1000) == 228 and K.next_limit(1000, 1000) is None
    assert K.group_first_fit([100, 100, 1000, 10], 2, 300) == [0, 0, 1, 2]
