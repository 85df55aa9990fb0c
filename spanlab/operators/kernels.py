"""Sequential kernels, shared by the batch operators, the streaming ones and the tests.

Each works on one stream in order; the state machines take items one at a time, so the
result doesn't depend on how a stream is cut into batches.
"""

from __future__ import annotations

import math

import numpy as np

RATE = 16_000
FRAME = 512
SNAP = 2.0 / RATE


def merge_greedy(spans, longest: float) -> list[tuple[float, float]]:
    """Extend the current span while its whole length stays within ``longest``."""
    if not (math.isfinite(longest) and longest > 0):
        raise ValueError("longest must be finite and positive")
    out: list[list[float]] = []
    for a, b in spans:
        if b < a or a < 0 or (out and a < out[-1][1]):
            raise ValueError("spans must be ordered, without overlap and not negative")
        if out and b - out[-1][0] <= longest + 1e-9:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def snap(spans, duration: float, longest: float | None = None) -> list[tuple[float, float]]:
    """Clamp to the media, drop what is empty, close overlaps of up to two samples."""
    out, end = [], 0.0
    for k, (a, b) in enumerate(spans):
        if not (math.isfinite(a) and math.isfinite(b)) or b < a:
            raise ValueError(f"span {k}: bad bounds")
        if a < -SNAP or b > duration + SNAP:
            raise ValueError(f"span {k}: outside the media")
        a, b = (min(max(x, 0.0), duration) for x in (a, b))
        if b <= a:
            continue
        if a < end - SNAP:
            raise ValueError(f"span {k}: overlap")
        a = max(a, end)
        if longest is not None and b - a > longest + SNAP:
            raise ValueError(f"span {k}: too long")
        end = b
        out.append((a, b))
    return out


def frame_is_loud(samples: np.ndarray, threshold: float) -> bool:
    pcm = np.trunc((np.clip(samples.astype(np.float64), -1, 1) * 32767.0).astype(np.float32)).astype(np.int64)
    rms = math.sqrt(int((pcm * pcm).sum()) / max(1, len(pcm)))
    return 20.0 * math.log10(max(rms, 1e-10)) >= threshold


class EnergyTokens:
    """Loud and quiet frames to spans: inner silence is tolerated, the length is bounded."""

    def __init__(self, shortest: float, longest: float, silence: float, window: float = 0.05):
        self.samples = int(window * RATE)
        self.seconds = self.samples / RATE
        self.low = math.ceil(shortest / self.seconds)
        self.high = math.floor(longest / self.seconds + 1e-10)
        self.quiet = math.floor(silence / self.seconds + 1e-10)
        if self.high < self.low or self.quiet >= self.high:
            raise ValueError("longest must cover shortest, and more than the silence")
        # frame number, first frame, frames and samples held, quiet frames at the end
        self.at = self.first = self.held = self.held_samples = self.tail = 0
        self.open = self.follows = False

    def _emit(self, cut: bool):
        span = None
        if self.held and (self.held >= self.low or self.follows):
            a = self.first * self.seconds
            span = (a, a + self.held_samples / RATE)
            self.follows = cut
            if cut:
                self.first = self.at + 1
        else:
            self.follows = False
        self.held = self.held_samples = 0
        return span

    def push(self, loud: bool, samples: int | None = None):
        """The span that this frame ends, or None."""
        n, span = self.samples if samples is None else samples, None
        if not self.open:
            if loud:
                self.open, self.first, self.tail = True, self.at, 0
                self.held, self.held_samples = 1, n
                if self.held >= self.high:
                    span = self._emit(True)
        elif not loud and self.tail >= self.quiet:
            self.open = False
            if self.quiet == 0 or self.tail < self.held:
                span = self._emit(False)
            else:
                self.held = self.held_samples = self.tail = 0
        else:
            first_quiet = not loud and self.tail == 0
            self.tail = 0 if loud else self.tail + 1
            self.held, self.held_samples = self.held + 1, self.held_samples + n
            if self.held == self.high if first_quiet else self.held >= self.high:
                span = self._emit(True)
        self.at += 1
        return span

    def close(self):
        return self._emit(False) if self.open and self.held > self.tail else None


class Hysteresis:
    """Speech from probabilities with two thresholds, compared as float32."""

    def __init__(self, threshold=0.5, shortest_ms=250.0, longest_s=math.inf, silence_ms=100.0, pad_ms=30.0, low=None, silence_at_longest_ms=98.0, best_cut=True):
        self.up, self.down = np.float32(threshold), np.float32(max(threshold - 0.15, 0.01) if low is None else low)
        per_ms = RATE / 1000.0
        self.shortest, self.silence, self.pad = shortest_ms * per_ms, silence_ms * per_ms, pad_ms * per_ms
        self.at_longest, self.best_cut = silence_at_longest_ms * per_ms, best_cut
        self.longest = RATE * longest_s - FRAME - 2 * self.pad
        self.frame, self.start = 0, None
        self._reset()

    def _reset(self):
        self.dip = self.last = self.resume = 0
        self.pauses: list[tuple[int, int]] = []

    def push(self, prob: float) -> list[tuple[int, int]]:
        at, p, out = FRAME * self.frame, np.float32(prob), []
        self.frame += 1
        if p >= self.up and self.dip:
            if at - self.dip > self.at_longest:
                self.pauses.append((self.dip, at - self.dip))
            self.dip = 0
            if self.resume < self.last:
                self.resume = at
        if p >= self.up and self.start is None:
            self.start = at
            return out
        if self.start is not None and at - self.start > self.longest:
            if self.best_cut and self.pauses:
                end, pause = max(self.pauses, key=lambda x: x[1])
                out.append((self.start, end))
                self.start = end + pause if pause < at else None
                self._reset()
            elif self.last:
                out.append((self.start, self.last))
                self.start = None if self.resume < self.last else self.resume
                self._reset()
            else:
                out.append((self.start, at))
                self.start = None
                self._reset()
                return out
        if p < self.down and self.start is not None:
            self.dip = self.dip or at
            pause = at - self.dip
            if not self.best_cut and pause > self.at_longest:
                self.last = self.dip
            if pause >= self.silence:
                if self.dip - self.start > self.shortest:
                    out.append((self.start, self.dip))
                self.start = None
                self._reset()
        return out

    def close(self, samples: int) -> list[tuple[int, int]]:
        return [(self.start, samples)] if self.start is not None and samples - self.start > self.shortest else []


def pad_spans(spans, samples: int, pad: float) -> list[tuple[int, int]]:
    """Widen by ``pad``; neighbours that are nearer than two pads share the gap."""
    out = []
    for k, (a, b) in enumerate(spans):
        before = a - spans[k - 1][1] if k else None
        after = spans[k + 1][0] - b if k + 1 < len(spans) else None
        a = int(max(0, a - pad)) if before is None or before >= 2 * pad else max(0, a - before // 2)
        b = int(min(samples, b + pad)) if after is None or after >= 2 * pad else b + after // 2
        out.append((a, b))
    return out


def speech(probs, samples: int, **options) -> list[tuple[int, int]]:
    if len(probs) != -(-samples // FRAME):
        raise ValueError("one probability for each frame")
    h, out = Hysteresis(**options), []
    for p in probs:
        out += h.push(p)
    return pad_spans(out + h.close(samples), samples, h.pad)


ENDINGS = tuple(".!?…؟؛،")


class Cues:
    """Words to cues, one word at a time."""

    def __init__(self, chars: int, seconds: float, gap: float):
        self.chars, self.seconds, self.gap = chars, seconds, gap
        self.words: list[tuple[float, float, str]] = []
        self.length = 0

    def _flush(self):
        cue = self.words
        self.words, self.length = [], 0
        return [cue] if cue else []

    def push(self, start: float, end: float, text: str):
        out = []
        if self.words and (self.length + 1 + len(text) > self.chars or end - self.words[0][0] > self.seconds or start - self.words[-1][1] > self.gap):
            out += self._flush()
        self.length += len(text) + (1 if self.words else 0)
        self.words.append((start, end, text))
        return out + self._flush() if text.endswith(ENDINGS) else out

    def close(self):
        return self._flush()


def cues(words, chars: int, seconds: float, gap: float) -> list[tuple[float, float, str]]:
    """Raw bounds and text of each cue."""
    c, done = Cues(chars, seconds, gap), []
    for w in words:
        done += c.push(*w)
    from ..functions.text import py_strip

    return [(max(0.0, g[0][0]), max(g[0][0], g[-1][1]), py_strip(" ".join(w[2] for w in g))) for g in done + c.close()]


def ctc_align(logp: np.ndarray, targets, blank: int) -> list[int]:
    """The best path of labels, in float32; a tie prefers to stay, then to end on a label."""
    logp, targets = np.asarray(logp, np.float32), np.asarray(targets, np.int64)
    n, m = len(logp), len(targets)
    if not m or blank in targets or (targets < 0).any() or (targets >= logp.shape[1]).any():
        raise ValueError("targets must be labels other than blank")
    same = np.concatenate(([True], targets[1:] == targets[:-1]))
    least = m + int(same[1:].sum())
    if n < least:
        raise ValueError("too few frames for the targets")
    label = np.full(2 * m + 1, blank)
    label[1::2] = targets
    can_skip = np.zeros(2 * m + 1, bool)
    can_skip[1::2] = ~same
    no = np.float32(-np.inf)
    # a state is alive if the rest can still be consumed in the frames that are left
    rest = np.zeros(2 * m + 1, np.int64)  # frames needed after this state
    for s in range(2 * m - 2, -1, -1):
        rest[s] = 1 + rest[s + 1] if s % 2 == 0 else (1 + rest[s + 2] if can_skip[s + 2] else 1 + rest[s + 1])
    score = np.full(2 * m + 1, no)
    score[:2] = logp[0, label[:2]]
    score[rest > n - 1] = no
    back = np.zeros((n, 2 * m + 1), np.int8)
    for t in range(1, n):
        one = np.concatenate(([no], score[:-1]))
        two = np.where(can_skip, np.concatenate(([no, no], score[:-2])), no)
        step = np.where((two > one) & (two > score), 2, np.where((one > score) & (one > two), 1, 0))
        back[t] = step
        score = np.choose(step, [score, one, two]) + logp[t, label]
        score[rest > n - 1 - t] = no
    s = 2 * m if score[2 * m] > score[2 * m - 1] else 2 * m - 1
    path = [0] * n
    for t in range(n - 1, -1, -1):
        path[t] = int(label[s])
        s -= int(back[t, s])
    return path


def runs(path) -> list[tuple[int, int, int]]:
    """(label, first, last) of each run."""
    out: list[list[int]] = []
    for k, x in enumerate(path):
        if out and out[-1][0] == x:
            out[-1][2] = k
        else:
            out.append([x, k, k])
    return [tuple(r) for r in out]


def token_spans(tokens: list[list], segments: list[tuple], blank) -> list[tuple[int, int]]:
    """First and last frame of each token; a blank beside it is shared by halves, whole at the ends."""
    where, k, letter, begin = [], 0, 0, 0
    for at, (label, _, _) in enumerate(segments):
        if k == len(tokens):
            if at != len(segments) - 1 or label != blank:
                raise ValueError("the path goes on after the last token")
            continue
        if label == blank:
            continue
        if label != tokens[k][letter]:
            raise ValueError("the path leaves the tokens")
        if letter == 0:
            begin = at
        letter += 1
        if letter == len(tokens[k]):
            where.append((begin, at))
            k, letter = k + 1, 0
            while k < len(tokens) and not tokens[k]:
                where.append((at, at))
                k += 1
    if k != len(tokens):
        raise ValueError("the path doesn't reach the last token")
    out = []
    for n, (a, b) in enumerate(where):
        first, last = segments[a][1], segments[b][2]
        if a > 0 and segments[a - 1][0] == blank:
            _, x, y = segments[a - 1]
            first = x if n == 0 else (x + y) // 2
        if b + 1 < len(segments) and segments[b + 1][0] == blank:
            _, x, y = segments[b + 1]
            last = y if n == len(where) - 1 else (x + y) // 2
        out.append((first, last))
    return out


def take_count(durations, size: int, budget: float, alone: float = 35.0) -> int:
    """How many rows, longest first, make the next batch."""
    if durations[0] > alone:
        return 1
    return min(len(durations), size, max(1, math.floor(budget / max(durations[0], 1 / RATE))))


def pack(durations, size: int, budget: float, alone: float = 35.0) -> list[int]:
    """Batch number of each row, for rows sorted longest first."""
    out, k = [], 0
    while len(out) < len(durations):
        n = take_count(durations[len(out) :], size, budget, alone)
        out += [k] * n
        k += 1
    return out


def split_point(durations) -> int:
    """The cut with the least padded cost, the first of equal ones."""
    n = len(durations)
    return min(range(1, n), key=lambda i: (max(i * durations[0], (n - i) * durations[i]), i))


class Growth:
    """Batch size as a run learns it: memory errors lower its bound, room to spare raises it."""

    def __init__(self, size: int, most: int, total: int, budget: int = 0, ratio: float = 0.85):
        self.size, self.most, self.wait, self.total = size, most, 0, total
        self.budget = budget if budget > 0 else int(ratio * total)

    def oom(self, rows: int) -> int:
        self.wait = max(self.wait, 2)
        if rows > 1:
            self.most = min(self.most, rows - 1)
        self.size = max(1, min(self.most, rows // 2)) if rows > 1 else 1
        return self.size

    def fitted(self, rows: int, peak: int, before: int = 0) -> int:
        """After a batch of ``rows`` that reserved ``peak`` bytes, ``before`` of them before it."""
        if self.wait:
            self.wait -= 1
        elif self.size < self.most and rows >= self.size and self.total > 0 and peak > 0:
            room = (self.budget - peak) / self.total
            if room > 0.05:
                up = max(self.size + 1, math.ceil(self.size * (1.25 if room >= 0.20 else 1.125)))
                fits = rows * max(0, self.budget - before) // max(1, peak - before)
                if fits > 0:
                    up = min(up, max(self.size, fits))
                self.size = min(self.most, up)
        return self.size


def next_limit(current: int, ceiling: int) -> int | None:
    """The next token limit after a truncation; None at the end of the ladder."""
    if current >= ceiling:
        return None
    up = min(ceiling, max(current + 128, 2 * current))
    return ceiling if ceiling - up < 128 else up


def group_first_fit(estimates, workers: int, limit: int) -> list[int]:
    """Preparation group of each item, in order: at most ``workers`` items and ``limit`` bytes; a larger item is alone.

    An item of unknown size (None, NaN or none at all) reserves its worker's share of the limit.
    """
    out, group, used, held = [], -1, 0, 0
    for e in estimates:
        need = math.ceil(e * 1.05) if e is not None and e > 0 else max(1, limit // workers)
        if group < 0 or held >= workers or used + need > limit:
            group, used, held = group + 1, 0, 0
        used, held = used + need, held + 1
        out.append(group)
    return out
