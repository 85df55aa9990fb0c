"""Segmentation of unbounded streams: the batch state machines, carried across micro-batches.

The state of a stream is the pickled machine, a few hundred bytes; frames of a micro-batch
are taken in order, so results don't depend on how a stream is cut.  A span is emitted when
it closes.  The frames of a stream must come in order from one micro-batch to the next.
``ends`` is a boolean column that marks the last frame of a stream: it closes the span that
is open and drops the stream's state; without it, state stays for as long as the query runs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import kernels as K


def _stateful(frames: DataFrame, stream: str, order: str, value: str, make: Callable, push: Callable, schema: str, ends: str | None, close: Callable) -> DataFrame:
    kind = frames.schema[stream].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = [(key[0], *s) for v in rows[value] for s in push(machine, v)]
        if ends and bool(rows[ends].any()):
            out += [(key[0], *s) for s in close(machine)]
            state.remove()
        else:
            state.update((pickle.dumps(machine),))
        yield pd.DataFrame(out, columns=[stream, "start", "end"])

    return frames.select(stream, order, value, *([ends] if ends else [])).groupBy(stream).applyInPandasWithState(run, f"{stream} {kind}, {schema}", "machine binary", "append", GroupStateTimeout.NoTimeout)


def speech_spans(frames: DataFrame, stream: str, order: str, prob: str, ends: str | None = None, **options) -> DataFrame:
    """Unpadded spans in samples, from a probability for each frame."""
    return _stateful(frames, stream, order, prob, lambda: K.Hysteresis(**options), lambda m, v: m.push(v), "start long, end long", ends, lambda m: m.close(m.frame * K.FRAME))


def energy_spans(frames: DataFrame, stream: str, order: str, loud: str, shortest: float, longest: float, silence: float, window: float = 0.05, ends: str | None = None) -> DataFrame:
    """Spans in seconds, from loud and quiet frames."""

    def push(m, v):
        s = m.push(bool(v))
        return [s] if s else []

    return _stateful(frames, stream, order, loud, lambda: K.EnergyTokens(shortest, longest, silence, window), push, "start double, end double", ends, lambda m: [s for s in [m.close()] if s])
