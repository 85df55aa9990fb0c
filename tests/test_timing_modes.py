import math
import random

from spanlab.operators import timing


def timed(segments, speech):
    """words_by_mode by its definition."""
    out = []
    for key, text, a, b in segments:
        tokens = (text or "").split()
        met = sorted((max(a, s), min(b, e)) for k, s, e in speech if k == key and key is not None and e > a and s < b)
        met = [(s, e) for s, e in met if e > s]
        if met:
            total = sum(e - s for s, e in met)
            exact = [len(tokens) * ((e - s) / total) for s, e in met]
            counts = [math.floor(x) for x in exact]
            order = sorted(range(len(met)), key=lambda k: (counts[k] - exact[k], met[k][0] - met[k][1], k))
            for k in order[: len(tokens) - sum(counts)]:
                counts[k] += 1
        else:
            met, counts = [(a, a + max(0.0, b - a))], [len(tokens)]
        times = [(s + k * ((e - s) / n), s + (k + 1) * ((e - s) / n)) for (s, e), n in zip(met, counts) for k in range(n)]
        assert len(times) == len(tokens)
        source = "uniform_speech_spans" if any(k == key and key is not None and max(a, s) < min(b, e) for k, s, e in speech) else "uniform"
        out += [(key, i, s, e, w, source) for i, ((s, e), w) in enumerate(zip(times, tokens))]
    return sorted(out, key=repr)


def test_words_by_segment_are_as_defined(spark):
    """Stretches that meet, overlap, start together, are turned round, or lie outside; more stretches than words; no words; no key."""
    rng = random.Random(3)
    at = lambda: rng.randrange(0, 64) / 4
    segments = [(k, " ".join(f"w{i}" for i in range(rng.choice([0, 1, 2, 7, 40]))), x := at(), x + rng.choice([0.0, -1.0, 2.0, 8.0])) for k in range(300)]
    segments += [(300, None, 0.0, 4.0), (301, " \n", 0.0, 4.0), (None, "a b", 0.0, 4.0)]
    speech = [(k, x := at(), x + rng.choice([0.0, -1.0, 0.25, 1.0, 3.0])) for k in range(302) for _ in range(rng.choice([0, 1, 2, 9, 60]))] + [(None, 0.0, 1.0), (500, 0.0, 1.0)]
    rows = timing.words_by_mode(
        spark.createDataFrame(segments, "id int, text string, start double, end double"), spark.createDataFrame(speech, "id int, r_start double, r_end double"), ["id"], "segment"
    )
    assert dict(rows.dtypes) == {"id": "int", "word_index": "bigint", "start": "double", "end": "double", "word": "string", "source": "string"}
    got = sorted(((r.id, r.word_index, r.start, r.end, r.word, r.source) for r in rows.collect()), key=repr)
    want = timed(segments, speech)
    assert [(g[0], g[1], g[4], g[5]) for g in got] == [(w[0], w[1], w[4], w[5]) for w in want]
    assert all(math.isclose(g[i], w[i], abs_tol=1e-9) for g, w in zip(got, want) for i in (2, 3))


def test_words_are_not_moved_once_they_are_rows(spark):
    """A segment is one row in every shuffle, sort and join; its words come after the last one."""
    segments = spark.createDataFrame([(1, "a b c", 0.0, 3.0)], "id int, text string, start double, end double")
    speech = spark.createDataFrame([(1, 0.0, 1.0)], "id int, r_start double, r_end double")
    plan = timing.words_by_mode(segments, speech, ["id"], "segment")._jdf.queryExecution().executedPlan().toString().splitlines()
    words = [k for k, line in enumerate(plan) if "posexplode" in line]
    assert words and not [line for line in plan[: words[-1]] if any(x in line for x in ("Exchange", "Sort", "Join", "Union"))]
