"""Expected strings and numbers written out, so that code and SQL can't share a misreading."""

import pytest
from pyspark.sql import functions as F
from spanlab.functions import text as T
from spanlab.operators import cues
from spanlab.operators import kernels as K
from spanlab.operators import spans as S


@pytest.mark.parametrize("text, want", [
    ("مرحبا", "m r h b a"), ("عَلَيْكُمْ", "' l y k m"), ("الذكاء", "a l t h k a '"), ("الاصطناعي", "a l a s t n a ' y"), ("café", "c a f e"), ("don’t", "d o n ' t"),
    ("µ", "m"), ("か", "k a"), ("한", "h a n"), ("かった", "k a t t a"), ("じゃ", "j a"), ("ちょっと", "c h o t t o"), ("きょ", "k y o"), ("ショ", "s h o"), ("っちゃ", "t c h a"),
])
def test_romanized(text, want):
    assert T.py_romanize(text) == want


def test_normalized():
    assert T.py_normalize("foo (123) bar") == "foo bar" and T.py_normalize("foo ١٢٣ bar") == "foo ١٢٣ bar" and T.py_normalize("foo ꤀꤁ bar") == "foo bar"
    assert T.py_normalize(" foo\x1cbar\x85baz\u202f ") == "foo bar baz" and T.py_normalize("\0") == "\0"
    assert T.py_normalize("rock’n’roll") == "rock n'roll" and T.py_normalize("“yes” – no!") == "yes no"


def test_streams_for_alignment(spark):
    row = spark.createDataFrame([("foo (123) bar",)], "t string").select(T.romanized_stars(F.col("t")).alias("a"), T.with_stars(T.words(F.col("t"))).alias("b")).first()
    assert row.a == ["<star>", "f o o", "<star>", "", "<star>", "b a r"] and row.b == ["<star>", "foo", "<star>", "(123)", "<star>", "bar"]


def test_subtitles(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.25, "Hello"), (1, 1, 61.0, 62.5, "World")], "id int, cue_index int, start double, end double, text string")
    assert cues.srt(rows, "id").first().content == "1\n00:00:00,000 --> 00:00:01,250\nHello\n\n2\n00:01:01,000 --> 00:01:02,500\nWorld\n\n"
    assert cues.vtt(rows, "id").first().content == "WEBVTT\n\n00:00.000 --> 00:01.250\nHello\n\n01:01.000 --> 01:02.500\nWorld\n\n"


def test_errors(spark):
    def of(error, message):
        return spark.createDataFrame([(error, message)], "e string, m string").select(T.error_class(F.col("m"), error=F.col("e")).alias("c"), T.error_fingerprint(F.col("e"), F.col("m")).alias("f")).first()

    assert of("RuntimeError", "  CUDA   failure at 0x7ffc1234 on device 12 after 99 steps  ").f == "RuntimeError: CUDA failure at 0x* on device # after # steps"
    assert of("RuntimeError", "RuntimeError").f == of("RuntimeError", None).f == "RuntimeError: <no message>" and of("E", "item12 0xAF").f == "E: item12 0x*"
    for m in ("CUDA error: memory allocation", "CUBLAS_STATUS_ALLOC_FAILED", "DefaultCPUAllocator: no", "cannot allocate memory", "cudaErrorMemoryAllocation", "CUDA_ERROR_MEMORY_ALLOCATION"):
        assert of("RuntimeError", m).c == "oom", m
    for m in ("HIP error", "CUBLAS_STATUS_X", "device-side assert", "unspecified launch failure"):
        assert of("RuntimeError", m).c == "fatal", m
    assert of("RuntimeError", "no room").c == "error" and of("KeyError", "x").c == "fatal"


def test_growth():
    g = K.Growth(24, 64, 1000)
    assert g.oom(24) == 12 and g.most == 23 and [g.fitted(12, 100), g.fitted(12, 100)] == [12, 12]
    assert [g.fitted(g.size, 100) for _ in range(6)] == [15, 19, 23, 23, 23, 23]
    g = K.Growth(8, 64, 1000)
    assert g.fitted(8, 700) == 9 and g.fitted(9, 820) == 9 and g.fitted(8, 100) == 9 and g.fitted(9, 100) == 12 and g.oom(1) == 1
    assert K.Growth(8, 64, 1000).fitted(8, 600, 0) == 10 and K.Growth(20, 64, 1000).fitted(20, 640, 0) == 25


def test_last_frame_and_media_length(spark):
    rows = spark.createDataFrame([(1, k, True, 800 if k < 4 else 480) for k in range(5)], "s int, k int, loud boolean, n int")
    assert [(r.start, r.end) for r in S.energy_spans(rows, "s", "k", "loud", 0.1, 0.2, 0.05, length="n").orderBy("span").collect()] == [(0, 0.2), (0.2, 0.23)]
    probs = spark.createDataFrame([(1, k, 0.9, 1000) for k in range(2)], "s int, k int, p float, media int")
    assert [(r.start, r.end) for r in S.speech_spans(probs, "s", "k", "p", "media", shortest_ms=0, pad_ms=0).collect()] == [(0, 1000)]


def test_layouts():
    h = 0.5**0.5
    assert S.layout_weights(2) == [h, h] and S.layout_weights(6) == [h, h, 1.0, 0.0, 0.5, 0.5] and S.layout_weights(9) is None


def test_word_distance():
    assert T.word_errors([], ["a"]) == 1 and T.word_errors(["a", "b"], []) == 2 and T.word_errors("k i t t e n".split(), "s i t t i n g".split()) == 3
