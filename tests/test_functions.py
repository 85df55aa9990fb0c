import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanlab import config
from spanlab.functions import text as T
from spanlab.operators import cues, packing, profile, state, timing
from spanlab.operators import spans as S
from spanlab.sources import files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_white_space(spark):
    s = "\x1c  one\x85two​x　"
    assert one(spark, T.words(F.lit(s))) == T.py_words(s) == ["one", "two​x"]
    assert one(spark, T.strip(F.lit(s))) == T.py_strip(s) and one(spark, T.collapse(F.lit("  a \n b "))) == "a b"
    assert one(spark, T.is_blank(F.lit("  "))) and not one(spark, T.is_blank(F.lit("​")))


def test_normalize_and_romanize(spark):
    assert T.py_romanize("café") == "c a f e" and T.py_romanize("don’t") == "d o n ' t" and T.py_romanize("مرحبا") == "m r h b a"
    assert T.py_normalize("foo (123) bar") == "foo bar" and T.py_normalize("foo ١٢٣ bar") == "foo ١٢٣ bar"
    rows = spark.createDataFrame([("Café!",), (None,), ("",)], "t string")
    assert [r.x for r in rows.select(T.romanize(F.col("t")).alias("x")).collect()] == ["c a f e", None, ""]


def test_timestamps(spark):
    for x, hours, mark, want in [(-1.0, False, ".", "00:00.000"), (0.0005, False, ".", "00:00.000"), (0.0015, False, ".", "00:00.002"), (3661.234, True, ",", "01:01:01,234"), (3600.0, False, ".", "01:00:00.000")]:
        assert one(spark, T.timestamp(F.lit(x), hours, mark)) == want
    assert one(spark, T.duration(F.lit(3723.4))) == "1h02m03s"


def test_paths_errors_and_numbers(spark):
    for p, want in [("a//b/./c", "a/b/c"), ("//x/y", "//x/y"), ("/./", "/"), (".", ".")]:
        assert one(spark, T.path(F.lit(p))) == want
    assert one(spark, T.error_class(F.lit("CUDA out of memory"))) == "oom"
    assert T.py_float("1_0.5") == 10.5 and T.py_float("x") is None and T.py_int("1_000") == 1000 and T.py_int("1.0") is None


def test_words_on_segments_and_spans(spark):
    seg = spark.createDataFrame([(1, "  one\n two   three ", 1.0, 4.0), (2, " ", 0.0, 1.0), (3, "x", 5.0, 4.0)], "id int, text string, start double, end double")
    got = [(r.id, r.start, r.end, r.word) for r in timing.uniform_words(seg, "id").orderBy("id", "word_index").collect()]
    assert got == [(1, 1.0, 2.0, "one"), (1, 2.0, 3.0, "two"), (1, 3.0, 4.0, "three"), (3, 5.0, 5.0, "x")]
    spans = spark.createDataFrame([(1, k, a, b, ["one", "two", "three", "four"]) for k, (a, b) in enumerate([(0.0, 1.0), (1.0, 1.0), (3.0, 4.0)])], "id int, k int, start double, end double, tokens array<string>")
    got = [(r.start, r.end) for r in timing.words_across_spans(spans, ["id"], "k", "tokens").orderBy("word_index").collect()]
    assert got == [(0, 0.5), (0.5, 1), (3, 3.5), (3.5, 4)]
    shares = spark.createDataFrame([(1, 0, 1.0, 1), (1, 1, 1.0, 1), (1, 2, 1.0, 1), (2, 0, 1.0, 2), (2, 1, 3.0, 2)], "id int, k int, w double, n int")
    assert [r.share for r in timing.allocate(shares, ["id"], "k", "n", "w").orderBy("id", "k").collect()] == [1, 0, 0, 0, 2]


def test_spans(spark):
    spans = spark.createDataFrame([(1, a, b) for a, b in [(-1.0, 0.0), (0.0, 1.0), (1.0, 2.0), (2.0, 3.0), (4.0, 5.0)]], "id int, start double, end double")
    regions = spark.createDataFrame([(1, 0.5, 2.5)], "id int, r_start double, r_end double")
    assert sorted((r.start, r.end) for r in S.clip(spans, regions, "id").collect()) == [(0.5, 1), (1, 2), (2, 2.5)]
    media = spark.createDataFrame([(1, 1_044_000), (2, 0)], "id int, n long")
    assert [(r.start, r.end) for r in S.fixed_windows(media, "id", "n", 30.0).orderBy("start").collect()] == [(0, 30), (30, 60), (60, 65.25)]
    tiny = spark.createDataFrame([(1, 5)], "id int, n long")
    assert [(round(r.start * 16000), round(r.end * 16000)) for r in S.fixed_windows(tiny, "id", "n", 2.5 / 16000).orderBy("start").collect()] == [(0, 2), (2, 4), (4, 5)]
    folded = spark.createDataFrame([([(0.2, 4.0), (4.4, 9.8), (15.0, 24.0), (24.5, 31.0)],), ([],)], f"s {S.SPANS}").select(S.merge_array(F.col("s"), 10.0).alias("m")).collect()
    assert [tuple(x) for x in folded[0].m] == [(0.2, 9.8), (15, 24), (24.5, 31)] and folded[1].m == []


def test_cue_bounds_and_text(spark):
    raw = spark.createDataFrame([(1, 0, 0.0, 0.1, "one.", 0.4), (1, 1, 0.2, 0.25, "two.", 0.4)], "id int, cue_index int, start double, end double, text string, media double")
    assert [(r.start, r.end) for r in cues.bounds(raw, "id", "media").orderBy("cue_index").collect()] == [(0, 0.2), (0.2, 0.4)]
    seg = spark.createDataFrame([(1, 0, " one "), (1, 1, ""), (1, 2, " \n"), (1, 3, "two"), (2, 0, None)], "id int, k int, text string")
    assert {r.id: r.content for r in cues.txt(seg, "id", "k").collect()} == {1: "one\ntwo\n", 2: "\n"}


def test_state(spark):
    text = state.envelope({"b": [1, None], "a": "é"})
    assert state.py_open(text) == (T.canonical_json({"a": "é", "b": [1, None]}), None)
    assert state.py_open(text.replace("1", "2", 2))[1] in ("schema version", "digest mismatch") and state.py_open("{")[1] == "malformed" and state.py_open(None)[1] == "missing"
    base = {"language": "en", "vad": "none", "threshold": 0.5, "max_chars": 40, "formats": ["srt", "txt"]}
    assert state.asr_key(base) == state.asr_key(base | {"threshold": 0.9, "max_chars": 10}) != state.asr_key(base | {"vad": "energy"})
    assert state.render_key(base) == state.render_key(base | {"formats": ["txt", "srt"]}) != state.render_key(base | {"max_chars": 10})
    planned = state.plan_outputs(spark.createDataFrame([("a",), ("b",)], "stem string"), "stem", ["txt"])
    old = spark.createDataFrame([("a.txt",)], "output string")
    assert [r.output for r in state.apply_existing(planned, old, "skip").collect()] == ["b.txt"]
    with pytest.raises(FileExistsError):
        state.apply_existing(planned, old, "error")
    assert [r.payload is None for r in state.open_envelopes(spark.createDataFrame([(1, text), (2, None)], "id int, e string"), "id", "e").orderBy("id").collect()] == [False, True]


def test_sources(spark, tmp_path):
    pcm = np.array([0, 16384, -32768], "<i2").tobytes()
    wav = b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm
    (tmp_path / "b.wav").write_bytes(wav)
    (tmp_path / "A.wav").write_bytes(b"no")
    (tmp_path / "c.text").write_bytes(b"")
    listed = files.expand_inputs(spark, [str(tmp_path), str(tmp_path / "b.wav")])
    assert [r.path.rsplit("/")[-1] for r in listed.collect()] == ["A.wav", "b.wav"]
    got = {r.path[-5:]: r for r in files.decode_wav(spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))).collect()}
    assert list(got["b.wav"].samples) == [0, 0.5, -1] and got["A.wav"].error
    with pytest.raises(ValueError):
        files.normalize_inputs([" "])
    (tmp_path / "rows.jsonl").write_text('{"id": "a", "fingerprint": "f", "hypothesis": "x"}\n{"id": "b", "fing')
    assert files.worker_rows(spark, str(tmp_path / "rows.jsonl"), "f", torn_tail=True).count() == 1
    with pytest.raises(ValueError):
        files.worker_rows(spark, str(tmp_path / "rows.jsonl"), "f")


def test_tensors(spark, tmp_path):
    def blob(catalog, size):
        head = json.dumps(catalog).encode()
        return struct.pack("<Q", len(head)) + head + b"\0" * size

    good = blob({"w": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}, "b": {"dtype": "F16", "shape": [2], "data_offsets": [16, 20]}}, 20)
    (tmp_path / "m.tensors").write_bytes(good)
    spark.dataSource.register(files.TensorSource)
    rows = spark.read.format("tensors").option("paths", str(tmp_path / "m.tensors")).load().collect()
    assert {(r.name, r.dtype, r.nbytes) for r in rows} == {("w", "F32", 16), ("b", "F16", 4)}
    for bad in ({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 16]}}, {"a": {"dtype": "U8", "shape": [4], "data_offsets": [0, 4]}, "b": {"dtype": "U8", "shape": [4], "data_offsets": [2, 6]}}):
        data = blob(bad, 16)
        with pytest.raises(ValueError):
            files.tensor_catalog(data, len(data))
    x = np.array([1.0, math.pi, -1e-40, np.nan, 3.0e38], np.float32)
    back = files.to_float32("BF16", files.to_bfloat16(x).astype("<u2").tobytes())
    assert back[0] == 1 and abs(back[1] - math.pi) < 0.01 and back[2] == 0 and np.isnan(back[3])
    sizes = spark.createDataFrame([(0, 10), (1, 33), (2, 1)], "k int, n long")
    assert [r.offset for r in files.aligned_offsets(sizes, "k", "n").orderBy("k").collect()] == [0, 32, 96]


def test_options():
    o = config.resolve(config.Options())
    assert o.formats == ("txt", "srt", "vtt") and o.dtype == "fp16"
    assert config.resolve(config.Options(text_only=True)).alignment == "none" and config.resolve(config.Options(device="cpu")).dtype == "fp32"
    for bad in ({"language": "xx"}, {"threshold": 0.0}, {"max_duration": 0.1}, {"formats": ("srt", "srt")}, {"max_gap": math.nan}, {"workers": 0}, {"device": "cpu", "dtype": "fp16"}):
        with pytest.raises(ValueError):
            config.validate(config.Options(**bad))
    inputs, recursive, o = config.from_args(["a.wav", "--formats", "srt,txt", "--no-merge", "--max-ch", "30"])
    assert inputs == ["a.wav"] and not recursive and o.formats == ("srt", "txt") and o.merge is False and o.max_chars == 30


def test_leftover_and_growth(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 1, 30)], "g int, k int, n long")
    assert [r.grant for r in packing.share_leftover(rows, ["g"], "k", "n", 103).orderBy("k").collect()] == [25, 78]
    scored = profile.edits(spark.createDataFrame([("a b c", "a x"), ("d", None)], "r string, h string"), "r", "h").collect()
    assert [(r.word_edits, r.ref_words) for r in scored] == [(2, 3), (1, 1)]
