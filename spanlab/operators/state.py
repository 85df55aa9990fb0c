"""Manifests, checkpoints and the decision to skip, resume or process."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = 1


def decide(sources: DataFrame, manifests: DataFrame, checkpoints: DataFrame, key: str) -> DataFrame:
    """Skip where a verified manifest exists, resume from a valid checkpoint, else process.

    ``manifests`` has the key and ``m_reason`` (null if verified); ``checkpoints`` has the
    key and ``c_reason``.  Left joins on the key; sides that are small are broadcast by AQE.
    """
    joined = sources.join(manifests.withColumn("has_m", F.lit(True)), key, "left").join(checkpoints.withColumn("has_c", F.lit(True)), key, "left")
    ok_m, ok_c = F.col("has_m") & F.col("m_reason").isNull(), F.col("has_c") & F.col("c_reason").isNull()
    why_m = F.when(F.col("has_m"), F.col("m_reason")).otherwise("no manifest")
    why_c = F.when(F.col("has_c"), F.col("c_reason")).otherwise("no checkpoint")
    decision = F.when(ok_m, "skip").when(ok_c, "resume").otherwise("process")
    reason = F.when(ok_m, F.lit(None)).when(ok_c, why_m).otherwise(F.concat_ws("; ", why_m, why_c))
    return joined.withColumns({"decision": decision, "reason": reason}).drop("has_m", "has_c", "m_reason", "c_reason")


def first_reason(*rules: tuple[Column, str | Column]) -> Column:
    """The message of the first rule that fails; null if all hold."""
    out = F.lit(None).cast("string")
    for holds, message in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), message).otherwise(out)
    return out


def manifest_reasons(sources: DataFrame, manifests: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Why each source's manifest doesn't stand, by the first rule that fails; null if it is verified.

    ``sources`` has asr_key, render_key, source, and formats (sorted) with the names of their
    outputs; ``manifests`` has kind, m_asr, m_render, m_source, generation and outputs (format,
    name, size, sha256); ``found`` has format, size and sha256 of the outputs that are there.
    """
    there = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("format", F.struct("size", "sha256")))).alias("there"))
    rows = sources.join(manifests, key, "left").join(there, key, "left")
    told = F.map_from_entries(F.transform("outputs", lambda x: F.struct(x["format"], x)))
    each = F.transform(F.arrays_zip("formats", "names"), lambda x: F.when(told[x["formats"]]["name"] != x["names"], F.concat(F.lit("state marker path for "), x["formats"], F.lit(" does not match")))
        .when(F.try_element_at("there", x["formats"]).isNull(), F.concat(x["formats"], F.lit(" output is missing or not regular")))
        .when((F.try_element_at("there", x["formats"])["size"] != told[x["formats"]]["size"]) | (F.try_element_at("there", x["formats"])["sha256"] != told[x["formats"]]["sha256"]), F.concat(x["formats"], F.lit(" output does not match its state marker"))))
    first = F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))
    reason = first_reason(
        (F.col("kind").isNotNull(), "no manifest"), (F.col("kind") == "published", F.concat(F.lit('state is "'), F.col("kind"), F.lit('", not published'))),
        (F.col("m_asr") == F.col("asr_key"), "state marker ASR contract does not match"), (F.col("m_render") == F.col("render_key"), "state marker render contract does not match"),
        (F.col("m_source") == F.col("source"), "state marker source snapshot does not match"), (F.col("generation") != "", "state marker generation ID is invalid"),
        (F.array_sort(F.transform("outputs", lambda x: x["format"])) == F.col("formats"), "state marker output formats do not match"), (first.isNull(), first),
    )
    return rows.withColumn("reason", reason)


def checkpoint(asr: str, source, duration: float, times: list, texts: list[str], spans: list, tokens: list = (), generation: str = "g", kind: str = "asr_complete", **more) -> str:
    """The state of a recognised file, in its envelope."""
    body = {"duration": duration, "segment_times": times, "segment_texts": texts, "speech_spans": spans, "generated_tokens": list(tokens)} | more
    return envelope({"kind": kind, "generation_id": generation, "asr_contract_key": asr, "source": source, "checkpoint": body})


_INDICES = ("repetition_stopped_segments", "truncation_retried_segments", "token_limit_segments")


def _number(x, name: str) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise ValueError(f"{name} is not finite numeric data")
    return float(x)


def _spans(value, duration: float, name: str) -> list[list[float]]:
    if not isinstance(value, list):
        raise ValueError(f"{name} is not a list")
    out, last = [], 0.0
    for row in value:
        if not isinstance(row, list) or len(row) != 2:
            raise ValueError(f"{name} contains an invalid row")
        a, b = (_number(x, name) for x in row)
        if not last <= a <= b <= duration + 1e-6:
            raise ValueError(f"{name} contains an overlapping, out-of-order, or out-of-range row")
        last = b
        out.append([a, min(b, duration)])
    return out


def _is_index(x, n: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and 0 <= x < n


def py_restore(text: str | None, asr: str, source) -> tuple[str | None, str | None]:
    """The checked checkpoint as canonical JSON, or the reason why there is none."""
    body, reason = py_open(text)
    if body is None:
        return None, reason
    p = json.loads(body)
    if p.get("kind") != "asr_complete":
        return None, f'state is "{p.get("kind")}", not an ASR checkpoint'
    if p.get("asr_contract_key") != asr:
        return None, "ASR checkpoint contract does not match"
    if p.get("source") != source:
        return None, "state marker source snapshot does not match"
    try:
        if not isinstance(p.get("generation_id"), str) or not p["generation_id"]:
            raise ValueError("generation ID is invalid")
        c = p.get("checkpoint")
        if not isinstance(c, dict):
            raise ValueError("checkpoint is not an object")
        duration = _number(c.get("duration"), "duration")
        if duration < 0:
            raise ValueError("duration is invalid")
        out = c | {"duration": duration} | {k: _spans(c.get(k), duration, k) for k in ("segment_times", "speech_spans")}
        texts, n = c.get("segment_texts"), len(out["segment_times"])
        if not isinstance(texts, list) or not all(isinstance(t, str) for t in texts):
            raise ValueError("segment_texts is invalid")
        if len(texts) != n:
            raise ValueError("segment text/time counts differ")
        tokens = c.get("generated_tokens", [])
        if not isinstance(tokens, list):
            raise ValueError("generated_tokens is invalid")
        good = all(isinstance(r, list) and len(r) == 2 and _is_index(r[0], n) and _is_index(r[1], 1 << 62) for r in tokens)
        if not good or len({r[0] for r in tokens}) != len(tokens):
            raise ValueError("generated_tokens contains an invalid or duplicate row")
        for k in _INDICES:
            x = c.get(k, [])
            if not isinstance(x, list):
                raise ValueError(f"{k} is invalid")
            if not all(_is_index(v, n) for v in x) or len(set(x)) != len(x):
                raise ValueError(f"{k} is invalid or contains duplicate indices")
    except ValueError as e:
        return None, f"ASR checkpoint is invalid ({e})"
    return T.canonical_json(out), None


def restore_checkpoints(df: DataFrame, key: str, column: str, asr: str, source) -> DataFrame:
    """key, checkpoint (canonical JSON) and reason."""

    @F.pandas_udf("checkpoint string, reason string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([py_restore(x, asr, source) for x in s], columns=["checkpoint", "reason"])

    return df.select(key, run(F.col(column)).alias("r")).select(key, "r.checkpoint", "r.reason")


def manifest_outputs(outputs: DataFrame, key: str) -> DataFrame:
    """Format, size and SHA-256 of each rendered output, by file."""
    item = F.struct("format", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    return outputs.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("outputs"))


def envelope(payload) -> str:
    """A payload with its own digest."""
    return T.canonical_json({"schema_version": SCHEMA, "payload_sha256": T.fingerprint(payload), "payload": payload})


def py_open(text: str | None, limit: int = 64 << 20) -> tuple[str | None, str | None]:
    """The payload as canonical JSON, or the reason why there is none."""
    if text is None:
        return None, "missing"
    if len(text.encode()) > limit:
        return None, "too large"
    try:
        d = json.loads(text)
        body = d["payload"]
    except (ValueError, KeyError, TypeError):
        return None, "malformed"
    if d.get("schema_version") != SCHEMA:
        return None, "schema version"
    if d.get("payload_sha256") != hashlib.sha256(T.canonical_json(body).encode()).hexdigest():
        return None, "digest mismatch"
    return T.canonical_json(body), None


def open_envelopes(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, payload and reason."""
    @F.pandas_udf("payload string, reason string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([py_open(x) for x in s], columns=["payload", "reason"])

    return df.select(key, run(F.col(column)).alias("r")).select(key, "r.payload", "r.reason")


def check_spans(spans: DataFrame, key: str, duration: str) -> DataFrame:
    """Whether each file's spans are ordered, apart and inside the media, with unique indices."""
    w = Window.partitionBy(key).orderBy("idx")
    good = (F.col("end") >= F.col("start")) & (F.col("start") >= 0) & (F.col("end") <= F.col(duration) + 1e-6) & (F.col("start") >= F.coalesce(F.lag("end").over(w), F.lit(0.0)))
    n = F.count("*")
    return spans.withColumn("good", good).groupBy(key).agg((F.bool_and("good") & (F.count_distinct("idx") == n) & F.bool_and(F.col("idx") >= 0)).alias("valid"), n.alias("n_spans"))


ASR_FIELDS = ("language", "model", "dtype", "vad", "max_duration")
VAD_FIELDS = {"none": (), "energy": ("min_duration", "max_silence", "threshold"), "hysteresis": ("threshold", "min_speech_ms", "min_silence_ms", "pad_ms")}
RENDER_FIELDS = ("alignment", "max_chars", "max_cue_duration", "max_gap")


def asr_key(options: dict) -> str:
    """Changes only with what changes the recognised text; settings of other modes are nulled."""
    used = {*ASR_FIELDS, *VAD_FIELDS.get(options.get("vad", "none"), ())}
    every = {*ASR_FIELDS, *(f for fs in VAD_FIELDS.values() for f in fs)}
    return T.fingerprint({k: options.get(k) if k in used else None for k in every} | {"contract": 3})


def render_key(options: dict) -> str:
    return T.fingerprint({k: options.get(k) for k in RENDER_FIELDS} | {"formats": sorted(options.get("formats", [])), "asr": asr_key(options)})


def plan_outputs(files: DataFrame, stem: str, formats: list[str]) -> DataFrame:
    """A path for each file and format, and whether another file wants the same."""
    rows = files.select("*", F.explode(F.array(*[F.lit(f) for f in formats])).alias("format")).withColumn("output", F.concat_ws(".", F.col(stem), F.col("format")))
    return rows.withColumn("collides", F.count("*").over(Window.partitionBy("output")) > 1)


def apply_existing(planned: DataFrame, existing: DataFrame, policy: str) -> DataFrame:
    """``error`` raises if an output exists, ``skip`` leaves those out, ``overwrite`` keeps all."""
    if policy == "overwrite":
        return planned
    if policy == "skip":
        return planned.join(existing.select("output").distinct(), "output", "left_anti")
    if policy != "error":
        raise ValueError(f"no such policy: {policy}")
    taken = planned.join(existing.select("output").distinct(), "output", "left_semi").limit(1).collect()
    if taken:
        raise FileExistsError(taken[0]["output"])
    return planned
