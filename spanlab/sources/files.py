"""Input lists, WAV files, JSON lines, tensor files and the multi-file sink."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T

AUDIO = ("wav", "mp3", "m4a", "flac", "ogg", "opus", "aac", "wma", "webm", "mp4", "mkv", "mov", "avi", "aiff", "mka")


def normalize_inputs(audio) -> list[str]:
    """One path or a non-empty list of paths; blank ones are refused."""
    paths = [audio] if isinstance(audio, str) else list(audio)
    if not paths or any(not isinstance(p, str) or not p.strip() for p in paths):
        raise ValueError("paths must be a non-empty list of non-blank strings")
    for p in paths:
        p.encode()  # refuses lone surrogates
    return paths


def expand_inputs(spark: SparkSession, audio, recursive: bool = False) -> DataFrame:
    """path, input_index, length: folders become their audio files in folded order; the first of equal paths stays."""
    parts = None
    for k, p in enumerate(normalize_inputs(audio)):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(p)
        rows = read.select("path", "length", F.lit(k).alias("input_index"), (F.col("path").endswith("/" + p.rstrip("/").split("/")[-1])).alias("single"))
        rows = rows.filter(F.col("single") | F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*AUDIO)).drop("single")
        parts = rows if parts is None else parts.unionByName(rows)
    first = F.row_number().over(Window.partitionBy("path").orderBy("input_index"))
    out = parts.withColumn("n", first).filter("n = 1").drop("n").withColumn("key", T.casefold_key(F.col("path")))
    if out.isEmpty():
        raise ValueError("no audio files")
    return out.orderBy("input_index", "key", "path").drop("key")


def _wav(data: bytes, samples: bool = True):
    """Rate, channels, frames and mono float32 samples of a PCM16, PCM8 or float WAV file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and fmt:
            kind, channels, rate, _, block, bits = fmt
            frames = min(size, len(data) - at - 8) // block
            if not samples:
                return rate, channels, frames, None
            raw = data[at + 8 : at + 8 + frames * block]
            if kind == 1 and bits == 16:
                x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
            elif kind == 1 and bits == 8:
                x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
            elif kind == 3 and bits == 32:
                x = np.frombuffer(raw, "<f4")
            else:
                raise ValueError("unsupported WAV encoding")
            return rate, channels, frames, x.reshape(-1, channels).mean(1, dtype=np.float64).astype(np.float32)
        at += 8 + size + size % 2
    raise ValueError("no audio data")


def decode_wav(files: DataFrame, samples: bool = True) -> DataFrame:
    """path, rate, channels, frames, duration, samples (unless only probed) and error, from path and content."""

    def run(batches):
        for p in batches:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                try:
                    rate, channels, frames, x = _wav(bytes(content), samples)
                    if x is not None and not np.isfinite(x).all():
                        raise ValueError("samples that aren't finite")
                    rows.append((path, rate, channels, frames, frames / rate, x, None))
                except (ValueError, struct.error) as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "frames", "duration", "samples", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, rate int, channels int, frames long, duration double, samples array<float>, error string")


WORKER = "id string, fingerprint string, recognition_status string, hypothesis string, duration double, error string, _bad string"


def worker_rows(spark: SparkSession, path: str, fingerprint: str | None = None, torn_tail: bool = False) -> DataFrame:
    """JSON lines of a worker; a bad line, a repeated id or another fingerprint is an error.

    ``torn_tail`` allows for one bad line, the last of its file.
    """
    rows = spark.read.schema(WORKER).option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = rows.select("id", "_bad", F.input_file_name().alias("f")).filter("_bad is not null").limit(3).collect()
    if len(bad) > int(torn_tail):
        raise ValueError(f"malformed worker row: {bad[0]['_bad'][:80]}")
    if bad:
        ends = [spark.read.text(b["f"], wholetext=True).first()[0].rstrip("\n").split("\n")[-1] for b in bad]
        if ends != [b["_bad"] for b in bad]:
            raise ValueError("a malformed row before the last line")
    good = rows.filter("_bad is null and id is not null").drop("_bad")
    if good.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("repeated id")
    if fingerprint is not None and good.filter(~F.col("fingerprint").eqNullSafe(fingerprint)).limit(1).count():
        raise ValueError("another fingerprint")
    return good


DTYPES = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}
HEADER_LIMIT = 64 << 20


def tensor_catalog(head: bytes, size: int) -> list[tuple]:
    """(name, dtype, shape, start, bytes) of a tensor file with a JSON header; checked for lengths and overlap."""
    n = struct.unpack("<Q", head[:8])[0]
    if n > HEADER_LIMIT or 8 + n > size:
        raise ValueError("header length")
    out = []
    for name, t in json.loads(head[8 : 8 + n]).items():
        if name == "__metadata__":
            continue
        kind, shape, (a, b) = t["dtype"], t["shape"], t["data_offsets"]
        if kind not in DTYPES or any(not isinstance(x, int) or x < 0 for x in shape):
            raise ValueError(f"{name}: dtype or shape")
        if not 0 <= a <= b <= size - 8 - n or b - a != DTYPES[kind] * int(np.prod(shape, dtype=object)):
            raise ValueError(f"{name}: offsets")
        out.append((name, kind, shape, 8 + n + a, b - a))
    out.sort(key=lambda t: (t[3], t[4]))
    for x, y in zip(out, out[1:]):
        if x[3] + x[4] > y[3]:
            raise ValueError(f"{y[0]}: overlaps {x[0]}")
    return out


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _TensorReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, part):
        import os

        with open(part.path, "rb") as f:
            head = f.read(8)
            head += f.read(min(HEADER_LIMIT, struct.unpack("<Q", head)[0]))
        for name, kind, shape, start, size in tensor_catalog(head, os.path.getsize(part.path)):
            yield part.path, name, kind, [int(s) for s in shape], start, size


class TensorSource(DataSource):
    """spark.read.format("tensors").option("paths", "a,b").load() after spark.dataSource.register(TensorSource)."""

    @classmethod
    def name(cls):
        return "tensors"

    def schema(self):
        return "path string, name string, dtype string, shape array<bigint>, data_start bigint, nbytes bigint"

    def reader(self, schema):
        return _TensorReader([p for p in self.options.get("paths", "").split(",") if p])


def shard_set(index: DataFrame, catalog: DataFrame) -> DataFrame:
    """The tensors of some files (name, shard, ...) against their index (name, shard); ``error`` where they disagree."""
    there = catalog.withColumn("there", F.lit(True))
    both = index.withColumn("mapped", F.lit(True)).join(there, ["name", "shard"], "full_outer")
    error = F.when(F.col("there").isNull(), "maps a missing tensor").when(F.col("mapped").isNull(), "absent from the index")
    return both.withColumn("error", error).drop("there", "mapped")


def to_float32(kind: str, data: bytes) -> np.ndarray:
    if kind == "F32":
        return np.frombuffer(data, "<f4")
    if kind == "F16":
        return np.frombuffer(data, "<f2").astype(np.float32)
    if kind == "BF16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    raise ValueError(kind)


def to_bfloat16(x: np.ndarray) -> np.ndarray:
    """Half-even rounding; NaN stays NaN, subnormals become signed zero."""
    bits = np.asarray(x, np.float32).view(np.uint32)
    rounded = (bits.astype(np.uint64) + 0x7FFF + ((bits >> 16) & 1)) >> 16
    out = np.where(np.isnan(x), (bits >> 16) | 0x40, rounded).astype(np.uint16)
    return np.where((out & 0x7F80) == 0, out & 0x8000, out)


def aligned_offsets(df: DataFrame, order: str, size: str, unit: int = 32) -> DataFrame:
    """Where each tensor begins if each starts at a multiple of ``unit``.

    The catalog of one file: a few thousand rows, in one partition by its nature.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(F.ceil(F.col(size) / unit) * unit).over(w), F.lit(0)).cast("long"))


def publish(rendered: DataFrame, folder: str, policy: str = "error") -> None:
    """Text outputs (output, content) under a folder; the marker comes last.

    Spark commits the files of a write together; readers look for ``_SUCCESS``.
    """
    mode = {"error": "errorifexists", "overwrite": "overwrite", "skip": "ignore"}[policy]
    rendered.select("output", "content").write.mode(mode).parquet(folder)
