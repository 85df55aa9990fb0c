"""Options of a run: validated, resolved and readable from a command line."""

from __future__ import annotations

import argparse
import math
from dataclasses import dataclass, fields, replace

FORMATS = ("txt", "srt", "vtt", "json")
CHOICES = {
    "language": ("ar", "en"), "device": ("auto", "cpu", "cuda", "mps"), "dtype": ("auto", "fp32", "fp16", "bf16"), "vad": ("none", "energy", "hysteresis"),
    "alignment": ("none", "segment", "word"), "existing": ("error", "overwrite", "skip"),
}


@dataclass(frozen=True)
class Options:
    language: str = "en"
    device: str = "auto"
    dtype: str = "auto"
    vad: str = "hysteresis"
    alignment: str = "segment"
    existing: str = "error"
    text_only: bool = False
    formats: tuple[str, ...] = ()
    min_duration: float = 0.2
    max_duration: float = 30.0
    max_silence: float = 0.3
    energy_threshold: float = 50.0
    threshold: float = 0.5
    min_speech_ms: float = 250.0
    min_silence_ms: float = 100.0
    pad_ms: float = 30.0
    merge: bool = True
    max_chars: int = 42
    max_cue_duration: float = 6.0
    max_gap: float = 0.8
    batch_size: int | None = None
    batch_audio_seconds: float | None = None
    max_tokens: int = 448
    token_ceiling: int = 1024
    workers: int = 4
    memory_limit: int = 2 << 30


def validate(o: Options) -> Options:
    """Raises ``ValueError`` at the first rule that fails."""
    for name, allowed in CHOICES.items():
        if getattr(o, name) not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    for name in ("min_duration", "max_duration", "max_cue_duration", "energy_threshold", "threshold", "max_silence", "max_gap", "min_speech_ms", "min_silence_ms", "pad_ms"):
        v = getattr(o, name)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
            raise ValueError(f"{name} must be a finite number")
    for name in ("min_duration", "max_duration", "max_cue_duration"):
        if getattr(o, name) <= 0:
            raise ValueError(f"{name} must be positive")
    for name in ("max_silence", "max_gap", "min_speech_ms", "min_silence_ms", "pad_ms"):
        if getattr(o, name) < 0:
            raise ValueError(f"{name} must not be negative")
    for name in ("max_chars", "max_tokens", "token_ceiling", "workers", "memory_limit", "batch_size"):
        v = getattr(o, name)
        if name == "batch_size" and v is None:
            continue
        if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
            raise ValueError(f"{name} must be a positive integer")
    if o.batch_audio_seconds is not None and not o.batch_audio_seconds > 0:
        raise ValueError("batch_audio_seconds must be positive")
    if not 0 < o.threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if o.max_duration < o.min_duration:
        raise ValueError("max_duration must cover min_duration")
    if o.max_silence >= o.max_duration:
        raise ValueError("max_silence must be less than max_duration")
    if o.token_ceiling < o.max_tokens:
        raise ValueError("token_ceiling must cover max_tokens")
    if set(o.formats) - set(FORMATS) or len(set(o.formats)) != len(o.formats):
        raise ValueError("formats must be distinct and known")
    if o.text_only and {"srt", "vtt"} & set(o.formats):
        raise ValueError("text_only has no times for subtitles")
    if o.text_only and o.alignment == "word":
        raise ValueError("text_only and word alignment exclude each other")
    if o.device == "cpu" and o.dtype in ("fp16", "bf16"):
        raise ValueError("the CPU computes in fp32")
    return o


def resolve(o: Options, bf16: bool = False) -> Options:
    """Defaults that depend on other options."""
    validate(o)
    dtype = o.dtype if o.dtype != "auto" else "fp32" if o.device == "cpu" else "bf16" if bf16 else "fp16"
    return replace(o, dtype=dtype, alignment="none" if o.text_only else o.alignment, formats=o.formats or (("txt",) if o.text_only else ("txt", "srt", "vtt")))


def parse_formats(value: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(f.strip().lower() for f in value.split(",") if f.strip()))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanlab", allow_abbrev=True)
    p.add_argument("inputs", nargs="+")
    p.add_argument("--recursive", action="store_true")
    for f in fields(Options):
        flag = "--" + f.name.replace("_", "-")
        if f.name in CHOICES:
            p.add_argument(flag, choices=CHOICES[f.name], default=f.default)
        elif f.name == "formats":
            p.add_argument(flag, type=parse_formats, default=())
        elif isinstance(f.default, bool):
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            p.add_argument(flag, type=int if "int" in str(f.type) else float, default=f.default)
    return p


def from_args(argv: list[str]) -> tuple[list[str], bool, Options]:
    a = vars(parser().parse_args(argv))
    inputs, recursive = a.pop("inputs"), a.pop("recursive")
    return inputs, recursive, resolve(Options(**a))


def summary(n_ok: int, failures: list[tuple[str, str]], outputs: list[str], seconds: float) -> str:
    """The closing lines of a run: counts, up to 20 outputs and every failure."""
    lines = [f"{n_ok} completed, {len(failures)} failed, {seconds:.1f} s", *(f"  {p}" for p in outputs[:20])]
    if len(outputs) > 20:
        lines.append(f"  and {len(outputs) - 20} more")
    return "\n".join([*lines, *(f"  failed: {p}: {why}" for p, why in failures)])
