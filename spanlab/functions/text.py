"""Text functions as column expressions, and Arrow UDFs where Spark has no built-in.

White space is Unicode's, with the four separators U+001C to U+001F and without U+200B.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import letters

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
# as ranges: a matcher tests one after another for every character
_CLASS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PY = "[" + re.escape(SPACES) + "]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{_CLASS}+", ""), f"{_CLASS}+$", "")


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def words(c: Column) -> Column:
    """The runs without white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{_CLASS}+"), lambda w: w != "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{_CLASS}+", " "))


def py_strip(s: str) -> str:
    return s.strip(SPACES)


def py_words(s: str) -> list[str]:
    return [w for w in re.split(f"{_PY}+", s) if w]


def py_nfkc_lower(s: str) -> str:
    return unicodedata.normalize("NFKC", s).lower()


_FOLDED = str.maketrans({"ٱ": "ا", "ٰ": "ا", "ۥ": "و", "ۦ": "ي", "ـ": None, "ٓ": None, "ٕ": "ء", "ٔ": "ء"})
# of several curly quotes in a run the last one is the apostrophe
_QUOTE = re.compile(r"([^ \t\r\n\f\v]+)[‛’‘]([^ \t\r\n\f\v]+)")
# the digits of Unicode but for the Arabic ones, which are read as words
_DIGIT = "[^\\D٠-٩]"
_LEAD = re.compile(f"^{_DIGIT}+(?={_PY})")
_ALONE = re.compile(f"(?<={_PY}){_DIGIT}+(?={_PY}|$)")


def py_normalize(text: str) -> str:
    """For alignment: folded letters, no bracketed numbers, punctuation, marks or lone numbers."""
    s = re.sub(r"\([^)]*\d[^)]*\)", " ", py_nfkc_lower(text))
    for entity in ("&lt;", "&gt;", "&nbsp"):
        s = s.replace(entity, "")
    s = _QUOTE.sub(r"\1'\2", s).translate(_FOLDED)
    if not s.isascii() or not s.replace(" ", "").isalnum():
        s = "".join(" " if letters.is_blanked(ch) else ch for ch in s if not letters.is_dropped(ch))
    return " ".join(py_words(_ALONE.sub(" ", _LEAD.sub(" ", s))))


def py_romanize(text: str) -> str:
    """Letters of the normalized text in Latin script, each set apart by a space; see ``letters`` for what it covers."""
    spelled = (letters.spell(word) for word in py_normalize(text).split(" "))
    return " ".join(c for word in spelled for c in word.lower() if c == "'" or "a" <= c <= "z")


def _udf(fn, kind="string"):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    return run


def nfkc_lower(c: Column) -> Column:
    return _udf(py_nfkc_lower)(c)


def normalize(c: Column) -> Column:
    return _udf(py_normalize)(c)


def romanize(c: Column) -> Column:
    return _udf(py_romanize)(c)


STAR = "<star>"


def with_stars(tokens: Column) -> Column:
    """A wildcard before each token."""
    return F.flatten(F.transform(tokens, lambda t: F.array(F.lit(STAR), t)))


def romanized_stars(c: Column) -> Column:
    """The words of a text, each romanized by itself, with a wildcard before each."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [y for w in py_words(x) for y in (STAR, py_romanize(w))])

    return run(c)


def timestamp(seconds: Column, hours: bool = False, marker: str = ".") -> Column:
    """[HH:]MM:SS.mmm, half-even to the millisecond; hours always, or only where there are any."""
    ms = F.bround(F.greatest(F.lit(0.0), seconds) * 1000).cast("long")
    h, rest = F.floor(ms / 3_600_000), ms % 3_600_000
    m, s, f = F.floor(rest / 60_000), F.floor(rest % 60_000 / 1000), rest % 1000
    short = F.format_string(f"%02d:%02d{marker}%03d", m, s, f)
    long = F.format_string(f"%02d:%02d:%02d{marker}%03d", h, m, s, f)
    return long if hours else F.when(h > 0, long).otherwise(short)


def duration(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s, rounded half up."""
    t = F.round(F.greatest(F.lit(0.0), seconds)).cast("long")
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s)).when(m > 0, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))


def path(c: Column) -> Column:
    """Without '.' and empty parts; a leading '//' stays."""
    parts = F.array_join(F.filter(F.split(c, "/"), lambda p: (p != "") & (p != ".")), "/")
    lead = F.when(c.rlike("^//[^/]"), "//").when(c.startswith("/"), "/").when(c.rlike("^//$"), "//").otherwise("")
    joined = F.concat(lead, parts)
    return F.when(joined == "", ".").otherwise(joined)


def casefold_key(c: Column) -> Column:
    return _udf(str.casefold)(c)


_INT = re.compile(r"[+-]?\d+(_\d+)*")


def py_float(s: str) -> float | None:
    try:
        return float(s)
    except ValueError:
        return None


def py_int(s: str) -> int | None:
    t = s.strip()
    return int(t) if _INT.fullmatch(t) and abs(int(t)) < 1 << 63 else None


def parse_float(c: Column) -> Column:
    return _udf(py_float, "double")(c)


def parse_int(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else py_int(x)).astype("Int64"), "long")(c)


OOM = (
    r"(?i)out of memory|cannot allocate memory|cu(blas|dnn)_status_alloc_failed|defaultcpuallocator"
    r"|cuda(_error_|error: ?| error: )memory ?_?allocation|cudaerrormemoryallocation"
)
FATAL = r"(?i)cu(blas|dnn)_status|(cuda|hip) error|device-side assert|driver shutting down|illegal memory access|mps backend failed|unspecified launch failure"
#: errors of a program, not of its data
FAULTS = ("IndexError", "KeyError", "LoadError", "NameError", "NoMethodError", "NotImplementedError", "ScriptError", "SystemStackError", "TypeError")


def error_class(message: Column, kind: Column | None = None, error: Column | None = None) -> Column:
    """A typed kind where there is one; else by the message and the class of the error."""
    fault = F.lit(False) if error is None else F.coalesce(error.isin(*FAULTS), F.lit(False))
    text = F.when(message.rlike(OOM), "oom").when(fault | message.rlike(FATAL), "fatal").otherwise("error")
    return text if kind is None else F.coalesce(F.when(kind.isin("oom", "fatal", "error"), kind), text)


def error_fingerprint(error: Column, message: Column) -> Column:
    """Class and message, of 500 characters at most, with addresses and lone numbers masked, so like errors meet."""
    s = collapse(F.coalesce(message, F.lit("")))
    s = F.substring(F.when((s == "") | (s == error), "<no message>").otherwise(s), 1, 500)
    return F.concat(error, F.lit(": "), F.regexp_replace(F.regexp_replace(s, "(?i)0x[0-9a-f]+", "0x*"), r"\b[0-9]+\b", "#"))


def is_repo_id(c: Column) -> Column:
    ok = c.rlike(r"^\w[\w.-]*(/\w[\w.-]*)?$")
    return ok & ~c.contains("--") & ~c.contains("..") & (F.length(c) <= 96) & ~c.endswith(".git") & ~c.rlike("[.-]$")


def is_revision(c: Column) -> Column:
    return c.rlike(r"^[^\W_][\w./-]*$") & ~c.contains("..") & ~c.endswith("/")


def canonical_json(value) -> str:
    """Keys sorted at every depth, no white space, nulls kept."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def fingerprint_of(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of the named columns."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def centiseconds(c: Column) -> Column:
    return c / F.lit(100.0)


def word_errors(reference: list[str], hypothesis: list[str]) -> int:
    """Levenshtein distance of two token lists."""
    code: dict[str, int] = {}
    r, h = (np.array([code.setdefault(w, len(code)) for w in ws], np.int64) for ws in (reference, hypothesis))
    place = np.arange(len(h) + 1)
    row = place.copy()
    for i, x in enumerate(r.tolist(), 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (h != x))
        # insertions run to the right: the least of (value - place) so far, plus the place
        row = np.minimum.accumulate(np.concatenate(([i], best)) - place) + place
    return int(row[-1])


def word_distance(reference: Column, hypothesis: Column) -> Column:
    @F.pandas_udf("long")
    def run(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([word_errors(list(a), list(b)) for a, b in zip(r, h)])

    return run(reference, hypothesis)
