"""PII spans by weak supervision: labelers vote, EM weighs them, a classifier decides.

1. Candidates: every span of the whole text that looks like an address with an at sign, a
   code of 20 or more letters and digits, an IBAN, an IPv6 address, or digits (six at least)
   with the usual separators.  A longer chain of digit groups is cut between groups, so that
   a piece has 19 digits at most; a single longer group is a candidate by itself.
2. Labelers vote a kind, 'none', or abstain: regular expressions (mail, phone, IPv4, IPv6,
   card, IBAN, key), gazetteers (mail domains and hosts, card issuers, dialling codes, first
   octets in use, IBAN countries with their lengths) and context (the words before a span).
3. The votes of all candidates are counted by pattern, and expectation-maximisation over
   the patterns estimates each labeler's reliability (the chance of each vote under each
   true kind, counted over all candidates of that kind, also where it abstains) and the
   kind of each pattern, from the labelers that vote.  It
   starts from the shares of the votes, and a prior of ``pseudo`` votes for each labeler and
   kind holds that labelers are mostly right, else kinds could change places; it has the
   weight of so many votes and no more, so many votes outweigh it.
4. A multinomial logistic regression over the span's shape, length, parts and neighbouring
   words is fitted to those kinds, on at most ``max_train_spans`` candidates chosen by hash,
   and decides on every candidate.

Offsets count characters, as substring() does, from 0.  Defined results: a null or empty
text has no spans; rows with a null doc_id keep it null; repeated rows give repeated spans.
Without candidates the result is empty.  Extra columns are ignored.
"""

from __future__ import annotations

import ipaddress
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .textkernel import slices

KINDS = ("none", "email", "phone", "ip", "card", "key", "iban")
PARAMS = {"iterations": 60, "pseudo": 10.0, "max_train_spans": 50_000, "bits": 14, "epochs": 60, "rate": 0.5, "l2": 1e-4}

CANDIDATE = re.compile(
    r"(?P<mail>(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<iban>(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?!\w))"
    r"|(?P<code>(?<![\w-])[0-9A-Za-z_-]{20,}+)"
    r"|(?P<six>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,}+(?![\w:]))"
    r"|(?P<four>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]))"
    r"|(?P<phone>(?<!\w)\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}(?!\w))"
    r"|(?P<digits>(?<!\w)\+?\(?\d(?:[ .()-]{0,2}+\d)*+)"
)
#: no card, phone or account has more digits
DIGITS = 19
_GROUP = re.compile(r"\d+")
_ANY = re.compile(r"[@\d]|:[0-9A-Fa-f]*:")
MAIL_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info")
MAIL_HOSTS = ("mail", "gmail", "yahoo", "outlook", "hotmail", "proton", "icloud")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65")
#: characters of an IBAN by country
IBAN = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24, "TR": 26}
DIALLING = ("+1", "+33", "+34", "+44", "+49", "+7", "+86", "001", "0033", "0034", "0049")
CONTEXT = {
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "mastercard", "karte", "carte", "tarjeta"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "key": ("token", "secret", "password", "key", "apikey", "api_key", "pwd", "bearer"),
}
_BEFORE = {w: KINDS.index(k) for k, ws in CONTEXT.items() for w in ws}
_WORD = re.compile(r"[\w-]+")


def _luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _mod97(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _six(span: str) -> bool:
    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


def votes(span: str, before: list[str]) -> str:
    """One character a labeler: the index of the kind, or '-' to abstain."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    octets = span.split(".")
    at = "@" in span
    bare = span.replace(" ", "").upper()
    account = bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{8,31}", bare))
    colons = not at and span.count(":") >= 2
    code = colons or bool(re.fullmatch(r"[0-9A-Za-z_-]{20,}", span)) and not span.isdigit() or account
    ipish = len(octets) == 4 and all(o.isascii() and o.isdigit() and len(o) <= 3 for o in octets)
    vote = [
        # regular expressions
        "1" if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", span) else "0" if at else "-",
        "2" if re.fullmatch(r"(\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}", span) else "-",
        ("3" if all(int(o) <= 255 for o in octets) else "0") if ipish else "-",
        ("4" if _luhn(digits) else "0") if 13 <= len(digits) <= 19 and not at and not code else "-",
        ("3" if _six(span) else "0") if colons else "-",
        ("6" if _mod97(bare) else "0") if account and " " in span or account and bare[:2] in IBAN else "-",
        "5" if re.fullmatch(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}", span) and not span.isdigit() else "-",
        "0" if len(digits) > DIGITS and not code and not at else "-",
        "0" if re.fullmatch(r"\d{4}[-.]\d{2}[-.]\d{2}|\d{1,3}([.,]\d{3})+|\d{1,12}|\d+\.\d+", span) and not ipish else "-",
        "0" if 13 <= len(digits) <= 19 and len(span) == len(digits) and not (_luhn(digits) and ISSUERS.match(digits)) else "-",
        # gazetteers
        "1" if at and span.rsplit(".", 1)[-1].lower() in MAIL_DOMAINS else "-",
        ("6" if IBAN.get(bare[:2]) == len(bare) else "0") if account and bare[:2] in IBAN else "-",
        "1" if at and any(h in span.split("@", 1)[1].lower() for h in MAIL_HOSTS) else "-",
        ("4" if ISSUERS.match(digits) else "0") if len(digits) in (15, 16) and not at and not code else "-",
        ("3" if 1 <= int(octets[0]) <= 223 and not any(len(o) > 1 and o[0] == "0" for o in octets) else "0") if ipish else "-",
        "2" if span.startswith(DIALLING) and 10 <= len(digits) <= 15 and not code else "-",
        # shape
        "2" if 10 <= len(digits) <= 12 and ("(" in span or span.count("-") >= 1) and not at and not code else "-",
        "5" if code and not colons and " " not in span and not (account and bare[:2] in IBAN) and len(set(span)) >= 12 and any(c.isdigit() for c in span) and any(c.isalpha() for c in span) else "-",
    ]
    # context
    near = [_BEFORE[w] for w in before if w in _BEFORE]
    vote.append(str(near[-1]) if near else "-")
    return "".join(vote)


def features(span: str, before: list[str], after: str, bits: int) -> list[int]:
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "9", span)))
    short = re.sub(r"9+", "9", shape)
    digits = sum(c.isdigit() for c in span)
    parts = {f"shape={shape}", f"short={short}", f"len={min(len(span), 40)}", f"digits={digits}", f"first={span[:1] if not span[:1].isalpha() else 'a'}", f"head={re.sub(r'[A-Za-z]', 'a', span[:2])}"}
    parts |= {f"set={''.join(sorted(set(c for c in span if not c.isalnum())))}", f"letters={any(c.isalpha() for c in span)}", f"last={before[-1] if before else ''}", f"next={after}"}
    parts |= {f"bag={w}" for w in before if w in _BEFORE}
    octets = span.split(".")
    if len(octets) == 4 and all(o.isascii() and o.isdigit() for o in octets):
        parts.add(f"octets={all(len(o) <= 3 and int(o) <= 255 for o in octets)}")
    if span.count(":") >= 2 and "@" not in span:
        parts.add(f"six={_six(span)}")
    bare = span.replace(" ", "").upper()
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{8,31}", bare):
        parts |= {f"mod97={_mod97(bare)}", f"country={IBAN.get(bare[:2]) == len(bare)}"}
    if 13 <= digits <= 19 and digits == len(span):
        parts |= {f"luhn={_luhn(span)}", f"issuer={bool(ISSUERS.match(span))}", f"card={_luhn(span) and bool(ISSUERS.match(span))}"}
    return sorted({zlib.crc32(x.encode()) >> (32 - bits) for x in parts})


def pieces_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each candidate."""
    out, at = [], 0
    while m := CANDIDATE.search(text, at):
        a, b = m.span()
        at = b
        if m.lastgroup == "code":
            if any(c.isdigit() for c in m.group()) and not m.group().isdigit():
                out.append((a, b))
            elif m.group().isdigit():
                out += _digits(text, a, b)
        elif m.lastgroup == "digits":
            if b < len(text) and (text[b].isalnum() or text[b] == "_"):
                # the last group runs on into a word: it is none of these
                at = b
                b = next((x.end() for x in reversed(list(_GROUP.finditer(text, a, b))[:-1])), a)
            out += _digits(text, a, b)
        else:
            out.append((a, b))
    return out


def _digits(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A chain of digit groups, cut between groups into pieces of at most DIGITS digits; of six at least."""
    out, start, end, n = [], a, a, 0
    for g in _GROUP.finditer(text, a, b):
        k = g.end() - g.start()
        if n and n + k > DIGITS:
            out.append((start, end, n))
            start, n = g.start(), 0
        end, n = g.end(), n + k
    out.append((start, end, n))
    return [(s, e) for s, e, n in out if n >= 6]


def spans_of(text: str) -> list[tuple[int, int, list[str], str]]:
    """Start, end, up to four words before and the word after each candidate."""
    out = []
    if not _ANY.search(text):
        return out
    for a, b in pieces_of(text):
        before = _WORD.findall(text[max(0, a - 48) : a].lower())[-4:]
        after = _WORD.search(text[b : b + 24].lower())
        out.append((a, b, before, after.group() if after else ""))
    return out


def candidates(docs: DataFrame, bits: int = PARAMS["bits"]) -> DataFrame:
    """doc_id, start, end, votes and features of every candidate."""

    def run(b):
        for at, part in slices(b.column("text")):
            rows = []
            for k, text in enumerate(part.to_pylist()):
                for s, e, before, after in spans_of(text):
                    rows.append((at + k, s, e, votes(text[s:e], before), features(text[s:e], before, after, bits)))
            if rows:
                k, s, e, v, x = zip(*rows)
                yield pa.record_batch([b.column("doc_id").take(pa.array(k)), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(v), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "start", "end", "votes", "features"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).filter("text is not null and text <> ''")
    return map_arrow(rows, run, "doc_id bigint, start int, end int, votes string, features array<int>")


def reliabilities(patterns: list[str], counts: np.ndarray, iterations: int, pseudo: float = PARAMS["pseudo"]) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: the kind of each pattern, and by labeler and kind the chances of its votes where it votes."""
    code = np.array([[KINDS_AND_NONE.index(c) for c in p] for p in patterns])
    k = len(KINDS)
    # start: the share of each kind among the votes, 'none' where all abstain
    post = np.full((len(patterns), k), 0.02)
    for j in range(code.shape[1]):
        some = code[:, j] < k
        post[some, code[some, j]] += 1
    post[(code == k).all(1), 0] += 1
    post /= post.sum(1, keepdims=True)
    # the prior, by outcome and kind: one in ten is wrong, and of the rest half abstain, or all if the labeler doesn't know the kind
    prior = np.full((code.shape[1], k + 1, k), 0.1 / (k - 1))
    prior[:, k] = 0.9
    for j in range(code.shape[1]):
        known = np.unique(code[code[:, j] < k, j])
        prior[j, known, known] = prior[j, k, known] = 0.45
    chance = np.zeros((code.shape[1], k, k))
    for _ in range(iterations):
        weight = post * counts[:, None]
        share = weight.sum(0) + 1
        logs = np.tile(np.log(share / share.sum()), (len(patterns), 1))
        for j in range(code.shape[1]):
            seen = pseudo * prior[j]
            np.add.at(seen, code[:, j], weight)
            some = code[:, j] < k
            logs[some] += np.log(seen / seen.sum(0))[code[some, j]]
            chance[j] = (seen[:k] / seen[:k].sum(0)).T
        post = np.exp(logs - logs.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
    return post, chance


KINDS_AND_NONE = "".join(str(k) for k in range(len(KINDS))) + "-"


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(feats: list[np.ndarray], target: np.ndarray, p: dict) -> np.ndarray:
    """Weights (features by kinds) by full-batch AdaGrad on the soft kinds."""
    size = np.array([len(f) for f in feats])
    flat, row = np.concatenate(feats), np.repeat(np.arange(len(feats)), size)
    cut = np.cumsum(size) - size
    w, seen = np.zeros((1 << p["bits"], target.shape[1])), np.full((1 << p["bits"], 1), 1e-6)
    for _ in range(p["epochs"]):
        gap = _softmax(np.add.reduceat(w[flat], cut, axis=0)) - target
        g = np.zeros_like(w)
        np.add.at(g, flat, gap[row])
        g = g / len(feats) + p["l2"] * w
        seen += (g * g).sum(1, keepdims=True)
        w -= p["rate"] * g / np.sqrt(seen)
    return w


def find(docs: DataFrame, **params) -> DataFrame:
    """doc_id, start, end, kind and score (four digits) of every span found private."""
    p = PARAMS | params
    spark = docs.sparkSession
    found = materialize(candidates(docs, p["bits"]), "spans")
    # a labeler has two to four votes and the context one for each kind, so patterns are bounded whatever the corpus
    grouped = found.groupBy("votes").agg(F.count("*").alias("n")).collect()
    none = spark.createDataFrame([], "doc_id bigint, start int, end int, kind string, score double")
    if not grouped:
        return none
    grouped = sorted(grouped, key=lambda r: r["votes"])
    post, _ = reliabilities([r["votes"] for r in grouped], np.array([r["n"] for r in grouped], float), p["iterations"], p["pseudo"])
    kind_of = {r["votes"]: q for r, q in zip(grouped, post)}
    chosen = found.select("votes", "features", F.xxhash64("doc_id", "start", "end").alias("o")).orderBy("o", "votes", "features").limit(p["max_train_spans"])

    def fit(batches):
        feats, target = [], []
        for b in batches:
            feats += [np.array(x, np.int64) for x in b.column("features").to_pylist()]
            target += [kind_of[v] for v in b.column("votes").to_pylist()]
        if feats:
            w = train(feats, np.array(target), p)
            yield pa.record_batch([pa.array([w.astype(np.float32).tobytes()])], ["w"])

    # one task trains; what travels is a matrix of fixed size
    weights = chosen.repartition(1).sortWithinPartitions("o", "votes", "features").select("votes", "features").mapInArrow(fit, "w binary").collect()[0]["w"]
    shared = spark.sparkContext.broadcast(np.frombuffer(weights, np.float32).reshape(-1, len(KINDS)))

    def decide(b):
        lists = b.column("features")
        size = np.diff(lists.offsets.to_numpy())
        if not len(size):
            return
        score = _softmax(np.add.reduceat(shared.value[lists.flatten().to_numpy()], np.cumsum(size) - size, axis=0).astype(np.float64))
        best = score.argmax(1)
        yield pa.record_batch(
            [*b.columns[:3], pa.array(np.array(KINDS, object)[best], pa.string()), pa.array(np.round(score[np.arange(len(best)), best], 4))],
            ["doc_id", "start", "end", "kind", "score"],
        ).filter(pa.array(best > 0))

    return map_arrow(found.select("doc_id", "start", "end", "features"), decide, none.schema.simpleString().removeprefix("struct<").removesuffix(">"))
