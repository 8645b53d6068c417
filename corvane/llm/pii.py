"""Personal data by anchor expansion.

One Aho-Corasick pass over each text finds anchors: at-signs, schemes, plus
signs, digits and identifier cues. Around each anchor a small deterministic
parser expands to the left and right and validates the boundaries. Nothing is
scanned by a general pattern, so the cost is one automaton pass plus work
proportional to the number of anchors.

Kinds with a fixed definition (``BASE_KINDS``): email, ip, card, phone. The
method adds ``url`` (scheme anchors) and ``account`` (values after identifier
cues such as ``password=`` or ``Token: "``, and access-key prefixes). After a cue
in any case come an optional quote, spaces, ``=`` or ``:``, spaces and the value.
A value in quotes is all between them; one without is a run of letters, digits,
``_`` and ``-``, and has a digit if it doesn't follow ``=`` at once. Spans are code
points, end exclusive.

Defined results: a null or empty text has no spans; repeated rows each get
their own result; spans of one kind never overlap; a text of any length is searched whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import bound_batches, plain

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

# The anchors of each parser.
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("password", "passwd", "pwd", "api_key", "apikey", "token", "secret", "account")
#: Key prefixes that belong to the identifier, with the length of a whole key.
KEY_PREFIXES = {"AKIA": 20, "ASIA": 20, "ghp_": 40, "sk-": 20}

SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_ID = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN = re.compile(r"[0-9.]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD_RUN = re.compile(r"[0-9][0-9 -]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_ASSIGNED = re.compile(r"[\"']?[ \t]*[:=][ \t]*")
_QUOTED = re.compile(r"([\"'`])([^\s\"'`]{4,})\1")
_PLAIN = re.compile(r"[\"'`]?([A-Za-z0-9_-]{4,})")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for word, kind in [("@", 0), ("+", 1), *((d, 2) for d in sorted(_DIGITS)), *((s, 3) for s in SCHEMES), *((c, 4) for c in ACCOUNT_CUES), *((p, 5) for p in KEY_PREFIXES)]:
        auto.add_word(word.lower(), (kind, word))
    auto.make_automaton()
    return auto


_AUTO = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _octets(text: str) -> bool:
    # stripped of zeros first: int() refuses absurdly long digit strings
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _lowered(text: str) -> str:
    """``text`` in lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def _value(text: str, at: int) -> tuple[int, int] | None:
    """The value that is assigned to a cue which ends at ``at``."""
    if not (sign := _ASSIGNED.match(text, at)):
        return None
    if m := _QUOTED.match(text, sign.end()):
        return m.span(2)
    if (m := _PLAIN.match(text, sign.end())) and (sign[0] == "=" or not _DIGITS.isdisjoint(m[1])):
        return m.span(1)
    return None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of ``text``, ordered by kind as listed in ``KINDS``, then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (kind, word) in _AUTO.iter(_lowered(text)):
        if kind == 2:  # a digit: an address run and a number run, each parsed once
            if last >= ip_end:
                start = last
                while start > ip_end and text[start - 1] == ".":
                    start -= 1
                run = _IP_RUN.match(text, start)
                ip_end = run.end()
                if ip_end - start >= 7:
                    found["ip"] += [m.span() for m in _IP.finditer(text, start, ip_end) if _octets(m[0])]
            if last >= card_end:
                run = _CARD_RUN.match(text, last)
                card_end = run.end()
                if card_end - last >= 13:
                    for m in _CARD.finditer(text, last, card_end):
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 13 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append(m.span())
        elif kind == 0:
            start = last
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                mail_end = m.end()
                found["email"].append((start, mail_end))
        elif kind == 1:
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == 3:
            start = last + 1 - len(word)
            if start >= url_end and text.startswith(word, start) and (start == 0 or not text[start - 1].isalnum()) and (m := _URL.match(text, last + 1)):
                end = m.end()
                while text[end - 1] in ".,;:!?)]" and end > last + 1:
                    end -= 1
                if end > last + 1:
                    url_end = end
                    found["url"].append((start, end))
        elif kind == 4:
            start = last + 1 - len(word)
            if start >= account_end and (start == 0 or not text[start - 1].isalnum()) and (span := _value(text, last + 1)):
                account_end = span[1]
                found["account"].append(span)
        else:
            start = last + 1 - len(word)
            if start >= account_end and text.startswith(word, start) and (start == 0 or text[start - 1] not in _ID):
                end = last + 1
                while end < len(text) and text[end] in _ID:
                    end += 1
                if end - start == KEY_PREFIXES[word] or (word == "sk-" and end - start > KEY_PREFIXES[word]):
                    account_end = end
                    found["account"].append((start, end))
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def redact(text: str | None) -> str | None:
    """Replace every span by its kind in angle brackets; overlapping spans are merged, the first kind names them."""
    if not text:
        return text
    out, at, until, name = [], 0, -1, ""
    for s, e, k in sorted((s, e, k) for k, s, e in find_spans(text)):
        if s < until:
            until = max(until, e)
            continue
        if name:
            out.append(f"<{name.upper()}>")
            at = until
        out.append(text[at:s])
        until, name = e, k
    if name:
        out.append(f"<{name.upper()}>")
        at = until
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@F.arrow_udf(SPAN_TYPE)
def _spans_udf(text: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py())] for t in text], _SPANS)


@F.arrow_udf(T.StringType())
def _redact_udf(text: pa.Array) -> pa.Array:
    return pa.array([redact(t.as_py()) for t in text], pa.string())


def spans(text: Column) -> Column:
    """Column of spans ``array<struct<kind,start,end>>``; a null text gives an empty array."""
    return _spans_udf(plain(text))


def redacted(text: Column) -> Column:
    """The text with each span replaced; null stays null."""
    return _redact_udf(plain(text))


def joined(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of these kinds, comma-joined in their order."""
    return F.array_join(F.transform(F.filter(found, lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the fixed kinds, a hash of their spans, and all spans joined."""
    bound_batches(docs.sparkSession)
    n = lambda k: F.size(F.filter("__spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select("doc_id", spans(F.col("text")).alias("__spans")).select(
        "doc_id", *map(n, BASE_KINDS), F.sha2(joined(F.col("__spans"), BASE_KINDS).cast("binary"), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans")
    )


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with spans replaced in ``text`` and ``n_chars`` brought up to date; every row stays."""
    bound_batches(docs.sparkSession)
    out = docs.withColumn("text", redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
