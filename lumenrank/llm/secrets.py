"""Secret scan: keyword prefilter, anchored expressions near hits, checksums.

An Aho-Corasick automaton finds every keyword of all kinds in one walk over the text
(ASCII letters lowered, so places stay the same).  Only there a kind's expression is
tried, anchored at the keyword; since each kind's match starts with one of its keywords,
taking hits from left to right and skipping those inside the last match gives just the
leftmost non-overlapping matches.  A kind whose match may be long remembers how far a failed
attempt has read, so a text is read a bounded number of times whatever it repeats.  Hex runs have no keyword; they are runs of a byte
class.  Token formats that carry a checksum are reported only if it holds.

Kinds, as listed: assign, access, hex (the base), then github and npm (36 letters and
digits of which the last six are the CRC-32 of the rest in base 62), jwt (its header
must decode to JSON with "alg"), pem (a private key block).

Defined results: null text is empty and has no spans; places are code points, the end
exclusive; a failing match still uses up its characters; repeated rows give a row each.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import documents, read

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
MASK = "[SECRET]"
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ANCHORED = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
}
# What a failed attempt has already read: a later start inside it fails the same way.
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
_PEM_RUN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*")
_READ = {"jwt": _JWT_RUN, "pem": _PEM_RUN}
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
             "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github",
             "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin ": "pem"}


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def _checksum(body: str, tail: str) -> bool:
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = _BASE62[d] + digits
    return digits.rjust(6, "0") == tail


def _json_header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):    # no JSON, or nested deeper than any header
        return False
    return isinstance(head, dict) and "alg" in head


def _holds(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(2) - m.start(2) >= 12
    if kind == "access":
        return m.end() - m.start() >= 18
    if kind in ("github", "npm"):
        return _checksum(m[1], m[2])
    return kind != "jwt" or _json_header(m[1])


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        a.add_word(word, (KINDS.index(kind), len(word)))
    a.make_automaton()
    return a


def scan(text: str) -> list[Span]:
    """All spans of a text, by start, then kind as listed."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found, reached = [], [0] * len(KINDS)
    for last, (kind, size) in sorted(_automaton().iter(lowered), key=lambda x: x[0] - x[1][1]):
        start = last - size + 1
        if start < reached[kind]:
            continue
        name = KINDS[kind]
        if m := _ANCHORED[name].match(text, start):
            reached[kind] = m.end()
            if _holds(name, m):
                found.append(Span(start, kind, m.end()))
        elif name in _READ and (m := _READ[name].match(text, start)):
            reached[kind] = m.end()
    found += [Span(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def redact(text: str, spans: list[Span], mask: str = MASK) -> str:
    """The text with each run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at:s.start], mask]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if out else text


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 500):
            part = batch.slice(i, 500)
            spans = [scan(x or "") for x in part.column("text").to_pylist()]
            base = [[s for s in x if s.kind < 3] for x in spans]
            counts = [pa.array([sum(s.kind == k for s in x) for x in base], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *counts,
                 pa.array([hashlib.sha256(_listed(x).encode()).hexdigest() for x in base], pa.string()),
                 pa.array([_listed(x) for x in spans], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for i in range(0, len(batch), 500):
            part = batch.slice(i, 500)
            texts = [x if x is None else redact(x, scan(x)) for x in part.column(at).to_pylist()]
            yield part.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with its spans."""
    return documents(docs).mapInArrow(
        _scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span masked; n_chars, if there, follows the text."""
    out = docs.mapInArrow(_redact_batches, docs.schema)
    if "n_chars" in docs.columns:
        changed = F.coalesce(F.length("text"), F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return find_secrets(read(spark, sf_dir, "documents"))
