"""Secret scanning: an Aho-Corasick keyword prefilter, anchored expressions only near its hits, checksum validation.

Base kinds: `assign`, `access`, `hex`.  Runs of hexadecimal digits have no keyword, so their prefilter searches the text
mapped to character classes for 24 class symbols in a row.  Added kinds: `github` and `npm` tokens, whose last six
characters must be the base-62 CRC-32 of the thirty before them; `jwt`, whose header must decode to JSON with an "alg";
`pem`, a private key block whose body must be base64 of a DER sequence with a fitting length.

Defined cases: a null or empty text has no spans; repeated rows give repeated rows.  Spans are in code points, end
exclusive, and every kind is leftmost and non-overlapping in itself.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from larchspan.llm.common import id_and_text, rows

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
#: Keywords of the prefilter and the kind that each leads to.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin ": "pem"}
#: The patterns, each tried only where a keyword begins.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN ([A-Z ]*+(?<=PRIVATE KEY))-----([A-Za-z0-9+/=\s]++)-----END \1-----")
HEX = re.compile(rb"[0-9a-f]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_CLASS = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


@cache
def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def base62_crc(body: bytes) -> str:
    """CRC-32 as six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _jwt_ok(header: bytes) -> bool:
    try:
        got = json.loads(base64.urlsafe_b64decode(header + b"=" * (-len(header) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(got, dict) and "alg" in got


def _pem_ok(body: bytes) -> bool:
    try:
        der = base64.b64decode(b"".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(der) < 16 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == der[1] + 2
    k = der[1] & 0x7F
    return 0 < k <= 4 and len(der) == 2 + k + int.from_bytes(der[2 : 2 + k], "big")


def _try(kind: str, text: bytes, at: int) -> tuple[int, bool] | None:
    """Where a match that begins at `at` ends, and whether it is valid; None if nothing matches there."""
    if kind == "assign":
        m = ASSIGN.match(text, at)
        return m and (m.end(), m.end(2) - m.start(2) >= 6)
    if kind == "access":
        m = ACCESS.match(text, at)
        return m and (m.end(), m.end() - at >= 20)
    if kind in ("github", "npm"):
        m = (GITHUB if kind == "github" else NPM).match(text, at)
        return m and (m.end(), base62_crc(m[1]) == m[2].decode())
    if kind == "jwt":
        m = JWT.match(text, at)
        return m and (m.end(), _jwt_ok(m[1]))
    m = PEM.match(text, at)
    return m and (m.end(), _pem_ok(m[2]))


def spans(text: bytes) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a UTF-8 text, in code points, by start, then kind as listed."""
    plain = text if text.isascii() else re.sub(rb"[\x80-\xff]", b"\x80", text)
    hits = sorted((end - length + 1, kind) for end, (length, kind) in automaton().iter(plain.lower().decode("latin-1")))
    found: list[tuple[int, int, str]] = []
    past = dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at >= past[kind] and (m := _try(kind, text, at)):
            past[kind] = m[0]
            if m[1]:
                found.append((at, m[0], kind))
    classes = text.translate(_HEX_CLASS)
    at = classes.find(b"h" * 24)
    while at >= 0:
        end = HEX.match(text, at).end()
        found.append((at, end, "hex"))
        at = classes.find(b"h" * 24, end)
    if found and not text.isascii():
        marks = sorted({x for s, e, _ in found for x in (s, e)})
        points, last, n = {}, 0, 0
        for m in marks:
            n += len(text[last:m].decode("utf-8", "replace"))
            points[m], last = n, m
        found = [(points[s], points[e], k) for s, e, k in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base counts, the digest of the base spans and all spans; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches):
            out = [spans(t or b"") for t in texts]
            base = [[x for x in f if x[2] in BASE] for f in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64())]
                + [pa.array([sum(x[2] == k for x in b) for b in base], pa.int64()) for k in BASE]
                + [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(f) for f in out], pa.string()), pa.array([len(f) - len(b) for f, b in zip(out, base, strict=True)], pa.int64())],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
