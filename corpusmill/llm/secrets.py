"""Operator 3: secret scan.

Three steps inside each task, with no shuffle: an Aho-Corasick automaton finds keywords in every text; regular
expressions are tried only at those hits, anchored; tokens that carry a checksum are kept if it is right.
Runs of hexadecimal digits have no keyword: their prefilter looks at every eighth byte, as a run of 24 covers
three such bytes in a row, and the expression is tried only around such places.

Defined results: a null or empty text has no spans; long texts are scanned whole; repeated rows give repeated
results; an empty table gives an empty table; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from .common import pieces, texts_of

#: Kinds in the order in which spans are listed, the patterns of the first three, and their lengths.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
PATTERNS = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]{24,}"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"),
    "pem": re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----"),
}
JWT_PART = re.compile(rb"[A-Za-z0-9_-]*")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def base62_crc(body: bytes) -> bytes:
    """The CRC-32 of body in six base-62 digits, as issued tokens end."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit : digit + 1] + out
    return out


def _json_part(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def _der(body: bytes) -> bool:
    """The key block decodes to one ASN.1 sequence whose stated length is its own."""
    try:
        b = base64.b64decode(b"".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(b) < 2 or b[0] != 0x30:
        return False
    if b[1] < 0x80:
        return len(b) == 2 + b[1]
    n = b[1] & 0x7F
    return len(b) == 2 + n + int.from_bytes(b[2 : 2 + n], "big")


def valid(kind: str, m: re.Match) -> bool:
    """What follows a match: the length of the first kinds, the embedded checksum or structure of the others."""
    if kind == "assign":
        return len(m[1]) >= LEAST_VALUE
    if kind == "access":
        return len(m[0]) >= LEAST_ACCESS
    if kind in ("github", "npm"):
        body = m[0].partition(b"_")[2]
        return base62_crc(body[:-6]) == body[-6:]
    if kind == "jwt":
        head, claims, _ = m[0].split(b".")
        return _json_part(head) and _json_part(claims)
    return kind == "hex" or _der(m[2])


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def hex_places(text: bytes) -> list[tuple[int, int]]:
    """Where to look: from a place before which no near run of 24 digits begins, to the last at which one can begin.

    A run that begins after the sampled byte x - 1 has digits at the samples x to x + 2; neighbouring x are one place,
    whose first sample follows a byte that is no digit (or the text's start).
    """
    b = _HEX[np.frombuffer(text, np.uint8)[::8]]
    if len(b) < 3:
        return []
    hit = np.flatnonzero(b[:-2] & b[1:-1] & b[2:])
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)]
    return list(zip(np.maximum(0, first * 8 - 8).tolist(), (last * 8).tolist(), strict=True))


def find_spans(text: bytes, aho) -> list[tuple[int, int, str]]:
    """Valid spans in byte positions, by start and then kind; matches of a kind don't overlap."""
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in aho.iter(text.lower().decode("latin-1")):  # bytes.lower() changes A-Z only
        hits.setdefault(kind, []).append(end - n + 1)
    out = []
    for kind, starts in hits.items():
        free = bare = 0
        for at in sorted(starts):
            if at < max(free, bare):
                continue
            if m := PATTERNS[kind].match(text, at):
                free = m.end()
                if valid(kind, m):
                    out.append((m.start(), m.end(), kind))
            elif kind == "jwt" and text.startswith(b"eyJ", at):
                bare = JWT_PART.match(text, at).end()  # what failed after this run fails for every hit inside it
    m = None
    for at, last in hex_places(text):
        # the next match is kept from place to place, so no part of a text is searched twice
        if m is None or m.start() < at:
            m = PATTERNS["hex"].search(text, at)
        while m and m.start() <= last:
            out.append((m.start(), m.end(), "hex"))
            m = PATTERNS["hex"].search(text, m.end())
        if m is None:
            break
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2])))


def in_code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not spans or text.isascii():
        return spans
    points, done, n = {}, 0, 0
    for p in sorted({p for s in spans for p in s[:2]}):
        n += len(text[done:p].decode())
        points[p], done = n, p
    return [(points[a], points[b], k) for a, b, k in spans]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id, and spans as array of (start, end, kind) in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aho = automaton()
        for batch in pieces(batches):
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in in_code_points(t, find_spans(t, aho))] for t in texts_of(batch.column(1))]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], [id_col, "spans"])

    narrow = df.select(id_col, text_col)
    return narrow.mapInArrow(run, T.StructType([narrow.schema[0], T.StructField("spans", SPAN)]))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Ids and texts with each found span (overlapping ones joined) replaced by mask; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aho = automaton()
        for batch in pieces(batches):
            out: list[str | None] = []
            for t in batch.column(1).to_pylist():
                if t is None:
                    out.append(None)
                    continue
                b, at, kept = t.encode(), 0, []
                for start, end, _ in find_spans(b, aho):
                    if start >= at:
                        kept += [b[at:start], mask.encode()]
                    at = max(at, end)
                out.append(b"".join([*kept, b[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, text_col])

    narrow = df.select(id_col, text_col)
    return narrow.mapInArrow(run, T.StructType([narrow.schema[0], T.StructField(text_col, T.StringType())]))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of the spans, made from the operator's spans in SQL."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = "cast(size(filter(spans, s -> s.kind = '{0}')) as long) as n_{0}"
    return found.selectExpr(
        "doc_id", *(count.format(k) for k in KINDS[:3]),
        f"sha2({joined.format('filter(spans, s -> s.kind in (' + repr(KINDS[0]) + ',' + repr(KINDS[1]) + ',' + repr(KINDS[2]) + '))')}, 256) as base_sha256",
        f"{joined.format('spans')} as spans",
    )


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The first three kinds by plain expressions over the whole text; for tests."""
    spans, text = [], text or ""
    for kind, p in (("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(p, text):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                spans.append((m.start(), KINDS.index(kind), m.end()))
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()
