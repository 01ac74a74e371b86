"""Secret scans: patterns propose, and decoded structure confirms what patterns alone cannot.

Base kinds, leftmost and not overlapping within a kind: ``assign`` (a password-like name, ``:`` or ``=``, and a value of
at least 8 characters), ``access`` (``AKIA`` and 12 or more capitals or digits) and ``hex`` (32 or more digits). Base
matches are reported as they are. Candidates in base64 (16 characters or more, on one line or wrapped over several) or in
hex of either case (28 digits or more) are decoded and reported only if the bytes parse:

* ``jwt``  three dot-separated parts whose first ends in base64url JSON with an ``alg`` and whose second is JSON;
* ``key``  DER whose nested lengths add up to a private or public key (PKCS#1, PKCS#8, SEC 1, SPKI), or an OpenSSH key
  whose length-prefixed fields fill the bytes; within a PEM frame the lines are joined first, and a body whose headers
  say that it is encrypted is a key if it decodes to whole cipher blocks;
* ``nested``  printable text that itself holds any span, decoded as often as it takes: every layer is shorter than the last. If
  a run isn't such text as a whole, all its alignments (four of base64, two of hex) are read, and each stretch
  of printable ASCII in it that holds a span is reported where it stands; so what comes before the encoded text hides nothing.

DER nests at most 16 deep and has lengths of 4 bytes at most, which all key formats keep to. A caller's ``spans`` is replaced.

Offsets are code points, ends exclusive. No rows, null and empty texts have no spans. Repeated rows give repeated results. Whole
texts are read; plain substring tests skip the patterns of texts that cannot match, without changing a result.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm import common

KINDS = ("assign", "access", "hex", "jwt", "key", "nested")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_PARTS = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)(?=\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{28,}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = r"[\x20\t]*(?:\r?\n|\\r\\n|\\n)[\x20\t>#*]*"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+(?:{_BREAK}[A-Za-z0-9+/_-]+)+={{0,2}}")
_PIECE = re.compile(rf"(?:^|{_BREAK})([A-Za-z0-9+/_-]+={{0,2}})")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*(?:KEY|CERTIFICATE)-----((?:(?:\s|\\[nr])*[A-Za-z0-9-]+:\x20[^\n\\]*(?:\r?\n|\\r\\n|\\n))*)([A-Za-z0-9+/=\s\\]+)-----END [A-Z0-9 ]*-----")
_LEAST = 14  # characters of {"alg":""} in base64
_HEADER, _JSON = re.compile("(?=eyJ)"), json.JSONDecoder()
#: A readable part of decoded bytes: the shortest span of any kind has as many characters.
_STRETCH = re.compile(rb"[\t\r\n\x20-\x7e]{14,}")
_NAMES = ("passw", "secret", "token", "api")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The contract's three kinds."""
    out: list[Span] = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def unbase64(text: str) -> bytes | None:
    """Standard or URL-safe base64 with or without padding; null if it is neither."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, bytes, list]] | None:
    """The elements that fill ``data[at:end]`` exactly, with those nested in sequences; null if lengths do not add up."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if end - at < 2 or depth > 16:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > end:
                return None
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > end:
            return None
        inner = der(data, at, at + size, depth + 1) if tag & 0x20 else []
        if inner is None:
            return None
        out.append((tag, data[at : at + size], inner))
        at += size
    return out


def is_key(data: bytes) -> bool:
    """Whether the bytes are a key in a DER or OpenSSH encoding."""
    if data.startswith(b"openssh-key-v1\0"):
        return _fields(data[15:], least=2)
    if data[:4] == b"\0\0\0\x07" and data[4:11] in (b"ssh-rsa", b"ssh-dss") or data[:4] == b"\0\0\0\x0b" and data[4:15] == b"ssh-ed25519":
        return _fields(data, least=2, whole=True)
    if data[:1] != b"\x30":
        return False
    parts = der(data)
    if not parts or len(parts) != 1:
        return False
    inside = parts[0][2]
    tags = [t for t, _, _ in inside]
    pkcs1 = len(tags) >= 8 and all(t == 0x02 for t in tags[:9]) and inside[0][1] in (b"\0", b"\1")
    pkcs8 = tags[:3] == [0x02, 0x30, 0x04] and bool(inside[1][2]) and inside[1][2][0][0] == 0x06
    sec1 = tags[:2] == [0x02, 0x04] and inside[0][1] == b"\1"
    encrypted = tags == [0x30, 0x04] and bool(inside[0][2]) and inside[0][2][0][0] == 0x06
    spki = tags == [0x30, 0x03] and bool(inside[0][2]) and inside[0][2][0][0] == 0x06
    public1 = tags == [0x02, 0x02] and len(inside[0][1]) >= 64
    return pkcs1 or pkcs8 or sec1 or encrypted or spki or public1


def _fields(data: bytes, least: int, whole: bool = False) -> bool:
    at = count = 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            break
        at, count = at + 4 + size, count + 1
    return count >= least and (not whole or at == len(data))


class _Uncounted(str):
    """Text whose line breaks the JSON decoder does not count for each error: that would read the whole text each time."""

    def count(self, *_) -> int:
        return 0

    def rfind(self, *_) -> int:
        return 0


def token_start(head: str, body: str) -> int | None:
    """Where in ``head`` the header of a signed token begins that ends with it, the body being JSON; null if nowhere.

    The header is decoded once for each of the four alignments that its begin can have."""
    try:
        if not isinstance(json.loads(unbase64(body) or b""), dict):
            return None
    except (ValueError, RecursionError):
        return None
    decoded: dict[int, str | None] = {}
    for m in _HEADER.finditer(head):
        shift = m.start() % 4
        if shift not in decoded:
            data = unbase64(head[shift:])
            whole = data.decode("latin-1").rstrip(" \t\r\n") if data else ""
            decoded[shift] = _Uncounted(whole) if whole.endswith("}") else None
        if decoded[shift] is None:
            continue
        try:
            found, end = _JSON.raw_decode(decoded[shift], m.start() // 4 * 3)
        except (ValueError, RecursionError):
            continue
        if end == len(decoded[shift]) and isinstance(found, dict) and isinstance(found.get("alg"), str):
            return m.start()
    return None


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens: three parts at dots, each part read once."""
    past = 0
    for m in _PARTS.finditer(text):
        if m.start() >= past and len(m[1]) >= _LEAST and "eyJ" in m[1]:
            at = token_start(m[1], m[2])
            if at is not None:
                past = m.end(3)
                yield m.start() + at, past


def holds_secret(data: bytes) -> bool:
    """Whether decoded bytes are printable text with a span of any kind."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    return all(c.isprintable() or c in "\t\r\n" for c in text) and bool(spans(text))


def decoded_kinds(data: bytes | None) -> list[str]:
    """What decoded bytes are: ``key``, ``nested`` or neither."""
    return ["key"] * is_key(data) + ["nested"] * holds_secret(data) if data else []


def hidden(readings: list[tuple[int, bytes]], ratio: tuple[int, int], size: int) -> set[tuple[int, int]]:
    """Where in a candidate of ``size`` characters a printable stretch with a span stands.

    ``readings`` are the first character and the bytes of each way to align it; ``ratio`` is characters to bytes. Equal
    stretches are searched once."""
    known: dict[bytes, bool] = {}
    out = set()
    for first, data in readings:
        for m in _STRETCH.finditer(data):
            if m[0] not in known:
                known[m[0]] = bool(spans(m[0].decode()))
            if known[m[0]]:
                end = size if m.end() == len(data) else first - (-m.end() * ratio[0] // ratio[1])
                out.add((first + m.start() * ratio[0] // ratio[1], min(size, end)))
    return out


def alignments(run: str) -> list[tuple[int, bytes]]:
    """The bytes of a base64 run read from each of its first four characters."""
    body, out = run.rstrip("="), []
    for first in range(4):
        part = body[first:]
        data = unbase64(part[: len(part) - (len(part) % 4 == 1)])
        if data:
            out.append((first, data))
    return out


def is_encrypted(headers: str, data: bytes) -> bool:
    """Whether PEM headers say that the body is encrypted, and it is whole cipher blocks."""
    return "ENCRYPTED" in headers and "DEK-Info:" in headers and len(data) % 8 == 0


def wrapped_runs(pieces: list[str]) -> Iterator[tuple[int, int]]:
    """First and past last of the pieces that may be one wrapped text: equal lengths, but for the first and a shorter last."""
    at = 0
    while at < len(pieces):
        end = at + 1
        while end < len(pieces) and len(pieces[end]) == len(pieces[at]) and not pieces[end - 1].endswith("="):
            end += 1
        last = end < len(pieces) and len(pieces[end].rstrip("=")) <= len(pieces[at]) and not pieces[end - 1].endswith("=")
        for low in (at - 1, at) if at and not pieces[at - 1].endswith("=") else (at,):
            for high in (end + 1, end) if last else (end,):
                if high - low > 1:
                    yield low, high
        at = end


def spans(text: str) -> list[Span]:
    """All spans by start, then kind in the order of ``KINDS``."""
    out = base_spans(text)
    if "eyJ" in text:
        out += [("jwt", *span) for span in signed_tokens(text)]
    framed = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            framed.append(m.span())
            data = unbase64(re.sub(r"\\[nr]|\s", "", m[2]))
            if data and (is_key(data) or is_encrypted(m[1], data)):
                out.append(("key", *m.span()))
    for start, end in {m.span() for pattern in (_HEX, _ANY_HEX) for m in pattern.finditer(text)}:
        data = bytes.fromhex(text[start : end - (end - start) % 2])
        kinds = decoded_kinds(data)
        out += [(kind, start, end) for kind in kinds]
        if not kinds:
            other = bytes.fromhex(text[start + 1 : end - (end - start - 1) % 2])
            out += [("nested", start + a, start + b) for a, b in hidden([(0, data), (1, other)], (2, 1), end - start)]
    begins = [a for a, _ in framed]

    def within(at: int) -> bool:
        """Whether a place lies in a frame; frames follow one another."""
        frame = bisect.bisect_right(begins, at) - 1
        return frame >= 0 and at < framed[frame][1]

    for m in _BASE64.finditer(text):
        if not within(m.start()):
            kinds = decoded_kinds(unbase64(m[0]))
            out += [(kind, *m.span()) for kind in kinds]
            if not kinds:
                out += [("nested", m.start() + a, m.start() + b) for a, b in hidden(alignments(m[0]), (4, 3), len(m[0]))]
    if "\n" in text or "\\n" in text:
        for m in _WRAPPED.finditer(text):
            if within(m.start()):
                continue
            found = list(_PIECE.finditer(m[0]))
            pieces, past = [p[1] for p in found], 0
            for low, high in wrapped_runs(pieces):
                whole = "".join(pieces[low:high])
                if low < past or len(whole) < 16:
                    continue
                kinds = decoded_kinds(unbase64(whole))
                if kinds:
                    out += [(kind, m.start() + found[low].start(1), m.start() + found[high - 1].end(1)) for kind in kinds]
                    past = high
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``spans``: an array of (kind, start, end)."""
    docs = docs.drop("spans")
    kept = [f for f in docs.schema.fields if f.name.lower() != text.lower()]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = common.extended(type(docs.schema)(kept), spans="array<struct<kind: string, start: bigint, end: bigint>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, text):
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t)] if t else [] for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(found, kind)], [*(f.name for f in kept), "spans"])

    return docs.mapInArrow(run, schema)


