"""Secrets: patterns propose, structure confirms.

Base spans (assignments, access keys, long hex) stay as they are. Beyond them, base64 and hex candidates (hex in either
case, base64 in either alphabet, in one run or wrapped over lines) are decoded and reported only if what they hold parses
as a private key or a signed token:

- ``der``: PKCS#1, DSA, SEC1, PKCS#8 or encrypted PKCS#8, by the fields of its sequence, with lengths that nest exactly.
  Certificates and public keys parse as well, but hold no secret and give nothing.
- ``ssh``: the container of OpenSSH's private keys, whose nested lengths fill the blob. Public key lines give nothing.
- ``pem``: such a body in armour whose label says PRIVATE KEY, with or without encryption headers. A body that the headers
  call encrypted cannot be parsed; there the label, the headers and whole base64 blocks confirm it.
- ``jwt``: three dotted parts whose first is a JSON header that names an algorithm.

Candidates have 24 hex digits or more, 40 base64 characters or more in one run, a PEM label of up to 40 characters and a
token header of 14 characters or more (the shortest there is); shorter ones cannot hold a key. Confirmed hex adds a span
of its kind beside the base one. Null and empty texts give nothing; texts of any length are taken whole; offsets count
code points, ends are exclusive. Of candidates that overlap the first of the order pem, jwt, wrapped, hex, base64 counts.
Repeated rows give equal spans and an empty table none. Columns of any name may stand beside the id and the text; one
named like ``out`` is replaced.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

from pyspark.sql import DataFrame

from . import spans as S

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "jwt", "der", "ssh")

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,5}PRIVATE KEY(?: BLOCK)?)-----((?:[A-Za-z0-9+/=\s]|[A-Za-z-]+: [^\n]*\n){16,}?)-----END \1-----")
_PEM_HEADER = re.compile(r"(?m)^\s*([A-Za-z-]+): ([^\n]*)\n")
#: Three dotted parts; the shortest header, with an empty algorithm, takes 14 characters. Parts may start a token each, so only the header is taken in.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)(?=\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+))")
_B64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_URL64 = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}={0,2}")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}")
#: Runs over two lines or more; a DER sequence starts with M, OpenSSH's container with its name.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M|b3Bl)[A-Za-z0-9+/_-]*+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
_SSH_MAGIC = b"openssh-key-v1\0"


def _b64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode((text.translate(str.maketrans("-_", "+/")) if url else text) + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def nested_der(data: bytes, depth: int = 0) -> bool:
    """Whether the bytes are DER elements that fill them exactly, down through every constructed one."""
    at = 0
    while at < len(data):
        if len(data) - at < 2:
            return False
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return False
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if tag & 0x1F == 0x1F or at + n > len(data):
            return False
        if tag & 0x20 and (depth > 16 or not nested_der(data[at : at + n], depth + 1)):
            return False
        at += n
    return True


def _elements(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, body) of the elements one after another; ``data`` nests, so lengths are right."""
    out, at = [], 0
    while at < len(data):
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        out.append((tag, data[at : at + n]))
        at += n
    return out


_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _algorithm(body: bytes) -> bool:
    own = _elements(body)
    return bool(own) and own[0][0] == _OID and len(own[0][1]) >= 3


def der_key(data: bytes) -> bool:
    """A private key: a SEQUENCE that fills the bytes, nests exactly and has the fields of one of the known forms."""
    if len(data) < 16 or data[0] != _SEQUENCE or not nested_der(data):
        return False
    whole = _elements(data)
    if len(whole) != 1:
        return False
    own = _elements(whole[0][1])
    tags = [t for t, _ in own]
    if tags[:2] == [_SEQUENCE, _OCTETS] and len(own) == 2:  # encrypted PKCS#8; a public key has a BIT STRING there
        return _algorithm(own[0][1]) and len(own[1][1]) >= 8
    if not tags or tags[0] != _INTEGER or own[0][1] not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [_SEQUENCE, _OCTETS]:  # PKCS#8
        return _algorithm(own[1][1])
    if tags[1:2] == [_OCTETS]:  # SEC1
        return own[0][1] == b"\1" and len(own[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    # PKCS#1 has version, n, e, d, p, q and three more; DSA version, p, q, g, y, x
    return all(t == _INTEGER for t in tags[:6]) and len(own) in (6, 9, 10) and len(own[1][1]) >= 8


def _string(data: bytes, at: int) -> int:
    """The end of the wire string at ``at``, -1 if there is none."""
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return end if at + 4 <= end <= len(data) and at + 4 <= len(data) else -1


def ssh_size(data: bytes) -> int:
    """How many bytes the private container takes at the front of ``data``, 0 if it is none: three names, the public keys, and the private part."""
    if not data.startswith(_SSH_MAGIC):
        return 0
    at = len(_SSH_MAGIC)
    for _ in range(3):
        at = _string(data, at)
        if at < 0:
            return 0
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return 0
    for _ in range(count + 1):
        at = _string(data, at)
        if at < 0:
            return 0
    return at


def ssh_key(data: bytes) -> bool:
    """OpenSSH's private container, whose lengths fill the blob."""
    return 0 < ssh_size(data) == len(data)


def token_header(part: str) -> str | None:
    """The algorithm that a signed token's header names."""
    raw = _b64(part, url=True)
    try:
        head = json.loads(raw) if raw and raw.lstrip()[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return head["alg"] if isinstance(head, dict) and isinstance(head.get("alg"), str) else None


def _wrapped(text: str):
    """(kind, start, end) of keys wrapped over lines: from a line's start as far as the key's own lengths say, if a line ends there."""
    for m in _WRAPPED.finditer(text):
        pieces = [(p.start(), p.end()) for p in _PIECE.finditer(text, m.start(), m.end())]
        joined = "".join(text[a:b] for a, b in pieces)
        place, ends = 0, {}  # in ``joined``, of each line's end
        for k, (a, b) in enumerate(pieces):
            place += b - a
            ends[place] = k
        place, after = 0, 0
        for a, b in pieces:
            at, place = place, place + b - a
            if at < after:
                continue
            size, kind = 0, ""
            if joined[at] == "M":
                head = _b64(joined[at : at + 8], url=True) or b""
                if len(head) == 6 and head[0] == 0x30:
                    k = head[1] & 0x7F if head[1] & 0x80 else 0
                    size, kind = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1]) if k <= 4 else 0, "der"
            elif joined.startswith("b3Bl", at):
                rest = joined[at:]
                rest = rest[: len(rest) - (len(rest) % 4 == 1)]
                size, kind = ssh_size(_b64(rest, url=True) or b""), "ssh"
            end = at + -(-size * 4 // 3)
            if size and end in ends and end > place:
                raw = _b64(joined[at:end], url=True)
                if raw and (der_key(raw) if kind == "der" else ssh_key(raw)):
                    stop = pieces[ends[end]][1]
                    while stop < len(text) and text[stop] == "=" and (end - at + stop - pieces[ends[end]][1]) % 4:
                        stop += 1
                    yield kind, a, stop
                    after = end


class _Taken:
    """Spans that are taken: they don't overlap, so the one before a place tells."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)

    def free(self, a: int) -> bool:
        i = bisect.bisect_right(self.starts, a) - 1
        return i < 0 or a >= self.ends[i]


def _armoured(body: str) -> bool:
    """Whether a PEM body holds a private key; one that its headers call encrypted need only be whole blocks of base64."""
    headers = dict(_PEM_HEADER.findall(body))
    raw = _b64("".join(_PEM_HEADER.sub("", body).split()))
    if not raw:
        return False
    if "ENCRYPTED" in headers.get("Proc-Type", "") and "DEK-Info" in headers:
        return len(raw) >= 32 and len(raw) % 8 == 0
    return der_key(raw) or ssh_key(raw)


def find_spans(text: str) -> list[dict]:
    out = []

    def add(kind: str, a: int, b: int, score: float, detail: str | None = None):
        out.append({"kind": kind, "start": a, "end": b, "score": score, "base": kind in BASE, "detail": detail})

    if _KEYWORD.search(text):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                add("assign", m.start(), m.end(), 0.6, m[1].lower())
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            add("access", m.start(), m.end(), 0.9)
    taken = _Taken()
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if _armoured(m[2]):
                add("pem", m.start(), m.end(), 0.99, m[1].lower())
                taken.add(m.start(), m.end())
    if "." in text:
        end = 0
        for m in _JWT.finditer(text):
            if m.start() >= end and (alg := token_header(m[1])):
                end = m.end(3)
                add("jwt", m.start(), end, 0.99 if m[3] else 0.7, alg)
                if taken.free(m.start()):
                    taken.add(m.start(), end)

    def confirm(a: int, b: int, raw: bytes | None) -> bool:
        if raw and taken.free(a) and (kind := "der" if der_key(raw) else "ssh" if ssh_key(raw) else None):
            add(kind, a, b, 0.95)
            taken.add(a, b)
            return True
        return False

    if "\n" in text:
        for kind, a, b in _wrapped(text):
            if taken.free(a):
                add(kind, a, b, 0.95)
                taken.add(a, b)
    for m in _ANY_HEX.finditer(text):
        confirm(m.start(), m.end(), bytes.fromhex(m[0][: len(m[0]) // 2 * 2]))
    for m in _HEX.finditer(text):
        raw = bytes.fromhex(m[0][: len(m[0]) // 2 * 2])
        confirmed = der_key(raw) or ssh_key(raw)
        add("hex", m.start(), m.end(), 0.95 if confirmed else 0.4, "key" if confirmed else None)
    for m in _B64.finditer(text):
        confirm(m.start(), m.end(), _b64(m[0]))
    for m in _URL64.finditer(text):
        if "-" in m[0] or "_" in m[0]:
            confirm(m.start(), m.end(), _b64(m[0], url=True))
    return out


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the array ``out`` of (kind, start, end, score, base, detail)."""
    return S.find(docs, find_spans, text, out)


def secret_digests(docs: DataFrame) -> DataFrame:
    return S.digests(docs, find_spans, KINDS, BASE)
