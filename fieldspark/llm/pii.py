"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Nulls and empty texts give no spans; any other column is left alone. Offsets count code points, ends are exclusive.
Ties (two kinds at one start) are kept, in the order of ``KINDS``. Every function is linear in the text, so very
long texts need no cut.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from . import spans as S

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "mac")

#: What must follow a run of local-part characters.
_EMAIL_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])")

#: Base scores and the words that raise or lower them within CONTEXT code points (fixed values of this operator).
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.5, "mac": 0.6}
CONTEXT = 48
RAISE = {
    "email": ("mail", "email", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "fax", "contact"), "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social", "security"), "mac": ("mac", "device", "address"),
}
LOWER = {"ip": ("version", "release"), "card": ("order", "serial", "isbn", "tracking"), "phone": ("isbn", "order"), "ssn": ("order", "part", "serial")}
_WORD = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost matches: a match starts where the run of local-part characters before its @ does, or where the last match ended."""
    end = 0
    at = text.find("@")
    while at >= 0:
        m = _EMAIL_AT.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
                at = text.find("@", end)
                continue
        at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _candidates(text: str):
    if "@" in text:
        yield from (("email", a, b, None) for a, b in _emails(text))
    for m in _IP.finditer(text):
        # leading zeros may make a part long; int() of a long run is refused by Python, so strip them first
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end(), None
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            yield "card", m.start(), m.end(), "luhn"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end(), None
    for m in _IBAN.finditer(text):
        own = m[0].replace(" ", "")
        # a word after the number may have been taken in: the longest prefix by whole groups that the checksum confirms
        end = m.end()
        while len(own) >= 15 and not mod97(own):
            cut = text.rfind(" ", m.start(), end)
            if cut < 0:
                break
            end = cut
            own = text[m.start() : end].replace(" ", "")
        if 15 <= len(own) <= 34 and mod97(own):
            yield "iban", m.start(), end, "mod97"
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end(), None
    for m in _MAC.finditer(text):
        yield "mac", m.start(), m.end(), None


def _near(text: str, a: int, b: int) -> set[str]:
    """The words that lie whole within CONTEXT code points of a span, those in s also without it."""
    words: set[str] = set()
    for lo, hi in ((max(0, a - CONTEXT), a), (b, min(len(text), b + CONTEXT))):
        for m in _WORD.finditer(text, lo, hi):
            if not (m.start() == lo > 0 and text[lo - 1].isalnum() or m.end() == hi < len(text) and text[hi].isalnum()):
                w = m[0].lower()
                words.add(w)
                words.add(w.removesuffix("s"))
    return words


def find_spans(text: str, floor: float = 0.0) -> list[dict]:
    """All confirmed spans with scores, which the words nearby adjust; kinds beyond the base need a score of at least ``floor``."""
    out = []
    for kind, a, b, detail in _candidates(text):
        near = _near(text, a, b)
        score = PRIOR[kind] + 0.1 * (not near.isdisjoint(RAISE[kind])) - 0.2 * (not near.isdisjoint(LOWER.get(kind, ())))
        if kind in BASE or score >= floor:
            out.append({"kind": kind, "start": a, "end": b, "score": round(min(1.0, max(0.0, score)), 4), "base": kind in BASE, "detail": detail})
    return out


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the array ``out`` of (kind, start, end, score, base, detail)."""
    return S.find(docs, find_spans, text, out)


def pii_digests(docs: DataFrame) -> DataFrame:
    return S.digests(docs, find_spans, KINDS, BASE)
