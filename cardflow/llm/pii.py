"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Spans are (start, end) in code points, end exclusive. The base kinds are always reported; the kinds that
the method adds (`iban`, `ssn`) are reported once their score reaches `MIN_SCORE`. Null and empty
texts have no spans. Every search takes time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cardflow.llm.common import extend

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
MIN_SCORE = 0.6
# Characters on either side of a span in which context words count.
REACH = 48
# Score of a pattern alone, and what a passed validator adds. A context word adds CONTEXT.
PATTERN = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.3}
VALID = {"email": 0.0, "ip": 0.1, "card": 0.4, "phone": 0.1, "iban": 0.5, "ssn": 0.1}
CONTEXT = 0.2
# Words near a span that speak for its kind.
WORDS = {
    "email": ("mail", "contact", "write to", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
NEAR = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(words) + r")", re.IGNORECASE) for kind, words in WORDS.items()}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive runs: a shorter run never matches where the whole run does not.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


class Span(NamedTuple):
    start: int
    rank: int
    end: int
    score: float

    def __str__(self) -> str:
        return f"{KINDS[self.rank]}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digits of the results summed: a multiple of ten."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """First four characters moved to the end, letters as 10 to 35: remainder 1 by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From every @ back over the local part and on over the domain."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        at = text.find("@", max(floor, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest reading that passes mod-97, given up group by group from the right."""
    for m in IBAN.finditer(text):
        end = m.end()
        while end - m.start() >= 15:
            account = text[m.start() : end].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)
            if end < 0:
                break


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def find_spans(text: str) -> list[Span]:
    """All spans by start, then kind."""
    spans = []
    for rank, kind in enumerate(KINDS):
        for start, end in FINDERS[kind](text):
            near = f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}"
            score = PATTERN[kind] + VALID[kind] + CONTEXT * bool(NEAR[kind].search(near))
            if kind in BASE_KINDS or score >= MIN_SCORE:
                spans.append(Span(start, rank, end, min(1.0, score)))
    return sorted(spans)


def _columns(texts: pa.Array) -> list[pa.Array]:
    counts: list[list[int]] = [[] for _ in BASE_KINDS]
    hashes, joined, scores = [], [], []
    for text in texts.to_pylist():
        spans = find_spans(text or "")
        base = [s for s in spans if s.rank < len(BASE_KINDS)]
        for rank, count in enumerate(counts):
            count.append(sum(s.rank == rank for s in base))
        hashes.append(hashlib.sha256(",".join(map(str, base)).encode()).hexdigest())
        joined.append(",".join(map(str, spans)))
        scores.append(",".join(f"{s.score:.2f}" for s in spans))
    return [*(pa.array(c, pa.int64()) for c in counts), *(pa.array(x, pa.string()) for x in (hashes, joined, scores))]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id with counts, a digest of the base spans, all spans and their scores (0 to 1), one row per row."""
    names = [f"n_{kind}" for kind in BASE_KINDS]
    fields = [T.StructField(n, T.LongType()) for n in names]
    fields += [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans", "scores")]
    return extend(docs.select("doc_id", "text"), fields, _columns).drop("text")
