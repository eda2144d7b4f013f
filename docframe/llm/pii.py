"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docframe.llm.storage import add_columns

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Digits before a match can't begin one themselves, so that each run of digits is tried once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGITS = re.compile("[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")
#: What a confirmed pattern is worth, and words that raise (or, for other uses of such numbers, lower) it.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.4}
NEAR = {
    "email": re.compile(r"mail|contact|reply|write to"),
    "ip": re.compile(r"\bip\b|address|host|server|login"),
    "card": re.compile(r"card|visa|master|credit|debit|payment"),
    "phone": re.compile(r"phone|call|tel\b|mobile|fax|contact"),
    "iban": re.compile(r"iban|account|bank|transfer"),
    "national_id": re.compile(r"\bssn\b|social security|national id|tax id"),
}
FAR = re.compile(r"version|example|sample|invoice|order no|isbn|serial")
FIELD = "pii array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to both sides: one pass, however long a run before an @ is."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind, then start; those of a kind don't overlap."""
    for start, end in emails(text):
        yield "email", start, end
    if not DIGITS.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        found = m[0]
        while len(whole := found.replace(" ", "")) >= 15 and not mod97(whole):  # a word of capitals may follow
            found = found.rpartition(" ")[0]
        if len(whole) >= 15:
            yield "iban", m.start(), m.start() + len(found)
    for m in NATIONAL.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "national_id", m.start(), m.end()


def spans_of(text: str, threshold: float = 0.5, radius: int = 40) -> list[dict]:
    """Of the base kinds all confirmed spans, of the others those with a score of the threshold at least."""
    found = []
    for kind, start, end in proposals(text):
        around = (text[max(0, start - radius) : start] + " " + text[end : end + radius]).lower()
        score = min(1.0, max(0.0, START[kind] + 0.2 * bool(NEAR[kind].search(around)) - 0.2 * bool(FAR.search(around))))
        if kind in BASE_KINDS or score >= threshold:
            found.append({"kind": kind, "start": start, "end": end, "score": round(score, 2), "base": kind in BASE_KINDS})
    return found


def find_personal_data(docs: DataFrame, threshold: float = 0.5, radius: int = 40, carry: list[str] | None = None) -> DataFrame:
    """docs (of it, the columns in carry) with the array pii of spans {kind, start, end, score, base} in code points, end exclusive.

    Spans come by kind in the order of KINDS, then start. The base kinds
    (email, ip, card, phone) stay whatever their score; iban (mod-97) and
    national_id need the threshold, which nearby words help to reach. A null or
    empty text has no spans; time is in proportion to a text's length. A column
    pii of docs is replaced.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for text in batch.column("text"):
            yield (spans_of(text.as_py() or "", threshold, radius),)

    return add_columns(docs, FIELD, rows, carry)


def redact_text(text: str, threshold: float = 0.5, radius: int = 40) -> str:
    """The text with [KIND] in place of each span; of overlapping ones, the first to begin (then the longest) names it."""
    out, done = [], 0
    for x in sorted(spans_of(text, threshold, radius), key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= done:
            out += [text[done : x["start"]], f"[{x['kind'].upper()}]"]
        done = max(done, x["end"])
    return "".join(out) + text[done:]


def redact(docs: DataFrame, threshold: float = 0.5, radius: int = 40) -> DataFrame:
    """docs with personal data in text replaced by its kind; other columns, null texts and clean texts stay as they are."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for text in batch.column("text"):
            yield (None if text.as_py() is None else redact_text(text.as_py(), threshold, radius),)

    return add_columns(docs, "text string", rows).select(*[f"`{c}`" for c in docs.columns])
