"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, contact
schemes and identifier cues.  At each anchor a deterministic parser expands to the left and
right and validates what it has found.  The cost is linear in the text.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

#: Order of kinds at the same start.  The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "contact", "iban", "ssn", "account")
BASE = KINDS[:4]

#: Schemes and identifier cues; upper and lower case are the same.
CUES = {"mailto:": "contact", "tel:": "contact", "sip:": "contact", "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]+")
_LABEL = r"(?ai: (?:no|nr|number|code))?\.?[ :#=]{0,3}"
_AFTER = {
    "contact": re.compile(r"(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+?[0-9][0-9().-]{5,18}[0-9])"),
    "iban": re.compile(_LABEL + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.A),
    "ssn": re.compile(_LABEL + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "account": re.compile(_LABEL + r"([0-9]{6,17})(?![0-9A-Za-z])"),
}


_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    """text in lower case with as many characters; no cue depends on letters beyond A to Z."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for c in "@+0123456789":
        auto.add_word(c, (c if c in "@+" else "0", 1))
    for cue, kind in CUES.items():
        auto.add_word(cue, (kind, len(cue)))
    auto.make_automaton()
    return auto


_AUTO = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed in KINDS."""
    found = []
    mail = ip = card = phone = run = 0  # where the next match of each kind, and the next run of digits, may start
    for at, (what, width) in _AUTO.iter(_lower(text)):
        if what == "0":
            if at < run:
                continue
            run = at + 1
            while run < len(text) and "0" <= text[run] <= "9":
                run += 1
            if at >= ip and run < len(text) and text[run] == "." and (m := _IP.match(text, at)):
                ip = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append((at, ip, "ip"))
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                if 14 <= len(digits := _NON_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                    found.append((at, card, "card"))
        elif what == "@":
            start = at
            while start > mail and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                mail = m.end()
                found.append((start, mail, "email"))
        elif what == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 10 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                    found.append((at, phone, "phone"))
        else:
            start = at - width + 1
            if start and text[start - 1].isalnum():
                continue
            if what == "contact":
                if m := _AFTER[what].match(text, at + 1):
                    found.append((start, m.end(), what))
            elif (m := _AFTER[what].match(text, at + 1)) and (what != "iban" or _iban(m[1])):
                found.append((*m.span(1), what))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans) -> str:
    """text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"<{k.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


@tidy
def _scan(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = find(text or "")
            base = [s for s in spans if s[2] in BASE]
            rows.append([*(sum(s[2] == k for s in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts of the base kinds, their digest, all spans.

    Beside the base kinds: `contact` (mailto:, tel:, sip: and their target), and after a cue
    `iban` (checked mod 97), `ssn` and `account`.  A null text is empty: counts are 0, spans
    is "" and the digest that of the empty string.  Repeated rows give repeated rows; doc_id
    may be null.  Only doc_id and text are read.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, _SCHEMA)


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with all personal data in `text` replaced by its kind, and `length` brought up to date.

    Texts without personal data, null texts, other columns, the order of columns and the
    number of rows stay as they are.
    """
    names, schema = docs.columns, docs.schema

    @tidy
    def run(batches):
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            new = [redact(t, s) if t and (s := find(t)) else t for t in texts]
            columns = list(batch.columns)
            columns[names.index(text)] = pa.array(new, pa.string())
            if length in names:
                old, at = batch.column(names.index(length)), names.index(length)
                columns[at] = pa.array([o if a is b or a == b else len(b) for o, a, b in zip(old.to_pylist(), texts, new, strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


