"""Personal data by anchor expansion: an automaton finds anchors, local parsers expand and check what stands around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import documents, pieces, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
#: Spans of these kinds are added to the base ones.
ADDED_KINDS = ("iban", "ssn", "account", "userinfo")
KINDS = BASE_KINDS + ADDED_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Identifier cues, lower case, with the parser that reads what follows them.
CUES = {
    "iban": "iban", "ssn": "ssn", "social security": "ssn", "account number": "account", "account no": "account",
    "acct": "account", "passport": "account", "kontonummer": "account", "numéro de compte": "account", "número de cuenta": "account",
}
_GAP = re.compile(r"[\x20\t]*(?:(?:number|no|nr|#)\b\.?)?[\x20\t]*[:=#.]?[\x20\t]*", re.ASCII | re.IGNORECASE)
_SSN = re.compile(r"[0-9]{3}([- ]?)[0-9]{2}\1[0-9]{4}(?![0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?=[A-Z]{0,2}[0-9])[A-Z0-9](?:[\x20-]?[A-Z0-9]){5,19}(?![A-Za-z0-9])")
_USERINFO = re.compile(r"[A-Za-z0-9._%+~-]+:[^\x20\t\r\n/@\"'<>]+@[A-Za-z0-9][A-Za-z0-9.-]*")


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *"0123456789"):
        found.add_word(anchor, (anchor if not anchor.isdigit() else "0", len(anchor)))
    for cue in CUES:
        found.add_word(cue, (CUES[cue], len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in reversed(digits)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(doubled)) % 10 == 0


def iban_holds(text: str) -> bool:
    plain = text.replace(" ", "")
    return len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _lowered(text: str) -> str:
    """Lower case without moving any position: a character whose lower case has another length stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans_in(text: str, automaton) -> list[tuple[str, int, int]]:
    """Spans of one text by kind, then start; every parser looks only at the characters around its anchor.

    ``done`` holds where the last candidate of each base kind ended, kept or not: candidates never overlap within a kind and
    a failing one isn't retried.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (anchor, length) in automaton.iter(_lowered(text)):
        at = last - length + 1
        if anchor == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                found["email"].append((start, m.end()))
                done["email"] = m.end()
        elif anchor == "0":
            if at >= done["ip"]:
                if m := _IP.match(text, at):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                        found["ip"].append(m.span())
                    done["ip"] = m.end()
                else:  # no start within this run of digits does better
                    done["ip"] = _run_end(text, at)
            if at >= done["card"]:
                if m := _CARD.match(text, at):
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
                    done["card"] = m.end()
        elif anchor == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    found["phone"].append(m.span())
                done["phone"] = m.end()
        elif anchor == "://":
            if (m := _USERINFO.match(text, last + 1)) and m.start() >= done["userinfo"]:
                found["userinfo"].append(m.span())
                done["userinfo"] = m.end()
        else:
            before = text[at - 1] if at else " "
            m = None if before.isalnum() else _GAP.match(text, last + 1)
            pattern = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT}[anchor]
            m = m and pattern.match(text, m.end())
            if m and m.start() >= done[anchor] and (anchor != "iban" or iban_holds(m.group())):
                found[anchor].append(m.span())
                done[anchor] = m.end()
    return [(k, a, b) for k in KINDS for a, b in found[k]]


_NOT_DIGIT = re.compile(r"[^0-9]")


def _run_end(text: str, at: int) -> int:
    m = _NOT_DIGIT.search(text, at)
    return m.start() if m else len(text)


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` with ``spans`` an array of ``(kind, start, stop)`` in code points, stop exclusive, by kind, then start.

    Base kinds are email, ip, card and phone; added ones are account identifiers that follow a cue (IBANs must pass their check
    sum) and user names with passwords in addresses. A null or empty text has no spans; every row of ``docs`` gives
    one row. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in pieces(batches):
            spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in spans_in(t, automaton)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,stop:bigint>>")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of the base spans, and all spans as text."""

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
