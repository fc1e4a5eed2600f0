"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each text and finds anchors: at-signs, plus
signs, digits, schemes and identifier cues. From each anchor a local parser expands to
both sides, as far as the kind's characters go, and validates what it got: domain
labels, address parts, the Luhn sum, digit counts. Parsers work from left to right and
never go back behind the end of the last match of their kind, so each kind's matches are
the leftmost ones that do not overlap.

Base kinds: email, ip, card, phone. The method adds url (a scheme with a host) and
account (a cue such as IBAN or account with an identifier behind it).

Defined results: a null text is empty; empty texts have no spans; offsets are code
points, end exclusive; spans are ordered by start, then by kind in the order given;
repeated rows give repeated results; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirestream.llm.naming import free
from quirestream.llm.staging import small_batches

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Schemes of addresses, and cues that stand before an identifier.
SCHEMES = ("http://", "https://", "ftp://", "sftp://")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn", "tax id", "customer id", "user id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:[/?#][^\s<>\"'()]*)?")
_ACCOUNT = re.compile(r"(?:\s*(?:no|nr|number)\b)?[.:#\s]{0,3}((?=[A-Z0-9 -]{0,40}[0-9]{4})[A-Z]{0,4}[0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in "0123456789":
        a.add_word(d, ("0", 1))
    for s in SCHEMES:
        a.add_word(s, ("url", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of one text, ordered."""
    out: list[tuple[int, int, str]] = []
    done = {"email": 0, "card": 0, "phone": 0, "url": 0, "account": 0, "ip": 0}
    n = len(text)
    for last, (what, size) in anchors.iter(text):
        if what == "0":
            if last >= done["ip"]:  # the first digit of a chain, or of what no match took
                m = _CHAIN.match(text, last)
                done["ip"] = end = m.end()
                if "." in m[0]:
                    parts, at = m[0].split("."), last
                    for i in range(0, len(parts) - 3, 4):
                        four = parts[i : i + 4]
                        e = at + sum(map(len, four)) + 3
                        if all(_byte(p) for p in four):
                            out.append((at, e, "ip"))
                        at = e + 1
                    done["ip"] = end
            if last >= done["card"] and (m := _CARD.match(text, last)):
                done["card"] = m.end()
                if m.end() - last >= 12:
                    digits = re.sub("[ -]", "", m[0])
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((last, m.end(), "card"))
        elif what == "@":
            start, floor = last, done["email"]
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                out.append((start, m.end(), "email"))
                done["email"] = m.end()
        elif what == "+":
            if last >= done["phone"] and (m := _PHONE.match(text, last)):
                done["phone"] = m.end()
                if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                    out.append((last, m.end(), "phone"))
        elif what == "url":
            start = last - size + 1
            if start >= done["url"] and not (start and text[start - 1].isalnum()) and (m := _URL.match(text, last + 1)):
                end = m.end()
                while text[end - 1] in ".,;:!?" and end > last + 1:
                    end -= 1
                out.append((start, end, "url"))
                done["url"] = end
        elif last + 1 >= done["account"] and not (last + 1 - size and text[last - size].isalpha()) and last + 1 < n and not text[last + 1].isalpha():
            if m := _ACCOUNT.match(text, last + 1):
                out.append((m.start(1), m.end(1), "account"))
                done["account"] = m.end(1)
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``pii``: spans (kind, start, end, in order), as
    text, the count of each base kind and the digest of the base spans; where a column has
    that name, the result's gets a ``_``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("found array<struct<kind:string,start:int,end:int>>, spans string, base_sha256 string, n_email long, n_ip long, n_card long, n_phone long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for b in batches:
            rows = []
            for t in b:
                spans = find(t, anchors) if t else []
                base = [x for x in spans if x[2] in BASE]
                rows.append(([{"kind": k, "start": s, "end": e} for s, e, k in spans], joined(spans), hashlib.sha256(joined(base).encode()).hexdigest(), *(sum(x[2] == k for x in base) for k in BASE)))
            yield pd.DataFrame(rows, columns=["found", "spans", "base_sha256", "n_email", "n_ip", "n_card", "n_phone"])

    return docs.withColumn(free(docs.columns, "pii")[0], udf(F.col(text_col)))
