"""Personal data: patterns propose spans, checksums confirm, context scores them.

Each kind has a pattern, a validator and a base score. Words nearby that name
the kind raise the score. Spans of the four base kinds are kept once their
validator holds; spans of the further kinds need a score of LEAST.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "local_phone")
#: Score that a span of a further kind needs.
LEAST = 0.5
#: Code points on either side that count as nearby.
NEAR = 48
#: Base score of a confirmed span, the bonus for context, and the words that give it.
SCORES = {
    "email": (0.8, 0.2, ("mail", "contact", "write")),
    "ip": (0.6, 0.3, ("ip", "host", "server", "address", "login")),
    "card": (0.7, 0.3, ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte")),
    "phone": (0.6, 0.3, ("phone", "call", "tel", "mobile", "fax")),
    "iban": (0.9, 0.1, ("iban", "bank", "account", "konto")),
    "ssn": (0.3, 0.4, ("ssn", "social", "security")),
    "local_phone": (0.3, 0.4, ("phone", "call", "tel", "mobile", "fax")),
}
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b")
_BORDER = re.compile(r"\b")
#: Characters of an IBAN, by country.
_IBAN_SIZES = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+] )\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9-])")
_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    left = 0
    for c in s[4:] + s[:4]:
        left = int(f"{left}{int(c, 36)}") % 97
    return left == 1


def ibans(text: str):
    """(start, end) from the left: of the ends at word borders the one of the country's size, else the longest, for which mod-97 holds."""
    at = 0
    while m := _IBAN.search(text, at):
        a, at = m.start(), m.start() + 1
        size = _IBAN_SIZES.get(text[a : a + 2])
        ends = [b.start() for b in _BORDER.finditer(text, a + 15, m.end()) if text[b.start() - 1] != " "]
        for b in sorted(ends, key=lambda b: (len(text[a:b].replace(" ", "")) != size, -b)):
            if mod97(text[a:b]):
                yield a, b
                at = b
                break


def emails(text: str):
    """Leftmost matches: the part ahead of each @ reaches back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHAR:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def proposals(text: str):
    """(kind, start, end) of every confirmed span."""
    for a, b in emails(text):
        yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for a, b in ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()
    if "(" in text:
        for m in _LOCAL_PHONE.finditer(text):
            yield "local_phone", m.start(), m.end()


_DIGIT = re.compile(r"[0-9]")
_ORDER = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}


def spans_of(text: str) -> list[tuple]:
    """Scored spans, by kind as listed, then start."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    out = []
    for kind, a, b in proposals(text):
        score, bonus, words = SCORES[kind]
        near = text[max(0, a - NEAR) : a].lower() + " " + text[b : b + NEAR].lower()
        if any(w in re.split(r"[^\w]+", near) for w in words):
            score += bonus
        if kind in BASE_KINDS or score >= LEAST:
            out.append((kind, a, b, min(1.0, score)))
    return sorted(out, key=lambda x: (_ORDER[x[0]], x[1]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans array<struct<kind, start, end, score>>.

    Offsets are code points, end exclusive. Null and empty texts have no spans;
    repeated rows are scanned alike; other columns are dropped. No shuffle.
    """
    return common.map_texts(common.id_and_text(docs, id_col, text_col), lambda: lambda texts: [([dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t)],) for t in texts], f"spans {SPANS}")


def joined(spans, keep=None):
    """kind:start:end of an array of spans, joined by commas."""
    if keep is not None:
        spans = F.filter(spans, keep)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(spans, kinds) -> list:
    """Counts per kind, base_sha256 and spans, the columns of a span contract."""
    s = F.col(spans)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in kinds]
    return [*counts, F.sha2(joined(s, lambda x: x["kind"].isin(*kinds)), 256).alias("base_sha256"), joined(s).alias("spans")]


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, and the spans' scores in the order of spans."""
    scores = F.concat_ws(",", F.transform("spans", lambda s: F.format_number(s["score"], 2)))
    return find_pii(common.documents(spark, sf_dir)).select("doc_id", *digest("spans", BASE_KINDS), scores.alias("scores"))
