"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds: email, card (Luhn and issuer range), iban (mod 97 and the country's length), ssn (area, group and serial rules), ipv4, phone. A card or
IBAN whose checksum fails is not reported. Each kind has a base score; a context word of the kind within ``NEAR`` characters raises it by ``BONUS``,
a word that speaks against it (a version before an address, an order before a number) lowers it by ``PENALTY``, and spans under ``least`` go. The
shapes that other numbers have too (ssn, phone without prefix or brackets, addresses of four numbers under 32) need a word for them; an address or
phone of a clear shape needs none but is refused by a word against it. Of overlapping spans the one with the higher score stays (then the
longer, then the earlier).

Defined cases: digits are ASCII digits; a null or empty text has no spans; texts are searched whole; offsets are characters from 0, the end excluded; repeated rows
give their spans each; a null id is reported as null; ids may be
whole numbers or texts; further columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import kernels as K
from eventloom.llm.common import apart, arrow_batches, named, narrow
from eventloom.session import unused

NEAR = 40


def pattern(text: str, flags: int = 0) -> re.Pattern:
    """Words and borders are those of Unicode, digits are ASCII digits: what ``find`` passes over has none of them."""
    return re.compile(text.replace(r"\d", "[0-9]"), flags)


EMAIL = pattern(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![\w-])")
DIGITS = pattern(r"(?<!\d)\d(?:[ -]?\d){12,}")
AFTER = pattern(r"(?![\w-]|\.\d)")
IBAN = pattern(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30}(?!\w)")
SSN = pattern(r"(?<![\w.-])(\d{3})([ -])(\d\d)\2(\d{4})(?![\w-]|\.\d)")
IPV4 = pattern(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")
PHONE = pattern(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)")
CONTEXT = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write|reply|correo|courriel)\b", re.I),
    "card": re.compile(r"\b(cards?|credit|debit|visa|mastercard|amex|payment|cvv|karte|tarjeta|carte)\b", re.I),
    "iban": re.compile(r"\b(iban|account|bank|bic|swift|konto|cuenta|compte)\b", re.I),
    "ssn": re.compile(r"\b(ssn|social|security|taxpayer)\b", re.I),
    "ipv4": re.compile(r"\b(ip|address|host|server|login|client|ping|ssh)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|telephone|call|mobile|fax|cell|telefon|tel[eé]fono|t[eé]l[eé]phone)\b", re.I),
}
NUMBERS = r"orders?|invoices?|parts?|serial|sku|tracking|items?|case|ticket|isbn|bestellung|pedido|commande"
VERSIONS = r"v|vers?|versi[oó]n|release|lib|library|build|firmware|package|upgrade|section|chapter"
AGAINST = {
    "card": re.compile(rf"\b({NUMBERS})\b", re.I),
    "ssn": re.compile(rf"\b({NUMBERS})\b", re.I),
    "ipv4": re.compile(rf"\b({VERSIONS})\b", re.I),
    "phone": re.compile(rf"\b({NUMBERS}|{VERSIONS})\b", re.I),
}
#: The base score of a shape that other numbers have too.
UNSURE = 0.4
BASE = {"email": 0.9, "card": 0.8, "iban": 0.9, "ssn": UNSURE, "ipv4": 0.6, "phone": 0.6}
#: What a word adds (twice that for an unsure shape) and takes away.
BONUS, PENALTY = 0.1, 0.2
#: Characters of an IBAN by country.
IBAN_LENGTH = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22,
    GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19,
    MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22,
    VG=24, XK=20,
)


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d)
        if place % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def issued(digits: str) -> bool:
    """Whether the first digits and the length are of a card issuer's range."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return (
        digits[0] == "4" and n in (13, 16, 19)
        or (51 <= two <= 55 or 2221 <= four <= 2720) and n == 16
        or two in (34, 37) and n == 15
        or two in (36, 38, 39) and n == 14 or 300 <= int(digits[:3]) <= 305 and n == 14
        or (four == 6011 or two == 65 or 644 <= int(digits[:3]) <= 649) and n in (16, 19)
        or two == 35 and n == 16 or two == 62 and 16 <= n <= 19
    )


def cards_in(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """(begin, end) of the cards in a run of digit groups.

    From each group on, the most groups of 13 to 19 digits that an issuer's range and Luhn confirm are a card; the search goes on after it, or a
    group later if there is none.
    """
    groups = [(m.start() + begin, m.end() + begin) for m in re.finditer(r"[0-9]+", text[begin:end])]
    first = 1 if begin and re.match(r"[\w.+-]", text[begin - 1]) else 0
    last = len(groups) if AFTER.match(text, end) else len(groups) - 1
    out = []
    while first < last:
        digits, fit = "", None
        for k in range(first, last):
            digits += text[groups[k][0] : groups[k][1]]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and issued(digits) and luhn(digits) and len(set(digits)) > 1:
                fit = k
        if fit is not None:
            out.append((groups[first][0], groups[fit][1]))
            first = fit
        first += 1
    return out


def iban_in(run: str) -> str | None:
    """The prefix of a candidate run that has its country's length and passes mod 97 (words after an IBAN may look like more of it)."""
    for end in range(len(run), 14, -1):
        part = run[:end]
        plain = part.replace(" ", "")
        if len(plain) == IBAN_LENGTH.get(plain[:2]) and part[-1] != " " and (end == len(run) or run[end] == " ") and mod97(plain):
            return part
    return None


def around(text: str, begin: int, end: int) -> str:
    """The whole words within ``NEAR`` characters."""
    low, high = max(0, begin - NEAR), min(len(text), end + NEAR)
    while 0 < low < begin and text[low - 1].isalnum() and text[low].isalnum():
        low += 1
    while end < high < len(text) and text[high - 1].isalnum() and text[high].isalnum():
        high -= 1
    return text[low:begin] + " " + text[end:high]


def spans(text: str, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, begin, end, score) in order of begin."""
    found = []

    def add(kind: str, begin: int, end: int, unsure: bool = False) -> None:
        near = around(text, begin, end)
        score = (UNSURE if unsure else BASE[kind]) + BONUS * (1 + unsure) * bool(CONTEXT[kind].search(near)) - PENALTY * bool(kind in AGAINST and AGAINST[kind].search(near))
        found.append((kind, begin, end, round(min(1.0, score), 2)))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add("email", *m.span())
    for m in DIGITS.finditer(text):
        for span in cards_in(text, *m.span()):
            add("card", *span)
    at = 0
    while m := IBAN.search(text, at):
        got = iban_in(m[0])
        at = m.start() + len(got or m[0].partition(" ")[0])
        if got:
            add("iban", m.start(), at)
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[3] != "00" and m[4] != "0000":
            add("ssn", *m.span(), unsure=True)
    for m in IPV4.finditer(text):
        add("ipv4", *m.span(), unsure=max(map(int, m[0].split("."))) < 32)
    for m in PHONE.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
            add("phone", *m.span(), unsure=m[0][0] not in "+(")
    return apart(sorted((s for s in found if s[3] >= least), key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])))


DIGIT_OR_AT = np.zeros(256, bool)
DIGIT_OR_AT[48:58] = True
DIGIT_OR_AT[64] = True

SPANS = "array<struct<kind:string,begin:int,end:int,score:double>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def holding(column: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Numbers of the texts that have a byte of the set ``wanted``."""
    data, offsets = K.text_parts(column)
    return np.unique(np.searchsorted(offsets, np.flatnonzero(wanted[data]), "right") - 1)


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, kind, begin, end, score): a row for each span. Texts with neither a digit nor an @ are passed over in numpy."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf(SPANS)
    def search(column: pa.Array) -> pa.Array:
        out: list = [[]] * len(column)
        for i in holding(column, DIGIT_OR_AT):
            out[i] = [{"kind": k, "begin": b, "end": e, "score": s} for k, b, e, s in spans(column[i].as_py(), least)]
        return pa.array(out, ARROW_SPANS)

    return narrow(docs).select(F.col("_k").alias("doc_id"), F.explode(search("_t")).alias("s")).select("doc_id", "s.kind", "s.begin", "s.end", "s.score")


def redact(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        out = []
        for item in column:
            value = item.as_py()
            for kind, begin, end, _ in reversed(spans(value, least)) if value else ():
                value = f"{value[:begin]}<{kind}>{value[end:]}"
            out.append(value)
        return pa.array(out, pa.string())

    held = unused(docs, "_clean")
    return docs.withColumn(held, clean(named(text).cast("string"))).select(*[F.col(held).alias(c) if c == text else named(c) for c in docs.columns])
