"""Personal data: regular expressions propose spans, checksums confirm, context scores.

Base kinds (kept whatever their score): email, ip, card, phone. Kinds of the method, kept
from MIN_SCORE on: iban (of its country's length, confirmed by mod-97), ssn (three-two-four
digits of numbers that are given out), secret (keys and tokens). Words near a span raise
its score, or lower it where they say that it is something else. Positions count code
points; ends are exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
#: Score of a confirmed span without context, by kind; context adds or takes CONTEXT_GAIN, within 0 and 1.
SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.4}
CONTEXT_GAIN = 0.35
#: Code points before and after a span in which context words count.
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 24
#: The least score of a span that the method adds.
MIN_SCORE = 0.5
#: Words that speak for a kind, and words that speak against it.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "bic", "swift"),
    "ssn": ("ssn", "social security", "taxpayer", "tax id"),
    "secret": ("key", "token", "secret", "password", "passwd", "pwd", "apikey", "credential", "bearer", "auth"),
}
AGAINST = {
    "email": ("noreply", "no-reply"),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("order", "serial", "isbn", "tracking", "article"),
    "phone": ("order", "serial", "isbn", "part number"),
    "iban": ("sample", "example", "specimen"),
    "ssn": ("order", "serial", "part number", "model", "example", "sample"),
    "secret": ("sha1", "sha256", "md5", "checksum", "commit", "hash", "digest", "fingerprint", "uuid"),
}
#: Fixed values of the standard: letters and digits of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number never begins within a run of digits, which the look-behind says without trying each digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Keys whose form tells what they are, and runs of letters and digits that may be one.
_FORMS = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"
)
#: Three-part tokens: where one may begin, and what follows its first part, which is looked for from the dot before it.
_TOKEN_HEAD, _TOKEN_REST, _TOKEN = re.compile(r"(?<![A-Za-z0-9])eyJ"), re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
#: Score of a key whose form tells it, and the least bits a character of a run that may be a key.
FORM_SCORE, LEAST_BITS = 0.9, 3.0
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    own = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part is the run before an @, so only @ are looked at."""
    out, at = [], 0
    sign = text.find("@")
    while sign >= 0:
        before = text[at:sign]
        local = len(before) - len(before.rstrip(_LOCAL))
        after = _DOMAIN.match(text, sign + 1) if local else None
        if after:
            out.append((sign - local, after.end()))
        at = after.end() if after else sign + 1
        sign = text.find("@", at)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


def ibans(text: str) -> list[tuple[int, int]]:
    """Numbers of their country's length, in one piece or with single blanks, whatever stands after them."""
    out = []
    for m in _IBAN.finditer(text):
        left, at = IBAN_LENGTH.get(m[1], 0) - 4, m.end()
        while left > 0 and at < len(text):
            if text[at] == " " and text[at - 1] != " ":
                at += 1
            elif "0" <= text[at] <= "9" or "A" <= text[at] <= "Z":
                at, left = at + 1, left - 1
            else:
                break
        whole = at == len(text) or not (text[at].isascii() and text[at].isalnum())
        if left == 0 and at > m.end() and whole and mod97(text[m.start() : at]):
            out.append((m.start(), at))
    return out


def ssns(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SSN.finditer(text)]


def bits(run: str) -> float:
    """Entropy of a string's characters."""
    return -sum(n / len(run) * log2(n / len(run)) for n in map(run.count, set(run)))


def three_parts(text: str, at: int) -> tuple[int, int] | None:
    """The first match of ``eyJ..``, ``eyJ..`` and a third part, parted by dots, from a place on; each run between dots is looked at once."""
    dot = text.find(".", at)
    while dot >= 0:
        rest = _TOKEN_REST.match(text, dot)
        if rest:
            head = _TOKEN_HEAD.search(text, at + len(text[at:dot].rstrip(_TOKEN)), dot)
            if head and dot - head.end() >= 8:
                return head.start(), rest.end()
        at = dot + 1
        dot = text.find(".", at)
    return None


def forms(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping keys whose form tells what they are."""
    out: list[tuple[int, int]] = []
    at, end = 0, (len(text) + 1, 0)
    key, token = (-1, 0), (-1, 0)
    while True:
        # what was found stands as long as nothing found before reaches into it
        if key[0] < at:
            found = _FORMS.search(text, at)
            key = found.span() if found else end
        if token[0] < at:
            token = three_parts(text, at) or end
        first = min(key, token)
        if first == end:
            return out
        out.append(first)
        at = first[1]


def secrets(text: str) -> list[tuple[int, int]]:
    """Keys of known forms, and runs of 20 characters or more with digits and letters that look random and aren't UUIDs; none within another."""
    known = forms(text)
    ends, out = [e for _, e in known], list(known)
    for m in _RUN.finditer(text):
        run = m[0]
        k = bisect_right(ends, m.start())  # the first key that ends after the run's start
        if _DIGIT.search(run) and not run.isdigit() and bits(run) >= LEAST_BITS and not _UUID.fullmatch(run) and not (k < len(known) and known[k][0] < m.end()):
            out.append(m.span())
    return sorted(out)


FINDERS: dict[str, Callable[[str], list[tuple[int, int]]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns, "secret": secrets}
#: Context words as whole words, or the beginnings of words, by kind.
_SAID = {k: (re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, CONTEXT[k])) + ")"), re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, AGAINST[k])) + ")")) for k in KINDS}


def score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's score, raised by words for it and lowered by words against it, before or after the span."""
    near = f"{text[max(0, start - CONTEXT_BEFORE) : start]}\n{text[end : end + CONTEXT_AFTER]}".lower()
    base = FORM_SCORE if kind == "secret" and (_FORMS.fullmatch(text, start, end) or three_parts(text[start:end], 0) == (0, end - start)) else SCORE[kind]
    words, against = _SAID[kind]
    return round(min(1.0, max(0.0, base + CONTEXT_GAIN * (bool(words.search(near)) - bool(against.search(near))))), 2)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed in KINDS and then by start."""
    out = []
    for kind, find in FINDERS.items():
        for start, end in find(text):
            s = score(kind, text, start, end)
            if kind in BASE or s >= MIN_SCORE:
                out.append((kind, start, end, s))
    return out


def redact(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by [KIND] of its first."""
    out, at = [], 0
    for kind, start, end, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _text(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row of docs; null text counts as empty, repeated rows give a row each."""

    def run(texts: list) -> list[pa.Array]:
        return [pa.array([[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans(t)] for t in texts], _SPANS)]

    return per_text(docs.select(F.col(id_col).cast("long").alias("id"), _text(text_col).alias("text")), run, "id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text column replaced; other columns, rows and null texts as they were."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, spans(t)))

    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), clean(F.col(text_col))))
