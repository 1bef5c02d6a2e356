"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score.

A span's score starts from what confirms it: a checksum (cards, IBANs), a form that hardly anything else has (e-mail
addresses, IP addresses, international numbers, keys of known form, private-key blocks), or nothing. Context words
raise or lower it. Spans of the base kinds always stand; any other one stands if its score is ACCEPT or more.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralume.llm.common import bounded, sliced

#: Base kinds in the order of digests, then the kinds that this operator adds.
KINDS = ("email", "ip", "card", "phone", "iban", "ipv6", "secret")
BASE = KINDS[:4]
#: Characters before and after a span in which context words count.
NEAR = 40
#: Score that a span beside the base ones needs; scores before context words: confirmed by a checksum, by form, not at all.
ACCEPT = 0.5
CONFIRMED, FORMED, PROPOSED = 0.9, 0.7, 0.4
#: What context words for and against a kind change a score by.
RAISE, LOWER = 0.2, 0.35
#: Bits of entropy a character that a value has at least to be random (hex digits: RANDOM_HEX).
RANDOM, RANDOM_HEX = 3.0, 2.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails inside too, hence the look-behind: linear on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
_WORD = re.compile(r"[A-Za-z0-9]")
#: Lengths of countries' IBANs.
_COUNTRIES = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL FK SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK MN",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL OM SO",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_LENGTHS = {c: n for n, cs in _COUNTRIES.items() for c in cs.split()}
# Numbers in groups; only context words make them phone numbers.
_NATIONAL = re.compile(r"(?<![A-Za-z0-9+])\(?[0-9]+(?:[ ./)-]{1,2}[0-9]+)*(?![A-Za-z0-9])")
_GROUP = re.compile(r"[0-9]+")
# Dates and four numbers with dots, which aren't phone numbers.
_OTHER = re.compile(r"[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4}(?![0-9])|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_CARD_FORM = re.compile(r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
# Keys whose form says what they are, and values behind a name that says it.
_KEY = re.compile(
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]{0,10000}-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    r"|(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{20,255}|glpat-[A-Za-z0-9_-]{20,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|sk-[A-Za-z0-9_-]{20,255}|[sr]k_(?:live|test)_[A-Za-z0-9]{10,255}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,4000}\.[A-Za-z0-9_-]{10,4000}\.[A-Za-z0-9_-]{10,4000})(?![A-Za-z0-9_])"
)
_NAMED = re.compile(r"(?<![A-Za-z0-9])((?:[A-Za-z0-9]{1,30}[_-]){0,4}(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credentials?|bearer|authorization)(?:[_-][A-Za-z0-9]{1,30}){0,2})[\"']?\s{0,3}(?:[:=]{1,2}|=>|\bis\b|\s)\s{0,3}[\"'`]?([A-Za-z0-9+/_.~$!@#%^&*-]{8,512}={0,2})", re.IGNORECASE)
_HEX = re.compile(r"[0-9a-fA-F]+")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,512}(?![A-Za-z0-9+/_-])")
#: Words that raise or lower the score of a kind nearby.
_FOR = {
    "card": re.compile(r"\b(?:card|visa|mastercard|carte|karte|tarjeta|payment)\b", re.IGNORECASE),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|teléfono|téléphone|telefon)\b", re.IGNORECASE),
    "ip": re.compile(r"\b(?:ip|host|server|address|adresse)\b", re.IGNORECASE),
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|correo|courriel)\b", re.IGNORECASE),
    "ipv6": re.compile(r"\b(?:ip|ipv6|host|server|address|adresse)\b", re.IGNORECASE),
    "secret": re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[ _-]?key|apikey|access[ _-]?key|private[ _-]?key|credentials?|bearer|authorization|auth)(?![A-Za-z])", re.IGNORECASE),
    "iban": re.compile(r"\b(?:iban|account|konto|compte|cuenta|bank)\b", re.IGNORECASE),
}
_AGAINST = re.compile(r"\b(?:version|isbn|order|invoice|build|sample)\b", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10 of an IBAN without spaces."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _ibans(text: str):
    """IBANs (start, end, confirmed) that end where a word does: of the country's length, else any whose mod 97 holds.

    Of a known country that is the whole run only, of another one the longest part of it.
    """
    end = 0
    for m in _IBAN.finditer(text):
        a = m.start()
        if a < end:
            continue
        ends = [b for b in range(m.end(1), m.end(), -1) if text[b - 1] != " " and not _WORD.match(text, b)]
        ends = [(b, b - a - text.count(" ", a, b)) for b in ends]
        known = _LENGTHS.get(m[0][:2])
        own = [b for b, n in ends if n == known]
        for b in own + [b for b, n in ends[: 1 if known else None] if n >= 15]:
            if mod97(text[a:b].replace(" ", "")):
                yield a, b, True
                end = b
                break
        else:
            if own:
                yield a, own[0], False
                end = own[0]


def _national(text: str):
    """Numbers of 7 to 15 digits in groups or with a leading 0 that may be phone numbers; longer ones end at a group."""
    for m in _NATIONAL.finditer(text):
        a, b, digits = m.start(), m.start(), 0
        for g in _GROUP.finditer(text, a, m.end()):
            if digits + len(g[0]) > 15:
                break
            b, digits = g.end(), digits + len(g[0])
        if 7 <= digits and (digits < b - a or text[a] == "0" or digits == 10) and not _OTHER.match(text, a):
            yield a, b


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _below_256(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base kinds, in their order; failing matches are dropped, not retried."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_below_256, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def entropy(text: str) -> float:
    """Bits a character of the text's own character frequencies."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def _random(value: str) -> bool:
    """Whether a value looks drawn at random: digits and letters, and enough bits a character."""
    if not _DIGIT.search(value) or not re.search("[A-Za-z]", value):
        return False
    return entropy(value) >= (RANDOM_HEX if _HEX.fullmatch(value) else RANDOM)


def _secrets(text: str):
    """Keys and tokens (start, end, what confirms it): by their form; random values behind a name like token; random bare words of 20 characters or more."""
    for m in _KEY.finditer(text):
        yield *m.span(), FORMED
    if _FOR["secret"].search(text):
        for m in _NAMED.finditer(text):
            if _random(m[2]):
                yield *m.span(2), FORMED
        for m in _BARE.finditer(text):
            if _random(m[0]):
                yield *m.span(), PROPOSED


def score(text: str, kind: str, begin: int, end: int, start: float) -> float:
    """0 to 1: start, more with context words for the kind within NEAR characters, less with words against it."""
    near = text[max(0, begin - NEAR) : begin] + " " + text[end : end + NEAR]
    if kind in _FOR and _FOR[kind].search(near):
        start += RAISE
    if _AGAINST.search(near):
        start -= LOWER
    return min(1.0, max(0.0, round(start, 6)))


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by kind and start: the base ones, always, and those that the method adds.

    An added span stands if its score is ACCEPT or more and no span of its kind, or none at all if nothing confirms
    it, overlaps it: context words lift cards and IBANs whose checksum fails, numbers without a country code and
    random words over it, and words against a kind press IPv6 addresses and keys under it.
    """
    base = base_spans(text)
    sure = {"card": CONFIRMED}
    out = [(k, a, b, score(text, k, a, b, sure.get(k, FORMED))) for k, a, b in base]
    more = []
    if _DIGIT.search(text):
        more = [("iban", a, b, CONFIRMED if ok else PROPOSED) for a, b, ok in _ibans(text)]
        if ":" in text:
            more += [("ipv6", *m.span(), FORMED) for m in _IPV6.finditer(text)]
        # Cards of usual form beside other digits, and shorter ones.
        more += [("card", *m.span(), CONFIRMED if luhn(re.sub("[^0-9]", "", m[0])) else PROPOSED) for m in _CARD_FORM.finditer(text)]
        if _FOR["phone"].search(text):
            more += [("phone", a, b, PROPOSED) for a, b in _national(text)]
    more += [("secret", *x) for x in _secrets(text)]
    for kind, a, b, start in sorted(more, key=lambda x: -x[3]):
        if any(x < b and a < y for k, x, y, _ in out if k == kind or start == PROPOSED):
            continue
        s = score(text, kind, a, b, start)
        if s >= ACCEPT:
            out.append((kind, a, b, s))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (rank[x[0]], x[1]))


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first and longest stands."""
    parts, end = [], 0
    for kind, a, b, _ in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if b <= end:
            continue
        parts += [text[end:a], f"[{kind.upper()}]"] if a >= end else []
        end = b
    return "".join([*parts, text[end:]]) if parts else text


def _digest(found) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in found)


def _report(batches):
    for b in sliced(batches, 1):
        rows = []
        for text in b.column(1).to_pylist():
            found = spans(text or "")
            base = base_spans(text or "") if found else []
            rows.append((*(sum(x[0] == k for x in base) for k in BASE), hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(found), [x[3] for x in found]))
        cols = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:6]), pa.array(cols[6], pa.list_(pa.float64()))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and their scores of every whole text; offsets are code points.

    Null and empty texts have no spans, very long ones are read whole. Repeated rows stay; other columns don't
    matter; no documents give no rows.
    """
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def masked_documents(docs: DataFrame) -> DataFrame:
    """The documents, all columns, their texts masked; n_chars, if there, follows the text.

    Null texts stay null, repeated rows stay, very long texts are masked whole, no documents give no rows.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in sliced(batches, at):
            texts = [None if t is None else mask(t) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if chars is not None:
                cols[chars] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return bounded(docs).mapInArrow(run, docs.schema)
