"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

Every text goes through three steps. Proposal: patterns name candidate spans of
each kind, in time linear in the text. Confirmation: validators look at the
candidate's characters (Luhn for card and device numbers, mod 97 for bank
accounts, ranges for addresses and dates, structure for issued numbers). Score:
a kind's prior, plus what a passed checksum adds, plus or minus what the words
within ``CONTEXT`` code points say ("iban", "born", "phone" for; "order",
"version", "isbn" against).

The base kinds (email, ip, card, phone) always stay, with their score. Spans of the further
kinds are added where their score reaches ``threshold`` and no base span overlaps
them; of overlapping further spans the higher score stays, then the earlier, then
the longer.

Null text has no spans; repeated rows keep one result row each, as do rows without
an id; very long texts are scanned whole; an empty table gives an empty result;
further columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts

#: Code points before and after a span whose words count as its context.
CONTEXT = 48
#: From this score a span of a further kind is added.
THRESHOLD = 0.6

LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rule:
    """A kind of personal data: how spans are proposed and confirmed, and what its score is made of."""

    kind: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool]
    prior: float  # score of a confirmed span without context
    near: frozenset[str]  # words that raise it
    against: frozenset[str]  # words that lower it


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Every second digit from the right doubled, digits of the products added, the sum divisible by ten."""
    doubled = [int(c) * 2 for c in number[-2::-2]]
    return (sum(map(int, number[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def mod_97(account: str) -> bool:
    """The account with its first four characters moved to the end and letters as 10 to 35 leaves 1 by 97."""
    rest = 0
    for c in account[4:] + account[:4]:
        for digit in str(int(c, 36)):
            rest = (rest * 10 + int(digit)) % 97
    return rest == 1


# Base kinds: leftmost, non-overlapping; failing matches are dropped and not tried again.


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A run of local characters before an @, cut at the match before, with a domain of two labels or more."""
    end = 0
    if "@" not in text:
        return
    for run in LOCAL_PART.finditer(text):
        start = max(run.start(), end)
        if start < run.end() and text[run.end() : run.end() + 1] == "@" and (domain := DOMAIN.match(text, run.end() + 1)):
            end = domain.end()
            yield start, end


def fours(text: str) -> Iterator[tuple[int, int]]:
    """Numbers joined by dots, four at a time."""
    for chain in NUMBER_CHAIN.finditer(text):
        if chain[0].count(".") >= 3:
            ends = [chain.start() - 1, *(chain.start() + m.start() for m in re.finditer(r"\.", chain[0])), chain.end()]
            for k in range(0, len(ends) - 4, 4):
                yield ends[k] + 1, ends[k + 4]


def spans_of(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def is_address(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def is_card(found: str) -> bool:
    number = digits(found)
    return 16 <= len(number) <= 19 and luhn(number)


def is_phone(found: str) -> bool:
    return 8 <= len(digits(found)) <= 15


# Further kinds.

#: Lengths of bank account numbers by country.
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
ACCOUNT_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[\x20]?[A-Z0-9])")
SOCIAL = re.compile(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
HARDWARE = re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])")
LONG_ADDRESS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:.])")
SHORT_DIGITS = re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9A-Za-z-])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?0?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9A-Za-z-])")
DAY = re.compile(r"(?<![0-9A-Za-z./-])(?:([0-9]{4})([./-])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([./-])([0-9]{1,2})\6([0-9]{4}))(?![0-9A-Za-z/-])")
PASSPORT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{1,2}[0-9]{6,8}(?![0-9A-Za-z])")


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """From each country code and its two check digits as many characters as the country has, single spaces between."""
    end = 0
    for head in ACCOUNT_HEAD.finditer(text):
        length = ACCOUNT_LENGTHS.get(head[0][:2])
        if not length or head.start() < end:
            continue
        at, count = head.end(), 4
        while count < length:
            at += text[at : at + 1] == " "
            if not ("0" <= (c := text[at : at + 1]) <= "9" or "A" <= c <= "Z"):
                break
            at, count = at + 1, count + 1
        if count == length and not (text[at : at + 1].isalnum() and text[at : at + 1].isascii()):
            end = at
            yield head.start(), at


def is_social(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def is_long_address(found: str) -> bool:
    """Eight groups of up to four hexadecimal digits, or fewer around one double colon; at least two groups stand there."""
    if found.count(":") < 3 or found.count("::") > 1 or ":::" in found:
        return False
    left, gap, right = found.partition("::")
    groups = [g for side in (left, right) if side for g in side.split(":")]
    return all(1 <= len(g) <= 4 for g in groups) and (2 <= len(groups) < 8 if gap else len(groups) == 8)


def is_device(found: str) -> bool:
    number = digits(found)
    return 13 <= len(number) <= 15 and len(set(number)) > 2 and luhn(number)


def is_day(found: str) -> bool:
    """A day of a year from 1900 to 2099, year first or last, day or month first."""
    parts = [int(p) for p in re.split(r"[./-]", found)]
    year, a, b = (parts[0], parts[1], parts[2]) if parts[0] > 99 else (parts[2], parts[1], parts[0])
    return 1900 <= year <= 2099 and (1 <= a <= 12 and 1 <= b <= 31 or parts[0] <= 99 and 1 <= b <= 12 and 1 <= a <= 31)


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Context words by kind, in several languages.
NUMBER_WORDS = words("order invoice isbn issn version sku part item ticket serial tracking bestellung rechnung commande facture pedido factura version")
PHONE_WORDS = words("phone tel telephone mobile cell call fax whatsapp contact telefon handy anruf téléphone portable appelez teléfono móvil llamar")
CARD_WORDS = words("card credit debit visa mastercard amex cvv cvc expiry payment karte kreditkarte carte bancaire tarjeta crédito")
RULES = (
    Rule("email", emails, lambda _: True, 0.9, words("email mail contact write e courriel correo kontakt"), words("example git scp")),
    Rule("ip", fours, is_address, 0.7, words("ip address host server login client adresse dirección"), words("version release v build chapter section")),
    Rule("card", spans_of(DIGIT_CHAIN), is_card, 0.8, CARD_WORDS, NUMBER_WORDS),
    Rule("phone", spans_of(PHONE), is_phone, 0.8, PHONE_WORDS, NUMBER_WORDS),
    Rule("account", accounts, lambda found: mod_97(found.replace(" ", "")), 0.9, words("iban account bank transfer konto überweisung compte virement cuenta transferencia"), NUMBER_WORDS),
    Rule("social", spans_of(SOCIAL), is_social, 0.5, words("ssn social security tax tin taxpayer insurance"), NUMBER_WORDS | PHONE_WORDS),
    Rule("hardware", spans_of(HARDWARE), lambda found: len(set(re.sub("[:-]", "", found))) > 2, 0.7, words("mac hardware ethernet wifi adapter device interface"), NUMBER_WORDS),
    Rule("address6", spans_of(LONG_ADDRESS), is_long_address, 0.7, words("ip ipv address host server login client adresse dirección"), words("time duration at uhr heure hora")),
    Rule("device", spans_of(SHORT_DIGITS), is_device, 0.3, CARD_WORDS | words("imei device handset amex gerät appareil dispositivo"), NUMBER_WORDS),
    Rule("local_phone", spans_of(LOCAL_PHONE), lambda found: 9 <= len(digits(found)) <= 11, 0.3, PHONE_WORDS, NUMBER_WORDS),
    Rule("birth", spans_of(DAY), is_day, 0.25, words("born birth birthday dob birthdate geboren geburtstag geburtsdatum né née naissance nacido nacida nacimiento"), NUMBER_WORDS),
    Rule("passport", spans_of(PASSPORT), lambda _: True, 0.2, words("passport reisepass passeport pasaporte ausweis identity"), NUMBER_WORDS),
)
KINDS, BASE = tuple(r.kind for r in RULES), 4
#: What one or more context words add or take away.
FOR, AGAINST = 0.45, 0.35


def score(rule: Rule, text: str, start: int, end: int) -> float:
    """The rule's prior, moved by words near the span; between 0 and 1."""
    left, right = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    around = {w.lower() for w in WORD.findall(text, left, start)} | {w.lower() for w in WORD.findall(text, end, right)}
    value = rule.prior + FOR * (not around.isdisjoint(rule.near)) - AGAINST * (not around.isdisjoint(rule.against))
    return round(min(1.0, max(0.0, value)), 2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start."""
    return [(k, a, b) for k, rule in enumerate(RULES[:BASE]) for a, b in rule.propose(text) if rule.confirm(text[a:b])]


def further_spans(text: str, base: list[tuple[int, int, int]], threshold: float) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) of the further kinds that reach the threshold, disjoint from base spans and each other."""
    found = []
    for k, rule in enumerate(RULES[BASE:], BASE):
        for a, b in rule.propose(text):
            if rule.confirm(text[a:b]) and (value := score(rule, text, a, b)) >= threshold:
                found.append((k, a, b, value))
    if not found:
        return []
    taken = bytearray(len(text))  # a mark for each code point that a span holds
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    kept = []
    for x in sorted(found, key=lambda x: (-x[3], x[1], -x[2], x[0])):
        if not any(taken[x[1] : x[2]]):
            taken[x[1] : x[2]] = b"\1" * (x[2] - x[1])
            kept.append(x)
    return sorted(kept)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in spans)


def scan(text: str, threshold: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """Base spans by kind and start; all spans with their scores, likewise."""
    base = base_spans(text)
    scored = [(k, a, b, score(RULES[k], text, a, b)) for k, a, b in base]
    return base, scored + further_spans(text, base, threshold)


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (string) and found (array of kind, start, end, score) of every row."""

    def rows(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (*(f"n_{kind}" for kind in KINDS[:BASE]), "base_sha256", "spans", "found")}
        for text in texts:
            base, every = scan(text, threshold)
            for k, kind in enumerate(KINDS[:BASE]):
                out[f"n_{kind}"].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
            out["found"].append([{"kind": KINDS[k], "start": a, "end": b, "score": s} for k, a, b, s in every])
        return out

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,score:double>>"
    return map_texts(id_and_text(docs, id_col, text_col), rows, schema)


def masked(text: Column, found: Column, least: float = THRESHOLD) -> Column:
    """``text`` with each span of at least this score replaced by its kind in brackets; overlapping spans are covered together."""
    spans = F.array_sort(F.transform(F.filter(found, lambda m: m["score"] >= least), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, m: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(m["start"] - state["at"], F.lit(0)).cast("int"))
        label = F.when(m["start"] >= state["at"], F.concat(F.lit("["), m["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(state["out"], between, label).alias("out"), F.greatest(state["at"], m["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
