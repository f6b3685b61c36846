"""Detectors: text and named-entity spans in, candidate spans out. Plain Python, run in Arrow batches.

Each detector is a generator of Candidate; SCAN lists them in order, with a cheap test
that tells texts on which it cannot find anything. Offsets are code points.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from . import patterns as P

Ner = list[tuple[str, int, int]]


class Candidate(NamedTuple):
    entity_type: str
    start: int
    end: int
    text: str
    confidence: float
    recognizer: str
    normalized: str | None = None
    validated: bool = False
    strong_context: bool = False
    signals: tuple[str, ...] = ()
    version: int | None = None
    ner_label: str | None = None


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def emails(text: str, ner: Ner, today: dt.date) -> Iterator[Candidate]:
    for m in P.EMAIL.finditer(text):
        value = m[0]
        local, _, domain = value.rpartition("@")
        # The token around it: back to white space within 120 characters, or else to the text's start.
        token = max(text.rfind(c, max(0, m.start() - 120), m.start()) for c in " \t\n") + 1
        scheme = text.find("://", token, m.end())
        in_url = 0 <= scheme < text.rfind("@", token, m.end())
        if len(value) <= 254 and len(local) <= 64 and max(map(len, domain.split("."))) <= 63 and not in_url:
            yield Candidate("EMAIL", m.start(), m.end(), value, 0.99, "email_regex", value.casefold(), True, signals=("EMAIL_PATTERN", "DOMAIN_LABELS"))


def phone_form(value: str, labelled: bool) -> tuple[float, tuple[str, ...]] | None:
    """Confidence and signals of a phone-shaped value."""
    digits = digits_of(value)
    separators = sum(value.count(c) for c in " -().")
    if not 8 <= len(digits) <= 15:
        return None
    if value.lstrip().startswith("+"):
        return (0.98, ("EXPLICIT_COUNTRY_CODE", "PHONE_LENGTH")) if len(digits) >= 9 and len(set(digits)) >= 3 else None
    if len(digits) == 10 and digits[0] in "6789":
        return 0.94, ("INDIAN_MOBILE_PREFIX", "PHONE_LENGTH")
    if digits[0] == "0" and len(digits) in (10, 11) and separators >= 2:
        return 0.95, ("INDIAN_TRUNK_PREFIX", "GROUPED_LANDLINE")
    return (0.93, ("PHONE_LABEL", "GROUPED_NUMBER", "PHONE_LENGTH")) if labelled and separators else None


def phone_number(value: str) -> str:
    digits = digits_of(value)
    if value.lstrip().startswith("+"):
        return "+" + digits
    return "+91" + digits if len(digits) == 10 and digits[0] in "6789" else digits


def phones(text: str, ner: Ner, today: dt.date) -> Iterator[Candidate]:
    for m in P.PHONE.finditer(text):
        before = text[max(0, m.start() - 60) : m.start()]
        if P.PHONE_VETO.search(before) or P.PHONE_MONEY.search(before):
            continue
        if form := phone_form(m[0], bool(P.PHONE_LABEL.search(before))):
            yield Candidate("PHONE", m.start(), m.end(), m[0], form[0], "phone_regex_context", phone_number(m[0]), True, signals=form[1])


def ssns(text: str, ner: Ner, today: dt.date) -> Iterator[Candidate]:
    for m in P.SSN.finditer(text):
        area, group, serial = map(int, m.groups())
        if 0 < area < 900 and area != 666 and group and serial and m[0] not in P.SSN_INVALID:
            yield Candidate("SSN", m.start(), m.end(), m[0], 0.99, "ssn_regex_validated", m[0], True, signals=("CANONICAL_SSN", "VALID_RANGES"))


def luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return not sum(doubled[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def cards(text: str, ner: Ner, today: dt.date) -> Iterator[Candidate]:
    for m in P.CARD.finditer(text):
        digits = digits_of(m[0])
        if luhn(digits) and not P.CARD_VETO.search(text[max(0, m.start() - 50) : m.start()]):
            yield Candidate("CREDIT_CARD", m.start(), m.end(), m[0], 0.99, "credit_card_luhn", digits, True, signals=("CARD_CANDIDATE", "LUHN_VALID"))


def compressed_ip(text: str) -> tuple[str, int] | None:
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return address.compressed, address.version


def ips(text: str, ner: Ner, today: dt.date) -> Iterator[Candidate]:
    for pattern in (P.IPV4, P.IPV6):
        for m in pattern.finditer(text):
            if found := compressed_ip(m[0]):
                yield Candidate("IP_ADDRESS", m.start(), m.end(), m[0], 0.99, "ipaddress_validated", found[0], True, signals=(f"IPV{found[1]}_CANDIDATE", "IPADDRESS_VALID"), version=found[1])


def birth_date(text: str, today: dt.date) -> str | None:
    """ISO form; the first format that fits decides."""
    for form in P.DATE_FORMATS:
        try:
            day = dt.datetime.strptime(text, form).date()
        except ValueError:
            continue
        return day.isoformat() if dt.date(1900, 1, 1) <= day <= today else None
    return None


def births(text: str, ner: Ner, today: dt.date) -> Iterator[Candidate]:
    for m in P.DATE.finditer(text):
        before = P.BIRTH_BEFORE.search(text[max(0, m.start() - 48) : m.start()])
        if not before and not P.BIRTH_AFTER.search(text[m.end() : m.end() + 32]):
            continue
        if iso := birth_date(m[0], today):
            yield Candidate("DOB", m.start(), m.end(), m[0], 0.98, "dob_context", iso, True, True, ("VALID_DATE", "BIRTH_CONTEXT_BEFORE" if before else "BIRTH_CONTEXT_AFTER"))


def _stripped(text: str, start: int, end: int, left: str, right: str) -> tuple[int, int]:
    value = text[start:end]
    start += len(value) - len(value.lstrip(left))
    return start, max(start, start + len(text[start:end].rstrip(right)))


def clean_name(text: str, start: int, end: int) -> tuple[int, int]:
    """Without punctuation at the ends, a role behind the name, and an honorific before it."""
    start, end = _stripped(text, start, end, " \t,;:/([", " \t,;:/*")
    if role := P.ROLE_TRAILING.search(text, start, end):
        end = role.start()
    start, end = _stripped(text, start, end, "", " \t,;:/*)]")
    if honorific := P.HONORIFIC.match(text, start, end):
        start = honorific.end()
    return start, end


def name_parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    cuts = [(start, start), *(m.span() for m in P.LIST_SEPARATOR.finditer(text, start, end)), (end, end)]
    parts = (clean_name(text, a, b) for (_, a), (b, _) in zip(cuts, cuts[1:], strict=False))
    return [(a, b) for a, b in parts if a < b]


def looks_like_name(value: str) -> bool:
    return P.PERSON_SHAPE.fullmatch(value) is not None and not any(w.casefold().strip(".'’- ") in P.NOT_NAMES for w in value.split())


def role_regions(text: str) -> list[tuple[int, int]]:
    regions = []
    for m in P.ROLE_INTRO.finditer(text):
        stop = P.ROLE_STOP.search(text, m.end(), min(len(text), m.end() + 300))
        end = stop.start() if stop else min(len(text), m.end() + 300)
        if m.end() < end:
            regions.append((m.end(), end))
    return regions


def people(text: str, ner: Ner, today: dt.date) -> Iterator[Candidate]:
    found: dict[tuple[int, int], Candidate] = {}

    def add(a: int, b: int, confidence: float, signals: tuple[str, ...], label: str | None = None) -> None:
        a, b = clean_name(text, a, b)
        if confidence >= 0.82 and looks_like_name(text[a:b]):
            strong = "LOCAL_PERSON_ROLE" in signals or "PERSON_LIST_CONTEXT" in signals
            found[a, b] = Candidate("PERSON", a, b, text[a:b], min(confidence, 0.98), "person_ner_local_context", strong_context=strong, signals=signals, ner_label=label)

    regions = role_regions(text)
    for region in regions:
        for a, b in name_parts(text, *region):
            add(a, b, 0.96, ("PERSON_LIST_CONTEXT", "LOCAL_PERSON_ROLE"))
    for label, start, end in ner:
        if label not in ("PERSON", "ORG"):
            continue
        parts = name_parts(text, start, end)
        several = len(parts) > 1
        qualified = any(a <= start < b for a, b in regions) or P.ROLE_BEFORE.search(text[max(0, start - 70) : start]) is not None
        if label == "ORG" and not qualified and not (several and all(looks_like_name(text[a:b]) for a, b in parts)):
            continue
        confidence, signals = (0.84, ("NER_PERSON",)) if label == "PERSON" else (0.72, ("NER_ORG",))
        if several:
            confidence, signals = confidence + 0.12, (*signals, "SEPARATED_PERSON_LIST")
        if qualified:
            confidence, signals = confidence + 0.14, (*signals, "LOCAL_PERSON_ROLE")
        for a, b in parts:
            add(a, b, confidence, signals, label)
    yield from (found[span] for span in sorted(found))


def companies(text: str, ner: Ner, today: dt.date) -> Iterator[Candidate]:
    legal: list[tuple[int, int]] = []
    for m in P.LEGAL_COMPANY.finditer(text):
        start, end = m.span()
        for lead in (P.FORMERLY, P.COMPANY_ROLE):
            if cut := lead.match(text, start, end):
                start = cut.end()
        value = text[start:end]
        if value and not P.REGULATORS.search(value) and not P.TRUST.search(value):
            legal.append((start, end))
            yield Candidate("COMPANY", start, end, value, 0.97, "company_ner_local_context", strong_context=True, signals=("LEGAL_COMPANY_SUFFIX", "PRECISE_SUFFIX_BOUNDARY"))
    edge = " \t,;:.()"
    for label, a, b in ner:
        if label != "ORG" or any(a < y and x < b for x, y in legal):
            continue
        start, end = _stripped(text, a, b, edge, edge)
        value = text[start:end]
        commercial, words = P.COMMERCIAL.search(value) is not None, value.split()
        personal = P.PERSON_SHAPE.fullmatch(value) is not None and not commercial and "&" not in value
        if not value or P.REGULATORS.search(value) or P.NOT_COMPANIES.search(value) or personal:
            continue
        labelled = P.COMPANY_LABEL.search(text[max(0, start - 100) : start]) is not None
        structured = commercial and ("&" in value or len(words) >= 3)
        heading = value == text.strip() and (value.isupper() or len(words) <= 5)
        confidence, signals = 0.76, ("NER_ORG",)
        if labelled:
            confidence, signals = confidence + 0.12, (*signals, "LOCAL_COMPANY_LABEL")
        if structured:
            confidence, signals = confidence + 0.08, (*signals, "NAMED_COMMERCIAL_STRUCTURE")
        if not heading and (labelled or structured) and confidence >= 0.84:
            yield Candidate("COMPANY", start, end, value, min(confidence, 0.94), "company_ner_local_context", strong_context=labelled, signals=signals)


def address_bounds(text: str, ner: Ner) -> tuple[int, int, bool]:
    """Start, end, and whether an address label stands before it."""
    prefixes = list(P.ADDRESS_PREFIX.finditer(text))
    start = prefixes[-1].end() if prefixes else len(text) - len(text.lstrip())
    contact = P.CONTACT_START.search(text, start)
    end = contact.start() if contact else len(text.rstrip())
    if not prefixes:
        if company := P.LEADING_COMPANY.match(text[start:end]):
            start += company.end()
        elif feature := P.ADDRESS_FEATURE.search(text, start, max(start, end)):
            start = next((b for label, a, b in ner if label == "ORG" and a <= start + 2 and b <= feature.start()), start)
    return (*_stripped(text, start, max(start, end), " \t,;:-", " \t,;:."), bool(prefixes))


def addresses(text: str, ner: Ner, today: dt.date) -> Iterator[Candidate]:
    start, end, labelled = address_bounds(text, ner)
    value = text[start:end]
    if not value:
        return
    postal, features = P.POSTAL_CODE.search(value) is not None, len(P.ADDRESS_FEATURE.findall(value))
    premise, region, commas = P.PREMISE.search(value) is not None, P.REGION.search(value) is not None, value.count(",")
    if postal:
        built = features > 0 and (premise or region or commas > 0)
    else:
        built = features >= 2 and premise and (labelled or commas > 0 or features >= 3)
    if not built:
        return
    confidence, signals = 0.86, ["ADDRESS_STRUCTURE"]
    located = any(label in ("FAC", "GPE", "LOC") and start < b and a < end for label, a, b in ner)
    for holds, more, signal in (
        (postal, 0.05, "POSTAL_CODE_OR_OCR_VARIANT"),
        (labelled, 0.05, "LOCAL_ADDRESS_LABEL"),
        (premise, 0.02, "PREMISE_COMPONENT"),
        (region, 0.01, "REGION_COMPONENT"),
        (located, 0.01, "NER_LOCATION_SUPPORT"),
    ):
        if holds:
            confidence += more
            signals.append(signal)
    yield Candidate("ADDRESS", start, end, value, min(confidence, 0.99), "address_structural_local_context", strong_context=labelled or postal, signals=tuple(signals))


Detector = Callable[[str, Ner, dt.date], Iterable[Candidate]]


def _has_digit(text: str) -> bool:
    return P.re.search(r"\d", text) is not None


#: Name, detector, and whether it can find anything at all in a text.
SCAN: tuple[tuple[str, Detector, Callable[[str, Ner], bool]], ...] = (
    ("email", emails, lambda t, n: "@" in t),
    ("phone", phones, lambda t, n: _has_digit(t)),
    ("ssn", ssns, lambda t, n: "-" in t and _has_digit(t)),
    ("card", cards, lambda t, n: _has_digit(t)),
    ("ip", ips, lambda t, n: "." in t or ":" in t),
    ("dob", births, lambda t, n: _has_digit(t)),
    ("person", people, lambda t, n: True),
    ("company", companies, lambda t, n: True),
    ("address", addresses, lambda t, n: True),
)
NAMES = tuple(name for name, _, _ in SCAN)


def scan(text: str, ner: Ner, today: dt.date, names: Iterable[str] = NAMES) -> list[Candidate]:
    wanted = set(names)
    return [c for name, run, possible in SCAN if name in wanted and possible(text, ner) for c in run(text, ner, today)]
