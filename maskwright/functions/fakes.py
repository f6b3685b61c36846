"""Synthetic values derived from a seed of 16 hex digits, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import seed_mod

# The names that synthetic values are made of, in the order that seeds index.
FIRST_NAMES = "Aarav Aditi Ananya Arjun Diya Ishaan Kavya Meera Neel Nisha Priya Rohan Saanvi Tara Vihaan Zoya".split()
LAST_NAMES = "Bose Desai Iyer Kapoor Kulkarni Mehta Menon Nair Patel Rao Sen Shah Sharma Singh Verma Yadav".split()
COMPANY_WORDS = "Arcadia Bluehaven Cedar Evergreen Harbor Meridian Northstar Silverline".split()
COMPANY_INDUSTRIES = "Advisory Industries Logistics Manufacturing Securities Services Technologies Ventures".split()


def _pick(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (number + 1).cast("int"))


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _first(seed: Column) -> Column:
    return _pick(FIRST_NAMES, seed_mod(seed, len(FIRST_NAMES)))


def _last(seed: Column) -> Column:
    return _pick(LAST_NAMES, seed_mod(seed, len(LAST_NAMES), 8))


def person(seed: Column) -> Column:
    return F.concat(_first(seed), F.lit(" "), F.char(seed_mod(seed, 26, 16) + ord("A")), F.lit(". "), _last(seed))


def email(seed: Column, linked: Column) -> Column:
    named = F.concat(F.lower(_first(seed)), F.lit("."), F.lower(_last(seed)))
    return F.concat(F.when(linked, named).otherwise(F.concat(F.lit("synthetic.contact+"), F.substring(seed, 11, 6))), F.lit("@example.com"))


def phone(seed: Column) -> Column:
    return F.concat(F.lit("+1 202-555-"), _padded(seed_mod(seed, 100) + 100, 4))


def company(seed: Column) -> Column:
    return F.concat_ws(" ", F.lit("Example"), _pick(COMPANY_WORDS, seed_mod(seed, 8)), _pick(COMPANY_INDUSTRIES, seed_mod(seed, 8, 8)), F.upper(F.substring(seed, 9, 4)), F.lit("Private Limited"))


def address(seed: Column) -> Column:
    building = F.floor(seed_mod(seed, 80, 8) / 4) + 1
    return F.concat(
        F.lit("Unit "), (seed_mod(seed, 900) + 100).cast("string"), F.lit(", Example Heights "), building.cast("string"),
        F.lit(", Synthetic Avenue, Pune – "), (seed_mod(seed, 100, 16) + 411900).cast("string"), F.lit(", Maharashtra, India"),
    )


def ssn(seed: Column) -> Column:
    return F.concat_ws("-", _padded(seed_mod(seed, 199) + 700, 3), _padded(seed_mod(seed, 99, 8) + 1, 2), _padded(seed_mod(seed, 9999, 16) + 1, 4))


def card(seed: Column) -> Column:
    head = F.concat(F.lit("424242"), _padded(seed_mod(seed, 10**9), 9))
    check = F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(head, d)))
    return F.concat_ws(" ", *[F.substring(F.concat(head, F.get(check, F.lit(0))), at, 4) for at in (1, 5, 9, 13)])


def birth_date(seed: Column, original: Column) -> Column:
    """In the form of the original."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), seed_mod(seed, 30 * 365).cast("int"))
    return (
        F.when(F.rlike(original, F.lit("^\\d{4}-\\d{1,2}-\\d{1,2}$")), F.date_format(day, "yyyy-MM-dd"))
        .when(F.contains(original, F.lit("/")), F.date_format(day, "dd/MM/yyyy"))
        .when(F.rlike(original, F.lit("^\\d{1,2}-\\d{1,2}-\\d{4}$")), F.date_format(day, "dd-MM-yyyy"))
        .when(F.rlike(original, F.lit("^[A-Za-z]")), F.date_format(day, "MMMM dd, yyyy"))
        .otherwise(F.date_format(day, "dd MMMM yyyy"))
    )


def ip(seed: Column, version: Column) -> Column:
    six = F.concat(F.lit("2001:db8::"), F.lower(F.hex(seed_mod(seed, 65534) + 1)))
    return F.when(version == 6, six).otherwise(F.concat(F.lit("192.0.2."), (seed_mod(seed, 254) + 1).cast("string")))


def synthetic(entity_type: Column, seed: Column, original: Column, version: Column, linked: Column) -> Column:
    made = {
        "PERSON": person(seed), "EMAIL": email(seed, linked), "PHONE": phone(seed), "COMPANY": company(seed), "ADDRESS": address(seed),
        "SSN": ssn(seed), "CREDIT_CARD": card(seed), "DOB": birth_date(seed, original), "IP_ADDRESS": ip(seed, version),
    }
    out: Column | None = None
    for name, value in made.items():
        out = F.when(entity_type == name, value) if out is None else out.when(entity_type == name, value)
    return out
