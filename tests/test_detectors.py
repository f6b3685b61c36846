"""Detectors on accepted and rejected texts; values are invented."""

import datetime as dt

import pytest

from maskwright.functions import detectors
from maskwright.operators import pseudonymize

TODAY = dt.date(2026, 1, 1)


def found(name, text, ner=()):
    return [(c.text, c.normalized) for c in detectors.scan(text, list(ner), TODAY, (name,))]


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("email", "write (Ann.Lee+x@Mail.Example.co) now", [("Ann.Lee+x@Mail.Example.co", "ann.lee+x@mail.example.co")]),
        ("email", "a..b@x.org", []),
        ("email", "a@b", []),
        ("email", "a@-x.org", []),
        ("email", "https://user:ann@host.example.org/x", []),
        ("email", "ß.ann@x.org", []),
        ("phone", "call +91 98765-43210", [("+91 98765-43210", "+919876543210")]),
        ("phone", "9876543210", [("9876543210", "+919876543210")]),
        ("phone", "office 022-2345 6789", [("022-2345 6789", "02223456789")]),
        ("phone", "Phone: (202) 555-0148", [("(202) 555-0148", "2025550148")]),
        ("phone", "(202) 555-0148", []),
        ("phone", "Reference: 9876543210", []),
        ("phone", "₹ 9876543210", []),
        ("phone", "+111111111", []),
        ("ssn", "SSN 123-45-6789.", [("123-45-6789", "123-45-6789")]),
        ("ssn", "000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000 078-05-1120 1123-45-6789", []),
        ("card", "4111-1111 1111 1111", [("4111-1111 1111 1111", "4111111111111111")]),
        ("card", "4111 1111 1111 1112", []),
        ("card", "registration 4111111111111111", []),
        ("ip", "10.1.2.3 and 2001:0db8::0001", [("10.1.2.3", "10.1.2.3"), ("2001:0db8::0001", "2001:db8::1")]),
        ("ip", "256.1.1.1 1.2.3 01.2.3.4 1.2.3.4.5", []),
        ("dob", "DOB: 5/11/1984; 1984-11-05 (date of birth)", [("5/11/1984", "1984-11-05"), ("1984-11-05", "1984-11-05")]),
        ("dob", "Born on March 7, 1990", [("March 7, 1990", "1990-03-07")]),
        ("dob", "born 31/02/1990, dated 01/02/1990", []),
        ("dob", "DOB: 01/01/2030", []),
        ("person", "Promoters of our company are Ann Lee, Bob Ray Stone (Managing Director) and Dr Cid Moor", [("Ann Lee", None), ("Bob Ray Stone", None), ("Cid Moor", None)]),
        ("person", "Directors: Risk Committee; ann lee", []),
        ("company", "Formerly Oak & Ash Trading Ltd. and the Family Trust Limited", [("Oak & Ash Trading Ltd.", None)]),
        ("company", "SEBI Limited. Private Limited", []),
        ("address", "Registered Office: Flat 4, Hill Road, Pune 411 001. Tel: 1", [("Flat 4, Hill Road, Pune 411 001", None)]),
        ("address", "Mumbai, India", []),
        ("address", "Oak Trading Limited, Plot 9, Mill Road, Pune 411001", [("Plot 9, Mill Road, Pune 411001", None)]),
    ],
)
def test_texts(name, text, want):
    assert found(name, text) == want


def test_named_entities():
    assert found("person", "Ann Lee spoke", [("PERSON", 0, 7)]) == [("Ann Lee", None)]
    assert found("person", "Ann Lee spoke", [("ORG", 0, 7)]) == []
    assert found("person", "CEO: Ann Lee", [("ORG", 5, 12)]) == [("Ann Lee", None)]
    assert found("company", "The bank is Vale Ratings & Co today", [("ORG", 12, 29)]) == [("Vale Ratings & Co", None)]
    assert found("company", "Vale Ratings & Co", [("ORG", 0, 17)]) == []


def test_the_column_rules_for_fakes_agree_with_the_detectors():
    from maskwright.functions.fakes import COMPANY_WORDS

    assert pseudonymize.revalidate("EMAIL", "synthetic.contact+00ff1a@example.com") and pseudonymize.revalidate("EMAIL", "ann.lee@example.com")
    assert all(pseudonymize.revalidate("PHONE", f"+1 202-555-{n:04d}") for n in range(100, 200))
    assert pseudonymize.revalidate("SSN", "898-99-9999") and pseudonymize.revalidate("IP_ADDRESS", "192.0.2.254") and pseudonymize.revalidate("IP_ADDRESS", "2001:db8::fffe")
    assert pseudonymize.revalidate("CREDIT_CARD", "4242 4242 4242 4242") and pseudonymize.revalidate("DOB", "07 March 1990") and pseudonymize.revalidate("COMPANY", COMPANY_WORDS[0])
