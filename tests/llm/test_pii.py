import random
import re

import pytest

from parcelar.llm import pii as m

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for found in re.finditer(pattern, text):
            s = found.group()
            digits = re.sub("[^0-9]", "", s)
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and m.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((found.start(), order, kind, found.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


@pytest.mark.parametrize("alphabet", ["0123456789..--  ()+@ab é", "01 -", "a.@-b", "+1() .-2", "0.1"])
def test_base_kinds_equal_the_patterns(alphabet):
    random.seed(alphabet)
    anchors = m.automaton()
    for _ in range(8000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 45)))
        assert [s for s in m.spans_of(text, anchors) if s[0] in m.BASE] == brute(text), text


def test_added_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, Account no 12345678 http://bob:pw@host.com/x accounting 1234567"
    assert [s for s in m.spans_of(text, m.automaton()) if s[0] in m.ADDED] == [("iban", 6, 33), ("ssn", 39, 50), ("login", 72, 94)]
    assert m.spans_of("account 12345678", m.automaton()) == [("account", 8, 16)]
    for clean in ("http://host.com/a:b@c", "IBAN GB00 WEST 1234 5698 7654 32", "ssn 123456789", "subaccount 12345678", "see page 12 of 30"):
        assert not [s for s in m.spans_of(clean, m.automaton()) if s[0] in m.ADDED]


@pytest.mark.parametrize(
    "before, value, kind",
    [
        ("Account number: ", "12345678", "account"), ("account no. ", "12345678", "account"), ("ACCOUNT Nr ", "12345678", "account"),
        ("İ aCCount number is # ", "12345678", "account"), ("Cuenta número: ", "12345678", "account"), ("IBAN is ", "DE89 3704 0044 0532 0130 00", "iban"),
        ("iBan ", "NO93 8601 1117 947", "iban"), ("Social Security Number: ", "123-45-6789", "ssn"), ("Social Security No.: ", "123-45-6789", "ssn"),
        ("SSN is ", "123-45-6789", "ssn"),
    ],
)
def test_cues_in_any_case_and_with_fillers(before, value, kind):
    text = f"é {before}{value}, end"
    start = text.index(value)
    assert [s for s in m.spans_of(text, m.automaton()) if s[0] in m.ADDED] == [(kind, start, start + len(value))]


def test_fillers_are_whole_words():
    for clean in ("account numbering 12345678", "account isolated 12345678", "account number is number is 12345678", "account is of 12345678"):
        assert not [s for s in m.spans_of(clean, m.automaton()) if s[0] in m.ADDED]
