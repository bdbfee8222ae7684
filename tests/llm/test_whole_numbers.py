"""Personal numbers and logins whatever follows them and however long they are."""

from __future__ import annotations

from understory.llm import pii


def kinds(t):
    return [(k, t[a:b]) for k, a, b in pii.finder()(t)[1]]


def test_iban_before_capitals_and_numbers():
    for code in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO9386011117947"):
        for after in ("", ".", " BIC COBADEFF", " 250 EUR", " 1 2 3 4 5 6 7 8 9 10 11 12"):
            assert kinds(f"IBAN: {code}{after}") == [("iban", code)]
    assert kinds("IBAN DE88370400440532013000 250 EUR") == [] and kinds("IBAN DE89370400440532013000X") == []


def test_long_accounts_and_logins():
    assert kinds("account no. " + "1234567890" * 3) == [("account", "1234567890" * 3)]
    user, password = "u" * 90, "p" * 200
    assert kinds(f"https://{user}:{password}@host.example/x") == [("login", f"{user}:{password}@host.example")]
    assert kinds(f"https://{user}@host.example") == [("login", f"{user}@host.example")]


def test_linear():
    for t in ("://" + "a" * 200_000, "IBAN " + "DE89 " * 50_000, "account " + "1 " * 200_000, "://a:" * 50_000):
        pii.finder()(t)
