"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, plus signs, digits, schemes, identifier cues); small parsers then
expand from each anchor to the boundaries of an e-mail, address, card, phone or account number and validate it.
Each parser keeps a cursor behind which its kind is done, so the work is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame

from .spans import Span, span_table

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "account", "login")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGITS = re.compile(r"[0-9]++")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[:\x20#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}+)")
SSN = re.compile(r"(?:\x20?(?:no\.?|number|#))?[:\x20]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"(?:\x20?(?:no\.?|number|nr\.?|#))?[:\x20]{1,3}([0-9](?:[\x20-]?[0-9]){5,}+)")
DATE = re.compile(r"(?:19|20)[0-9]{2}[\x20-](?:0[1-9]|1[0-2])[\x20-](?:0[1-9]|[12][0-9]|3[01])(?![0-9])")
LOGIN = re.compile(r"[A-Za-z0-9._%+~-]++(?::[^\s/@]++)?@[A-Za-z0-9.-]+")
#: Characters of an IBAN by country; those of other countries may end at any group.
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG CR DE GB GE IE ME RS VA BH", 23: "AE GI IL IQ TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for code in codes.split()
}
CUES = {"iban": ("IBAN", "iban", "Iban"), "ssn": ("SSN", "ssn", "Social Security", "social security"), "account": ("account", "Account", "acct", "Acct", "Konto", "konto", "cuenta", "Cuenta", "compte", "Compte")}


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def octet(part: str) -> bool:
    """Whether a number is 255 at most; leading zeros, however many, do not count."""
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def iban_valid(code: str) -> bool:
    """Whether the number modulo 97 is 1 once letters stand for 10 to 35."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_end(text: str, start: int, stop: int) -> int | None:
    """Where the IBAN at ``start`` ends: at its country's length, or else the last group end up to ``stop`` that is valid."""
    ends, code = [], ""
    for at in range(start, stop):
        if text[at] != " ":
            code += text[at]
            if len(code) >= 14 and not re.match(r"[A-Za-z0-9]", text[at + 1 : at + 2]):
                ends.append((at + 1, len(code)))
    n = IBAN_LENGTHS.get(code[:2])
    return next((end for end, size in reversed(ends) if size == (n or size) and iban_valid(code[:size])), None)


def finder() -> Callable[[str], tuple[list[Span], list[Span]]]:
    """A function giving base and added spans of a text."""
    anchors = ahocorasick.Automaton()
    for sign in ["@", "+", *"0123456789"]:
        anchors.add_word(sign, ("digit" if sign.isdigit() else sign, 1))
    anchors.add_word("://", ("login", 3))
    for kind, words in CUES.items():
        for w in words:
            anchors.add_word(w, (kind, len(w)))
    anchors.make_automaton()

    def find(text: str) -> tuple[list[Span], list[Span]]:
        base: list[Span] = []
        extra: list[Span] = []
        done = dict.fromkeys(("email", "ip", "card", "phone"), 0)
        for end, (kind, width) in anchors.iter(text):
            at = end + 1 - width
            if kind == "digit":
                if at >= done["ip"]:
                    if m := IP.match(text, at):
                        done["ip"] = m.end()
                        if all(octet(x) for x in m.groups()):
                            base.append(("ip", at, m.end()))
                    else:
                        done["ip"] = DIGITS.match(text, at).end()
                if at >= done["card"]:
                    if m := CARD.match(text, at):
                        done["card"] = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            base.append(("card", at, m.end()))
                    else:
                        done["card"] = end + 1
            elif kind == "@":
                start, floor = at, done["email"]
                while start > floor and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, end + 1)):
                    done["email"] = m.end()
                    base.append(("email", start, m.end()))
                else:
                    done["email"] = max(floor, end + 1)
            elif kind == "+":
                if at >= done["phone"] and (m := PHONE.match(text, at)):
                    done["phone"] = m.end()
                    if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        base.append(("phone", at, m.end()))
            elif kind == "iban":
                if (m := IBAN.match(text, end + 1)) and (stop := iban_end(text, *m.span(1))):
                    extra.append(("iban", m.start(1), stop))
            elif kind == "ssn":
                if (m := SSN.match(text, end + 1)) and m[1][:3] not in ("000", "666") and m[1][0] != "9" and m[1][4:6] != "00" and m[1][7:] != "0000":
                    extra.append(("ssn", *m.span(1)))
            elif kind == "account":
                if (m := ACCOUNT.match(text, end + 1)) and not DATE.match(m[1]) and len(set(m[1]) - {" ", "-"}) > 1:
                    extra.append(("account", *m.span(1)))
            elif m := LOGIN.match(text, end + 1):
                extra.append(("login", *m.span()))
        return base, extra

    return find


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of personal data in every whole text; a pure map over the rows.

    Null and empty texts have none; equal rows give equal results; other columns are not read.
    """
    return span_table(docs, finder, BASE, EXTRA, key, text)
