"""Secrets: key assignments, access keys and hex runs, and high-entropy strings by sliding windows.

A candidate string is a maximal run of one character class: base-64, and in it base-36 and hex in either case. A
window slides over it; the Shannon entropy of the window follows from counts that are changed by one character in and
one out. Allow-listed shapes (joined words, UUIDs, digests named as such, dates, and slugs and paths whose parts are all
ordinary) are suppressed. Of nested runs
that are both found the longer one is reported.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from operator import itemgetter

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .spans import Span, masked, span_table

BASE = ("assign", "access", "hex")
EXTRA = ("entropy",)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A)
CUE = re.compile(r"[dDtTnNyY][\"']?\x20*[:=]")
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,}+)={0,2}+(?![A-Za-z0-9+/_=-])")
#: Classes in a base-64 run, by case; maximal runs of each are judged by themselves.
FINER = tuple((("base36", re.compile(f"[0-9{z}]{{20,}}+")), ("hex", re.compile(f"[0-9{f}]{{20,}}+"))) for z, f in (("a-z", "a-f"), ("A-Z", "A-F")))
DIGIT = re.compile(r"[0-9]")
#: What parts of slugs and paths are: words (also with a short number), words joined by capitals, initials, numbers, ordinals.
SEGMENT = r"(?:[A-Z]?+[a-z]++[0-9]{0,4}+|[A-Z]?+[a-z]++(?:[A-Z][a-z]++)+|[A-Z]++[0-9]{0,4}+|[0-9]{1,12}+(?:[a-z]{1,2}+)?)(?![A-Za-z0-9])"
DIGEST = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5)[:=]\x20?$", re.I | re.A)
ONE_CASE = re.compile(r"[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Entropy:
    """Window width, and the least entropy in bits a character of each class; strings without digits have limits of their own."""

    width: int = 20
    hex: float = 3.0
    base36: float = 3.6
    base64: float = 3.9
    letters: float = 3.8  # of one case
    mixed: float = 4.0  # letters of both cases, or letters and signs
    allow: tuple[str, ...] = (
        r"[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})+",  # words joined by capitals
        r"[0-9_/-]+",  # numbers and dates
        f"[/_-]*+{SEGMENT}(?:[/_-]++{SEGMENT})+[/_-]*+",  # slugs and paths, each part of which is ordinary
        r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUIDs
        r"(?:sha(?:1|256|384|512)|md5)-.*",  # integrity digests
    )

    def least(self, kind: str, run: str) -> float:
        """The entropy that a run of a class needs."""
        if kind == "hex" or DIGIT.search(run):
            return getattr(self, kind)
        return self.letters if ONE_CASE.fullmatch(run) else self.mixed


def highest_entropy(text: str, width: int) -> float:
    """The highest entropy, in bits a character, of any window of ``width`` characters (or of all, if fewer)."""
    width = min(width, len(text))
    term = [0.0, *(c * math.log2(c) for c in range(1, width + 2))]
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log c over the window
    best = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i >= width:
            old = text[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += term[n - 1] - term[n]
        if i >= width - 1:
            best = max(best, math.log2(width) - total / width)
    return best


def finder(rule: Entropy = Entropy()) -> Callable[[str], tuple[list[Span], list[Span]]]:
    """A function giving base and added spans of a text."""
    allowed = re.compile("|".join(f"(?:{x})" for x in rule.allow))

    def secret(kind: str, run: str) -> bool:
        return not allowed.fullmatch(run) and highest_entropy(run, rule.width) >= rule.least(kind, run)

    def find(text: str) -> tuple[list[Span], list[Span]]:
        base: list[Span] = []
        if CUE.search(text):
            base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            base += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
        base += [("hex", *m.span()) for m in HEX.finditer(text)]
        extra: list[Span] = []
        for m in CANDIDATE.finditer(text):
            if allowed.fullmatch(m[0]) or DIGEST.search(text[max(0, m.start() - 10) : m.start()]):
                continue
            if secret("base64", m[1]):
                extra.append(("entropy", *m.span()))
                continue
            inner: set[tuple[int, int]] = set()
            for case in FINER:
                found: list[tuple[int, int]] = []  # of the wider class, in order
                for kind, runs in case:
                    new = []
                    for r in runs.finditer(m[1]):
                        at = bisect_right(found, r.start(), key=itemgetter(0)) - 1
                        if (at < 0 or found[at][1] < r.end()) and secret(kind, r[0]):
                            new.append(r.span())
                    found = sorted(found + new)
                inner.update(found)
            extra += [("entropy", m.start() + a, m.start() + b) for a, b in sorted(inner)]
        return base, extra

    return find


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Entropy = Entropy()) -> DataFrame:
    """Counts and spans of secrets in every whole text; a pure map over the rows.

    Null and empty texts have none; equal rows give equal results; other columns are not read.
    """
    return span_table(docs, lambda: finder(rule), BASE, EXTRA, key, text)


def mask_secrets(docs: DataFrame, rule: Entropy = Entropy()) -> DataFrame:
    """The documents with every secret in the text replaced by its kind; nulls stay null, n_chars follows the text.

    Rows are mapped one by one: repeated rows give repeated results, an empty table an empty one, and all other columns,
    of any name, stay.
    """

    @pandas_udf("string")
    def clean(texts):
        find = finder(rule)

        def one(t):
            if not t:
                return t
            base, extra = find(t)
            return masked(t, [*base, *extra]) if base or extra else t

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
