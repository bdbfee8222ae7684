"""Spans of found text, and the digest columns that describe them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from .shared import map_texts

Span = tuple[str, int, int]


def joined(spans: Sequence[Span], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind in the given order, comma-joined; code points, end exclusive."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], order[s[0]], s[2])))


def span_table(docs: DataFrame, find: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]], base: Sequence[str], extra: Sequence[str], key: str, text: str) -> DataFrame:
    """One row a document: n_<kind> for each base kind, base_sha256 over the base spans, and all spans as a string.

    ``find`` makes, once a task, the function that gives base and added spans of a text. Null texts count as empty:
    no spans, and the digest of the empty string. Rows with equal ids each give their own row.
    """
    order = {k: i for i, k in enumerate([*base, *extra])}
    counts = [f"n_{k}" for k in base]

    def run(keys: list, texts: list, made: list = []) -> dict[str, list]:  # noqa: B006  one finder for a task
        if not made:
            made.append(find())
        out: dict[str, list] = {n: [] for n in ["doc_id", *counts, "base_sha256", "spans"]}
        for k, t in zip(keys, texts, strict=True):
            sure, added = made[0](t) if t else ([], [])
            out["doc_id"].append(k)
            for kind in base:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in sure))
            out["base_sha256"].append(hashlib.sha256(joined(sure, order).encode()).hexdigest())
            out["spans"].append(joined([*sure, *added], order))
        return out

    schema = ", ".join(["doc_id bigint", *(f"{n} bigint" for n in counts), "base_sha256 string", "spans string"])
    return map_texts(docs, key, text, schema, run)


def masked(text: str, spans: Sequence[Span]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
