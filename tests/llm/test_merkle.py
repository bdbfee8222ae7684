"""The Merkle manifest against a recursive definition."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from understory.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def proofs(level):
    """(root, siblings of each place from below, as (left, right))."""
    if len(level) == 1:
        return level[0], [[]]
    runs = [level[i : i + 2] for i in range(0, len(level), 2)]
    root, above = proofs([sha(*run) for run in runs])
    return root, [[(run[:j], run[j + 1 :]), *above[i]] for i, run in enumerate(runs) for j in range(len(run))]


def brute(data):
    groups = {}
    for row in data:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    below = {g: proofs([leaf(r) for r in groups[g]]) for g in names}
    root, above = proofs([below[g][0] for g in names]) if names else (None, [])
    out = []
    for g, upper in zip(names, above):
        for row, lower in zip(groups[g], below[g][1]):
            changed = list(row)
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                changed[3] += 1
            folded = leaf(changed)
            for left, right in lower + upper:
                folded = sha(*left, folded, *right)
            out.append((row[0], leaf(row), below[g][0], root, sha(*(x for a, b in lower + upper for x in a + b)), folded, folded == root))
    return sorted(out, key=str)


def table(n):
    langs = ["en", "de", None, "fr", "é", "", "=", "z"]
    return [(i * 37 % 101 - 20 if i % 13 else None, ["web", None][i % 5 == 0], langs[i % 3 if i < n - 9 else i % 8], i if i % 11 else None, [f"text {i} é", "", None][i % 3]) for i in range(n)]


@pytest.mark.parametrize(("n", "bits"), [(1, 10), (2, 1), (9, 2), (60, 1), (150, 10)])
def test_proofs_by_definition(spark, n, bits):
    data = table(n) + table(n)[:3]  # repeated rows and ids
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("mine") for c in ("key", "grp", "digest", "rank", "_part", "root")}).repartition(4)
    got = merkle.manifest(df, bits=bits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows(got) == brute(data)


def test_a_long_text_and_no_rows(spark):
    data = [(7, "s", "en", 2_000_000, "é" * 2_000_000)]
    assert rows(merkle.manifest(spark.createDataFrame(data, SCHEMA))) == brute(data)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_group_may_hold_nearly_all_rows(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'s' AS source", "IF(id = 5, 'x', 'en') AS lang", "id AS n_chars", "CAST(id AS STRING) AS text")
    got = merkle.manifest(df, bits=4)
    assert rows(got) == brute([tuple(r) for r in df.collect()])
    hit = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 == 0]
    assert got.where("NOT verified").count() == len(hit)
