"""Legal rows that are hard: very long runs, ids that repeat, columns that bear inner names."""

from __future__ import annotations

import collections
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from understory.llm import mixing, packing, pii, secrets, simhash

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
CLASHING = ("_id", "_size", "_place", "_total", "_key", "_row", "_class", "_others", "class", "root", "n", "lost", "_cut", "a.b")


def table(spark, data, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(data, schema).withColumns({c: F.lit("mine") for c in CLASHING})


@pytest.mark.parametrize("fill", [" ", "\n", "\xa0", "\t ", "0", "a", "="])
def test_a_million_equal_characters_are_packed(spark, fill):
    text = "a" + fill * 1_000_000 + "b"
    got = packing.pack_documents(spark.createDataFrame([(1, text), (2, "word")], "doc_id long, text string"), *VOCABULARY)
    ids = packing.Encoder(VOCABULARY[0]).encode(text)
    assert got.where("doc_id = 1").agg(F.sum("length")).first()[0] == len(ids) + 1
    assert packing.Encoder(*VOCABULARY).encode(text) == ids


def test_one_length_that_all_have_is_placed_gapless(spark):
    df = spark.createDataFrame([(1, "same words")] * 3000 + [(i, "other words here") for i in range(900)], "doc_id long, text string").repartition(7)
    got = packing.pack_documents(df, *VOCABULARY).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) == 3900 and (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    assert got.groupby("sequence_id").length.sum().max() <= 1024 and got.sequence_id.nunique() == -(-got.length.sum() // 1024)


def test_long_zero_padded_addresses():
    find = pii.finder()
    for t, n in (("0" * 5000 + "1.2.3.4", 1), ("1.2.3." + "0" * 6000, 1), ("1.2.3." + "0" * 6000 + "256", 0), ("9" * 6000 + ".1.1.1", 0)):
        assert [s[0] for s in find(t)[0]].count("ip") == n


def test_dates_and_fillers_are_no_accounts():
    kinds = lambda t: [t[a:b] for k, a, b in pii.finder()(t)[1] if k == "account"]
    assert kinds("account 2023 10 15 99 and account 000000000") == []
    assert kinds("account: 2023 1015 99, Konto 55-667788") == ["2023 1015 99", "55-667788"]


def classes(run, rule):
    """Least entropy of each class a whole string belongs to, written without patterns."""
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    has = any(c in digit for c in run)
    one = all(c in lower for c in run) or all(c in upper for c in run)
    free = rule.letters if one else rule.mixed
    out = [rule.base64 if has else free]
    if all(c in lower + digit for c in run) or all(c in upper + digit for c in run):
        out.append(rule.base36 if has else free)
    if all(c in digit + "abcdef" for c in run) or all(c in digit + "ABCDEF" for c in run):
        out.append(rule.hex)
    return out


def best_window(run, width):
    n = min(width, len(run))
    return max(-sum(c / n * math.log2(c / n) for c in collections.Counter(run[i : i + n]).values()) for i in range(len(run) - n + 1))


def test_runs_of_each_class_are_judged_by_brute_force():
    import re

    rule, r = secrets.Entropy(allow=(r"[0-9_/-]+",)), random.Random(2)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ab01", "+/-_", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    ranges = (r"[A-Za-z0-9+/_-]+", r"[0-9a-z]+", r"[0-9A-Z]+", r"[0-9a-f]+", r"[0-9A-F]+")
    found_some = 0
    for _ in range(600):
        t = "".join("".join(r.choices(r.choice(alphabets), k=r.choice([1, 3, 19, 20, 24, 40]))) + r.choice(["", "", " ", "/", "-"]) for _ in range(r.randint(1, 4)))
        want = set()
        for outer in re.finditer(ranges[0], t):
            if len(outer[0]) < 20 or re.fullmatch(rule.allow[0], outer[0]):
                continue
            hits = set()
            for k, pattern in enumerate(ranges):
                for m in re.finditer(pattern, outer[0]):
                    n = (0, 1, 1, 2, 2)[k]
                    limits = classes(m[0], rule)
                    limit = limits[n] if n < len(limits) else None
                    if len(m[0]) >= 20 and not re.fullmatch(rule.allow[0], m[0]) and best_window(m[0], rule.width) >= limit - 1e-9:
                        hits.add((outer.start() + m.start(), outer.start() + m.end()))
            want |= {h for h in hits if not any(o != h and o[0] <= h[0] and h[1] <= o[1] for o in hits)}
        got = {(a, b) for _, a, b in secrets.finder(rule)(t)[1]}
        found_some += len(want)
        assert got == want, t
    assert found_some > 200


def test_values_of_letters_and_glued_digests_are_found():
    extra = lambda t: [t[a:b] for _, a, b in secrets.finder()(t)[1]]
    assert extra("KEY=wJalrXUtnFEMIKMDENGbPxRfiCYEXAMPLEQZ") == ["wJalrXUtnFEMIKMDENGbPxRfiCYEXAMPLEQZ"]
    digest = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638"
    assert any(digest in x for x in extra(f"path/to/{digest}-file"))
    for harmless in ("InternationalAccountSettingsController", "Some-Ordinary-Slug-Of-Words/And-More", "thequestionsofordinarypeople", "AWS_SECRET_ACCESS_KEY"):
        assert extra(harmless) == [], harmless


def test_stages_keep_columns_of_any_name(spark):
    texts = ["a b c d e f", "a b c d e f", None, "", "g h i", "j k l m n o p q"]
    df = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for stage in (simhash.keep_one, mixing.mixed_documents):
        out = stage(df)
        assert out.columns == df.columns and out.count() > 0
        assert all(x[c] == "mine" for x in out.collect() for c in CLASHING)
    assert {x.doc_id for x in simhash.keep_one(df).collect()} == {0, 2, 4, 5}
    assert simhash.keep_one(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_mixed_in_part(spark):
    data = [(None, "a b c", "s")] * 500 + [(i, "a b c d", "s") for i in range(100)] + [(None, "x y", "t")] * 700 + [(5, "", "t")] * 20
    df = table(spark, data).repartition(6)
    got = mixing.mix(df)
    sums = {x.source_size: (x.n, x.target) for x in got.groupBy("source_size").agg(F.sum("taken").alias("n"), F.max("target").alias("target")).collect()}
    assert set(sums) == {1900, 1400} and all(abs(n - target) <= 4 for n, target in sums.values())
    assert rows(got) == rows(mixing.mix(table(spark, data).repartition(3)))
    n = mixing.mixed_documents(df).groupBy("source").agg(F.sum(mixing.words(F.col("text")))).collect()
    assert sorted(x[1] for x in n) == sorted(int(v[0]) for v in sums.values())


def test_empty_texts_come_at_most_twice(spark):
    df = table(spark, [(i, "" if i % 2 else "a b", "s" if i < 20 else "t") for i in range(40)])
    counts = collections.Counter(x.doc_id for x in mixing.mixed_documents(df).collect())
    assert max(counts.values()) <= 2
