"""Spelling variants against all pairs of a small vocabulary."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from understory.llm import variants


def words_of(data):
    """n of each word, straight from the definition."""
    counts = collections.Counter()
    for key, text in data:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0])
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(data):
    n = words_of(data)
    near = {w: [v for v in n if v != w and one_apart(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def texts(seed):
    """Words with typing errors, in chains and crowds; letters beyond ASCII too."""
    r = random.Random(seed)
    stems = ["telephone", "commencement", "aaaaaaa", "aaaaaaaa", "élémentaire", "Straßenbahn", "abababab", "x" * 30] + ["".join(r.choices("abcé", k=8)) for _ in range(6)]

    def wrong(w):
        i, c = r.randrange(len(w)), r.choice("abcdeéÿ")
        return r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])

    vocabulary = stems + [wrong(w) for w in stems for _ in range(8)]
    vocabulary += [wrong(w) for w in vocabulary[len(stems) :]]
    weights = [200 if w in stems[:4] else r.choice([1, 2, 25]) for w in vocabulary]
    return [(i if i % 9 else None, r.choice([" ", ", ", "1", "_", "÷ "]).join(r.choices(vocabulary, weights, k=60))) for i in range(60)]


@pytest.mark.parametrize("most", [2048, 3])
def test_words_forms_and_roots_by_brute_force(spark, most):
    chain = " ".join(["lanternfish"] * 2000 + ["lantermfish"] * 90 + ["lantermfisk"] * 3)
    data = texts(7) + [(10, chain), (11, chain), (5, None), (6, ""), (7, "short ones 1234567 only"), (8, "Q" * 5000 + " " + "Q" * 5000), (9, "Q" * 4999 + " " + "Q" * 4999)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "id", "run", "size", "part")}).repartition(6)
    got = {tuple(x) for x in variants.group_variants(df, most=most).collect()}
    want = brute(data)
    assert got == want
    assert sum(x[1] is not None for x in want) > 10 and any(x[2] not in (x[0], x[1]) for x in want) and any(len(x[0]) > 4000 for x in want)


def test_no_part_is_larger_than_asked_for(spark):
    # a crowd of words that share all but their ends
    words = spark.range(3000).select(F.concat(F.lit("international"), F.translate(F.lpad(F.col("id").cast("string"), 5, "0"), "0123456789", "abcdefghij")).alias("word"), F.lit(2).cast("bigint").alias("n"))
    dealt = variants.parts(words, 50)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"), F.max(F.col("to") - F.col("start")).alias("wide"))
    assert sizes.where("n > 50 AND wide > 1").count() == 0 and sizes.where("n > 1").count() > 50
    pairs = variants.near_words(words, 50)
    names = [x.word for x in words.collect()]
    by_gap = collections.Counter((w[:i], w[i + 1 :]) for w in names for i in range(len(w)))
    assert pairs.count() == sum(n * (n - 1) for n in by_gap.values())
    assert pairs.distinct().count() == pairs.count()


def test_an_acceptor_is_minimal_and_reads_its_words():
    words = sorted({"tap", "taps", "top", "tops", "a", "", "stops"})
    a = variants.Acceptor(words)

    def read(q, lead=""):
        return ([lead] if a.final[q] else []) + [w for c, p in sorted(a.arcs[q].items()) for w in read(p, lead + c)]

    assert sorted(read(a.start)) == words
    assert len({(a.final[q], *a.arcs[q].items()) for q in range(len(a.arcs))}) == len(a.arcs)
    deep = sorted("b" * i + "a" * (3000 - i) for i in range(3000))  # a state for each letter, no recursion
    assert len(variants.Acceptor(deep).arcs) < 10_000


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(df).count() == 0
