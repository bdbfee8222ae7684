"""Operators on single texts: quality rules, personal data, secrets, packing, mixing."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from conftest import rows
from pyspark.sql import functions as F

from understory.llm import mixing, packing, pii, quality, queries, secrets

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
LONG = "word " * 60_000 + "tail"
TEXTS = [None, "", " \n\t ", "one", LONG, "same text here", "same text here", "x" * 200_000, "é ü ñ 中文 \x1f \xa0 b"]


def docs(spark, texts, clash=True):
    """Documents with ids in order; extra columns bear the names that the operators use inside or return."""
    df = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 4 else None, "en", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("kept", "spans", "size", "taken", "piece", "length", "offset", "component_id", "fp", "root", "key")}) if clash else df


# quality rules


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_counts_by_brute_force():
    r = random.Random(0)
    for _ in range(400):
        t = "".join(r.choice(["a", "bb", "c#", "<d>", " ", "  ", "\n", "\t", "\xa0", "é", "\x1f", "\n\n"]) for _ in range(r.randint(0, 80)))
        n, chars, symbols, lines, repeats, failed = brute_quality(t)
        assert quality.base_counts(t) == (n, chars, symbols, lines, repeats)


def test_quality_query(spark):
    r = random.Random(1)
    prose = [" ".join("".join(r.choices("etaoinshrdlucmfw", k=r.randint(1, 9))) for _ in range(n)) for n in (60, 300, 3000)]
    noise = "".join(chr(r.randrange(0x4E00, 0x9FFF)) + (" " if i % 5 == 0 else "") for i in range(4000))
    got = {x.doc_id: x for x in quality.judge(docs(spark, [*TEXTS, *prose, noise])).collect()}
    assert len(got) == len(TEXTS) + 4
    for i, t in enumerate([*TEXTS, *prose]):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == brute_quality(t)
    k = len(TEXTS)
    assert [got[k + i].kept for i in range(3)] == [True] * 3 and not got[4].kept and not got[0].kept
    assert quality.judge(docs(spark, [])).count() == 0


def test_bands_reject_repetition_and_noise():
    squeeze = zstandard.ZstdCompressor(level=3)
    verdict = lambda raw: quality.compression_verdict(raw, quality.Bands(), squeeze)[2]
    assert not verdict(b"All work and no play. " * 200) and not verdict(random.Random(0).randbytes(5000))
    assert verdict(b"short") and verdict(b"")
    half = b"All work and no play. " * 100 + random.Random(0).randbytes(2300)
    assert not verdict(half)  # the whole looks normal, its chunks do not


def test_keep_good_keeps_rows_and_columns(spark):
    df = docs(spark, [*TEXTS, " ".join(f"w{i}q{i * 7 % 31}" for i in range(80))])
    out = quality.keep_good(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [len(TEXTS)]


# personal data and secrets


def joined(spans, order):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]))))


def brute_personal(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def brute_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]


PARTS = ["@", ".", "a", "b.c", "1", "12", "300", "+", "-", " ", "()", "4111 1111 1111 1111", "x@y.z", "+1 (017) 555-7713", "10.0.0.1", "é", "token", "Secret", "API_KEY", "\"", "'", "=", ":", "0123456789abcdef", "AKIAABCDEFGH1234", "g", "deadbeef" * 5, "ſecret", "\n"]


@pytest.mark.parametrize(("module", "brute"), [(pii, brute_personal), (secrets, brute_secrets)])
def test_base_spans_by_brute_force(module, brute):
    r, find = random.Random(7), module.finder()
    for _ in range(20_000):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))
        assert sorted(find(t)[0]) == sorted(brute(t)), t


@pytest.mark.parametrize(("fn", "module", "brute"), [(pii.find_personal, pii, brute_personal), (secrets.find_secrets, secrets, brute_secrets)])
def test_span_tables(spark, fn, module, brute):
    texts = [*TEXTS, "mail bob@example.com or +1 (017) 555-7713", 'token = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638" 10.0.0.1', "é 4111 1111 1111 1111"]
    got = {r.doc_id: r for r in fn(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute(t) if t and len(t) < 10_000 else []
        assert got[i].base_sha256 == hashlib.sha256(joined(want, module.BASE).encode()).hexdigest()
        assert all(getattr(got[i], f"n_{k}") == sum(s[0] == k for s in want) for k in module.BASE)
        assert set(joined(want, module.BASE).split(",")) <= set(got[i].spans.split(","))
    assert fn(docs(spark, [])).count() == 0


def test_added_personal_spans():
    find = pii.finder()
    kinds = lambda t: [(k, t[a:b]) for k, a, b in find(t)[1]]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01") == []
    assert kinds("SSN: 123-45-6789, SSN 000-12-3456") == [("ssn", "123-45-6789")]
    assert kinds("account no. 12345678 on account of") == [("account", "12345678")]
    assert kinds("ftp://bob:pw@host.example/x http://plain.example/a@b") == [("login", "bob:pw@host.example")]


def test_finders_are_linear_in_hostile_texts():
    for t in ("a" * 200_000 + "@", "1." * 100_000, "1" * 200_000, "+1" * 100_000, "token" + " " * 200_000, "f" * 200_000, "Ab1" * 60_000, "@" * 100_000):
        pii.finder()(t)
        secrets.finder()(t)


def test_window_entropy_by_brute_force():
    r = random.Random(3)
    for _ in range(500):
        w = "".join(r.choice("abcd01") for _ in range(r.randint(1, 50)))
        n = min(20, len(w))
        want = max(-sum(c / n * math.log2(c / n) for c in collections.Counter(w[i : i + n]).values()) for i in range(len(w) - n + 1))
        assert secrets.highest_entropy(w, 20) == pytest.approx(want)


def test_entropy_and_its_allow_list():
    extra = lambda t: [t[a:b] for _, a, b in secrets.finder()(t)[1]]
    assert extra("key q7Zp0vXb93LmTr5Ks8Wy2Hd here") == ["q7Zp0vXb93LmTr5Ks8Wy2Hd"]
    for harmless in ("an-ordinary-slug-of-words-in-a-path", "2024-01-02/2024-02-03_12345", "123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaaa1", "Donaudampfschifffahrtsgesellschaft"):
        assert extra(harmless) == []


def test_masked_secrets_are_gone(spark):
    df = docs(spark, [*TEXTS, 'x token = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638" y'])
    out = {r.doc_id: r for r in secrets.mask_secrets(df).collect()}
    last = out[len(TEXTS)]
    assert last.text == 'x <assign>" y' and last.n_chars == len(last.text) and out[0].text is None and out[3].text == "one"


# packing


def test_encoder_gives_the_tokenizers_ids():
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r, own = random.Random(5), packing.Encoder(*RANKS)
    texts = ["".join(r.choice([" ", "a", "'s", "1", "\n", ",", "é", "\xa0", "\x85", "中", "<|endoftext|>", "\r\n", "\t", "Word"]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    assert [own.encode(t) for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert packing.PATTERN == public_tokenizers.PATTERN


def test_plan_by_simulation():
    r = random.Random(0)
    for _ in range(400):
        cap = r.choice([10, 16, 31])
        counts = {r.randint(1, cap): r.randint(1, 30) for _ in range(r.randint(0, 8))}
        used, got = collections.defaultdict(list), collections.Counter()
        for length, a, b, first, each, offset in packing.plan(counts, cap):
            for k in range(b - a):
                used[first + k // each].append((offset + k % each * length, length))
            got[length] += b - a
        assert got == counts
        assert sorted(used) == list(range(len(used)))
        for held in used.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= cap and sum(3 * x > cap for _, x in held) <= 2
        assert len(used) <= 1.25 * -(-sum(k * v for k, v in counts.items()) // cap) + sum(v for k, v in counts.items() if 2 * k > cap)


def test_packing_covers_every_token(spark):
    texts = [*TEXTS[:4], "word " * 3000, *TEXTS[5:7], "x y z " * 500, TEXTS[8]] * 2
    got = packing.pack_documents(docs(spark, texts), *RANKS).toPandas()
    own = packing.Encoder(*RANKS)
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t or ""), 2], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert list(mine.piece) == list(range(len(mine))) and mine.length.sum() == len(ids) and (mine.length[1:] == 1024).all()
        for p in mine.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        assert len(mine) == -(-len(ids) // 1024)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all() and got.groupby("sequence_id").length.sum().max() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 1
    assert packing.pack_documents(docs(spark, []), *RANKS).count() == 0


# mixing


def test_mix_by_brute_force(spark):
    r = random.Random(11)
    texts = [None, ""] + [" ".join("w" * r.randint(1, 14) for _ in range(r.randint(0, 60))) for _ in range(300)]
    df = docs(spark, texts)
    got = {x.doc_id: x for x in mixing.mix(df).collect()}
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    source = {x.doc_id: x.source for x in df.collect()}
    names = sorted({s for s in source.values() if s}) + [None]
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weight = dict(zip(names, [3, 1, 2, 3], strict=True))
    target, left, full = {}, 1.5 * sum(total.values()), set()
    while True:
        level = left / sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and weight[s] * level > 2 * total[s]]
        if not over:
            break
        s = min(over, key=lambda n: total[n] / weight[n])
        full.add(s)
        left -= 2 * total[s]
    for s in names:
        target[s] = 2 * total[s] if s in full else weight[s] * level
    for i, x in got.items():
        assert x.size == size[i] and x.source_size == total[source[i]] and x.target == pytest.approx(target[source[i]]) and x.taken % max(x.size, 1) == 0 and x.taken <= 2 * x.size
    for s in names:
        assert abs(sum(got[i].taken for i in got if source[i] == s) - target[s]) <= 30
    assert rows(mixing.mix(df)) == rows(mixing.mix(df.repartition(5)))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_ranges_do_not_change_the_mix(spark, monkeypatch):
    df = docs(spark, [" ".join(["word"] * (i % 17)) for i in range(400)])
    want = rows(mixing.mix(df))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    assert rows(mixing.mix(df)) == want


def test_mixed_documents_repeat_rows(spark):
    df = docs(spark, ["a b c d"] * 40 + [None])
    taken = {x.doc_id: x.taken for x in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    counts = collections.Counter(x.doc_id for x in out.collect())
    assert out.columns == df.columns and all(counts[i] == taken[i] / 4 for i in range(40))


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
