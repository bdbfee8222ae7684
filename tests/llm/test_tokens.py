"""Token counts against the library itself."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from understory.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "▁", "\n", "\t", "a", "aa", "e", "er", "in", "the", "=", "-", "--", "#", "0", "1", "é", "日", "本", "の", "😀", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "�", ".", "..", "http", "://", "A", "ing", "tion", "'", "{", "}", "\r", "​", "ﬁ", "ко", "ра"]
HARD = ["", " ", "   ", "▁", "\n" * 5000, " " * 10_001, "a" * 10_003, "ab" * 5000, "=" * 9999, "é" * 4000, "x" * 7 + "-" * 9001, "日本" * 3000, "word " * 4000, "\x00", "😀" * 3000]


@pytest.fixture(scope="module")
def machine():
    return tokens.Transducer(MODEL)


@pytest.fixture(scope="module")
def library():
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda text: len(processor.encode(text))


def test_counts_of_mixtures_and_hard_texts(machine, library):
    r = random.Random(1)
    for k in range(6000):
        t = "".join(r.choices(PARTS if k % 2 else r.sample(PARTS, 4), k=r.randint(1, 40)))
        assert machine.count(t) == library(t), repr(t)
    for t in [*HARD, "".join(r.choices("abcdefghij", k=20_000)), "".join(r.choices("ab ", k=20_000))]:
        assert machine.count(t) == library(t), repr(t[:20])


def test_chunk_maps_compose_in_any_brackets(machine, library):
    r = random.Random(2)
    for k in range(300):
        t = "".join(r.choices(PARTS if k % 2 else ["a", "b", "ab", "▁"], k=60))
        text = tokens.BLANK + t.replace(" ", tokens.BLANK)
        at = sorted({0, len(text), *(r.randint(0, len(text)) for _ in range(r.randint(0, 12)))})
        maps = [machine.chunk_map(text[i:j]) for i, j in zip(at, at[1:])]
        while len(maps) > 1:
            i = r.randrange(len(maps) - 1)
            maps[i : i + 2] = [machine.compose(maps[i], maps[i + 1])]
        assert machine.through(machine.start, maps[0])[1] == library(t)


def test_few_states_at_a_time_give_the_same_counts(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_STATES", 50)
    monkeypatch.setattr(tokens, "MOST_RUNS", 10)
    small, r = tokens.Transducer(MODEL), random.Random(3)
    for _ in range(300):
        t = "".join(r.choices(PARTS, k=60))
        assert small.count(t) == library(t)
        assert len(small.states) <= 51


def test_tokens_are_apart_as_their_string_says(machine):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r, names = random.Random(4), [n for n in machine.score if not n.startswith("▁")]
    for _ in range(5000):
        a, b = r.choice(names), r.choice(names)
        pieces = processor.encode("\n" + a + b, out_type=str)[2:]
        assert machine.stays_apart(a, b) == (pieces == [a, b])


def test_rows_of_any_kind(spark, library):
    data = [(1, "some words here"), (1, "some words here"), (None, "x"), (2, None), (3, ""), (4, "word " * 5000)] + [(10 + i, t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("_key", "_text", "n_tokens", "class")}).repartition(5)
    got = tokens.count_tokens(df, MODEL)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows(got) == sorted([(k, len((t or "").encode()), n, n > 4096) for k, t in data for n in [library(t or "")]], key=str)
    assert tokens.count_tokens(df.limit(0), MODEL).count() == 0
