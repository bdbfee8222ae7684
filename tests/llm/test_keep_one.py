"""The near-duplicate stage: five-word Jaccard of 0.8, and one row of every group whatever its ids."""

from __future__ import annotations

import random

from test_links import documents, words

from understory.llm import passages, simhash


def test_keep_one_finds_near_copies_by_jaccard(spark):
    r, texts, near = random.Random(5), [], []
    for i in range(60):
        base = words(i, 150).split()
        other = list(base)
        for k in r.sample(range(150), 1 + i % 5):
            other[k] = f"z{k}"
        texts += [" ".join(base), " ".join(other)]
        a, b = (passages.shingle_set(t, 5) for t in texts[-2:])
        near.append(len(a & b) / len(a | b) >= 0.8)
    kept = {x.doc_id for x in simhash.keep_one(documents(spark, texts)).collect()}
    assert 10 < sum(near) < 60
    assert [2 * i + 1 not in kept for i in range(60)] == near and all(2 * i in kept for i in range(60))


def test_every_group_keeps_one_row(spark):
    texts = [words(i, 60) for i in range(5)]
    given = [texts[0], texts[1], texts[2], texts[3], texts[3], texts[4], texts[4], None, ""]
    kept = simhash.keep_one(documents(spark, given, ids=[None, None, 7, 7, 7, None, 9, 4, 4])).collect()
    found = sorted((str(x.doc_id), x.text or "") for x in kept)
    assert found == sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3]), ("9", texts[4]), ("4", "")])


def test_keep_one_links_by_fingerprints(spark):
    """Texts that repeat one phrase and end otherwise share few of their distinct shingles, but their fingerprints."""
    phrase = words(1, 9) + " "
    texts = [phrase * 80 + words(50, 14), phrase * 80 + words(51, 14), words(52, 60), words(53, 60)]
    prints = [simhash.fingerprint(t) for t in texts]
    a, b = (passages.shingle_set(t, 5) for t in texts[:2])
    assert (prints[0] ^ prints[1]).bit_count() <= 2 and len(a & b) / len(a | b) < 0.8
    kept = simhash.keep_one(documents(spark, [*texts, texts[1]], ids=[4, 3, 2, 1, 9])).collect()
    assert sorted(x.doc_id for x in kept) == [1, 2, 3]
