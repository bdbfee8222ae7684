"""Compression verdicts of short texts and of the bytes after the last full chunk."""

from __future__ import annotations

import random

import zstandard

from understory.llm import quality

SQUEEZE = zstandard.ZstdCompressor(level=3)


def test_tail_is_judged():
    r = random.Random(0)
    prose = " ".join("".join(r.choices("etaoinshrdlucmfw", k=r.randint(1, 9))) for _ in range(2000)).encode()
    share = lambda raw: quality.compression_verdict(raw, quality.Bands(), SQUEEZE)[1]
    assert share(prose[:4096]) == 0 and share(prose[:2048] + r.randbytes(2047)) == 0.5
    assert share(prose[:2048]) == 0 and share(prose[:2047]) is None


def test_short_texts_are_judged():
    r = random.Random(1)
    fine = lambda raw: quality.compression_verdict(raw, quality.Bands(), SQUEEZE)[2]
    prose = b"It was late in the day when we came to the old mill by the river, and no one had lit a lamp in any of its windows yet."
    assert fine(prose) and fine(prose + b" We went in all the same, since rain was on its way from the hills.")
    assert not any(fine(b) for n in (100, 127, 128, 200, 255) for b in (r.randbytes(n), (b"a b " * 64)[:n]))
