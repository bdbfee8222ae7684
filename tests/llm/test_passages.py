"""Passages: what is removed always stays elsewhere, and chance blocks hide no passage."""

from __future__ import annotations

from test_links import documents, words

from understory.llm import passages


def covered(spans, low, high):
    return sum(max(0, min(b, high) - max(a, low)) for a, b in spans) / (high - low)


def test_first_place_of_each_passage_stays(spark):
    x, y, c = words(1, 80), words(2, 80), words(3, 24)
    around = lambda i, t: words(100 + i, 40) + " " + t + " " + words(200 + i, 40)
    texts = [around(i, t) for i, t in enumerate([f"{x} {c}", f"{x} {c}", f"{y} {c}", f"{y} {c}"])]
    texts += [around(i, t) for i, t in enumerate([words(4, 80), words(4, 80) + " " + words(5, 80), words(5, 80)], 4)]
    gone = {i: [] for i in range(7)}
    for r in passages.repeated(documents(spark, texts)).collect():
        if r.removed:
            gone[r.doc_id].append((r.start, r.stop))
    assert covered(gone[0], 40, 144) == 0 and covered(gone[1], 40, 144) > 0.5
    assert covered(gone[2], 40, 120) == 0 and covered(gone[3], 40, 120) > 0.5
    assert not gone[4] and covered(gone[5], 40, 120) > 0.5 and covered(gone[5], 120, 200) == 0 and covered(gone[6], 40, 120) > 0.5


def test_chance_blocks_hide_no_passage():
    how = passages.Passages()
    core = [(100 + 7 * k, 7) for k in range(5)]
    assert passages.passages_of([(84, 6), *core, (145, 6)], how) == [(1, 6)]
    assert passages.passages_of(core, how) == [(0, 5)] and passages.passages_of(core[:2], how) == []
    edited = [(0, 15), (20, 15), (47, 5)]  # a gap inside stays bridged
    assert passages.passages_of(edited, how) == [(0, 2)]


def test_rows_that_repeat_an_id_are_texts_of_their_own(spark):
    shared = words(1, 70)
    a, b = words(2, 50) + " " + shared + " " + words(3, 40), words(4, 90) + " " + shared
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, words(5, 200))], "doc_id long, text string")
    got = [(r.doc_id, r.start, r.stop, r.removed) for r in passages.repeated(df).collect() if r.kind == "passage"]
    kept, gone = [x for x in got if not x[3]], [x for x in got if x[3]]
    assert {x[0] for x in got} == {1} and covered([(s, e) for _, s, e, _ in kept], 50, 120) + covered([(s, e) for _, s, e, _ in kept], 90, 160) > 0.5
    assert sum(e - s for _, s, e, _ in gone) > 35
    assert passages.repeated(df.where("doc_id = 2")).isEmpty()


def test_a_shingle_that_all_lines_share_makes_no_band_of_all(spark):
    how = passages.Passages()
    df = documents(spark, [words(i, 40) + " one very common closing line" for i in range(300)])
    keyed = passages.paragraph_rows(df, how)
    most = keyed.selectExpr("explode(keys) AS k").groupBy("k").count().agg({"count": "max"}).first()[0]
    assert how.bands * how.rows == 10 and most < 30
