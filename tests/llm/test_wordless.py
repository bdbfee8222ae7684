"""Near copies among texts without words, and no texts at all."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.llm.quality import keep_good
from understory.llm.similar import similar_texts


def test_wordless_texts_are_alike(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "\n"), (5, "word"), (6, "word"), (7, "other")], "doc_id long, text string")
    found = {r["node"]: r["root"] for r in similar_texts(docs).collect()}
    classes = {r["doc_id"]: r["c"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    root = {d: found.get(c, c) for d, c in classes.items()}
    assert root[1] == root[2] == root[3] == root[4] and root[5] == root[6]
    assert len({root[1], root[5], root[7]}) == 3
    assert similar_texts(docs.limit(0)).count() == 0
    assert keep_good(docs).count() == keep_good(docs.limit(0)).count() == 0
