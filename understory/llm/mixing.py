"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has the exponential key -ln(u) / quality, u being a hash of its id. A source's target is met by whole
epochs first; the rest goes to the documents with the smallest keys, up to the word budget. Where that prefix ends
is found from word counts of small key ranges and then inside the one range that holds the end, so no source,
however large, is sorted by one task. Taking is then a comparison with the source's cut, row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from .shared import apart, cut, together

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 4096  # documents in a key range, on average
SOURCES_SENT = 10_000  # plans of up to so many sources are broadcast; more are joined by shuffle


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality(text: Column, size: Column) -> Column:
    """Weight of a document: half where its words are unlikely short or long on average."""
    mean = F.try_divide(F.length(text), size)
    return F.when((mean >= 3) & (mean <= 12), 1.0).otherwise(0.5)


def keyed(docs: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with _size and _key. Rows of equal ids have equal keys; null ids hash like the string ``null``."""
    size = words(docs[text])
    unit = (F.conv(F.substring(F.sha2(F.concat(F.coalesce(docs[key].cast("string"), F.lit("null")), F.lit(f":{seed}")), 256), 1, 13), 16, 10).cast("bigint") + 0.5) / float(2**52)
    return docs.withColumn("_size", size).withColumn("_key", -F.log(unit) / quality(docs[text], F.col("_size")))


def targets(totals: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``totals`` (source, _total, _docs) with _target: ``share`` of all words by weight, at most ``most`` times a source.

    Sources by code point, null last, take the weights in turn. The sources fullest for their weight are filled
    first; what a filled one cannot take is shared by the others. The windows run over one row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place - 1, F.lit(len(weights))) + 1)
    w = totals.withColumn("_place", place).withColumn("_by", by).withColumn("_cap", most * F.col("_total"))
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("_cap") / F.col("_by"), "_place").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("_total").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    level = left / (F.sum("_by").over(everything) - F.coalesce(F.sum("_by").over(earlier), F.lit(0)))
    full = w.withColumn("_level", level)
    return full.withColumn("_target", F.least(F.col("_cap").cast("double"), F.col("_by") * F.max("_level").over(everything))).select("source", "_total", "_docs", "_place", "_target")


def _range(of: Column, docs: Column) -> Column:
    # 1 - exp(-key) grows with the key and is near uniform, so ranges hold about as many documents each
    ranges = F.ceil(docs / RANGE_ROWS)
    return F.least(F.floor(ranges * (1 - F.exp(-of))), ranges - 1)


def mix_plan(sized: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """One row a source: its target, whole epochs, and the cut up to which documents are taken once more."""
    totals = sized.groupBy("source").agg(F.sum("_size").alias("_total"), F.count("*").alias("_docs"))
    plan = cut(targets(totals, **how).withColumn("_epochs", F.coalesce(F.floor(F.try_divide("_target", "_total")), F.lit(0))).withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_total")))
    rows = cut(sent(sized.select("source", key, "_size", "_key"), plan.select("source", "_place", "_docs")).withColumn("_range", _range(F.col("_key"), F.col("_docs"))).drop("source"))
    sums = rows.groupBy("_place", "_range").agg(F.sum("_size").alias("_words"))
    before = F.sum("_words").over(Window.partitionBy("_place").orderBy("_range")) - F.col("_words")
    ends = sums.withColumn("_before", before).join(plan.select("_place", "_rest"), "_place").where("_before <= _rest")
    last = ends.groupBy("_place").agg(F.max(F.struct("_range", "_before", "_rest")).alias("_e")).select("_place", "_e.*")
    # rows that agree in key, id and size are one row here: however many, they are no window's burden
    ties = rows.join(last, ["_place", "_range"]).groupBy("_place", "_before", "_rest", "_key", key, "_size").agg(F.count("*").alias("_ties"))
    order = Window.partitionBy("_place").orderBy("_key", key, "_size").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("_rest") - F.col("_before") - F.sum(F.col("_size") * F.col("_ties")).over(order) + F.col("_size") * F.col("_ties")
    fit = F.when(room >= 0, F.least("_ties", F.coalesce(F.floor(F.try_divide(room, "_size") + 0.5), F.col("_ties"))))
    taken = ties.withColumn("_fit", fit).where("_rest > 0 and _fit > 0")
    cuts = taken.groupBy("_place").agg(F.max(F.struct(F.struct("_key", F.col(key).alias("_id"), "_size").alias("_cut"), "_fit", "_ties")).alias("_e")).select("_place", "_e.*")
    return cut(plan.join(last.select("_place", F.col("_range").alias("_last")), "_place", "left").join(cuts, "_place", "left"))


def sent(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source's plan; the plan is broadcast only if counted to be small."""
    right = plan.withColumnRenamed("source", "_source")
    if right.count() <= SOURCES_SENT:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def copies(sized: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """``sized`` with its source's plan and _copies, the times the mix takes each row.

    Where only some of the rows that agree with the cut in key, id and size fit, they are numbered, partition by partition.
    """
    at, row = _range(F.col("_key"), F.col("_docs")), F.struct("_key", F.col(key).alias("_id"), "_size")
    tied = F.coalesce((at == F.col("_last")) & row.eqNullSafe(F.col("_cut")), F.lit(False))
    more = F.coalesce((at < F.col("_last")) | ((at == F.col("_last")) & (row < F.col("_cut"))), F.lit(False))
    found = sent(sized, plan)
    whole = found.withColumn("_copies", (F.col("_epochs") + (more | tied).cast("bigint")).cast("bigint"))
    if plan.where("_fit < _ties").isEmpty():
        return whole
    some = tied & (F.col("_fit") < F.col("_ties"))
    held = cut(found.where(some)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    before = held.groupBy("_place", "_part").agg(F.count("*").alias("_n")).select("_place", "_part", (F.sum("_n").over(Window.partitionBy("_place").orderBy("_part")) - F.col("_n")).alias("_earlier"))
    number = F.col("_earlier") + F.row_number().over(Window.partitionBy("_place", "_part").orderBy("_at"))
    chosen = held.join(before, ["_place", "_part"]).withColumn("_copies", (F.col("_epochs") + (number <= F.col("_fit")).cast("bigint")).cast("bigint"))
    return whole.where(~some).unionByName(chosen.select(whole.columns))


def mix(docs: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    Null texts have size zero, null sources are one source, the last; an empty table gives no rows. Taken words are
    within half a document of the target; no row is taken more than twice, rows that repeat an id too. The same rows
    give the same result.
    """
    sized = cut(keyed(docs.select(docs[key].alias("doc_id"), docs["source"].alias("source"), docs[text].alias("text")), seed).drop("text"))
    found = copies(sized, mix_plan(sized, **how))
    return found.select("doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns, whatever their names. Texts are not shuffled.

    Null and empty texts have size 0. Rows that agree in id, source, size and key are
    taken together or in part. An empty table stays empty.
    """
    columns, docs = docs.columns, apart(docs, "doc_id", "source", "text")
    plan = mix_plan(cut(keyed(docs, seed).select("doc_id", "source", "_size", "_key")), **how)
    found = copies(keyed(docs, seed), plan).where("_copies > 0")
    return together(found.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))), columns, "doc_id", "source", "text")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, length(text) AS chars,
    (('0x' || substr(sha256(doc_id::VARCHAR || ':0'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / (CASE WHEN size > 0 AND chars / size::DOUBLE BETWEEN 3 AND 12 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS k FROM d),
t AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM t),
l AS (SELECT *, (1.5::DOUBLE * (sum(total) OVER ())::DOUBLE - coalesce(sum(2 * total) OVER o, 0)::DOUBLE) / ((sum(w) OVER ()) - coalesce(sum(w) OVER o, 0))::DOUBLE AS level FROM w
    WINDOW o AS (ORDER BY 2 * total / w::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, least((2 * total)::DOUBLE, w * max(level) OVER ()) AS target FROM l),
e AS (SELECT *, coalesce(floor(target / nullif(total, 0)), 0) AS epochs FROM g),
c AS (SELECT k.doc_id, k.size, e.total, e.target, e.epochs, e.target - e.epochs * e.total AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, total AS source_size, target, (size * (epochs + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
