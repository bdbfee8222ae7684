"""Splits without leakage, sampling weights, resampled intervals, records and validators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.chance import unit
from .graph import components


def close_boxes(boxes: DataFrame, id: str, crs: str, gap: float, bucket: float) -> DataFrame:
    """(a, b), a < b: boxes (left, bottom, right, top) of one reference system at most ``gap`` apart.

    Boxes meet in the buckets that they touch once grown by the gap: an equi-join, not all pairs.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - gap) / bucket), F.floor((F.col(b) + gap) / bucket)))
    dealt = boxes.where(F.col(crs).isNotNull()).withColumn("_x", span("left", "right")).withColumn("_y", span("bottom", "top"))
    names = ("left", "bottom", "right", "top")
    side = lambda k: dealt.select(crs, "_x", "_y", F.col(id).alias(k), *(F.col(n).alias(f"{k}_{n}") for n in names))
    apart = lambda lo, hi: F.greatest(F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.col(f"b_{lo}") - F.col(f"a_{hi}"), F.lit(0.0))
    dx, dy = apart("left", "right"), apart("bottom", "top")
    return side("a").join(side("b"), [crs, "_x", "_y"]).where((F.col("a") < F.col("b")) & (F.sqrt(dx * dx + dy * dy) <= gap)).select("a", "b").distinct()


def leakage_groups(rows: DataFrame, id: str, links: DataFrame) -> DataFrame:
    """``rows`` with group_id: 16 hex digits of a hash of the sorted ids that links (a, b) connect."""
    keyed = rows.withColumn("_k", F.xxhash64(id))
    roots = components(links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), "a", "b")
    placed = keyed.join(roots, F.col("_k") == F.col("node"), "left").withColumn("_g", F.coalesce("root", "_k"))
    named = placed.groupBy("_g").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(id).cast("string"))), "|"), 256), 1, 16).alias("group_id"))
    return placed.join(named, "_g").drop("_k", "_g", "node", "root")


def hash_split(groups: DataFrame, stratum: str, seed: int, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """``groups`` (group_id, stratum) with model_split: in hash order, the first share is test, the next val.

    Strata of one group are train, of two have no val; else at least one group is taken for each.
    """
    w = Window.partitionBy(stratum)
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "group_id"), 256)))
    take = lambda share: F.greatest(F.lit(1), F.rint(n * share))  # noqa: E731  halves to the even number
    vals = F.when(n >= 3, take(val)).otherwise(0)
    return groups.withColumn("model_split", F.when(n < 2, "train").when(place <= take(test), "test").when(place <= take(test) + vals, "val").otherwise("train"))


def official_split(groups: DataFrame, stratum: str, seed: int, val: float = 0.2) -> DataFrame:
    """``groups`` (group_id, stratum, official) with model_split: groups that hold officially held-out rows (``official``) are test.

    Of the others in a stratum, two or more, the first share in hash order is val, one group at least; all else is train.
    """
    free = Window.partitionBy(stratum, "official")
    n = F.count("*").over(free)
    place = F.row_number().over(free.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "group_id"), 256)))
    val_ = (n >= 2) & (place <= F.greatest(F.lit(1), F.rint(n * val)))
    return groups.withColumn("model_split", F.when(F.col("official"), "test").when(val_, "val").otherwise("train"))


def sampling_weights(rows: DataFrame, real: Column, group: Sequence[str], parent: str, share: float = 0.75) -> DataFrame:
    """``rows`` with weight: real rows share ``share`` evenly over groups and then rows, the others the rest over parents."""
    if not 0 < share < 1:
        raise ValueError("both kinds need weight")
    key = F.when(real, F.concat_ws(":", *group)).otherwise(F.col(parent).cast("string"))
    keyed = rows.withColumn("_real", real).withColumn("_key", key)
    sizes = keyed.groupBy("_real", "_key").agg(F.count("*").alias("_n"))
    kinds = sizes.groupBy("_real").agg(F.count("*").alias("_groups"))
    share_of = F.when(F.col("_real"), share).otherwise(1 - share)
    return keyed.join(sizes, ["_real", "_key"]).join(F.broadcast(kinds), "_real").withColumn("weight", share_of / F.col("_groups") / F.col("_n")).drop("_real", "_key", "_n", "_groups")


def bootstrap(values: DataFrame, stratum: str, value: str, rounds: int = 2000) -> DataFrame:
    """(low, high, mean) of the mean of stratum means under stratified resampling with replacement, at 95%.

    Draws are hashes of (round, stratum, place), so reruns agree; each draw is a lookup by number, not a copy of the data.
    """
    w = Window.partitionBy(stratum)
    numbered = values.select(stratum, value).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1)
    sizes = numbered.groupBy(stratum).agg(F.count("*").alias("_n"))
    draws = sizes.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    picked = draws.withColumn("_i", F.floor(unit("_r", stratum, "_k") * F.col("_n")).cast("int")).join(numbered, [stratum, "_i"])
    means = picked.groupBy("_r", stratum).agg(F.avg(value).alias("m")).groupBy("_r").agg(F.avg("m").alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg("m").alias("mean"))


def latest(records: DataFrame, id: str, order: str, *ties: str) -> DataFrame:
    """The last record of each id."""
    row = F.struct(*records.columns)
    return records.groupBy(id).agg(F.max_by(row, F.struct(order, *ties)).alias("_r")).select("_r.*")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(rule, subject) of every row of every check: each check's first column names what breaks its rule."""
    parts = [df.select(F.lit(rule).alias("rule"), F.col(df.columns[0]).cast("string").alias("subject")) for rule, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status): both, left or right, from a full outer join; callers fail on any but both."""
    a, b = left.select(key, F.lit(1).alias("_l")), right.select(key, F.lit(1).alias("_r"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both").alias("status"))


def weighted_sample(rows: DataFrame, weight: Column, count: int, stratum: str, id: str, seed: int = 0) -> DataFrame:
    """``count`` rows of each stratum without replacement, by exponential keys from a hash of the id."""
    keyed = rows.withColumn("_k", -F.log(unit(id, F.lit(seed))) / weight)
    return keyed.withColumn("_p", F.row_number().over(Window.partitionBy(stratum).orderBy("_k", id))).where(F.col("_p") <= count).drop("_k", "_p")
