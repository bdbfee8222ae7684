"""Panoptic and detection metrics over label columns.

Two labelings of the same points are partitions, so a truth and a prediction that cover over half of their union are
each other's only such partner; only exact halves can tie, and then the smallest ids win. Matching at one half is
thus an integer comparison, without an assignment step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window


def known(points: DataFrame, truth: str = "truth") -> DataFrame:
    """Points with a known label: the unknown (-1) count for neither side."""
    return points.where(F.col(truth) >= 0)


def contingency(points: DataFrame, by: str = "dataset_id", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(by, truth, pred, n), background 0 included."""
    return points.groupBy(by, truth, pred).agg(F.count("*").alias("n"))


def ious(table: DataFrame, by: str = "dataset_id") -> DataFrame:
    """(by, truth, pred, n, ng, np, iou) of overlapping pairs; sizes include background overlap. One shuffle of counts."""
    t, p = Window.partitionBy(by, "truth"), Window.partitionBy(by, "pred")
    sized = table.withColumn("ng", F.sum("n").over(t)).withColumn("np", F.sum("n").over(p))
    return sized.where("truth > 0 AND pred > 0").withColumn("iou", F.col("n") / (F.col("ng") + F.col("np") - F.col("n")))


def matches(pairs: DataFrame, by: str = "dataset_id") -> DataFrame:
    """The pairs matched at an IoU of one half or more, one to one."""
    hit = pairs.where("2 * n >= ng + np - n")
    best_p = F.min("pred").over(Window.partitionBy(by, "truth"))
    best_t = F.min("truth").over(Window.partitionBy(by, "pred"))
    return hit.withColumn("_p", best_p).withColumn("_t", best_t).where("2 * n > ng + np - n OR (pred = _p AND truth = _t)").drop("_p", "_t")


def instance_metrics(points: DataFrame, by: str = "dataset_id") -> DataFrame:
    """(by, tp, fp, fn, iou_sum, mucov, mwcov): mucov is the mean best IoU of truths, mwcov the same by their sizes.

    One scan of the points; all else are windows over the contingency table, dealt by truth, by prediction, by truth.
    """
    t, p = Window.partitionBy(by, "truth"), Window.partitionBy(by, "pred")
    both = (F.col("truth") > 0) & (F.col("pred") > 0)
    sized = contingency(known(points), by).withColumn("ng", F.sum("n").over(t)).withColumn("np", F.sum("n").over(p))
    union = F.col("ng") + F.col("np") - F.col("n")
    rated = sized.withColumn("iou", F.when(both, F.col("n") / union)).withColumn("_hit", both & (2 * F.col("n") >= union)).withColumn("_sure", both & (2 * F.col("n") > union))
    side = rated.withColumn("_t", F.min(F.when(F.col("_hit"), F.col("truth"))).over(p)).withColumn("_onep", (F.row_number().over(p.orderBy("truth")) == 1) & (F.col("pred") > 0))
    full = (
        side.withColumn("_p", F.min(F.when(F.col("_hit"), F.col("pred"))).over(t))
        .withColumn("best", F.max(F.coalesce("iou", F.lit(0.0))).over(t))
        .withColumn("_onet", (F.row_number().over(t.orderBy("pred")) == 1) & (F.col("truth") > 0))
        .withColumn("_match", F.col("_sure") | (F.col("_hit") & (F.col("pred") == F.col("_p")) & (F.col("truth") == F.col("_t"))))
    )
    one = lambda v: F.sum(F.when(F.col("_onet"), v))
    sums = full.groupBy(by).agg(
        F.count_if("_match").alias("tp"), F.count_if("_onep").alias("_np"), F.count_if("_onet").alias("_nt"), F.sum(F.when(F.col("_match"), F.col("iou"))).alias("iou_sum"),
        one(F.col("best")).alias("_b"), one(F.col("best") * F.col("ng")).alias("_bn"), one(F.col("ng")).alias("_n"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(by, "tp", (F.col("_np") - F.col("tp")).alias("fp"), (F.col("_nt") - F.col("tp")).alias("fn"), zero("iou_sum").alias("iou_sum"), zero(F.try_divide("_b", "_nt")).alias("mucov"), zero(F.try_divide("_bn", "_n")).alias("mwcov"))


def ratios(tp: Column, fp: Column, fn: Column, iou_sum: Column) -> list[Column]:
    """precision, recall, f1, pq, sq with denominators of one at least."""
    one = lambda c: F.greatest(c, F.lit(1))
    den = F.greatest(tp + 0.5 * (fp + fn), F.lit(1.0))
    return [(tp / one(tp + fp)).alias("precision"), (tp / one(tp + fn)).alias("recall"), (tp / den).alias("f1"), (iou_sum / den).alias("pq"), (iou_sum / one(tp)).alias("sq")]


def totals(rows: DataFrame, *by: str) -> DataFrame:
    """Summed counts and their ratios, by group or over all."""
    sums = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "iou_sum")))
    return sums.select(*by, "tp", "fp", "fn", "iou_sum", *ratios(*map(F.col, ("tp", "fp", "fn", "iou_sum"))))


def source_balanced(rows: DataFrame, source: str = "source", collection: str = "collection") -> DataFrame:
    """Pooled metrics, a row for each source:collection, and their unweighted means, marked by ``scope``.

    Every group's sums go to its own row and to the pooled one, so the rows are read once.
    """
    groups = totals(rows.withColumn("scope", F.concat_ws(":", source, collection)), "scope")
    both = groups.withColumn("scope", F.explode(F.array("scope", F.lit("pooled"))))
    counts = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "iou_sum")]
    sums = both.groupBy("scope").agg(*counts, F.avg("pq").alias("_pq"), F.avg("f1").alias("_f1"))
    pooled = F.col("scope") == "pooled"
    means = [F.when(pooled, F.col("_pq")).alias("source_balanced_pq"), F.when(pooled, F.col("_f1")).alias("source_balanced_f1")]
    return sums.select("scope", "tp", "fp", "fn", "iou_sum", *ratios(*map(F.col, ("tp", "fp", "fn", "iou_sum"))), *means)


def binary_metrics(points: DataFrame, *by: str, truth: Column, pred: Column) -> DataFrame:
    """tp, fp, fn, iou, f1, accuracy of foreground flags."""
    n = lambda c, a: F.count_if(c).alias(a)
    s = points.groupBy(*by).agg(n(truth & pred, "tp"), n(~truth & pred, "fp"), n(truth & ~pred, "fn"), n(truth == pred, "_same"), F.count("*").alias("_all"))
    one = lambda c: F.greatest(c, F.lit(1))
    return s.select(*by, "tp", "fp", "fn", (F.col("tp") / one(F.expr("tp + fp + fn"))).alias("iou"), (2 * F.col("tp") / one(F.expr("2 * tp + fp + fn"))).alias("f1"), (F.col("_same") / one(F.col("_all"))).alias("accuracy"))


def footprint_metrics(truth: DataFrame, pred: DataFrame, pairs: DataFrame, matched: DataFrame, ignore: DataFrame, by: str = "dataset_id", whole: bool = False) -> DataFrame:
    """(by, tp, fp, fn, iou_sum, ignored) of footprints (by, id, row, col); ``whole``: an id names one footprint over all of ``by``.

    ``pairs`` (by, a, b, iou) are overlaps of truths a and predictions b, ``matched`` those chosen one to one. A
    prediction half or more in ``ignore`` cells is forgiven if it is unmatched and like no truth: duplicates are not.
    """
    n_truth = truth.groupBy(by).agg(F.countDistinct("id").alias("_t"))
    mine = ignore.select(by, "row", "col").distinct().withColumn("_i", F.lit(1))
    cover = pred.join(mine, [by, "row", "col"], "left").groupBy(by, "id").agg((F.count("_i") / F.count("*")).alias("_c"))
    own = ["id"] if whole else [by, "id"]
    seen = pairs.where("iou >= 0.5").withColumn("id", F.col("b")).select(*own).distinct().withColumn("_s", F.lit(1))
    p = cover.join(seen, own, "left").groupBy(by).agg(F.count("*").alias("_p"), F.count_if(F.col("_s").isNull() & (F.col("_c") >= 0.5)).alias("ignored"))
    hit = matched.groupBy(by).agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    rows = n_truth.join(p, by, "full_outer").join(hit, by, "left").na.fill(0).na.fill(0.0)
    return rows.select(by, "tp", (F.col("_p") - F.col("tp") - F.col("ignored")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn"), "iou_sum", "ignored")
