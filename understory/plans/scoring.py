"""Scoring queries: instance metrics, their aggregates, coverage, hits and objectives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from ..operators import metrics
from ..sources import views
from .registry import query

PAIRS = """WITH {points}, k AS (SELECT * FROM points WHERE truth >= 0),
t AS (SELECT dataset_id, truth, pred, count(*) AS n FROM k GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY dataset_id, truth)::BIGINT AS ng, sum(n) OVER (PARTITION BY dataset_id, pred)::BIGINT AS np FROM t),
pairs AS (SELECT *, n / (ng + np - n)::DOUBLE AS iou FROM s WHERE truth > 0 AND pred > 0)"""
MATCHES = PAIRS + """, h AS (SELECT *, min(pred) OVER (PARTITION BY dataset_id, truth) AS bp, min(truth) OVER (PARTITION BY dataset_id, pred) AS bt FROM pairs WHERE 2 * n >= ng + np - n),
matches AS (SELECT * EXCLUDE (bp, bt) FROM h WHERE 2 * n > ng + np - n OR (pred = bp AND truth = bt))"""
PLOT = MATCHES + """, g AS (SELECT dataset_id, truth, any_value(ng) AS ng FROM s WHERE truth > 0 GROUP BY ALL),
b AS (SELECT g.*, coalesce((SELECT max(iou) FROM pairs p WHERE p.dataset_id = g.dataset_id AND p.truth = g.truth), 0) AS best FROM g),
plot AS (SELECT d.dataset_id, coalesce(m.tp, 0) AS tp, coalesce(p.n, 0) - coalesce(m.tp, 0) AS fp, coalesce(q.n, 0) - coalesce(m.tp, 0) AS fn, coalesce(m.iou_sum, 0) AS iou_sum, coalesce(q.mucov, 0) AS mucov, coalesce(q.mwcov, 0) AS mwcov
FROM (SELECT DISTINCT dataset_id FROM t) d LEFT JOIN (SELECT dataset_id, count(*) AS tp, sum(iou) AS iou_sum FROM matches GROUP BY 1) m USING (dataset_id)
LEFT JOIN (SELECT dataset_id, count(DISTINCT pred) AS n FROM t WHERE pred > 0 GROUP BY 1) p USING (dataset_id)
LEFT JOIN (SELECT dataset_id, count(*) AS n, avg(best) AS mucov, sum(best * ng) / sum(ng) AS mwcov FROM b GROUP BY 1) q USING (dataset_id))"""
RATIO = "round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(tp / greatest(tp + 0.5 * (fp + fn), 1), 6) AS f1, round(iou_sum / greatest(tp + 0.5 * (fp + fn), 1), 6) AS pq, round(iou_sum / greatest(tp, 1), 6) AS sq"
GROUPED = PLOT + """, r AS (SELECT * FROM plot JOIN plots USING (dataset_id)),
sums AS (SELECT source || ':' || collection AS scope, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(iou_sum) AS iou_sum FROM r GROUP BY 1),
groups AS (SELECT scope, tp, fp, fn, iou_sum, tp / greatest(tp + 0.5 * (fp + fn), 1) AS f1, iou_sum / greatest(tp + 0.5 * (fp + fn), 1) AS pq FROM sums)"""
GROUPED = GROUPED.replace("WITH {points}", "WITH {points}, {plots}")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its doubles (or the named columns) rounded to six places."""
    chosen = names or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, 6) for n in chosen})


def nudged(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with a billionth added to means of few distinct values: those may lie on a rounding edge, where the order of a sum decides."""
    return df.withColumns({n: F.col(n) + 1e-9 for n in names})


def plot_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.instance_metrics(views.points(spark, d)).join(views.plots(spark, d), "dataset_id")


@query("WITH {points} SELECT dataset_id, truth, pred, count(*) AS n FROM points WHERE truth >= 0 GROUP BY ALL")
def contingency_table(spark, d):
    return metrics.contingency(metrics.known(views.points(spark, d)))


@query(PAIRS + " SELECT dataset_id, truth, pred, n, round(iou, 6) AS iou FROM pairs")
def iou_pairs(spark, d):
    return rounded(metrics.ious(contingency_table(spark, d)).select("dataset_id", "truth", "pred", "n", "iou"))


@query(MATCHES + " SELECT dataset_id, truth, pred, n, round(iou, 6) AS iou FROM matches")
def matched_instances(spark, d):
    return rounded(metrics.matches(metrics.ious(contingency_table(spark, d))).select("dataset_id", "truth", "pred", "n", "iou"))


@query(PLOT + " SELECT dataset_id, tp, fp, fn, round(iou_sum, 6) AS iou_sum, round(mucov, 6) AS mucov, round(mwcov, 6) AS mwcov FROM plot")
def point_instance_metrics(spark, d):
    return rounded(metrics.instance_metrics(views.points(spark, d)))


@query(GROUPED + f""" SELECT scope, tp, fp, fn, round(iou_sum, 6) AS iou_sum, {RATIO}, NULL::DOUBLE AS source_balanced_pq, NULL::DOUBLE AS source_balanced_f1 FROM sums
UNION ALL SELECT 'pooled', tp, fp, fn, round(iou_sum, 6), {RATIO}, round((SELECT avg(pq) FROM groups), 6), round((SELECT avg(f1) FROM groups), 6)
FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(iou_sum) AS iou_sum FROM sums)""")
def panoptic_source_balanced(spark, d):
    return rounded(metrics.source_balanced(plot_metrics(spark, d)))


@query(PLOT.replace("WITH {points}", "WITH {points}, {plots}") + f""" SELECT coalesce(collection, 'overall') AS collection, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
round(avg(abs(fp - fn)), 6) AS count_mae, round(sqrt(avg((fp - fn) * (fp - fn))), 6) AS count_rmse, round(avg(fp - fn), 6) AS count_bias
FROM plot JOIN plots USING (dataset_id) GROUP BY ROLLUP (collection)""")
def detector_aggregate(spark, d):
    e = F.col("fp") - F.col("fn")
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    out = plot_metrics(spark, d).rollup("collection").agg(*sums, F.avg(F.abs(e)).alias("count_mae"), F.sqrt(F.avg(e * e)).alias("count_rmse"), F.avg(e).alias("count_bias"))
    return rounded(out.withColumn("collection", F.coalesce("collection", F.lit("overall"))))


@query(PLOT + """ SELECT coalesce(CAST(dataset_id AS VARCHAR), 'overall') AS tile, round(sum(iou_sum) / nullif(sum(tp), 0), 6) AS mean_iou, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS precision,
round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS recall FROM plot GROUP BY ROLLUP (dataset_id)""")
def tile_weighted_aggregate(spark, d):
    s = F.sum
    out = plot_metrics(spark, d).rollup("dataset_id").agg(F.try_divide(s("iou_sum"), s("tp")).alias("mean_iou"), F.try_divide(s("tp"), s("tp") + s("fp")).alias("precision"), F.try_divide(s("tp"), s("tp") + s("fn")).alias("recall"))
    return rounded(out.select(F.coalesce(F.col("dataset_id").cast("string"), F.lit("overall")).alias("tile"), "mean_iou", "precision", "recall"))


@query(PAIRS + """, g AS (SELECT dataset_id, truth, any_value(ng) AS ng FROM s WHERE truth > 0 GROUP BY ALL),
b AS (SELECT g.dataset_id, g.truth, g.ng, coalesce(max(iou), 0) AS best FROM g LEFT JOIN pairs p ON p.dataset_id = g.dataset_id AND p.truth = g.truth GROUP BY ALL)
SELECT dataset_id, truth, ng, round(best, 6) AS best_iou, best < 0.5 AS missed, ng <= 200 AND best >= 0.5 AS sparse_hit FROM b""")
def difficulty_and_sparse_hits(spark, d):
    table = contingency_table(spark, d)
    sizes = table.where("truth > 0").groupBy("dataset_id", "truth").agg(F.sum("n").alias("ng"))
    best = metrics.ious(table).groupBy("dataset_id", "truth").agg(F.max("iou").alias("best"))
    rows = sizes.join(best, ["dataset_id", "truth"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return rows.select("dataset_id", "truth", "ng", F.round("best", 6).alias("best_iou"), (F.col("best") < 0.5).alias("missed"), ((F.col("ng") <= 200) & (F.col("best") >= 0.5)).alias("sparse_hit"))


@query(MATCHES + """, c AS (SELECT truth AS id, count(DISTINCT (CAST(floor(x * 2) AS BIGINT), CAST(floor(y) AS BIGINT))) / 2.0 AS area, dataset_id FROM k WHERE truth > 0 GROUP BY truth, dataset_id)
SELECT c.dataset_id, count(*) FILTER (area <= 200) AS gt_small, count(*) FILTER (area <= 200 AND m.truth IS NOT NULL) AS hit_small, count(*) FILTER (area <= 400) AS gt_medium, count(*) FILTER (area <= 400 AND m.truth IS NOT NULL) AS hit_medium
FROM c LEFT JOIN matches m ON m.dataset_id = c.dataset_id AND m.truth = c.id GROUP BY c.dataset_id""")
def small_crown_hits(spark, d):
    p = metrics.known(views.points(spark, d))
    area = p.where("truth > 0").select("dataset_id", "truth", F.floor(F.col("x") * 2).alias("r"), F.floor("y").alias("c")).distinct().groupBy("dataset_id", "truth").agg((F.count("*") / 2.0).alias("area"))
    hit = metrics.matches(metrics.ious(metrics.contingency(p))).select("dataset_id", "truth", F.lit(True).alias("hit"))
    n = lambda c, a: F.count_if(F.expr(c)).alias(a)
    return area.join(hit, ["dataset_id", "truth"], "left").groupBy("dataset_id").agg(n("area <= 200", "gt_small"), n("area <= 200 AND hit", "hit_small"), n("area <= 400", "gt_medium"), n("area <= 400 AND hit", "hit_medium"))


@query("""WITH {points} SELECT dataset_id, count(*) FILTER (truth > 0 AND pred > 0) AS tp, count(*) FILTER (truth <= 0 AND pred > 0) AS fp, count(*) FILTER (truth > 0 AND pred <= 0) AS fn,
round(count(*) FILTER (truth > 0 AND pred > 0) / greatest(count(*) FILTER (truth > 0 OR pred > 0), 1), 6) AS iou,
round(2 * count(*) FILTER (truth > 0 AND pred > 0) / greatest(2 * count(*) FILTER (truth > 0 AND pred > 0) + count(*) FILTER ((truth > 0) <> (pred > 0)), 1), 6) AS f1,
round(count(*) FILTER ((truth > 0) = (pred > 0)) / greatest(count(*), 1), 6) AS accuracy FROM points WHERE truth >= 0 GROUP BY dataset_id""")
def binary_foreground(spark, d):
    return rounded(metrics.binary_metrics(metrics.known(views.points(spark, d)), "dataset_id", truth=F.col("truth") > 0, pred=F.col("pred") > 0))


@query("""WITH {points} SELECT dataset_id, count(*) FILTER (truth > 0) AS canopy, count(*) FILTER (pred > 0 AND truth <= 0) AS recovered, count(*) FILTER (truth > 0 AND pred <= 0) AS lost,
round(count(*) FILTER (pred > 0 AND z >= 2) / greatest(count(*) FILTER (z >= 2), 1), 6) AS canopy_coverage FROM points GROUP BY dataset_id""")
def coverage_before_after(spark, d):
    n = lambda c: F.count_if(F.expr(c))
    return rounded(views.points(spark, d).groupBy("dataset_id").agg(n("truth > 0").alias("canopy"), n("pred > 0 AND truth <= 0").alias("recovered"), n("truth > 0 AND pred <= 0").alias("lost"), (n("pred > 0 AND z >= 2") / F.greatest(n("z >= 2"), F.lit(1))).alias("canopy_coverage")))


@query("""WITH {points} SELECT dataset_id, CAST(floor(x / 2) AS BIGINT) AS col, CAST(floor(y / 2) AS BIGINT) AS row, count(*) AS n, round(count(*) FILTER (truth <= 0) / count(*), 6) AS before, round(count(*) FILTER (pred = 0) / count(*), 6) AS after
FROM points WHERE z >= 2 GROUP BY ALL""")
def coverage_map(spark, d):
    p = views.points(spark, d).where("z >= 2")
    return rounded(p.groupBy("dataset_id", F.floor(F.col("x") / 2).alias("col"), F.floor(F.col("y") / 2).alias("row")).agg(F.count("*").alias("n"), (F.count_if(F.expr("truth <= 0")) / F.count("*")).alias("before"), (F.count_if(F.expr("pred = 0")) / F.count("*")).alias("after")))


@query(GROUPED + """, o AS (SELECT (SELECT avg(pq) FROM groups) AS p, (SELECT avg(f1) FROM groups) AS f)
SELECT round(sqrt(p * f), 6) AS geometric, round(2 * p * f / greatest(p + f, 1e-12), 6) AS harmonic FROM o""")
def joint_objective(spark, d):
    groups = metrics.totals(plot_metrics(spark, d).withColumn("scope", F.concat_ws(":", "source", "collection")), "scope")
    p, f = F.col("p"), F.col("f")
    return groups.agg(F.avg("pq").alias("p"), F.avg("f1").alias("f")).select(F.round(F.sqrt(p * f), 6).alias("geometric"), F.round(2 * p * f / F.greatest(p + f, F.lit(1e-12)), 6).alias("harmonic"))


SWEEP = """, grid AS (SELECT unnest([0.2::DOUBLE, 0.3, 0.4, 0.5, 0.6, 0.7]) AS threshold),
sw AS (SELECT threshold, count(*) FILTER (best >= threshold) AS hits, count(*) AS truths FROM (SELECT g.dataset_id, g.truth, coalesce(max(iou), 0) AS best FROM g LEFT JOIN pairs p ON p.dataset_id = g.dataset_id AND p.truth = g.truth GROUP BY ALL), grid GROUP BY 1)"""
GT = PAIRS + ", g AS (SELECT DISTINCT dataset_id, truth FROM s WHERE truth > 0)"


def sweep(spark: SparkSession, d: str) -> DataFrame:
    table = contingency_table(spark, d)
    best = table.where("truth > 0").select("dataset_id", "truth").distinct().join(metrics.ious(table).groupBy("dataset_id", "truth").agg(F.max("iou").alias("best")), ["dataset_id", "truth"], "left")
    grid = F.explode(F.array(*map(F.lit, (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)))).alias("threshold")
    return best.select(F.coalesce("best", F.lit(0.0)).alias("best"), grid).groupBy("threshold").agg(F.count_if(F.expr("best >= threshold")).alias("hits"), F.count("*").alias("truths"))


@query(GT + SWEEP + " SELECT threshold, hits, truths, round(hits / greatest(truths, 1), 6) AS recall FROM sw")
def threshold_sweep(spark, d):
    return sweep(spark, d).select("threshold", "hits", "truths", F.round(F.col("hits") / F.greatest("truths", F.lit(1)), 6).alias("recall"))


@query(GT + SWEEP + " SELECT threshold, hits FROM sw WHERE hits >= (SELECT max(hits) - 2 FROM sw) ORDER BY threshold DESC LIMIT 1")
def near_best_threshold(spark, d):
    s = sweep(spark, d)
    top = F.max("hits").over(Window.partitionBy())
    return s.withColumn("_top", top).where("hits >= _top - 2").agg(F.max(F.struct("threshold", "hits")).alias("b")).select("b.threshold", "b.hits")


@query(GT + SWEEP + " SELECT w.threshold, w.hits >= 0.9 * b.hits AND w.hits > 0 AS accepted FROM sw w, (SELECT hits FROM sw WHERE threshold = 0.5) b")
def selection_gate(spark, d):
    s = sweep(spark, d)
    base = F.max(F.when(F.col("threshold") == 0.5, F.col("hits"))).over(Window.partitionBy())
    return s.select("threshold", ((F.col("hits") >= 0.9 * base) & (F.col("hits") > 0)).alias("accepted"))
