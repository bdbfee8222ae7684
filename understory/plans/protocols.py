"""Queries over commits and the ledger: a conversion of four tables as one commit, and a choice that is tested once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoint import cut, scratch
from ..operators import metrics, polygons, raster
from ..sources import ledger, views
from .campaigns import config, dealt, dealt_sql
from .registry import query
from .scoring import PLOT, rounded


@query("""WITH {points}, c AS (SELECT *, CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col FROM points), chm AS (SELECT dataset_id, row, col, max(greatest(z, 0)) AS h FROM c WHERE classification <> 2 GROUP BY ALL), top AS (SELECT dataset_id, row, col, arg_max(truth, (z, -truth)) AS label FROM c WHERE truth > 0 GROUP BY ALL),
full_ AS (SELECT dataset_id, truth, count(*) AS n FROM (SELECT DISTINCT dataset_id, truth, row, col FROM c WHERE truth > 0) GROUP BY ALL), seen AS (SELECT dataset_id, label, count(*) AS n FROM top GROUP BY ALL)
SELECT 'chm' AS layer, dataset_id, count(*) AS n, round(sum(h), 6) AS total FROM chm GROUP BY ALL UNION ALL SELECT 'labels', dataset_id, count(*), round(CAST(sum(label) AS DOUBLE), 6) FROM top GROUP BY ALL
UNION ALL SELECT 'crowns', dataset_id, count(*), round(CAST(sum(n) AS DOUBLE), 6) FROM full_ GROUP BY ALL UNION ALL SELECT 'visible', dataset_id, count(*), round(CAST(sum(n) AS DOUBLE), 6) FROM seen GROUP BY ALL""")
def reference_conversion(spark, d):
    """Canopy heights, topmost labels, whole and visible crowns as polygons: four tables in one commit, read again."""
    to, p = scratch(spark, "conversion"), views.points(spark, d)
    top = cut(raster.topmost(p, 1.0)).select("dataset_id", "row", "col", F.col("truth").alias("label"))
    cells = raster.cells(p.where("truth > 0"), 1.0).select("dataset_id", F.col("truth").alias("label"), "row", "col").distinct()
    shapes = lambda c: polygons.shapes(polygons.rings(c, "label"), "label")
    chm = raster.rasters(p, 1.0).where("chm IS NOT NULL").select("dataset_id", "row", "col", "chm")
    ledger.commit(spark, to, {"chm": chm, "labels": top, "crowns": cut(shapes(cells)), "visible": cut(shapes(top))})
    got, out = ledger.committed(spark, to), None
    for layer, value in {"chm": "chm", "labels": "label", "crowns": "area", "visible": "area"}.items():
        part = got[layer].groupBy("dataset_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col(value).cast("double")), 6).alias("total")).select(F.lit(layer).alias("layer"), "dataset_id", "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


LOW, CLASSICAL = "CASE WHEN y <= 40 AND pred > 0 THEN supp + 1 ELSE 0 END", "CASE WHEN y <= 15 THEN supp + 1 ELSE 0 END"
#: Name of each candidate by its place in the deal.
MODELS = ("retained", "low", "classical")


def candidate_scores(spark, d, split):
    """(model, pq, f1) of every candidate over the plots of a split."""
    y, own = F.col("y"), F.col("supp") + 1
    labels = [F.col("pred"), F.when((y <= 40) & (F.col("pred") > 0), own).otherwise(0), F.when(y <= 15, own).otherwise(0)]
    plots = views.plots(spark, d).where(F.col("model_split") == split)
    m = metrics.instance_metrics(dealt(views.points(spark, d).join(F.broadcast(plots), "dataset_id", "left_semi"), labels)).withColumn("model", F.element_at(F.array(*map(F.lit, MODELS)), config().cast("int") + 1))
    t = m.groupBy("model").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "iou_sum")))
    _, _, f1, pq, _ = metrics.ratios(*map(F.col, ("tp", "fp", "fn", "iou_sum")))
    return t.select("model", F.round(pq, 9).alias("pq"), F.round(f1, 9).alias("f1"))


@query(dealt_sql(PLOT.replace("WITH {points}", "WITH {points}, {plots}"), "pred", LOW, CLASSICAL) + f""", s9 AS (SELECT CAST(dataset_id % 100 AS INT) AS k, model_split, round(sum(iou_sum) / greatest(sum(tp) + 0.5 * (sum(fp) + sum(fn)), 1), 9) AS pq, round(sum(tp) / greatest(sum(tp) + 0.5 * (sum(fp) + sum(fn)), 1), 9) AS f1
FROM (SELECT p.*, model_split FROM plot p JOIN plots ON plots.dataset_id = p.dataset_id // 100) GROUP BY ALL), b9 AS (SELECT * FROM s9 WHERE k = 2 AND model_split = 'val'), w9 AS (SELECT arg_max(s9.k, (s9.pq, s9.f1, s9.k)) AS k FROM s9, b9 AS b WHERE s9.model_split = 'val' AND s9.k < 2 AND s9.pq > b.pq AND s9.f1 > b.f1)
SELECT CASE k WHEN 0 THEN 'retained' ELSE 'low' END AS model, v.pq AS val_pq, v.f1 AS val_f1, t.pq AS test_pq, t.f1 AS test_f1, true AS cached, 'the test has been run' AS second_run, 'inputs or parameters have changed since the choice was frozen' AS changed_inputs FROM w9 JOIN s9 v USING (k) JOIN s9 t USING (k) WHERE v.model_split = 'val' AND t.model_split = 'test'""")
def frozen_test(spark, d):
    """Candidates scored on validation plots under a signature, the best frozen, and one run on the test plots; later ones are refused."""
    to = scratch(spark, "protocol")
    inputs = views.points(spark, d).select("pid", "dataset_id", "truth", "pred", "y")
    key = ledger.signature({"models": MODELS, "iou": 0.5}, points=inputs)
    ledger.cached(spark, f"{to}/assessed", key, lambda: candidate_scores(spark, d, "val"))
    scores, hit = ledger.cached(spark, f"{to}/assessed", key, lambda: candidate_scores(spark, d, "val"))
    winner = ledger.best(scores, "classical")
    if winner is None:
        raise RuntimeError("no candidate exceeds the classical one")
    ledger.freeze(spark, to, {"signature": key, "test_used": False, **winner})
    run = lambda choice: candidate_scores(spark, d, "test").where(F.col("model") == choice["model"])

    def refused(signature):
        try:
            ledger.test_once(spark, to, signature, run)
        except RuntimeError as e:
            return str(e)
        raise RuntimeError("a second test run was allowed")

    tested = ledger.test_once(spark, to, key, run)
    changed = ledger.signature({"models": MODELS, "iou": 0.5}, points=inputs.where("pid % 2 = 0"))
    facts = {"cached": hit, "second_run": refused(key), "changed_inputs": refused(changed)}
    return tested.select("model", F.lit(winner["pq"]).alias("val_pq"), F.lit(winner["f1"]).alias("val_f1"), F.col("pq").alias("test_pq"), F.col("f1").alias("test_f1"), *(F.lit(v).alias(k) for k, v in facts.items()))
