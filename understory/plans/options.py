"""Options of support fusion, a verifier fitted on all features, and outputs of merged crowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoint import cut
from ..operators import crowns, masks, raster, scorer
from ..operators.spatial import near_own_group
from ..sources import views
from .fusion import ANCHOR, FEATURES, M, reconciled, tables
from .geometry import hulls_sql
from .registry import query
from .scoring import nudged, rounded


@query(M + ", " + ANCHOR + """, c AS (SELECT mask_id, count(*) AS n, any_value(object_score) AS o, any_value(object_score) * avg(score) AS ranking FROM kept JOIN masks USING (mask_id) WHERE object_score >= 0.1 GROUP BY 1 HAVING count(*) >= 12),
held AS (SELECT k.*, c.n, c.o, c.ranking, a.label AS held FROM kept k JOIN c USING (mask_id) LEFT JOIN anchor a USING (pid)), sh AS (SELECT mask_id, held AS label, count(*) AS s FROM held WHERE held IS NOT NULL GROUP BY ALL),
w AS (SELECT mask_id, arg_max(label, (s, -label)) AS label, max(s) AS s, sum(s) AS total FROM sh GROUP BY 1), z AS (SELECT label, count(*) AS size FROM anchor GROUP BY 1),
won AS (SELECT w.mask_id, w.label, w.s / (c.n + z.size - w.s) AS aff FROM w JOIN c USING (mask_id) JOIN z ON z.label = w.label WHERE w.s / w.total >= 0.8 AND w.s / (c.n + z.size - w.s) >= 0.2),
offers AS (SELECT h.pid, won.label, h.score * h.o * won.aff AS offer, h.ranking, h.mask_id, h.x, h.y, h.z FROM held h JOIN won USING (mask_id) WHERE h.held IS NULL AND h.score >= 0.6),
o2 AS (SELECT DISTINCT pid, label, x, y, z FROM offers), near AS (SELECT DISTINCT o.pid, o.label FROM o2 o JOIN anchor a ON a.label = o.label AND (o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y) + (o.z - a.z) * (o.z - a.z) <= 16),
hp AS (SELECT label AS g, x, CAST(y AS DOUBLE) AS y FROM anchor), """ + hulls_sql("hv", "hp") + """,
ins AS (SELECT o.pid, o.label FROM o2 o JOIN hv ON hv.g = o.label AND hv.corners >= 3 JOIN hv_e e ON e.g = o.label AND o.x BETWEEN e.x AND e.x2 GROUP BY ALL HAVING count(DISTINCT e.side) = 2 AND bool_and(e.side * ((e.y - o.y) * (e.x2 - e.x) + (e.y2 - e.y) * (o.x - e.x)) >= -1e-9)),
mid AS (SELECT label, median(x) AS mx, median(CAST(y AS DOUBLE)) AS my FROM anchor GROUP BY 1), vote AS (SELECT o.pid, o.label FROM o2 o JOIN mid USING (label) WHERE (x - mx) * (x - mx) + (y - my) * (y - my) <= 400),
fam AS (SELECT 'boundary' AS family, * FROM near UNION ALL SELECT 'interior', near.* FROM near JOIN ins USING (pid, label) UNION ALL SELECT 'vote', near.* FROM near JOIN vote USING (pid, label))
SELECT family, pid, arg_max(label, (offer, ranking, -mask_id)) AS label, round(max(offer) + 1e-9, 6) AS offer FROM offers JOIN fam USING (pid, label) GROUP BY family, pid""")
def support_families(spark, d):
    """Points that support fusion recovers near their anchor, of those the ones inside its hull, and the ones that vote for its middle."""
    mp, m = tables(spark, d)
    anchors = views.points(spark, d).where("truth > 0 AND y <= 30").select("pid", F.col("truth").alias("label"), "x", "y", "z", F.col("x").alias("vx"), F.col("y").alias("vy"))
    ranked = cut(masks.candidates(mp, m, 0.1, 0.6, 12).select("mask_id", "n", "object_score", "ranking"))
    offered = mp.where("score >= 0.6").withColumns({"vx": F.col("x"), "vy": F.col("y")})
    families = {"boundary": lambda q: q, "interior": lambda q: masks.inside_hull(q, anchors), "vote": lambda q: masks.voting_near(q, anchors, 20.0)}
    won = masks.leanings(anchors, ranked, offered)
    close = cut(near_own_group(masks.offers(anchors, won, offered, probability=0.6), anchors, 4.0, "label"))  # every family is a part of these
    out = None
    for name, only in families.items():
        got = masks.awarded(only(close)).withColumn("family", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return rounded(nudged(out.select("family", "pid", "label", "offer"), "offer"))


#: The fourteen features and the SQL of each.
MEASURES = {
    "log_points": "ln(1 + n)", "log_area_cells": "ln(1 + cells)", "max_height": "hi", "height_std": "hs", "mean_mask": "ms", "std_mask": "ss", "max_object": "mo", "mean_object": "ao", "log_votes": "ln(1 + k)",
    "xy_compactness": "cells / box", "xy_aspect": "sqrt(e0 / e1)", "top_offset": "sqrt((tx - ax) * (tx - ax) + (ty - ay) * (ty - ay)) / greatest(sqrt(e0 + e1), 0.25)", "point_density": "n / cells", "member_agreement": "total / n",
}
NAMES = tuple(MEASURES)


def each(text: str) -> str:
    return ", ".join(text.replace("{n}", n) for n in NAMES)


def added(text: str) -> str:
    return " + ".join(text.replace("{n}", n) for n in NAMES)


FITTED = FEATURES + """, sz AS (SELECT truth, count(*) AS size FROM points WHERE truth > 0 GROUP BY 1), kn AS (SELECT grp, count(*) AS np, count(*) FILTER (truth >= 0) AS known FROM fused GROUP BY 1),
bi AS (SELECT grp, max(cc / (known + size - cc)) AS iou FROM (SELECT grp, truth, count(*) AS cc FROM fused WHERE truth > 0 GROUP BY ALL) JOIN sz USING (truth) JOIN kn USING (grp) GROUP BY 1),
x AS (SELECT grp, """ + ", ".join(f"{sql} AS {n}" for n, sql in MEASURES.items()) + """, CASE WHEN known / np < 0.5 THEN -1 WHEN coalesce(iou, 0) >= 0.5 THEN 1 ELSE 0 END AS target, grp % 3 <> 0 AS fit FROM r JOIN kn USING (grp) LEFT JOIN bi USING (grp)),
sl AS (SELECT """ + each("avg({n}) AS m_{n}, greatest(stddev_pop({n}), 1e-6) AS s_{n}") + """ FROM x WHERE fit AND target >= 0),
zx AS (SELECT grp, target, fit, """ + each("least(greatest(({n} - m_{n}) / s_{n}, -5), 5) AS {n}") + """ FROM x, sl),
cl AS (SELECT count(*) FILTER (target = 1) AS n1, count(*) FILTER (target = 0) AS n0, """ + each("avg({n}) FILTER (target = 1) AS a_{n}, avg({n}) FILTER (target = 0) AS b_{n}, var_pop({n}) FILTER (target = 1) AS va_{n}, var_pop({n}) FILTER (target = 0) AS vb_{n}") + """ FROM zx WHERE fit AND target >= 0),
wt AS (SELECT *, """ + each("coalesce((a_{n} - b_{n}) / greatest((n1 * va_{n} + n0 * vb_{n}) / (n1 + n0), 1e-6), 0) AS w_{n}") + """ FROM cl),
md AS (SELECT *, ln((n1 + 1) / (n0 + 1)) - (""" + added("coalesce(w_{n} * (a_{n} + b_{n}) / 2, 0)") + ")  AS bias FROM wt)"


def verified(spark, d):
    """Fused proposals with features, target and whether they are of the part that is fitted; and the model."""
    fused, members = reconciled(spark, d)
    sizes = views.points(spark, d).where("truth > 0").groupBy("truth").agg(F.count("*").alias("size"))
    x = cut(masks.features(fused, members).join(masks.targets(fused, sizes).select("group", "target"), "group").withColumn("fit", F.col("group") % 3 != 0))  # a row a proposal
    return x, scorer.fitted(x.where("fit"), NAMES)


@query(FITTED + " " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(w_{n}, 6) AS weight FROM md" for n in NAMES))
def verifier_weights(spark, d):
    """Weights of the fourteen features, fitted on two thirds of the proposals."""
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"_w_{n}").alias("weight")) for n in NAMES))
    return rounded(verified(spark, d)[1].select(F.explode(pairs).alias("p")).select("p.*"))


@query(FITTED + ", sc AS (SELECT target, 1 / (1 + exp(-(bias + " + added("w_{n} * {n}") + """))) AS score FROM zx, md WHERE NOT fit AND target >= 0), t AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(3, 18) t(i))
SELECT threshold, count(*) FILTER (score >= threshold) AS kept, count(*) FILTER (score >= threshold AND target = 1) AS good, count(*) FILTER (target = 1) AS targets, count(*) AS proposals FROM t, sc GROUP BY 1""")
def fitted_verifier(spark, d):
    """The proposals left out of the fit under fifteen thresholds of the fitted score."""
    x, model = verified(spark, d)
    at = scorer.scored(x.where("NOT fit AND target >= 0"), model, NAMES).withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(3), F.lit(17)), lambda i: i / 20.0)))
    sure, good = F.col("score") >= F.col("threshold"), F.col("target") == 1
    return at.groupBy("threshold").agg(F.count_if(sure).alias("kept"), F.count_if(sure & good).alias("good"), F.count_if(good).alias("targets"), F.count("*").alias("proposals"))


@query()
def crown_modes(spark, d):
    """Areas of fused proposals' crowns: the hull of their surest points, the cells of all their points, and both together."""
    fused = reconciled(spark, d)[0].withColumn("label", F.col("group") + 1)
    cells = raster.cells(fused, 4.0).select("dataset_id", "label", "row", "col")
    return rounded(crowns.crown_areas(fused.where("score >= 0.75"), cells, "label", 4.0))
