"""Mask and consensus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoint import cut
from ..operators import consensus, masks
from ..operators.spatial import near_own_group
from ..sources import views
from .geometry import hulls_sql
from .registry import query
from .scoring import nudged, rounded

M = "WITH {points}, {masks}, mp AS (SELECT *, 1 - discount * 5 AS score FROM mask_points), kept AS (SELECT * FROM mp WHERE score >= 0.6)"
NODES = M + """, nodes AS (SELECT k.mask_id, count(*) AS n, avg(score) AS mean, max(z) AS top, sum(x * score) / sum(score) AS cx, sum(y * score) / sum(score) AS cy, any_value(object_score) AS object_score
FROM kept k JOIN masks m USING (mask_id) WHERE object_score >= 0.1 GROUP BY 1 HAVING count(*) >= 8 AND max(z) >= 1.5)"""
LINKS = NODES + """, live AS (SELECT * FROM kept WHERE mask_id IN (SELECT mask_id FROM nodes)), ov AS (SELECT a.mask_id AS a, b.mask_id AS b, count(*) AS n FROM live a JOIN live b ON a.pid = b.pid AND a.mask_id < b.mask_id GROUP BY ALL),
links AS (SELECT o.a, o.b FROM ov o JOIN nodes p ON p.mask_id = o.a JOIN nodes q ON q.mask_id = o.b WHERE o.n / least(p.n, q.n) >= 0.55 AND o.n / (p.n + q.n - o.n) >= 0.2
AND sqrt((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy)) <= 8 AND abs(p.top - q.top) <= 3)"""
FUSED = LINKS.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), walk AS (SELECT mask_id, mask_id AS root FROM nodes UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.mask_id),
members AS (SELECT mask_id, min(root) AS grp FROM walk GROUP BY 1),
fused AS (SELECT grp, pid, max(score) AS score, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, any_value(truth) AS truth FROM live JOIN members USING (mask_id) GROUP BY ALL)"""


def tables(spark, d):
    mp = views.mask_points(spark, d).withColumn("score", 1 - F.col("discount") * 5)
    m = mp.select("mask_id", "dataset_id").distinct().withColumn("object_score", views.mask_score(F.col("mask_id")))
    return mp, m.select("mask_id", "object_score")


@query(M + " SELECT mask_id, count(*) AS n, round(any_value(object_score) * avg(score) + 1e-9, 6) AS ranking FROM kept JOIN masks USING (mask_id) WHERE object_score >= 0.1 GROUP BY 1 HAVING count(*) >= 12")
def mask_candidates(spark, d):
    return rounded(nudged(masks.candidates(*tables(spark, d), 0.1, 0.6, 12).select("mask_id", "n", "ranking"), "ranking"))


@query(M + " SELECT a.mask_id AS a, b.mask_id AS b, count(*) AS n FROM mp a JOIN mp b ON a.pid = b.pid AND a.mask_id < b.mask_id GROUP BY ALL")
def mask_overlaps(spark, d):
    return masks.overlaps(tables(spark, d)[0])


@query(LINKS + " SELECT a, b FROM links")
def mask_links(spark, d):
    mp, m = tables(spark, d)
    nodes = masks.candidates(mp, m, 0.1, 0.6, 8, 1.5)
    return masks.links(masks.overlaps(mp.where("score >= 0.6").join(nodes.select("mask_id"), "mask_id")), nodes, distance=8.0)


def reconciled(spark, d):
    return masks.reconcile(*tables(spark, d), mask_threshold=0.6, distance=8.0)


@query(FUSED + " SELECT grp AS \"group\", count(*) AS points, round(sum(score), 6) AS score, (SELECT count(*) FROM members m WHERE m.grp = f.grp) AS members FROM fused f GROUP BY grp")
def mask_reconcile(spark, d):
    fused, members = reconciled(spark, d)
    n = members.groupBy("group").agg(F.count("*").alias("members"))
    return rounded(fused.groupBy("group").agg(F.count("*").alias("points"), F.sum("score").alias("score")).join(n, "group"))


#: Parts of the fourteen features, before they are rounded.
FEATURES = FUSED + """, lo AS (SELECT grp, min(x) AS mx, min(y) AS my FROM fused GROUP BY 1), b AS (SELECT f.*, floor((x - mx) / 0.5) AS bx, floor((y - my) / 0.5) AS by_ FROM fused f JOIN lo USING (grp)),
g AS (SELECT grp, count(*) AS n, count(DISTINCT (bx, by_)) AS cells, max(z) AS hi, stddev_pop(z) AS hs, avg(score) AS ms, stddev_pop(score) AS ss, (max(bx) + 1) * (max(by_) + 1) AS box, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c,
  avg(x) AS ax, avg(y) AS ay, arg_max(x, (z, -pid)) AS tx, arg_max(y, (z, -pid)) AS ty FROM b GROUP BY 1),
v AS (SELECT grp, max(object_score) AS mo, avg(object_score) AS ao, count(*) AS k, sum(n)::BIGINT AS total FROM members JOIN nodes USING (mask_id) GROUP BY 1),
r AS (SELECT *, greatest((vx + vy) / 2 - sqrt((vx - vy) * (vx - vy) / 4 + c * c), 1e-6) AS e0, greatest((vx + vy) / 2 + sqrt((vx - vy) * (vx - vy) / 4 + c * c), 1e-6) AS e1 FROM g JOIN v USING (grp))"""


@query(FEATURES + """ SELECT grp AS "group", round(ln(1 + n), 6) AS log_points, round(ln(1 + cells), 6) AS log_area_cells, hi AS max_height, round(hs, 6) AS height_std, round(ms + 1e-9, 6) AS mean_mask, round(ss + 1e-9, 6) AS std_mask, mo AS max_object, round(ao + 1e-9, 6) AS mean_object, round(ln(1 + k), 6) AS log_votes,
round(cells / box, 6) AS xy_compactness, round(sqrt(e0 / e1), 6) AS xy_aspect, round(sqrt((tx - ax) * (tx - ax) + (ty - ay) * (ty - ay)) / greatest(sqrt(e0 + e1), 0.25), 6) AS top_offset, round(n / cells, 6) AS point_density, round(total / n, 6) AS member_agreement FROM r""")
def proposal_features(spark, d):
    return rounded(nudged(masks.features(*reconciled(spark, d)), "mean_mask", "std_mask", "mean_object"))


@query(FUSED + """, sz AS (SELECT truth, count(*) AS size FROM points WHERE truth > 0 GROUP BY 1), g AS (SELECT grp, count(*) AS n, count(*) FILTER (truth >= 0) AS known FROM fused GROUP BY 1),
h AS (SELECT f.grp, f.truth, count(*) AS c FROM fused f WHERE truth > 0 GROUP BY ALL), b AS (SELECT grp, max(c / (known + size - c)) AS iou FROM h JOIN sz USING (truth) JOIN g USING (grp) GROUP BY 1)
SELECT grp AS "group", CAST(CASE WHEN known / n < 0.5 THEN -1 WHEN coalesce(iou, 0) >= 0.5 THEN 1 ELSE 0 END AS INT) AS target, round(CASE WHEN known / n < 0.5 THEN 0 ELSE coalesce(iou, 0) END, 6) AS iou FROM g LEFT JOIN b USING (grp)""")
def proposal_targets(spark, d):
    sizes = views.points(spark, d).where("truth > 0").groupBy("truth").agg(F.count("*").alias("size"))
    return rounded(masks.targets(reconciled(spark, d)[0], sizes))


ANCHOR = "anchor AS (SELECT pid, truth AS label, x, y, z FROM points WHERE truth > 0 AND y <= 30)"


@query(M + ", " + ANCHOR + """, c AS (SELECT mask_id, count(*) AS n, any_value(object_score) AS o, any_value(object_score) * avg(score) AS ranking FROM kept JOIN masks USING (mask_id) WHERE object_score >= 0.1 GROUP BY 1 HAVING count(*) >= 12),
held AS (SELECT k.*, c.n, c.o, c.ranking, a.label AS held FROM kept k JOIN c USING (mask_id) LEFT JOIN anchor a USING (pid)), sh AS (SELECT mask_id, held AS label, count(*) AS s FROM held WHERE held IS NOT NULL GROUP BY ALL),
w AS (SELECT mask_id, arg_max(label, (s, -label)) AS label, max(s) AS s, sum(s) AS total FROM sh GROUP BY 1), z AS (SELECT label, count(*) AS size FROM anchor GROUP BY 1),
won AS (SELECT w.mask_id, w.label, w.s / (c.n + z.size - w.s) AS aff FROM w JOIN c USING (mask_id) JOIN z ON z.label = w.label WHERE w.s / w.total >= 0.8 AND w.s / (c.n + z.size - w.s) >= 0.2),
offers AS (SELECT h.pid, won.label, h.score * h.o * won.aff AS offer, h.ranking, h.mask_id, h.x, h.y, h.z FROM held h JOIN won USING (mask_id) WHERE h.held IS NULL AND h.score >= 0.6),
near AS (SELECT DISTINCT o.pid, o.label FROM offers o JOIN anchor a ON a.label = o.label AND (o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y) + (o.z - a.z) * (o.z - a.z) <= 16)
SELECT pid, arg_max(label, (offer, ranking, -mask_id)) AS label, round(max(offer) + 1e-9, 6) AS offer FROM offers JOIN near USING (pid, label) GROUP BY pid""")
def support_fusion(spark, d):
    mp, m = tables(spark, d)
    anchors = views.points(spark, d).where("truth > 0 AND y <= 30").select("pid", F.col("truth").alias("label"), "x", "y", "z")
    ranked = cut(masks.candidates(mp, m, 0.1, 0.6, 12).select("mask_id", "n", "object_score", "ranking"))
    return rounded(nudged(masks.fuse_support(anchors, ranked, mp.where("score >= 0.6"), lambda p: near_own_group(p, anchors, 4.0, "label"), probability=0.6), "offer"))


WIDE = consensus.Consensus(vote_distance=20.0, distance=4.0, growth=3.0, growth_vote=6.0, growth_margin=0.25)
CONSENSUS = """WITH {points}, b AS (SELECT pid, dataset_id, x, y, z, x AS vx, y AS vy, 1 - discount * 5 AS p, CASE WHEN truth > 0 AND y <= 30 AND truth % 3 <> 0 THEN truth ELSE 0 END AS anchor, CASE WHEN pred > 0 THEN pred + 5000 ELSE 0 END AS other FROM points),
c AS (SELECT other, anchor, count(*) AS n FROM b WHERE anchor > 0 AND other > 0 GROUP BY ALL), w AS (SELECT other, arg_max(anchor, (n, -anchor)) AS dest, max(n) AS n, sum(n) AS total FROM c GROUP BY 1),
best AS (SELECT other, dest FROM w WHERE n >= 4 AND n / total >= 0.8), mid AS (SELECT dataset_id, anchor AS label, median(vx) AS cx, median(vy) AS cy FROM b WHERE anchor > 0 GROUP BY ALL),
free AS (SELECT * FROM b WHERE anchor = 0 AND other > 0 AND p >= 0.5), off AS (SELECT f.pid, dest AS label, f.x, f.y, f.z FROM free f JOIN best USING (other) JOIN mid ON mid.label = dest WHERE (vx - cx) * (vx - cx) + (vy - cy) * (vy - cy) <= 400),
comp AS (SELECT DISTINCT o.pid, o.label FROM off o JOIN b a ON a.anchor = o.label AND (o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y) + (o.z - a.z) * (o.z - a.z) <= 16),
alone AS (SELECT dataset_id, other FROM b WHERE other > 0 GROUP BY ALL HAVING avg(CASE WHEN anchor > 0 THEN 1.0::DOUBLE ELSE 0 END) <= 0.05 AND other NOT IN (SELECT other FROM best)),
new AS (SELECT f.dataset_id, other, median(vx) AS x, median(vy) AS y FROM free f JOIN alone USING (other) GROUP BY ALL HAVING count(*) >= 12 AND max(z) >= 2),
far AS (SELECT other FROM new n WHERE NOT EXISTS (SELECT 1 FROM mid m WHERE m.dataset_id = n.dataset_id AND (m.cx - n.x) * (m.cx - n.x) + (m.cy - n.y) * (m.cy - n.y) < 1)), hp AS (SELECT other AS g, x, CAST(y AS DOUBLE) AS y FROM free JOIN alone USING (other) JOIN far USING (other)), HULLS,
ids AS (SELECT g AS other, (SELECT max(anchor) FROM b) + g AS label FROM hv WHERE area >= 0.75),
f3 AS (SELECT b.*, CASE WHEN anchor > 0 THEN anchor WHEN comp.label IS NOT NULL THEN comp.label WHEN ids.label IS NOT NULL AND p >= 0.5 THEN ids.label ELSE 0 END AS label,
  CASE WHEN anchor > 0 THEN 1 WHEN comp.label IS NOT NULL THEN 2 WHEN ids.label IS NOT NULL AND p >= 0.5 THEN 3 ELSE 0 END AS source FROM b LEFT JOIN comp USING (pid) LEFT JOIN ids USING (other)),
cen AS (SELECT dataset_id, label, median(vx) AS cx, median(vy) AS cy FROM f3 WHERE label > 0 GROUP BY ALL),
rk AS (SELECT f.pid, c.label, (f.vx - c.cx) * (f.vx - c.cx) + (f.vy - c.cy) * (f.vy - c.cy) AS d2, row_number() OVER (PARTITION BY f.pid ORDER BY (f.vx - c.cx) * (f.vx - c.cx) + (f.vy - c.cy) * (f.vy - c.cy), c.label) AS k
  FROM f3 f JOIN cen c USING (dataset_id) WHERE f.label = 0 AND f.p >= 0.5 AND f.z >= 0.5),
safe AS (SELECT a.pid, a.label FROM rk a LEFT JOIN rk b ON a.pid = b.pid AND b.k = 2 WHERE a.k = 1 AND a.d2 <= 36 AND (b.d2 IS NULL OR sqrt(b.d2) - sqrt(a.d2) >= 0.25)),
grown AS (SELECT DISTINCT s.pid, s.label FROM safe s JOIN f3 f USING (pid) JOIN f3 m ON m.label = s.label AND (f.x - m.x) * (f.x - m.x) + (f.y - m.y) * (f.y - m.y) + (f.z - m.z) * (f.z - m.z) <= 9)
SELECT f.pid, f.dataset_id, coalesce(g.label, f.label)::BIGINT AS label, CASE WHEN g.label IS NOT NULL THEN 4 ELSE f.source END AS source FROM f3 f LEFT JOIN grown g USING (pid)"""


@query(CONSENSUS.replace("HULLS", hulls_sql("hv", "hp")))
def dual_consensus(spark, d):
    anchor = F.when(F.expr("truth > 0 AND y <= 30 AND truth % 3 <> 0"), F.col("truth")).otherwise(0)
    other = F.when(F.col("pred") > 0, F.col("pred") + 5000).otherwise(0)
    base = views.points(spark, d).select("pid", "dataset_id", "x", "y", "z", F.col("x").alias("vx"), F.col("y").alias("vy"), (1 - F.col("discount") * 5).alias("p"), anchor.alias("anchor"), other.alias("other"))
    return consensus.fuse(base, WIDE)
