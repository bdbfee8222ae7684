"""Whole campaigns: preparation, prediction by windows, calibration grids, audits and reports, each as one composed query.

A grid of configurations is a column, not a loop: points are dealt to every configuration under a packed plot id
(plot * 100 + configuration), so one job scores them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.checkpoint import cut, scratch
from ..operators import flooding, grid, kernels, masks, metrics, raster, spatial, votes
from ..operators.predict import by_windows
from ..sources import readers, sinks, views
from .fusion import ANCHOR, FUSED, M, reconciled, tables
from .geometry import hulls_sql
from .gridding import CELLS, canopy
from .registry import query
from .scoring import MATCHES, PLOT, RATIO, nudged, plot_metrics, rounded


def dealt(points: DataFrame, labels: list[Column], by: str = "dataset_id") -> DataFrame:
    """``points`` once for each prediction in ``labels``, as ``pred`` under a packed plot id."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), c.cast("bigint").alias("p")) for i, c in enumerate(labels))))
    return points.withColumn("_e", each).withColumn(by, F.col(by) * 100 + F.col("_e.i")).withColumn("pred", F.col("_e.p")).drop("_e")


def dealt_sql(sql: str, *labels: str, points: str = "points") -> str:
    """``sql`` over points that are dealt to every prediction, given as SQL expressions."""
    union = " UNION ALL ".join(f"SELECT * REPLACE (dataset_id * 100 + {i} AS dataset_id, CAST({e} AS BIGINT) AS pred) FROM {points}" for i, e in enumerate(labels))
    return sql.replace("k AS (SELECT * FROM points WHERE truth >= 0)", f"dealt AS ({union}), k AS (SELECT * FROM dealt WHERE truth >= 0)")


def config() -> Column:
    return F.col("dataset_id") % 100


F1 = "tp / greatest(tp + 0.5 * (fp + fn), 1)"


# calibration grids


@query(MATCHES + """, pc AS (SELECT dataset_id, pred, avg(1 - discount * 5) AS conf FROM k WHERE pred > 0 GROUP BY ALL), nt AS (SELECT count(*) AS n FROM (SELECT DISTINCT dataset_id, truth FROM k WHERE truth > 0)),
g AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 81) t(i)), c AS (SELECT threshold, count(*) FILTER (conf + 1e-9 >= threshold) AS np, count(*) FILTER (m.pred IS NOT NULL AND conf + 1e-9 >= threshold) AS tp, coalesce(sum(m.iou) FILTER (conf + 1e-9 >= threshold), 0) AS iou_sum
FROM g, pc LEFT JOIN matches m USING (dataset_id, pred) GROUP BY 1), s9 AS (SELECT threshold, tp, np - tp AS fp, n - tp AS fn, iou_sum FROM c, nt),
r AS (SELECT *, round(tp / greatest(tp + 0.5 * (fp + fn), 1), 6) AS f1, round(iou_sum / greatest(tp + 0.5 * (fp + fn), 1), 6) AS pq FROM s9) SELECT threshold, tp, fp, fn, f1, pq, threshold = (SELECT arg_max(threshold, (f1, pq, threshold)) FROM r) AS best FROM r""")
def detector_calibration(spark, d):
    """Eighty confidence thresholds; the best by F1, then PQ, then confidence."""
    p = metrics.known(views.points(spark, d))
    hit = metrics.matches(metrics.ious(metrics.contingency(p))).select("dataset_id", "pred", "iou")
    conf = p.where("pred > 0").groupBy("dataset_id", "pred").agg((F.avg(1 - F.col("discount") * 5) + 1e-9).alias("conf")).join(hit, ["dataset_id", "pred"], "left")
    truths = p.where("truth > 0").select("dataset_id", "truth").distinct().agg(F.count("*").alias("n"))
    at = conf.withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: i / 100.0)))
    sure = F.col("conf") >= F.col("threshold")
    c = at.groupBy("threshold").agg(F.count_if(sure).alias("np"), F.count_if(sure & F.col("iou").isNotNull()).alias("tp"), F.coalesce(F.sum(F.when(sure, F.col("iou"))), F.lit(0.0)).alias("iou_sum"))
    s = c.join(F.broadcast(truths)).select("threshold", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("n") - F.col("tp")).alias("fn"), "iou_sum")
    r = s.select("threshold", "tp", "fp", "fn", *(F.round(x, 6).alias(n) for n, x in zip(("precision", "recall", "f1", "pq", "sq"), metrics.ratios(*map(F.col, ("tp", "fp", "fn", "iou_sum"))), strict=True) if n in ("f1", "pq")))
    top = F.max(F.struct("f1", "pq", "threshold")).over(Window.partitionBy())  # eighty rows
    return r.select("threshold", "tp", "fp", "fn", "f1", "pq", (F.col("threshold") == top["threshold"]).alias("best"))


def vote_grid(spark, d, probabilities, variants):
    """Metrics of vote instances for each probability and variant of the voting; one job for each variant."""
    p = views.points(spark, d)
    base = p.select("dataset_id", "pid", "truth", "x", "y", "z", F.col("x").alias("vx"), F.col("y").alias("vy"), (1 - F.col("discount") * 5).alias("p"))
    out = None
    for v, how in enumerate(variants):
        each = dealt(base, [F.when(F.col("p") >= q, 1).otherwise(0) for q in probabilities]).withColumn("pid", F.col("pid") * 100 + config())
        found = votes.instances(each.where("pred = 1"), how).select("dataset_id", "pid", F.col("label").alias("_l"))
        scored = metrics.instance_metrics(each.drop("pred").join(found, ["dataset_id", "pid"], "left").withColumn("pred", F.coalesce("_l", F.lit(0))))
        rows = metrics.totals(scored.withColumn("config", config() + v * len(probabilities)), "config")
        out = rows if out is None else out.unionByName(rows)
    return out


def vote_grid_sql(probabilities, variants) -> str:
    """The same in SQL; a variant is (smoothing in cells, separation in cells, radius)."""
    parts, rows = [], []
    for i, (sigma, reach, radius, q) in enumerate((*v, q) for v in variants for q in probabilities):
        n, span = f"x{i}", int(4 * sigma + 0.5)
        parts.append(f"""{n}v AS (SELECT dataset_id, CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col, count(*) AS n FROM points WHERE 1 - discount * 5 >= {q} AND z >= 0.5 GROUP BY ALL),
{n}s AS (SELECT a.dataset_id, a.row, a.col, sum(b.n * exp(-((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) / (2 * {sigma}::DOUBLE * {sigma}::DOUBLE)) / pow((SELECT sum(exp(-i * i / (2 * {sigma}::DOUBLE * {sigma}::DOUBLE))) FROM range(-{span}, {span} + 1) t(i)), 2)) AS d
FROM {n}v a JOIN {n}v b ON a.dataset_id = b.dataset_id AND b.row BETWEEN a.row - {span} AND a.row + {span} AND b.col BETWEEN a.col - {span} AND a.col + {span} GROUP BY ALL),
{n}h AS (SELECT a.dataset_id, a.row, a.col, a.d, max(b.d) AS high FROM {n}s a JOIN {n}s b ON a.dataset_id = b.dataset_id AND b.row BETWEEN a.row - {reach} AND a.row + {reach} AND b.col BETWEEN a.col - {reach} AND a.col + {reach} GROUP BY ALL),
{n}q AS (SELECT dataset_id, row + 0.5 AS y, col + 0.5 AS x, (row + 1073741824) * 2147483648 + col + 1073741824 AS peak FROM (SELECT *, max(d) OVER (PARTITION BY dataset_id, floor((col + 0.5) / 20), floor((row + 0.5) / 20)) AS t FROM {n}h) WHERE d >= high - 1e-9 AND d >= 0.3 * t),
{n}a AS (SELECT p.dataset_id, p.pid, arg_min(q.peak, ((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), q.peak)) AS label FROM points p JOIN {n}q q ON q.dataset_id = p.dataset_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= {radius * radius} WHERE 1 - discount * 5 >= {q} AND z >= 0.5 GROUP BY ALL),
{n}l AS (SELECT a.dataset_id, label FROM {n}a a JOIN points p USING (dataset_id, pid) GROUP BY ALL HAVING count(*) >= 8 AND max(z) >= 2), {n}p AS (SELECT a.dataset_id || ':' || a.label AS g, p.x, CAST(p.y AS DOUBLE) AS y FROM {n}a a JOIN {n}l l ON l.dataset_id = a.dataset_id AND l.label = a.label JOIN points p ON p.dataset_id = a.dataset_id AND p.pid = a.pid),
{hulls_sql(n + "z", n + "p")}""")
        rows.append(f"SELECT p.* REPLACE (p.dataset_id * 100 + {i} AS dataset_id, coalesce(l.label, 0) AS pred) FROM points p LEFT JOIN (SELECT a.dataset_id, a.pid, a.label FROM {n}a a JOIN {n}z z ON z.g = a.dataset_id || ':' || a.label WHERE z.area >= 0.75) l ON l.dataset_id = p.dataset_id AND l.pid = p.pid")
    text = PLOT.replace("k AS (SELECT * FROM points WHERE truth >= 0)", ", ".join(parts) + ", dealt AS (" + " UNION ALL ".join(rows) + "), k AS (SELECT * FROM dealt WHERE truth >= 0)")
    return text + f", c AS (SELECT CAST(dataset_id % 100 AS INT) AS config, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(iou_sum) AS iou_sum FROM plot GROUP BY 1) SELECT config, tp, fp, fn, round(iou_sum, 6) AS iou_sum, {RATIO} FROM c"


def voted(smoothing, separation, radius):
    return votes.Voting(probability=0.0, cell=1.0, smoothing=smoothing, separation=separation, fraction=0.3, core=20.0, radius=radius, points=8)


@query(vote_grid_sql((0.5, 0.7, 0.9), [(1.0, 1, 3.0), (1.0, 2, 3.0)]))
def full_crown_calibration(spark, d):
    """Three probabilities by two separations of the vote clustering, scored against the truth."""
    return rounded(vote_grid(spark, d, (0.5, 0.7, 0.9), [voted(1.0, 1.0, 3.0), voted(1.0, 2.0, 3.0)]))


@query(vote_grid_sql((0.6, 0.8), [(1.0, 2, 2.0), (1.0, 2, 4.0)]))
def crown_scale_calibration(spark, d):
    """Profiles of probability and radius; each variant is a shard of a log, and a second run finds none pending."""
    to, variants = scratch(spark, "trials"), [voted(1.0, 2.0, 2.0), voted(1.0, 2.0, 4.0)]
    jobs = spark.createDataFrame([(i,) for i in range(len(variants))], "stripe int")
    for job in sinks.pending(jobs, spark, to, "scale").collect():
        rows = vote_grid(spark, d, (0.6, 0.8), [variants[job["stripe"]]])
        sinks.shard(rows.withColumn("config", F.col("config") + 2 * job["stripe"]), to, "scale", job["stripe"])
    if not sinks.pending(jobs, spark, to, "scale").isEmpty():
        raise RuntimeError("a trial is missing from the log")
    return rounded(spark.read.parquet(f"{to}/signature=scale").drop("stripe"))


@query(PLOT.replace("WITH {points}", "WITH {points}, {plots}") + f""", r AS (SELECT * FROM plot JOIN plots USING (dataset_id)), u AS (SELECT 'pooled' AS scope, * FROM r UNION ALL SELECT 'native', * FROM r WHERE dataset_id % 3 <> 0),
c AS (SELECT scope, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(iou_sum) AS iou_sum FROM u GROUP BY 1) SELECT scope, tp, fp, fn, round(iou_sum, 6) AS iou_sum, {RATIO} FROM c""")
def dual_head_evaluation(spark, d):
    """All plots pooled, and those with annotations of their own."""
    scopes = F.explode(F.array_compact(F.array(F.lit("pooled"), F.when(F.col("dataset_id") % 3 != 0, "native"))))
    return rounded(metrics.totals(plot_metrics(spark, d).withColumn("scope", scopes), "scope"))


OTHER = "CASE WHEN y <= 40 AND pred > 0 THEN supp + 1 ELSE 0 END"


@query(dealt_sql(PLOT.replace("WITH {points}", "WITH {points}, {plots}"), "pred", OTHER) + f""", w AS (SELECT CAST(dataset_id // 100 AS INT) AS dataset_id, CAST(dataset_id % 100 AS INT) AS model, {F1} AS f1, iou_sum / greatest(tp + 0.5 * (fp + fn), 1) AS pq FROM plot)
SELECT a.dataset_id, round(a.pq, 6) AS pq_a, round(b.pq, 6) AS pq_b, round(b.f1 - a.f1, 6) AS f1_gain, CASE WHEN round(b.pq, 9) > round(a.pq, 9) THEN 'b' WHEN round(b.pq, 9) < round(a.pq, 9) THEN 'a' ELSE 'even' END AS better
FROM w a JOIN w b USING (dataset_id) JOIN plots USING (dataset_id) WHERE a.model = 0 AND b.model = 1 AND model_split = 'test'""")
def held_out_comparison(spark, d):
    """Two frozen models on the same held-out plots."""
    other = F.when((F.col("y") <= 40) & (F.col("pred") > 0), F.col("supp") + 1).otherwise(0)
    m = metrics.instance_metrics(dealt(views.points(spark, d), [F.col("pred"), other]))
    _, _, f1, pq, _ = metrics.ratios(*map(F.col, ("tp", "fp", "fn", "iou_sum")))
    s = m.select(F.floor(F.col("dataset_id") / 100).cast("int").alias("dataset_id"), config().alias("model"), f1, pq)
    one = lambda c, k: F.max(F.when(F.col("model") == k, F.col(c)))
    t = s.join(views.plots(spark, d).where("model_split = 'test'"), "dataset_id", "left_semi").groupBy("dataset_id").agg(one("pq", 0).alias("pq_a"), one("pq", 1).alias("pq_b"), (one("f1", 1) - one("f1", 0)).alias("f1_gain"))
    a, b = F.round("pq_a", 9), F.round("pq_b", 9)
    return rounded(t.withColumn("better", F.when(b > a, "b").when(b < a, "a").otherwise("even")))


@query(dealt_sql(PLOT.replace("WITH {points}", "WITH {points}, {plots}"), "pred", OTHER) + """, m AS (SELECT collection, CAST(matches.dataset_id % 100 AS INT) AS mode, iou FROM matches JOIN plots ON plots.dataset_id = matches.dataset_id // 100) SELECT collection, mode, count(*) AS matched, round(avg(iou), 6) AS mean_iou FROM m GROUP BY ALL""")
def normalisation_diagnostic(spark, d):
    """Mean matched IoU of each collection under two modes of prediction."""
    other = F.when((F.col("y") <= 40) & (F.col("pred") > 0), F.col("supp") + 1).otherwise(0)
    hit = metrics.matches(metrics.ious(metrics.contingency(metrics.known(dealt(views.points(spark, d), [F.col("pred"), other])))))
    s = hit.select(F.floor(F.col("dataset_id") / 100).cast("int").alias("dataset_id"), config().alias("mode"), "iou").join(views.plots(spark, d), "dataset_id")
    return rounded(s.groupBy("collection", "mode").agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou")))


def fused_sql(name: str, dominance: float, radius: float) -> str:
    """Labels after support fusion, as SQL steps ending in ``name`` (pid, label)."""
    n = name
    return f"""{n}w AS (SELECT w.mask_id, w.label, w.s / (c.n + z.size - w.s) AS aff FROM w JOIN c USING (mask_id) JOIN z ON z.label = w.label WHERE w.s / w.total >= {dominance} AND w.s / (c.n + z.size - w.s) >= 0.2),
{n}o AS (SELECT h.pid, v.label, h.score * h.o * v.aff AS offer, h.ranking, h.mask_id, h.x, h.y, h.z FROM held h JOIN {n}w v USING (mask_id) WHERE h.held IS NULL AND h.score >= 0.6),
{n}n AS (SELECT DISTINCT o.pid, o.label FROM {n}o o JOIN anchor a ON a.label = o.label AND (o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y) + (o.z - a.z) * (o.z - a.z) <= {radius * radius}),
{name} AS (SELECT pid, arg_max(label, (offer, ranking, -mask_id)) AS label FROM {n}o JOIN {n}n USING (pid, label) GROUP BY pid)"""


SUPPORT = ANCHOR + """, c AS (SELECT mask_id, count(*) AS n, any_value(object_score) AS o, any_value(object_score) * avg(score) AS ranking FROM kept JOIN masks USING (mask_id) WHERE object_score >= 0.1 GROUP BY 1 HAVING count(*) >= 12),
held AS (SELECT q.*, c.n, c.o, c.ranking, a.label AS held FROM kept q JOIN c USING (mask_id) LEFT JOIN anchor a USING (pid)), sh AS (SELECT mask_id, held AS label, count(*) AS s FROM held WHERE held IS NOT NULL GROUP BY ALL),
w AS (SELECT mask_id, arg_max(label, (s, -label)) AS label, max(s) AS s, sum(s) AS total FROM sh GROUP BY 1), z AS (SELECT label, count(*) AS size FROM anchor GROUP BY 1)"""


def ablation_sql() -> str:
    steps = f"{SUPPORT}, {fused_sql('fa', 0.8, 4.0)}, {fused_sql('fb', 0.6, 2.0)}, lab AS (SELECT p.*, coalesce(a.label, 0) AS l0, coalesce(a.label, fa.label, 0) AS l1, coalesce(a.label, fb.label, 0) AS l2 FROM points p LEFT JOIN anchor a USING (pid) LEFT JOIN fa ON fa.pid = p.pid LEFT JOIN fb ON fb.pid = p.pid)"
    union = " UNION ALL ".join(f"SELECT * EXCLUDE (l0, l1, l2) REPLACE (dataset_id * 100 + {i} AS dataset_id, CAST(l{i} AS BIGINT) AS pred) FROM lab" for i in range(3))
    head = M.replace("WITH {points}, {masks}", "WITH {points}, {masks}")
    body = PLOT.removeprefix("WITH {points}, ").replace("k AS (SELECT * FROM points WHERE truth >= 0)", f"dealt AS ({union}), k AS (SELECT * FROM dealt WHERE truth >= 0)")
    body = body.replace("s AS (SELECT *, sum(n) OVER", "s1 AS (SELECT *, sum(n) OVER").replace("FROM s WHERE", "FROM s1 WHERE")
    return f"{head}, {steps}, {body}, g9 AS (SELECT CAST(dataset_id % 100 AS INT) AS config, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(iou_sum) AS iou_sum FROM plot GROUP BY 1), q9 AS (SELECT *, round(iou_sum / greatest(tp + 0.5 * (fp + fn), 1), 6) AS pq FROM g9) SELECT config, tp, fp, fn, pq, pq >= (SELECT pq FROM q9 WHERE config = 0) AS accepted FROM q9"


@query(ablation_sql())
def support_ablation(spark, d):
    """Anchors alone and two families of support fusion; a family is accepted if its quality does not fall."""
    mp, m = tables(spark, d)
    p = views.points(spark, d)
    anchors = p.where("truth > 0 AND y <= 30").select("pid", F.col("truth").alias("label"), "x", "y", "z")
    ranked = cut(masks.candidates(mp, m, 0.1, 0.6, 12).select("mask_id", "n", "object_score", "ranking"))
    offered = mp.where("score >= 0.6")
    won = masks.leanings(anchors, ranked, offered)
    fuse = lambda dominance, radius: masks.awarded(spatial.near_own_group(masks.offers(anchors, won, offered, dominance, probability=0.6), anchors, radius, "label")).select("pid", "label")
    own = p.join(anchors.select("pid", F.col("label").alias("a")), "pid", "left")
    for name, how in (("b", (0.8, 4.0)), ("c", (0.6, 2.0))):
        own = own.join(fuse(*how).withColumnRenamed("label", name), "pid", "left")
    labels = [F.coalesce("a", F.lit(0)), F.coalesce("a", "b", F.lit(0)), F.coalesce("a", "c", F.lit(0))]
    t = metrics.totals(metrics.instance_metrics(dealt(own, labels).drop("a", "b", "c")).withColumn("config", config()), "config")
    pq = F.round("pq", 6)
    base = F.max(F.when(F.col("config") == 0, pq)).over(Window.partitionBy())  # a row a configuration
    return t.select("config", "tp", "fp", "fn", pq.alias("pq"), (pq >= base).alias("accepted"))


GUARDS = (0.0, 0.3, 0.6)


def audit_sql() -> str:
    ratio = "SELECT * FROM (VALUES " + ", ".join(f"({g}::DOUBLE)" for g in GUARDS) + ") v(guard)"
    text = FUSED.replace("links AS (SELECT o.a, o.b FROM ov o", f"guards AS ({ratio}), links AS (SELECT guard, o.a, o.b FROM guards, ov o").replace("AND abs(p.top - q.top) <= 3)", "AND abs(p.top - q.top) <= 3 AND least(p.n, q.n) / greatest(p.n, q.n) >= guard)")
    text = text.replace("e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)", "e AS (SELECT guard, a, b FROM links UNION ALL SELECT guard, b, a FROM links)")
    text = text.replace("walk AS (SELECT mask_id, mask_id AS root FROM nodes UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.mask_id)", "walk AS (SELECT guard, mask_id, mask_id AS root FROM nodes, guards UNION SELECT w.guard, e.b, w.root FROM walk w JOIN e ON e.a = w.mask_id AND e.guard = w.guard)")
    text = text.replace("members AS (SELECT mask_id, min(root) AS grp FROM walk GROUP BY 1)", "members AS (SELECT guard, mask_id, min(root) AS grp FROM walk GROUP BY ALL)").replace("fused AS (SELECT grp, pid,", "fused AS (SELECT guard, grp, pid,")
    return text + """, sz AS (SELECT truth, count(*) AS size FROM points WHERE truth > 0 GROUP BY 1), g AS (SELECT guard, grp, count(*) FILTER (truth >= 0) AS known FROM fused GROUP BY ALL),
h AS (SELECT guard, grp, truth, count(*) AS c FROM fused WHERE truth > 0 GROUP BY ALL), r AS (SELECT h.guard, h.truth FROM h JOIN sz USING (truth) JOIN g USING (guard, grp) WHERE c / (known + size - c) >= 0.5)
SELECT guard, count(DISTINCT r.truth) AS reached, (SELECT count(*) FROM sz) AS truths, (SELECT count(DISTINCT grp) FROM members m WHERE m.guard = gd.guard) AS proposals FROM guards gd LEFT JOIN r USING (guard) GROUP BY guard"""


@query(audit_sql())
def recall_audit(spark, d):
    """Truths that fused masks reach at half an IoU, under three guards on the ratio of sizes."""
    sizes = views.points(spark, d).where("truth > 0").groupBy("truth").agg(F.count("*").alias("size"))
    truths = sizes.agg(F.count("*").alias("truths"))
    mp, m = tables(spark, d)
    kept = mp.where("score >= 0.6")
    nodes = cut(masks.candidates(mp, m, 0.1, 0.6, 8, 1.5))
    pairs = cut(masks.overlaps(kept))
    held = None
    for i, guard in enumerate(GUARDS):
        one = masks.grouped(nodes, masks.links(pairs, nodes, distance=8.0, size_ratio=guard)).withColumn("guard", F.lit(i))
        held = one if held is None else held.unionByName(one)
    # a group that several guards give is fused once, under the id of its masks
    whole = cut(held.groupBy("guard", "group").agg(F.sort_array(F.collect_list("mask_id")).alias("masks")))
    alike = cut(whole.groupBy("masks").agg(F.collect_list("guard").alias("guards")).withColumn("group", F.monotonically_increasing_id()))
    members = alike.select("group", F.explode("masks").alias("mask_id")).join(nodes.select("mask_id", "n"), "mask_id")
    counts = cut(masks.fused_points(kept, members).groupBy("group", "truth").agg(F.count("*").alias("c")))
    known = counts.groupBy("group").agg(F.sum(F.when(F.expr("truth >= 0"), F.col("c")).otherwise(0)).alias("known"))
    hit = counts.where("truth > 0").join(sizes, "truth").join(known, "group").where(F.col("c") / (F.col("known") + F.col("size") - F.col("c")) >= 0.5)
    reached = hit.join(alike.select("group", F.explode("guards").alias("i")), "group").groupBy("i").agg(F.count_distinct("truth").alias("reached"))
    proposals = whole.groupBy(F.col("guard").alias("i")).agg(F.count("*").alias("proposals"))
    guards = spark.createDataFrame(list(enumerate(GUARDS)), "i int, guard double")
    out = guards.join(reached, "i", "left").join(proposals, "i", "left").join(F.broadcast(truths))
    return out.select("guard", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("reached", "truths", "proposals")))


VERIFIED = FUSED + """, sz AS (SELECT truth, count(*) AS size FROM points WHERE truth > 0 GROUP BY 1), g AS (SELECT grp, any_value(pid) AS any_pid, count(*) AS n, max(z) AS top, avg(score) AS mean, count(*) FILTER (truth >= 0) AS known FROM fused GROUP BY 1),
v AS (SELECT grp, max(object_score) AS obj FROM members JOIN nodes USING (mask_id) GROUP BY 1), b AS (SELECT h.grp, max(c / (known + size - c)) AS iou FROM (SELECT grp, truth, count(*) AS c FROM fused WHERE truth > 0 GROUP BY ALL) h JOIN sz USING (truth) JOIN g USING (grp) GROUP BY 1),
x AS (SELECT grp, ln(1 + n) AS f1, top AS f2, mean AS f3, obj AS f4, CASE WHEN known / n < 0.5 THEN -1 WHEN coalesce(iou, 0) >= 0.5 THEN 1 ELSE 0 END AS target, grp % 3 <> 0 AS fit FROM g JOIN v USING (grp) LEFT JOIN b USING (grp)),
m AS (SELECT """ + ", ".join(f"avg(f{i}) FILTER (fit) AS m{i}, greatest(stddev_pop(f{i}) FILTER (fit), 1e-6) AS s{i}" for i in range(1, 5)) + """ FROM x),
sc AS (SELECT grp, target, fit, 1 / (1 + exp(-(""" + " + ".join(f"least(greatest((f{i} - m{i}) / s{i}, -5), 5)" for i in range(1, 5)) + """) / 4)) AS score FROM x, m)"""


@query(VERIFIED + """, t AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(3, 18) t(i)), c AS (SELECT threshold, count(*) FILTER (score >= threshold) AS kept, count(*) FILTER (score >= threshold AND target = 1) AS good, count(*) FILTER (target = 1) AS targets FROM t, sc WHERE NOT fit AND target >= 0 GROUP BY 1)
SELECT threshold, kept, good, targets, good >= 0.5 * targets AND good >= 0.5 * kept AS passes FROM c""")
def verifier_sweep(spark, d):
    """Fused proposals verified: features standardised on the fitting part and clipped, a logistic score, fifteen thresholds and a gate."""
    fused, members = reconciled(spark, d)
    sizes = views.points(spark, d).where("truth > 0").groupBy("truth").agg(F.count("*").alias("size"))
    f = masks.features(fused, members).select("group", F.col("log_points").alias("f1"), F.col("max_height").alias("f2"), F.col("mean_mask").alias("f3"), F.col("max_object").alias("f4"))
    x = cut(f.join(masks.targets(fused, sizes).select("group", "target"), "group").withColumn("fit", F.col("group") % 3 != 0))  # a row a proposal
    fit = [g.alias(n + str(i)) for i in range(1, 5) for n, g in (("m", F.avg(F.when(F.col("fit"), F.col(f"f{i}")))), ("s", F.greatest(F.stddev_pop(F.when(F.col("fit"), F.col(f"f{i}"))), F.lit(1e-6))))]
    clipped = [F.least(F.greatest((F.col(f"f{i}") - F.col(f"m{i}")) / F.col(f"s{i}"), F.lit(-5.0)), F.lit(5.0)) for i in range(1, 5)]
    scored = x.join(F.broadcast(x.agg(*fit))).withColumn("score", logistic(sum(clipped[1:], clipped[0]) / 4)).where("NOT fit AND target >= 0")
    at = scored.withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(3), F.lit(17)), lambda i: i / 20.0)))
    sure, good = F.col("score") >= F.col("threshold"), F.col("target") == 1
    c = at.groupBy("threshold").agg(F.count_if(sure).alias("kept"), F.count_if(sure & good).alias("good"), F.count_if(good).alias("targets"))
    return c.withColumn("passes", (F.col("good") >= 0.5 * F.col("targets")) & (F.col("good") >= 0.5 * F.col("kept")))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


SIZES = (1.0, 2.0, 4.0)


@query("""WITH {points}, s AS (SELECT unnest([1.0::DOUBLE, 2, 4]) AS size), g AS (SELECT size, dataset_id, floor(x / size) AS a, floor(y / size) AS b, floor(z / size) AS c, truth, count(*) AS n FROM points, s WHERE truth >= 0 GROUP BY ALL),
u AS (SELECT size, dataset_id, sum(n) AS n, max(n) AS top FROM g GROUP BY size, dataset_id, a, b, c) SELECT size, CASE WHEN grouping(dataset_id) = 1 THEN 'all' ELSE CAST(dataset_id AS VARCHAR) END AS plot, count(*) AS groups, round(sum(n) / count(*), 6) AS compression, round(sum(top) / sum(n), 6) AS purity FROM u GROUP BY GROUPING SETS ((size, dataset_id), (size))""")
def superpoint_feasibility(spark, d):
    """Cell partitions of several sizes: compression and purity of each plot and over all."""
    p = metrics.known(views.points(spark, d)).withColumn("size", F.explode(F.array(*map(F.lit, SIZES))))
    at = [F.floor(F.col(a) / F.col("size")).alias(f"g{a}") for a in "xyz"]
    g = p.groupBy("size", "dataset_id", *at, "truth").agg(F.count("*").alias("n")).groupBy("size", "dataset_id", "gx", "gy", "gz").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    plots = F.explode(F.array(F.col("dataset_id").cast("string"), F.lit("all"))).alias("plot")
    return rounded(g.select("size", plots, "n", "top").groupBy("size", "plot").agg(F.count("*").alias("groups"), (F.sum("n") / F.count("*")).alias("compression"), (F.sum("top") / F.sum("n")).alias("purity")), "compression", "purity")


@query("WITH {points}, {plots}, t AS (SELECT truth AS g, x, CAST(y AS DOUBLE) AS y FROM points WHERE truth > 0), b AS (SELECT truth AS g, any_value(dataset_id) AS dataset_id, (max(x) - min(x)) * (max(y) - min(y)) AS box FROM points WHERE truth > 0 GROUP BY 1), " + hulls_sql("h", "t", 0.0) + """
SELECT collection || ':' || model_split AS scope, count(*) AS crowns, count(*) FILTER (abs(area - box) <= 0.05 * box) AS rectangles, round(avg(area / box), 6) AS fill FROM h JOIN b USING (g) JOIN plots USING (dataset_id) GROUP BY 1""")
def rectangle_audit(spark, d):
    """Crowns whose hull nearly fills their bounding box, by collection and split."""
    p = views.points(spark, d).where("truth > 0")
    box = p.groupBy("truth").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("box"))
    h = kernels.hulls(p, "truth", 0.0).join(box, "truth").join(views.plots(spark, d), "dataset_id")
    return rounded(h.groupBy(F.concat_ws(":", "collection", "model_split").alias("scope")).agg(F.count("*").alias("crowns"), F.count_if(F.abs(F.col("area") - F.col("box")) <= 0.05 * F.col("box")).alias("rectangles"), F.avg(F.col("area") / F.col("box")).alias("fill")))


# preparation


LIFTED = """lifted AS (SELECT * REPLACE (z + (dataset_id % 2) * 5 AS z, CASE WHEN dataset_id % 4 >= 2 AND classification = 2 THEN 5 ELSE classification END AS classification) FROM points),
lc AS (SELECT *, CAST(floor(y / 2) AS BIGINT) AS row, CAST(floor(x / 2) AS BIGINT) AS col FROM lifted), st AS (SELECT dataset_id, bool_or(classification = 2) AS g, min(z) AS low FROM lc GROUP BY 1),
md AS (SELECT dataset_id, o, CASE WHEN o = 0 AND g THEN 'class2' WHEN low <= 2 THEN 'zero' WHEN g THEN 'class2' ELSE 'envelope' END AS method FROM st, range(2) t(o)),
kn AS (SELECT dataset_id, row, col, avg(z) AS dtm FROM lc WHERE classification = 2 GROUP BY ALL), oc AS (SELECT DISTINCT dataset_id, row, col FROM lc),
c2 AS (SELECT oc.dataset_id, oc.row, oc.col, first(kn.dtm ORDER BY (oc.row - kn.row) * (oc.row - kn.row) + (oc.col - kn.col) * (oc.col - kn.col), kn.row, kn.col) AS dtm FROM oc JOIN kn USING (dataset_id) GROUP BY ALL),
lw AS (SELECT dataset_id, row, col, min(z) AS v FROM lc WHERE dataset_id % 4 = 3 GROUP BY ALL), bx AS (SELECT dataset_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM lw GROUP BY 1),
gr AS (SELECT dataset_id, row, unnest(range(c0, c1 + 1)) AS col FROM (SELECT *, unnest(range(r0, r1 + 1)) AS row FROM bx)), fl AS (SELECT g.dataset_id, g.row, g.col, first(v ORDER BY (g.row - w.row) * (g.row - w.row) + (g.col - w.col) * (g.col - w.col), w.row, w.col) AS v FROM gr g JOIN lw w ON g.dataset_id = w.dataset_id AND abs(g.row - w.row) <= 6 AND abs(g.col - w.col) <= 6 GROUP BY ALL),
mn AS (SELECT a.dataset_id, a.row, a.col, min(b.v) AS v FROM fl a JOIN fl b ON a.dataset_id = b.dataset_id AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL),
off AS (SELECT i, j FROM range(-4, 5) a(i), range(-4, 5) b(j)), mr AS (SELECT m.dataset_id, m.row, m.col, CASE WHEN m.row + i < r0 THEN 2 * r0 - 1 - (m.row + i) WHEN m.row + i > r1 THEN 2 * r1 + 1 - (m.row + i) ELSE m.row + i END AS rr, CASE WHEN m.col + j < c0 THEN 2 * c0 - 1 - (m.col + j) WHEN m.col + j > c1 THEN 2 * c1 + 1 - (m.col + j) ELSE m.col + j END AS cc FROM mn m JOIN bx USING (dataset_id), off),
en AS (SELECT mr.dataset_id, mr.row, mr.col, median(mn.v) AS dtm FROM mr JOIN mn ON mn.dataset_id = mr.dataset_id AND mn.row = rr AND mn.col = cc GROUP BY ALL)"""


def lifted(spark, d):
    """Points of which some plots have no ground class and some stand above zero."""
    return views.points(spark, d).withColumn("z", F.col("z") + (F.col("dataset_id") % 2) * 5).withColumn("classification", F.when((F.col("dataset_id") % 4 >= 2) & (F.col("classification") == 2), 5).otherwise(F.col("classification")))


@query("WITH {points}, " + LIFTED + """ SELECT CAST(o AS INT) AS zero_first, oc.dataset_id, method, count(*) AS cells, round(sum(CASE method WHEN 'zero' THEN 0 WHEN 'class2' THEN c2.dtm ELSE en.dtm END), 4) AS total
FROM md JOIN oc USING (dataset_id) LEFT JOIN c2 ON c2.dataset_id = oc.dataset_id AND c2.row = oc.row AND c2.col = oc.col LEFT JOIN en ON en.dataset_id = oc.dataset_id AND en.row = oc.row AND en.col = oc.col GROUP BY ALL""")
def terrain_fallbacks(spark, d):
    """Terrain under every cell, with both orders of the fallbacks for plots without ground."""
    p = lifted(spark, d)
    both = [raster.ground(p, 2.0, zero_first=bool(o)).groupBy("dataset_id", "method").agg(F.count("*").alias("cells"), F.round(F.sum("dtm"), 4).alias("total")).withColumn("zero_first", F.lit(o)) for o in (0, 1)]
    return both[0].unionByName(both[1])


@query("""WITH {points}, f AS (SELECT * REPLACE (CASE WHEN x % 1 < 0.01 AND truth > 0 THEN -1 ELSE truth END AS truth) FROM points WHERE classification <> 3), mn AS (SELECT dataset_id, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM f GROUP BY 1), kept AS (SELECT * FROM f WHERE truth >= 0),
o AS (SELECT dataset_id, min(x) AS a, min(y) AS b, min(z) AS c FROM kept GROUP BY 1), v AS (SELECT k.*, row_number() OVER (PARTITION BY k.dataset_id, floor((x - a) / 0.5), floor((y - b) / 0.5), floor((z - c) / 0.5) ORDER BY CASE WHEN truth > 0 THEN 0 ELSE 1 END, pid) AS k FROM kept k JOIN o USING (dataset_id)),
t AS (SELECT truth, arg_max(x, (z, -pid)) AS tx, arg_max(y, (z, -pid)) AS ty FROM v WHERE k = 1 AND truth > 0 GROUP BY 1)
SELECT v.dataset_id, (SELECT count(*) FROM points p WHERE p.dataset_id = v.dataset_id) AS raw, (SELECT count(*) FROM kept p WHERE p.dataset_id = v.dataset_id) AS kept, count(*) AS voxels, count(DISTINCT CASE WHEN v.truth > 0 THEN v.truth END) AS trees,
round(quantile_cont(intensity, 0.01), 6) AS low, round(quantile_cont(intensity, 0.99), 6) AS high, round(avg(sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y))), 6) AS mean_offset FROM v LEFT JOIN t ON t.truth = v.truth WHERE k = 1 GROUP BY 1""")
def external_preparation(spark, d):
    """A manifest row a plot: outside points dropped, boundary labels ignored, one labelled point a voxel, percentiles, offsets to tree tops."""
    p = views.points(spark, d)
    f = grid.finite(p.where("classification <> 3"), "x", "y", "z").withColumn("truth", F.when((F.col("x") % 1 < 0.01) & (F.col("truth") > 0), -1).otherwise(F.col("truth")))
    kept = f.where("truth >= 0")
    v = grid.voxel_dedup(kept, 0.5, first=F.col("truth") > 0)
    t = v.where("truth > 0").groupBy("truth").agg(F.max_by(F.struct("x", "y"), F.struct("z", -F.col("pid"))).alias("t"))
    j = v.join(t, "truth", "left")
    dx, dy = F.col("t.x") - F.col("x"), F.col("t.y") - F.col("y")
    q = F.percentile("intensity", F.array(F.lit(0.01), F.lit(0.99)))
    rows = j.groupBy("dataset_id").agg(F.count("*").alias("voxels"), F.count_distinct(F.when(F.col("truth") > 0, F.col("truth"))).alias("trees"), q.alias("q"), F.avg(F.sqrt(dx * dx + dy * dy)).alias("mean_offset"))
    counts = p.groupBy("dataset_id").agg(F.count("*").alias("raw")).join(kept.groupBy("dataset_id").agg(F.count("*").alias("kept")), "dataset_id")
    return rounded(counts.join(rows, "dataset_id").select("dataset_id", "raw", "kept", "voxels", "trees", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "mean_offset"))


@query("WITH {points}, " + LIFTED + """, nz AS (SELECT l.*, z - CASE method WHEN 'zero' THEN 0 WHEN 'class2' THEN c2.dtm ELSE en.dtm END AS h FROM lc l JOIN md USING (dataset_id) LEFT JOIN c2 USING (dataset_id, row, col) LEFT JOIN en USING (dataset_id, row, col) WHERE o = 1),
ch AS (SELECT dataset_id, row, col, max(greatest(h, 0)) AS chm, arg_max(CASE WHEN truth > 0 THEN truth END, (h, -truth)) FILTER (truth > 0) AS label FROM nz WHERE classification <> 2 GROUP BY ALL), ng AS (SELECT * REPLACE (h AS z) FROM nz),
o2 AS (SELECT dataset_id, min(x) AS a, min(y) AS b, min(z) AS c FROM ng GROUP BY 1), vx AS (SELECT dataset_id, count(DISTINCT (floor((x - a) / 0.5), floor((y - b) / 0.5), floor((z - c) / 0.5))) AS voxels FROM ng JOIN o2 USING (dataset_id) GROUP BY 1)
SELECT ch.dataset_id, any_value(method) AS method, count(*) AS cells, round(avg(chm), 6) AS mean_height, count(DISTINCT label) AS crowns, any_value(voxels) AS voxels FROM ch JOIN md ON md.dataset_id = ch.dataset_id AND o = 1 JOIN vx ON vx.dataset_id = ch.dataset_id GROUP BY 1""")
def combined_preparation(spark, d):
    """Terrain, canopy heights, crown labels and voxels of every plot, a row each."""
    p = lifted(spark, d)
    floor_ = raster.ground(p, 2.0, zero_first=True)
    nz = raster.cells(p, 2.0).join(floor_, ["dataset_id", "row", "col"]).withColumn("z", F.col("z") - F.col("dtm"))
    tree = F.col("truth") > 0
    ch = nz.where("classification <> 2").groupBy("dataset_id", "row", "col").agg(F.max(F.greatest("z", F.lit(0.0))).alias("chm"), F.max_by(F.when(tree, F.col("truth")), F.when(tree, F.struct("z", -F.col("truth")))).alias("label"), F.first("method").alias("method"))
    vx = grid.voxels(nz, 0.5).select("dataset_id", "gx", "gy", "gz").distinct().groupBy("dataset_id").agg(F.count("*").alias("voxels"))
    rows = ch.groupBy("dataset_id").agg(F.first("method").alias("method"), F.count("*").alias("cells"), F.avg("chm").alias("mean_height"), F.count_distinct("label").alias("crowns"))
    return rounded(rows.join(vx, "dataset_id"))


@query("WITH {points}, {plots}, " + CELLS + """, a AS (SELECT dataset_id, row, col, max(CASE WHEN classification <> 2 THEN greatest(z, 0) END) AS chm, count(*) FILTER (classification <> 2 AND z >= 2) AS density, avg(intensity) FILTER (classification <> 2 AND z >= 2) AS i FROM c GROUP BY ALL),
m AS (SELECT dataset_id, greatest(max(chm), 1e-6) AS hi, greatest(max(density), 1) AS den, greatest(max(i), 1e-6) AS ii FROM a GROUP BY 1), p AS (SELECT a.dataset_id, CAST(round(255 * coalesce(chm, 0) / hi + 1e-9) AS INT) AS red, CAST(round(255.0::DOUBLE * density / den + 1e-9) AS INT) AS green, CAST(round(255 * coalesce(i, 0) / ii + 1e-9) AS INT) AS blue FROM a JOIN m USING (dataset_id))
SELECT model_split, dataset_id, count(*) AS cells, CAST(sum(red) AS BIGINT) AS red, CAST(sum(green) AS BIGINT) AS green, CAST(sum(blue) AS BIGINT) AS blue, CAST(sum(greatest(red, green, blue)) AS BIGINT) AS fused FROM p JOIN plots USING (dataset_id) GROUP BY ALL""")
def raster_dataset(spark, d):
    """Three channels of bytes (height, density, intensity), each scaled by its plot's highest value, and their fusion, by split."""
    a = raster.rasters(views.points(spark, d), 1.0)
    top = a.groupBy("dataset_id").agg(F.greatest(F.max("chm"), F.lit(1e-6)).alias("_h"), F.greatest(F.max("density"), F.lit(1)).alias("_d"), F.greatest(F.max("intensity"), F.lit(1e-6)).alias("_i"))
    byte = lambda c, m: F.round(255.0 * F.coalesce(F.col(c), F.lit(0.0)) / F.col(m) + 1e-9).cast("int")
    p = a.join(F.broadcast(top), "dataset_id").select("dataset_id", byte("chm", "_h").alias("red"), byte("density", "_d").alias("green"), byte("intensity", "_i").alias("blue"))
    sums = [F.sum(c).alias(c) for c in ("red", "green", "blue")]
    return p.join(views.plots(spark, d), "dataset_id").groupBy("model_split", "dataset_id").agg(F.count("*").alias("cells"), *sums, F.sum(F.greatest("red", "green", "blue")).alias("fused"))


# prediction and reports


@query()
def classical_tiles(spark, d):
    """Smoothing, tree tops, stem diameters and crowns of scenes in tiles, published in pairs by the tile that a top lies in."""
    smooth = cut(raster.smoothed(canopy(spark, d), 0.6, "chm"))
    tops = raster.numbered(raster.treetops(smooth, 1.0, 2.0, raster.window_size(F.col("h")), 5.0)).withColumn("dbh", spatial.dbh(F.col("h")))
    own = cut(tops.withColumn("tile", (F.col("dataset_id") * 4096 + F.floor(F.col("row") / 25) + 1024) * 4096 + F.floor(F.col("col") / 25) + 1024))
    crowns, points = scratch(spark, "crowns"), scratch(spark, "tops")
    found, _ = flooding.scene(smooth, own, 25.0, 8.0, 2.0)
    sinks.pair(found.join(own.select("dataset_id", "tree_id", "tile"), ["dataset_id", "tree_id"]), crowns, own, points, by="tile")
    n = spark.read.parquet(crowns).groupBy("dataset_id", "tree_id").agg(F.count("*").alias("cells"))
    return rounded(spark.read.parquet(points).join(n, ["dataset_id", "tree_id"]).select(F.col("tile").cast("bigint").alias("tile"), "dataset_id", "tree_id", "row", "col", "h", "dbh", "cells"), "h", "dbh")


@query("WITH {points} SELECT pid, round(x * 2 + z, 6) AS score FROM points")
def tiled_inference(spark, d):
    """A model run window by window with a halo; every point is written by the one window that owns it, or it fails."""
    import pandas as pd

    def scorer(pdf: pd.DataFrame) -> pd.Series:
        return pdf["x"] * 2 + pdf["z"]

    return rounded(by_windows(views.points(spark, d).select("dataset_id", "pid", "x", "y", "z"), 20.0, 4.0, scorer, ("x", "z")).select("pid", "score"))


@query("WITH {points}, " + CELLS + """, b AS (SELECT dataset_id, pred, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points WHERE pred > 0 GROUP BY ALL), m AS (SELECT dataset_id, row, col, max(greatest(z, 0)) AS chm FROM c WHERE classification <> 2 GROUP BY ALL),
t AS (SELECT b.dataset_id, pred, x0, x1, y0, y1, floor((x0 + x1) / 2 / 25) AS tx, floor((y0 + y1) / 2 / 25) AS ty FROM b), p AS (SELECT t.dataset_id, t.pred, tx, ty, m.row, m.col, m.chm FROM t JOIN m ON m.dataset_id = t.dataset_id AND m.col + 0.5 >= x0 AND m.col + 0.5 < x1 AND m.row + 0.5 >= y0 AND m.row + 0.5 < y1)
SELECT dataset_id, pred, CAST(any_value(tx) AS BIGINT) AS tile_x, CAST(any_value(ty) AS BIGINT) AS tile_y, arg_max(row, (chm, -row, -col)) AS top_row, arg_max(col, (chm, -row, -col)) AS top_col, max(chm) AS height FROM p GROUP BY dataset_id, pred""")
def detector_scene(spark, d):
    """Detected boxes, owned by the tile of their centre, each with the highest canopy cell inside."""
    p = views.points(spark, d)
    b = p.where("pred > 0").groupBy("dataset_id", "pred").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").cast("double").alias("bottom"), F.max("y").cast("double").alias("top"))
    b = b.withColumn("tile_x", F.floor((F.col("left") + F.col("right")) / 2 / 25)).withColumn("tile_y", F.floor((F.col("bottom") + F.col("top")) / 2 / 25))
    m = raster.rasters(p, 1.0).where("chm IS NOT NULL").select("dataset_id", "row", "col", "chm", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    best = F.max_by(F.struct("row", "col", "chm"), F.struct("chm", -F.col("row"), -F.col("col"))).alias("_b")
    # boxes that hold the same cells have the same top: it is looked for once, and there are no more of them than pairs of cells
    edges = ("left", "right", "bottom", "top")
    b = b.withColumns({f"_{e}": F.ceil(F.col(e) - 0.5) for e in edges})
    alike = b.select("dataset_id", *(F.col(f"_{e}").cast("double").alias(e) for e in edges)).distinct()
    found = spatial.in_boxes(m.withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")}), alike, 16.0).groupBy("dataset_id", *edges).agg(best)
    tops = found.select("dataset_id", *(F.col(e).cast("bigint").alias(f"_{e}") for e in edges), "_b")
    return b.join(tops, ["dataset_id", *(f"_{e}" for e in edges)]).select("dataset_id", "pred", "tile_x", "tile_y", F.col("_b.row").alias("top_row"), F.col("_b.col").alias("top_col"), F.col("_b.chm").alias("height"))


@query("""WITH r AS (SELECT user_id % 5 AS machine, event_type, "value" AS seconds, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS k FROM events), a AS (SELECT machine, k % 2 AS turn, count(*) AS n, avg(seconds) AS mean, stddev_samp(seconds) AS sd, min(seconds) AS fastest FROM r GROUP BY ALL)
SELECT machine, CAST(turn AS INT) AS turn, n AS runs, round(mean, 6) AS mean, round(sd, 6) AS sd, round(fastest, 6) AS fastest, round(mean / 78.027, 6) AS per_hectare FROM a""")
def timing_report(spark, d):
    """Alternating repeats of two programs on a machine: mean, spread and seconds a hectare."""
    e = views.table(spark, d, "events").withColumn("machine", F.col("user_id") % 5)
    k = e.withColumn("turn", (F.row_number().over(Window.partitionBy("machine").orderBy("ts", "event_id")) % 2).cast("int"))
    return rounded(k.groupBy("machine", "turn").agg(F.count("*").alias("runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("fastest"), (F.avg("value") / 78.027).alias("per_hectare")))


@query(dealt_sql(PLOT.replace("WITH {points}", "WITH {points}, {plots}"), "pred", OTHER) + f""", c AS (SELECT CAST(p.dataset_id % 100 AS INT) AS model, model_split, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(iou_sum) AS iou_sum FROM plot p JOIN plots ON plots.dataset_id = p.dataset_id // 100 GROUP BY ALL),
s9 AS (SELECT model, model_split, round({F1}, 6) AS f1, round(iou_sum / greatest(tp + 0.5 * (fp + fn), 1), 6) AS pq FROM c) SELECT model, max(f1) FILTER (model_split = 'train') AS train_f1, max(f1) FILTER (model_split = 'val') AS val_f1, max(f1) FILTER (model_split = 'test') AS test_f1, max(pq) FILTER (model_split = 'val') AS val_pq FROM s9 GROUP BY 1""")
def consolidated_report(spark, d):
    """Runs logged as JSON, one record a model and split, read together into one table."""
    other = F.when((F.col("y") <= 40) & (F.col("pred") > 0), F.col("supp") + 1).otherwise(0)
    m = metrics.instance_metrics(dealt(views.points(spark, d), [F.col("pred"), other])).withColumn("model", config()).withColumn("dataset_id", F.floor(F.col("dataset_id") / 100).cast("int"))
    t = metrics.totals(m.join(views.plots(spark, d), "dataset_id"), "model", "model_split")
    to = scratch(spark, "report")
    sinks.atomic(rounded(t.select("model", "model_split", "f1", "pq")), to)
    one = lambda c, s: F.max(F.when(F.col("model_split") == s, F.col(c))).alias(f"{s}_{c}")
    runs = spark.read.schema("model int, model_split string, f1 double, pq double").json(to)
    return runs.groupBy("model").agg(one("f1", "train"), one("f1", "val"), one("f1", "test"), one("pq", "val"))
