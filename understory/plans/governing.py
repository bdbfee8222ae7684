"""Label, split, record and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F, Window

from ..functions.chance import unit_sql
from ..operators import governance, labels, spatial
from ..sources import views
from .registry import query
from .scoring import GROUPED, PLOT, plot_metrics, rounded


@query("""WITH {points} SELECT pid, CAST(CASE WHEN classification = 3 THEN -1 WHEN classification IN (1, 2) OR (truth = 0 AND abs(z) <= 0.05) OR truth IN (7, 9) THEN 0 WHEN truth > 0 THEN truth ELSE -1 END AS BIGINT) AS instance,
CAST(CASE WHEN classification = 3 THEN -1 WHEN classification IN (1, 2) OR (truth = 0 AND abs(z) <= 0.05) OR truth IN (7, 9) THEN 0 WHEN truth > 0 OR classification IN (4, 5, 6) THEN 1 ELSE -1 END AS INT) AS semantic FROM points""")
def annotation_targets(spark, d):
    i, s = labels.annotation_targets(F.col("truth"), F.col("classification"), True, (7, 9), F.col("z"))
    return views.points(spark, d).select("pid", i.cast("bigint").alias("instance"), s.alias("semantic"))


@query("""WITH {points}, e AS (SELECT dataset_id, truth FROM points WHERE truth > 0 GROUP BY ALL HAVING min(x) <= 2 OR max(x) >= 104.8 OR min(y) <= 0 OR max(y) >= 51)
SELECT dataset_id, count(*) FILTER (e.truth IS NOT NULL) AS excluded, count(*) FILTER (p.truth > 0 AND e.truth IS NULL) AS kept FROM points p LEFT JOIN e USING (dataset_id, truth) GROUP BY dataset_id""")
def boundary_exclusion(spark, d):
    p = views.points(spark, d).withColumn("old", F.col("truth"))
    out = labels.without_cut_instances(p, "truth", (1.0, -1.0, 105.8, 52.0), 1.0)
    return out.groupBy("dataset_id").agg(F.count_if(F.expr("truth = -1 AND old > 0")).alias("excluded"), F.count_if(F.expr("truth > 0")).alias("kept"))


GROUPS = """WITH {points}, g AS (SELECT *, CAST(dataset_id * 1000000 + floor(x / 4) * 1000 + floor(y / 4) AS BIGINT) AS grp FROM points),
m AS (SELECT grp, arg_max(CASE WHEN truth >= 0 THEN truth END, (n, -truth)) AS best FROM (SELECT grp, truth, count(*) AS n FROM g WHERE truth >= 0 GROUP BY ALL) GROUP BY 1)"""


def grouped(spark, d):
    return views.points(spark, d).withColumn("grp", (F.col("dataset_id") * 1000000 + F.floor(F.col("x") / 4) * 1000 + F.floor(F.col("y") / 4)).cast("bigint"))


@query(GROUPS + " SELECT grp, CAST(coalesce(best, 0) AS BIGINT) AS truth FROM (SELECT DISTINCT grp FROM g) LEFT JOIN m USING (grp)")
def group_majority(spark, d):
    return labels.majority(grouped(spark, d), "grp")


EDGES = """, c AS (SELECT a.pid AS a, b.pid AS b, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.pid) AS k
FROM g a JOIN g b ON a.dataset_id = b.dataset_id AND a.pid <> b.pid AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1),
e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM c WHERE k <= 5)"""


@query(GROUPS + EDGES + """, s AS (SELECT grp, count(*) AS n, count(DISTINCT CASE WHEN truth >= 0 THEN truth END) AS labels FROM g GROUP BY 1),
x AS (SELECT p.grp <> q.grp AS apart FROM e JOIN g p ON p.pid = src JOIN g q ON q.pid = dst WHERE p.truth > 0 AND q.truth > 0 AND p.truth <> q.truth)
SELECT sum(n)::BIGINT AS points, count(*) AS groups, round(sum(n) / count(*), 6) AS compression, median(n) AS median_points, round(quantile_cont(n, 0.95), 6) AS p95_points, round(count(*) FILTER (labels > 1) / count(*) FILTER (labels > 0), 6) AS mixed_share,
(SELECT round(count(*) FILTER (truth = best) / count(*), 6) FROM g JOIN m USING (grp) WHERE truth >= 0) AS purity, (SELECT count(*) FROM x) AS boundary_pairs, (SELECT round(count(*) FILTER (apart) / count(*), 6) FROM x) AS boundary_recall FROM s""")
def partition_diagnostics(spark, d):
    p = grouped(spark, d)
    return rounded(labels.partition_diagnostics(p, "grp", spatial.neighbour_edges(p, 1.0, 6)))


@query(GROUPS.replace("WITH", "WITH RECURSIVE", 1) + EDGES + """, n AS (SELECT DISTINCT p.grp AS a, q.grp AS b FROM e JOIN g p ON p.pid = src JOIN g q ON q.pid = dst WHERE p.grp <> q.grp), l AS (SELECT a, b FROM n JOIN m p ON p.grp = a JOIN m q ON q.grp = b WHERE p.best = q.best AND p.best > 0),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), w AS (SELECT grp, grp AS root FROM m WHERE best > 0 UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.grp), r AS (SELECT grp, min(root) AS part FROM w GROUP BY 1)
SELECT best AS truth, count(*) AS groups, count(DISTINCT part) AS parts FROM r JOIN m USING (grp) GROUP BY best""")
def split_instances(spark, d):
    p = grouped(spark, d)
    return labels.split_instances(p, "grp", spatial.neighbour_edges(p, 1.0, 6))


BOXES = """boxes AS (SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS crs, s_acctbal / 10 AS "left", s_suppkey % 97 AS bottom, s_acctbal / 10 + 8 AS "right", s_suppkey % 97 + 6 AS top FROM supplier)"""


def boxes(spark, d):
    s, a = F.col("s_suppkey"), F.col("s_acctbal") / 10
    return views.table(spark, d, "supplier").select(s.alias("id"), F.col("s_nationkey").cast("bigint").alias("crs"), a.alias("left"), (s % 97).alias("bottom"), (a + 8).alias("right"), (s % 97 + 6).alias("top"))


LINKED = "WITH RECURSIVE " + BOXES + """, l AS (SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.crs = b.crs AND a.id < b.id AND sqrt(pow(greatest(a."left" - b."right", b."left" - a."right", 0), 2) + pow(greatest(a.bottom - b.top, b.bottom - a.top, 0), 2)) <= 20),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), w AS (SELECT id, id AS root FROM boxes UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.id), c AS (SELECT id, min(root) AS root FROM w GROUP BY 1),
n AS (SELECT root, substr(sha256(string_agg(CAST(id AS VARCHAR), '|' ORDER BY CAST(id AS VARCHAR))), 1, 16) AS group_id FROM c GROUP BY 1)"""


@query(LINKED + " SELECT id, group_id FROM c JOIN n USING (root)")
def leakage_groups(spark, d):
    b = boxes(spark, d)
    return governance.leakage_groups(b.select("id"), "id", governance.close_boxes(b, "id", "crs", 20.0, 40.0))


@query(LINKED + """, g AS (SELECT group_id, min(crs) % 4 AS stratum FROM c JOIN n USING (root) JOIN boxes USING (id) GROUP BY 1), o AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS k, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || group_id)) AS p FROM g)
SELECT group_id, stratum, CASE WHEN k < 2 THEN 'train' WHEN p <= greatest(1, round_even(k * 0.15, 0)) THEN 'test' WHEN p <= greatest(1, round_even(k * 0.15, 0)) + CASE WHEN k >= 3 THEN greatest(1, round_even(k * 0.15, 0)) ELSE 0 END THEN 'val' ELSE 'train' END AS model_split FROM o""")
def leakage_safe_split(spark, d):
    b = boxes(spark, d)
    named = governance.leakage_groups(b, "id", governance.close_boxes(b, "id", "crs", 20.0, 40.0))
    return governance.hash_split(named.groupBy("group_id").agg((F.min("crs") % 4).alias("stratum")), "stratum", 42)


@query(LINKED + """, g AS (SELECT group_id, min(crs) % 4 AS stratum, bool_or(id % 7 = 0) AS official FROM c JOIN n USING (root) JOIN boxes USING (id) GROUP BY 1), o AS (SELECT *, count(*) OVER w AS k, row_number() OVER (w ORDER BY sha256('42:' || group_id)) AS p FROM g WINDOW w AS (PARTITION BY stratum, official))
SELECT group_id, stratum, official, CASE WHEN official THEN 'test' WHEN k >= 2 AND p <= greatest(1, round_even(k * 0.2, 0)) THEN 'val' ELSE 'train' END AS model_split FROM o""")
def official_split(spark, d):
    b = boxes(spark, d)
    named = governance.leakage_groups(b, "id", governance.close_boxes(b, "id", "crs", 20.0, 40.0))
    return governance.official_split(named.groupBy("group_id").agg((F.min("crs") % 4).alias("stratum"), F.bool_or(F.col("id") % 7 == 0).alias("official")), "stratum", 42)


@query("""WITH r AS (SELECT s_suppkey AS id, s_nationkey % 5 < 3 AS real, CAST(s_nationkey AS VARCHAR) AS g, CAST(s_suppkey % 11 AS VARCHAR) AS p FROM supplier),
k AS (SELECT *, CASE WHEN real THEN g ELSE p END AS key FROM r), n AS (SELECT *, count(*) OVER (PARTITION BY real, key) AS c FROM k) SELECT id, round(CASE WHEN real THEN 0.75::DOUBLE ELSE 0.25 END / (SELECT count(DISTINCT key) FROM k q WHERE q.real = n.real) / c, 9) AS weight FROM n""")
def domain_sampling_weights(spark, d):
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 11).alias("p"))
    return governance.sampling_weights(s, F.col("g") % 5 < 3, ["g"], "p").select("id", F.round("weight", 9).alias("weight"))


@query("""WITH {points}, c AS (SELECT dataset_id, truth, count(*) AS n, avg(x) AS x, avg(y) AS y FROM points WHERE truth > 0 GROUP BY ALL), m AS (SELECT dataset_id, median(n) AS med FROM c GROUP BY 1)
SELECT truth, round(least(greatest(sqrt(med / n), 0.5), 3) * CASE WHEN EXISTS (SELECT 1 FROM c b WHERE b.dataset_id = c.dataset_id AND b.truth <> c.truth AND (b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y) < 9) THEN 2 ELSE 1 END, 6) AS weight FROM c JOIN m USING (dataset_id)""")
def hard_example_weights(spark, d):
    c = views.points(spark, d).where("truth > 0").groupBy("dataset_id", "truth").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    close = spatial.near(c, c, 3.0, inclusive=False).where("l.truth <> r.truth").select(F.col("l.truth").alias("truth"), F.lit(2).alias("f")).distinct()
    med = c.groupBy("dataset_id").agg(F.median("n").alias("med"))
    w = F.least(F.greatest(F.sqrt(F.col("med") / F.col("n")), F.lit(0.5)), F.lit(3.0)) * F.coalesce("f", F.lit(1))
    return c.join(med, "dataset_id").join(close, "truth", "left").select("truth", F.round(w, 6).alias("weight"))


@query(GROUPED + f""", v AS (SELECT source, tp / greatest(tp + 0.5 * (fp + fn), 1) AS f1 FROM r), i AS (SELECT source, f1, row_number() OVER (PARTITION BY source ORDER BY f1) - 1 AS i FROM v), n AS (SELECT source, count(*) AS n FROM v GROUP BY 1),
dr AS (SELECT source, n, r, unnest(range(1, n + 1)) AS k FROM n, range(1, 2001) t(r)), pk AS (SELECT source, r, CAST(floor({unit_sql("r", "source", "k")} * n) AS BIGINT) AS i FROM dr),
ms AS (SELECT r, avg(m) AS m FROM (SELECT r, source, avg(f1) AS m FROM pk JOIN i USING (source, i) GROUP BY ALL) GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(m), 6) AS mean FROM ms""")
def bootstrap_interval(spark, d):
    p = plot_metrics(spark, d).withColumn("f1", F.col("tp") / F.greatest(F.expr("tp + 0.5 * (fp + fn)"), F.lit(1.0)))
    return rounded(governance.bootstrap(p, "source", "f1"))


@query("SELECT user_id, event_id, event_type, \"value\" FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_record(spark, d):
    return governance.latest(views.table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""WITH r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT rule, count(*) AS n, min(subject) AS first_subject FROM (
SELECT 'duplicate line' AS rule, CAST(l_orderkey AS VARCHAR) AS subject FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'order without lines', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM r)
UNION ALL SELECT 'line without order', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'quantity not whole', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE abs(l_quantity - round_even(l_quantity, 0)) > 1e-6) GROUP BY rule""")
def structural_violations(spark, d):
    li, o = views.table(spark, d, "lineitem"), views.table(spark, d, "orders")
    checks = {
        "duplicate line": li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "order without lines": o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey"),
        "line without order": li.join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("l_orderkey"),
        "quantity not whole": li.where(~labels.whole_number(F.col("l_quantity"))).select("l_orderkey"),
    }
    return governance.violations(checks).groupBy("rule").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN c.k IS NULL THEN 'right' WHEN o.k IS NULL THEN 'left' ELSE 'both' END AS status FROM (SELECT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k) GROUP BY 1""")
def full_outer_pairing(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return governance.paired(c, o, "k").groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT substr(sha256(text), 1, 16) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1""")
def content_hash_groups(spark, d):
    return views.table(spark, d, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 16).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("""WITH t AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey, p_size FROM t WHERE k = n // 2""")
def median_representative(spark, d):
    w = Window.partitionBy("p_brand")
    t = views.table(spark, d, "part").withColumn("k", F.row_number().over(w.orderBy("p_size", "p_partkey")) - 1).withColumn("n", F.count("*").over(w))
    return t.where(F.col("k") == F.floor(F.col("n") / 2)).select("p_brand", "p_partkey", "p_size")


@query("""WITH {points}, t AS (SELECT truth, pid, z, row_number() OVER (PARTITION BY truth ORDER BY z DESC, pid) AS k FROM points WHERE truth > 0) SELECT truth, k, pid, z FROM t WHERE k <= 32""")
def top_points_per_instance(spark, d):
    w = Window.partitionBy("truth").orderBy(F.desc("z"), "pid")
    return views.points(spark, d).where("truth > 0").withColumn("k", F.row_number().over(w).cast("bigint")).where("k <= 32").select("truth", "k", "pid", "z")


@query("""WITH {points}, t AS (SELECT truth, pid, row_number() OVER (PARTITION BY truth ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY truth) AS n FROM points WHERE truth > 0)
SELECT truth, pid FROM t WHERE n <= 16 OR floor((i + 1) * 16 / n) > floor(i * 16 / n)""")
def even_subsample(spark, d):
    w = Window.partitionBy("truth")
    t = views.points(spark, d).where("truth > 0").withColumn("i", F.row_number().over(w.orderBy("pid")) - 1).withColumn("n", F.count("*").over(w))
    return t.where("n <= 16 OR floor((i + 1) * 16 / n) > floor(i * 16 / n)").select("truth", "pid")


@query(f"WITH {{points}}, k AS (SELECT truth, pid, row_number() OVER (PARTITION BY truth ORDER BY -ln({unit_sql('pid', '0')}) / (z + 0.1), pid) AS k FROM points WHERE truth > 0) SELECT truth, pid FROM k WHERE k <= 32")
def weighted_point_sample(spark, d):
    p = views.points(spark, d).where("truth > 0")
    return governance.weighted_sample(p, F.col("z") + 0.1, 32, "truth", "pid").select("truth", "pid")


@query(PLOT.replace("WITH {points}", "WITH {points}, {plots}") + """ SELECT a.dataset_id, a.tp - b.tp AS tp_gain, round(a.iou_sum - b.iou_sum, 6) AS iou_gain FROM plot a JOIN plot b ON b.dataset_id = (a.dataset_id + 1) % 8""")
def paired_model_comparison(spark, d):
    p = plot_metrics(spark, d).select("dataset_id", "tp", "iou_sum")
    q = p.select(((F.col("dataset_id") + 7) % 8).alias("dataset_id"), F.col("tp").alias("t2"), F.col("iou_sum").alias("i2"))
    return rounded(p.join(q, "dataset_id").select("dataset_id", (F.col("tp") - F.col("t2")).alias("tp_gain"), (F.col("iou_sum") - F.col("i2")).alias("iou_gain")))
