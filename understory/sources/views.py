"""Point-cloud, label, mask and plot tables read from the given star schema.

Point ids are packed from the order key, line number and price, so no global numbering (and no single task) is
needed. Coordinates: x = price / 1000, y = quantity, z = (part key mod 300) / 10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same tables as SQL, to stand before a query's own steps.
POINTS_SQL = """points AS (SELECT (l_orderkey * 8 + l_linenumber) * 16777216 + CAST(round(l_extendedprice * 100) AS BIGINT) AS pid,
  CAST(l_suppkey % 8 AS INT) AS dataset_id, l_suppkey AS supp, l_extendedprice / 1000 AS x, l_quantity AS y, (l_partkey % 300) / 10.0::DOUBLE AS z,
  l_tax + 0.0::DOUBLE AS intensity, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 5 ELSE 3 END AS classification, l_discount AS discount,
  CAST(CASE WHEN l_linestatus = 'O' AND l_discount = 0 THEN -1 WHEN l_returnflag = 'A' THEN 0 ELSE l_suppkey + 1 END AS BIGINT) AS truth,
  CAST(CASE WHEN l_returnflag = 'A' AND l_tax >= 0.07 THEN 1000 + l_suppkey WHEN l_returnflag = 'A' THEN 0 WHEN l_suppkey % 4 = 3 AND l_quantity > 25 THEN 2000 + l_suppkey
       WHEN l_suppkey % 10 = 9 THEN 0 WHEN l_suppkey % 16 = 8 THEN l_suppkey + 9 ELSE l_suppkey + 1 END AS BIGINT) AS pred FROM lineitem)"""

PLOTS_SQL = """plots AS (SELECT CAST(s_suppkey AS INT) AS dataset_id, r_name AS source, n_name AS collection,
  CASE WHEN s_suppkey % 4 = 3 THEN 'test' WHEN s_suppkey % 4 = 2 THEN 'val' ELSE 'train' END AS model_split
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey < 8)"""

MASKS_SQL = """mask_points AS (
  SELECT supp * 5 AS mask_id, * EXCLUDE (supp) FROM points WHERE y <= 35
  UNION ALL SELECT supp * 5 + 1, * EXCLUDE (supp) FROM points WHERE y >= 10
  UNION ALL SELECT supp * 5 + 2, * EXCLUDE (supp) FROM points WHERE y BETWEEN 5 AND 14
  UNION ALL SELECT supp * 5 + 3, * EXCLUDE (supp) FROM points WHERE y BETWEEN 20 AND 50
  UNION ALL SELECT (supp - ((supp // 8) % 2) * 8) * 5 + 4, * EXCLUDE (supp) FROM points WHERE y >= 40),
masks AS (SELECT DISTINCT mask_id, dataset_id, (mask_id % 10) / 10.0::DOUBLE AS object_score FROM mask_points)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, dataset_id, supp, x, y, z, intensity, classification, discount, truth (-1 unknown, 0 ground), pred."""
    d, q, flag, s = F.col("l_discount"), F.col("l_quantity"), F.col("l_returnflag"), F.col("l_suppkey")
    truth = F.when((F.col("l_linestatus") == "O") & (d == 0), -1).when(flag == "A", 0).otherwise(s + 1)
    pred = F.when((flag == "A") & (F.col("l_tax") >= 0.07), 1000 + s).when(flag == "A", 0).when((s % 4 == 3) & (q > 25), 2000 + s).when(s % 10 == 9, 0).when(s % 16 == 8, s + 9).otherwise(s + 1)
    return table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 16777216 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("pid"),
        (s % 8).cast("int").alias("dataset_id"), s.alias("supp"), (F.col("l_extendedprice") / 1000).alias("x"), q.alias("y"), (F.col("l_partkey") % 300 / 10.0).alias("z"),
        (F.col("l_tax") + 0.0).alias("intensity"), F.when(flag == "A", 2).when(flag == "N", 5).otherwise(3).alias("classification"), d.alias("discount"),
        truth.cast("bigint").alias("truth"), pred.cast("bigint").alias("pred"),
    )


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset_id, source, collection, model_split of the eight plots."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey < 8")
    joined = s.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    split = F.when(F.col("s_suppkey") % 4 == 3, "test").when(F.col("s_suppkey") % 4 == 2, "val").otherwise("train")
    return joined.select(F.col("s_suppkey").cast("int").alias("dataset_id"), F.col("r_name").alias("source"), F.col("n_name").alias("collection"), split.alias("model_split"))


def mask_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mask_id and its points: five overlapping masks a supplier, of which the fifth may bridge two suppliers."""
    y, s = F.col("y"), F.col("supp")
    masks = F.array(
        F.when(y <= 35, s * 5), F.when(y >= 10, s * 5 + 1), F.when(y.between(5, 14), s * 5 + 2), F.when(y.between(20, 50), s * 5 + 3),
        F.when(y >= 40, (s - (F.floor(s / 8) % 2) * 8) * 5 + 4),
    )
    return points(spark, sf_dir).withColumn("mask_id", F.explode(masks)).where("mask_id IS NOT NULL").drop("supp")


def mask_score(mask_id) -> F.Column:
    """Object score of a mask."""
    return mask_id % 10 / 10.0
