"""A linear score of proposals, fitted as aggregates of the examples: no row leaves the executors but one of sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _clipped(name: str, limit: float = 5.0):
    return F.least(F.greatest((F.col(name) - F.col(f"_m_{name}")) / F.col(f"_s_{name}"), F.lit(-limit)), F.lit(limit))


def fitted(examples: DataFrame, names: Sequence[str], target: str = "target") -> DataFrame:
    """One row: of each feature mean, deviation (_m_, _s_) and weight (_w_), and the _bias, of the linear discriminant of two classes.

    Examples with target 1 or 0 are used, others (unknown) not. Features are standardised and clipped at five deviations;
    a weight is the distance of the class means over the variance within the classes, as if features were independent,
    so the fit is two passes of aggregates that combine map-side. Features that are constant weigh nothing. Where one
    class has no example all weights are 0 and the score is the share of the other, one added to both counts.
    """
    known = examples.where(F.col(target).isin(0, 1))
    scale = known.agg(*(g for n in names for g in (F.avg(n).alias(f"_m_{n}"), F.greatest(F.stddev_pop(n), F.lit(1e-6)).alias(f"_s_{n}"))))
    z = known.join(F.broadcast(scale)).select(target, *(_clipped(n).alias(n) for n in names))
    of = lambda c, n, f: f(F.when(F.col(target) == c, F.col(n)))
    parts = [g for n in names for g in (of(1, n, F.avg).alias(f"_1_{n}"), of(0, n, F.avg).alias(f"_0_{n}"), of(1, n, F.var_pop).alias(f"_v1_{n}"), of(0, n, F.var_pop).alias(f"_v0_{n}"))]
    sums = z.agg(F.count_if(F.col(target) == 1).alias("_n1"), F.count_if(F.col(target) == 0).alias("_n0"), *parts)
    within = lambda n: F.greatest((F.col("_n1") * F.col(f"_v1_{n}") + F.col("_n0") * F.col(f"_v0_{n}")) / (F.col("_n1") + F.col("_n0")), F.lit(1e-6))
    weight = lambda n: F.coalesce((F.col(f"_1_{n}") - F.col(f"_0_{n}")) / within(n), F.lit(0.0))
    middle = [F.coalesce(F.col(f"_w_{n}") * (F.col(f"_1_{n}") + F.col(f"_0_{n}")) / 2, F.lit(0.0)) for n in names]
    weighted = sums.select("*", *(weight(n).alias(f"_w_{n}") for n in names))
    bias = F.log((F.col("_n1") + 1) / (F.col("_n0") + 1)) - sum(middle[1:], middle[0])
    return scale.join(F.broadcast(weighted.withColumn("_bias", bias).select("_bias", *(f"_w_{n}" for n in names))))  # both are one row


def scored(proposals: DataFrame, model: DataFrame, names: Sequence[str], to: str = "score") -> DataFrame:
    """``proposals`` with the logistic of their score; null where a feature is null."""
    terms = [F.col(f"_w_{n}") * _clipped(n) for n in names]
    return proposals.join(F.broadcast(model)).select(*proposals.columns, (1 / (1 + F.exp(-(F.col("_bias") + sum(terms[1:], terms[0]))))).alias(to))
