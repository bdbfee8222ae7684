"""Searches for a budget: brackets of all plots halved together, and paired differences of what was found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.checkpoint import cut
from .governance import bootstrap


def bracketed(targets: DataFrame, run: Callable[[DataFrame], DataFrame], lower: float, upper: float, steps: int, by: str = "dataset_id") -> DataFrame:
    """(by, step, setting, value, target, chosen): ``steps`` trials of every plot at the geometric mean of its bracket.

    ``targets``: by, target. ``run`` takes settings (by, setting) and gives values (by, value) that grow with the
    setting. A step is one job over all plots, however many; a value below the target moves a plot's lower end up, any
    other its upper end down. ``chosen``: the trial whose value is nearest by ratio, the earliest of equals.
    """
    state = cut(targets.select(by, F.col("target").cast("double").alias("target"), F.lit(float(lower)).alias("low"), F.lit(float(upper)).alias("high")))
    trials: DataFrame | None = None
    for step in range(steps):
        asked = state.withColumn("setting", F.sqrt(F.col("low") * F.col("high")))
        done = cut(asked.join(run(asked.select(by, "setting")), by))
        trial = done.select(by, F.lit(step).alias("step"), "setting", "value", "target")
        trials = trial if trials is None else trials.union(trial)
        short = F.col("value") < F.col("target")
        state = done.select(by, "target", F.when(short, F.col("setting")).otherwise(F.col("low")).alias("low"), F.when(short, F.col("high")).otherwise(F.col("setting")).alias("high"))
    best = trials.groupBy(by).agg(F.min(F.struct(F.abs(F.log(F.col("value") / F.col("target"))).alias("off"), "step")).alias("b")).select(by, F.col("b.step").alias("_s"))
    return trials.join(best, by).select(by, "step", "setting", "value", "target", (F.col("step") == F.col("_s")).alias("chosen"))


def paired_bootstrap(values: DataFrame, method: str, first: str, second: str, value: str, stratum: str, by: str = "dataset_id", rounds: int = 2000) -> DataFrame:
    """(low, high, mean) of the mean difference, second minus first, of methods that were tried on the same plots."""
    one = lambda name: F.max(F.when(F.col(method) == name, F.col(value)))
    pairs = values.groupBy(by, stratum).agg(one(first).alias("_a"), one(second).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    return bootstrap(pairs.select(stratum, (F.col("_b") - F.col("_a")).alias("difference")), stratum, "difference", rounds)
