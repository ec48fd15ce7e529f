"""Experiment tracking: newest runs, partial updates, pivots, and rules over reported figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of every run_name; equal times are decided by the larger run_id."""
    k = F.row_number().over(Window.partitionBy("run_name").orderBy(F.col("start_time").desc(), F.col("run_id").desc()))
    return runs.withColumn("_k", k).where("_k = 1").drop("_k")


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """(run_name, value): ``new`` where it has a number, else ``old``."""
    return old.join(new, "run_name", "left").select("run_name", F.coalesce(F.nanvl("new", F.lit(None).cast("double")), "old").alias("value"))


def pivot_arms(rows: DataFrame, name: str, arm: str, value: str, arms: list[str], base: str) -> DataFrame:
    """One row per name with each arm's mean and its delta to the base arm; one pass, without a pivot job."""
    wide = rows.groupBy(name).agg(*(F.avg(F.when(F.col(arm) == a, F.col(value))).alias(a) for a in arms))
    return wide.select(name, *arms, *((F.col(a) - F.col(base)).alias(f"{a}_delta") for a in arms if a != base))


def finite(metrics: str) -> Column:
    """A map without its null and NaN values."""
    return F.map_filter(metrics, lambda _, v: v.isNotNull() & ~F.isnan(v))


def violations(rows: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, rule) of each rule that a row of (mean, point, lo, hi, ece, least, most, delta, a, b) breaks.

    bracket: an interval holds its own point. aggregate: the interval's point is the reported mean. range: where
    a calibration error is reported, the map's values (least, most) lie in [0, 1]. reconciles: a paired
    delta is b - a. A rule with an undefined figure holds.
    """
    defined = lambda *names: F.coalesce(F.forall(F.array(*(F.col(n).cast("double") for n in names)), lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    broken = {
        "bracket": defined("point", "lo", "hi") & ~F.col("point").between(F.col("lo"), F.col("hi")),
        "aggregate": defined("point", "mean") & (F.abs(F.col("point") - F.col("mean")) > tolerance),
        "range": F.col("ece").isNotNull() & defined("least", "most") & ((F.col("least") < 0) | (F.col("most") > 1)),
        "reconciles": defined("delta", "a", "b") & (F.abs(F.col("delta") - (F.col("b") - F.col("a"))) > tolerance),
    }
    found = F.array_compact(F.array(*(F.when(c, rule) for rule, c in broken.items())))
    return rows.select(key, F.explode(found).alias("rule"))


def require(rows: DataFrame) -> DataFrame:
    """Strict mode: evaluating the result fails if ``rows`` (key, rule) has any row."""
    return rows.agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") == 0, F.lit("reported figures break invariants")).alias("ok"))
