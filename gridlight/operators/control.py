"""Policies and episodes: rollouts as folds over a struct, and reductions of step tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truncate(steps: DataFrame, keys: list[str], max_steps: int) -> DataFrame:
    """Steps up to the first done one, at most ``max_steps``; ``success`` stays true once it is."""
    w = Window.partitionBy(*keys).orderBy("t")
    before = F.coalesce(F.sum(F.col("done").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("_b", before).where((F.col("_b") == 0) & (F.col("t") < max_steps)).drop("_b").withColumn("success", F.max("success").over(w))


def episodes(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_steps, success, ret, first_done): one row per episode; first_done counts from 1, null if never."""
    return steps.groupBy(*keys).agg(F.count("*").alias("n_steps"), F.bool_or("success").alias("success"), F.sum("reward").alias("ret"), (F.min(F.when(F.col("done"), F.col("t"))) + 1).alias("first_done"))


def summary(eps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, success_rate, mean_return, steps_to_goal) over episodes; steps are averaged over those that end."""
    return eps.groupBy(*keys).agg(F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("ret").alias("mean_return"), F.avg("first_done").alias("steps_to_goal"))


def chunks(steps: DataFrame, keys: list[str], action: str, k: int) -> DataFrame:
    """Each step's next ``k`` actions, the tail filled with the episode's last one."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.currentRow, k - 1)
    ahead = F.collect_list(action).over(w)
    return steps.withColumn("chunk", F.concat(ahead, F.array_repeat(F.element_at(ahead, -1), k - F.size(ahead))))


def proprioception(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Each observation with the last action and the change of velocity; zeros at a reset."""
    w = Window.partitionBy(*keys).orderBy("t")
    return steps.withColumns({"last_action": F.coalesce(F.lag("action").over(w), F.lit(0.0)), "dv": F.coalesce(F.col("vel") - F.lag("vel").over(w), F.lit(0.0))})


def estimated_gain(dv: Column, action: Column, dt: float) -> Column:
    """How strongly actions turned into velocity: |dv| / (dt |action|) within 0.3 to 1.5; 1 without an action."""
    return F.when(F.abs(action) < 1e-3, 1.0).otherwise(F.least(F.greatest(F.abs(dv) / (dt * F.abs(action)), F.lit(0.3)), F.lit(1.5)))


def simulate(conditions: DataFrame, steps: int, dt: float, amax: float, radius: float, kp: float = 4.0, kd: float = 2.0) -> DataFrame:
    """Rolls a point mass under a clipped PD policy: ``conditions`` (.., mass, gain, drag, gx, gy) with the path folded in.

    The state is a struct and an episode one fold, so episodes are rows and nothing is shuffled. Within
    ``radius`` of the goal an episode is done and successful, and its state stays as it is.
    """
    g = lambda c: F.col(c)
    start = F.struct(*(F.lit(0.0).alias(n) for n in ("x", "y", "vx", "vy", "ret")), F.lit(False).alias("ok"), F.lit(0).alias("n"))

    def step(s: Column, _: Column) -> Column:
        clip = lambda a: F.least(F.greatest(a, F.lit(-amax)), F.lit(amax))
        ax, ay = clip(kp * (g("gx") - s.x) - kd * s.vx), clip(kp * (g("gy") - s.y) - kd * s.vy)
        vx = s.vx + dt * (g("gain") * ax - g("drag") * s.vx) / g("mass")
        vy = s.vy + dt * (g("gain") * ay - g("drag") * s.vy) / g("mass")
        x, y = s.x + dt * vx, s.y + dt * vy
        far = F.sqrt((g("gx") - x) * (g("gx") - x) + (g("gy") - y) * (g("gy") - y))
        new = F.struct(x.alias("x"), y.alias("y"), vx.alias("vx"), vy.alias("vy"), (s.ret - far * dt).alias("ret"), (far < radius).alias("ok"), (s.n + 1).alias("n"))
        return F.when(s.ok, s).otherwise(new)

    return conditions.withColumn("end", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))
