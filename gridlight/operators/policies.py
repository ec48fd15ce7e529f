"""Linear policies cloned from step tables: one action, or chunks of the next ones whose overlapping predictions are averaged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlight.operators import control, moments


def clone(steps: DataFrame, obs: str, action: str) -> moments.Linear:
    """The linear policy from array ``obs`` to array ``action`` with the least squared error over all steps."""
    return moments.least_squares(steps, obs, action)


def clone_chunks(steps: DataFrame, keys: list[str], obs: str, action: str, k: int) -> moments.Linear:
    """The linear policy from ``obs`` to the next ``k`` values of the number ``action`` (the tail held), over all steps of all episodes."""
    return moments.least_squares(control.chunks(steps, keys, action, k), obs, "chunk")


def ensembled(predicted: DataFrame, keys: list[str], k: int, chunk: str = "predicted", decay: float = 0.0) -> DataFrame:
    """``predicted`` with action: the average of what the last ``k`` steps' chunks say about a step, weighted by exp(-decay * age).

    An episode's first steps have fewer predictions. Steps are numbered without gaps by ``t``; a step without a
    chunk says nothing.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    said = [F.lag(F.get(chunk, F.lit(age)), age).over(w) if age else F.get(chunk, F.lit(0)) for age in range(k)]
    weight = [F.exp(F.lit(-decay * age)) for age in range(k)]
    total = sum((F.coalesce(s * v, F.lit(0.0)) for s, v in zip(said, weight)), F.lit(0.0))
    share = sum((F.when(s.isNotNull(), v).otherwise(0.0) for s, v in zip(said, weight)), F.lit(0.0))
    return predicted.withColumn("action", F.when(share > 0, total / share))


def act(steps: DataFrame, model: moments.Linear, keys: list[str], obs: str, k: int, decay: float = 0.0) -> DataFrame:
    """``steps`` with predicted (the chunk of each step) and action (the average of the overlapping ones)."""
    return ensembled(moments.predicted(steps, model, obs, "predicted"), keys, k, decay=decay)
