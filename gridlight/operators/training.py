"""Training analytics: losses as sums, moving averages as folds, early stopping as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked_loss(x: str, recon: str, valid: str) -> Column:
    """Squared error of valid elements over their number, an aggregate."""
    v = F.col(valid).cast("double")
    return F.sum((F.col(recon) - F.col(x)) ** 2 * v) / (F.sum(v) + 1e-8)


def kl_loss(mu: str, logvar: str) -> Column:
    return F.avg(1 + F.col(logvar) - F.col(mu) ** 2 - F.exp(logvar)) * -0.5


def weighted_bce(logit: str, target: str, weight: str) -> Column:
    """Binary cross entropy of logits in its stable form: weighted, but a mean over all elements."""
    x, y = F.col(logit), F.col(target).cast("double")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return F.sum(F.col(weight).cast("double") * loss) / F.count(F.lit(1))


def ema(rows: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """(keys, ema): exponential moving average in order; the first value begins it. A series is one row's fold."""
    series = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))), lambda s: s._v)
    fold = F.aggregate(F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), F.get("_s", F.lit(0)), lambda a, v: (1 - alpha) * a + alpha * v)
    return rows.groupBy(*keys).agg(series.alias("_s")).select(*keys, fold.alias("ema"))


def curriculum(losses: DataFrame, kinds: DataFrame, key: str, temperature: float = 1.0) -> DataFrame:
    """(key, weight): softmax of standardised losses; kinds without a loss take the largest. Kinds are few."""
    w = Window.partitionBy(F.lit(1))
    s = kinds.join(losses, key, "left").withColumn("l", F.coalesce("ema", F.max("ema").over(w), F.lit(1.0)))
    z = s.withColumn("e", F.exp((F.col("l") - F.avg("l").over(w)) / (F.stddev_pop("l").over(w) + 1e-6) / temperature))
    return z.select(key, (F.col("e") / F.sum("e").over(w)).alias("weight"))


def early_stop(rows: DataFrame, keys: list[str], epoch: str, value: str, patience: int) -> DataFrame:
    """(keys, stop_epoch or null, best_epoch, best): stops after ``patience`` epochs without a new best; the best is of the epochs run."""
    w = Window.partitionBy(*keys).orderBy(epoch)
    s = rows.withColumn("_before", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_better", (F.col("_before").isNull() | (F.col(value) > F.col("_before"))).cast("int")).withColumn("_run", F.sum("_better").over(w))
    s = s.withColumn("_since", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(epoch)) - 1)
    stop = F.min(F.when(F.col("_since") >= patience, F.col(epoch))).over(Window.partitionBy(*keys))
    ran = s.withColumn("stop_epoch", stop).where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return ran.groupBy(*keys, "stop_epoch").agg(F.min_by(epoch, F.struct((-F.col(value)).alias("v"), F.col(epoch))).alias("best_epoch"), F.max(value).alias("best"))


def batch_statistics(rows: DataFrame, batch: str, channel: str, value: str) -> DataFrame:
    """(channel, mean, var): unweighted means over batches of the batches' means and variances."""
    each = rows.groupBy(batch, channel).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    return each.groupBy(channel).agg(F.avg("m").alias("mean"), F.avg("v").alias("var"))


def eta(elapsed: Column, done: Column, total: Column) -> Column:
    """Time left at the mean rate so far; 0 before the first."""
    return F.when(done > 0, elapsed / done * (total - done)).otherwise(0.0)


def quantise(x: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """(int8 code, its value) by an affine scale."""
    step = F.when(hi > lo, (hi - lo) / 255).otherwise(F.lit(1.0))
    code = F.bround((x - lo) / step).cast("int") - 128
    return code, (code + 128) * step + lo
