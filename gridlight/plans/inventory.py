"""Inventory, split, run and quality-rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlight.operators import tracking
from gridlight.plans.metrics import IMAGE_SCORES_SQL, image_scores
from gridlight.sources.tables import table


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample inventory: documents as samples, their ids formatted, labels by defect, splits by id."""
    d = table(spark, sf_dir, "documents")
    defect = F.when(F.col("source") == "src0", "good").otherwise(F.col("source"))
    split = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "validation").otherwise("test")
    s = d.select("doc_id", F.col("lang").alias("category"), split.alias("split"), defect.alias("defect"), "n_chars")
    return s.withColumns({"sample_id": F.format_string("%s_%s_%s_%03d", "category", "split", "defect", "doc_id"), "label": F.when(F.col("defect") == "good", 0).otherwise(1)})


def inventory_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("sample_id", "category", "split", "defect", "label")


def inventory_split_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n")).orderBy("split", "label")


def inventory_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.sum("label").alias("anomalies")).orderBy("category")


def split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunctive filter on split, label and categories."""
    return samples(spark, sf_dir).where((F.col("split") == "test") & (F.col("label") == 1) & F.col("category").isin("en", "de")).select("sample_id", "n_chars")


def calib_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each label, rows alternate in the order of sample_id: the first evaluates, the second calibrates."""
    k = F.row_number().over(Window.partitionBy("category", "label").orderBy("sample_id")) - 1
    return samples(spark, sf_dir).select("sample_id", F.when(k % 2 == 1, "calib").otherwise("eval").alias("part"))


def hash_pool_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample without replacement: the 50 members of each category first in a fixed pseudo-random order."""
    order = (F.col("doc_id") * 1103515245 + 12345) % 2147483647
    k = F.row_number().over(Window.partitionBy("category").orderBy(order, "doc_id"))
    return samples(spark, sf_dir).withColumn("k", k).where("k <= 50").select("category", "doc_id")


def synth_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint train and validation parts: max(16, n // 5) rows of each category validate."""
    order = (F.col("doc_id") * 48271 + 11) % 2147483647
    w = Window.partitionBy("category")
    s = samples(spark, sf_dir).withColumns({"k": F.row_number().over(w.orderBy(order, "doc_id")), "n": F.count("*").over(w)})
    return s.groupBy("category").agg(F.sum((F.col("k") <= F.greatest(F.lit(16), F.expr("n div 5"))).cast("long")).alias("n_val"), F.count("*").alias("n"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of every name: orders as runs of their customer."""
    return tracking.latest(runs(spark, sf_dir)).select("run_name", "run_id", F.round("metric", 4).alias("metric"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_name"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("start_time"), F.col("o_totalprice").alias("metric"), F.col("o_orderpriority").alias("experiment"))


def results_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method's stored figure, overwritten only where its newest run has one."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_name"), F.round("c_acctbal", 3).alias("old"))
    new = tracking.latest(runs(spark, sf_dir)).select("run_name", F.when(F.col("metric") > 50000, F.round(F.col("metric") / 1000, 3)).alias("new"))
    return tracking.refresh(old, new).select("run_name", F.round("value", 3).alias("value"))


def triad_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms side by side with their deltas to the baseline arm: mean price by priority and status."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("arm"), F.col("o_totalprice").alias("m"))
    p = tracking.pivot_arms(o, "name", "arm", "m", ["F", "O", "P"], "F")
    return p.select("name", *(F.round(c, 4).alias(c) for c in p.columns if c != "name"))


def metric_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each run without null and NaN entries."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("price"), "o_totalprice", F.lit("late"), F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))), F.lit("ratio"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice") / 100000)).alias("metrics"))
    kept = o.select("o_orderkey", tracking.finite("metrics").alias("m"))
    return kept.select("o_orderkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"))


def process_missing_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples not processed yet: documents without a label."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules broken by reported figures of each nation: interval, mean of means, range of the shares, and a delta."""
    x = F.col("c_acctbal")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg(x).alias("mean"), F.avg(F.round(x, -2)).alias("point"), F.min(x).alias("lo"), F.percentile("c_acctbal", 0.55).alias("hi"), F.min(x / 10000).alias("least"), F.max(x / 10000).alias("most"), F.avg(F.when(x > 0, x)).alias("b"), F.avg(F.when(x <= 0, x)).alias("a"))
    c = c.withColumns({"ece": F.when(F.col("c_nationkey") % 2 == 0, 0.1), "delta": F.col("b") - F.col("a") + F.when(F.col("c_nationkey") % 3 == 0, 1e-5).otherwise(0.0)})
    return tracking.violations(c, "c_nationkey").select("c_nationkey", "rule")


def table_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of rounded rows, beside the rounded mean of rows."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"))
    return rows.agg(F.round(F.avg(F.round("m", 3)), 3).alias("of_rounded"), F.round(F.avg("m"), 3).alias("rounded"))


def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of two arms over the images that both have: views and clicks of the same user."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    a, b = (e.where(F.col("event_type") == t).select("user_id", F.col("m").alias(n)) for t, n in (("view", "a"), ("click", "b")))
    return a.join(b, "user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"))


def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the finite scores of each category."""
    q = F.percentile("score", F.array(F.lit(0.025), F.lit(0.975)))
    return image_scores(spark, sf_dir).groupBy("category").agg(F.round(q[0], 6).alias("lo"), F.round(q[1], 6).alias("hi"))


_SAMPLES = """s AS (SELECT doc_id, lang AS category, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split, CASE WHEN source = 'src0' THEN 'good' ELSE source END AS defect, n_chars FROM documents),
i AS (SELECT *, CAST(defect <> 'good' AS INT) AS label, category || '_' || split || '_' || defect || '_' || CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END AS sample_id FROM s)"""
_LATEST = "l AS (SELECT o_custkey AS run_name, o_orderkey AS run_id, o_totalprice AS metric FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1)"

QUERIES = {f.__name__: f for f in (inventory_samples, inventory_split_label, inventory_category, split_filter, calib_eval_split, hash_pool_cap, synth_holdout, latest_run, results_refresh, triad_pivot, metric_filter, process_missing_antijoin, invariant_violations, table_mean, paired_arms, score_quantiles)}
ORACLES = {
    "inventory_samples": f"WITH {_SAMPLES} SELECT sample_id, category, split, defect, label FROM i",
    "inventory_split_label": f"WITH {_SAMPLES} SELECT split, label, count(*) AS n FROM i GROUP BY 1, 2",
    "inventory_category": f"WITH {_SAMPLES} SELECT category, count(*) AS n, CAST(sum(label) AS BIGINT) AS anomalies FROM i GROUP BY 1",
    "split_filter": f"WITH {_SAMPLES} SELECT sample_id, n_chars FROM i WHERE split = 'test' AND label = 1 AND category IN ('en', 'de')",
    "calib_eval_split": f"WITH {_SAMPLES} SELECT sample_id, CASE WHEN row_number() OVER (PARTITION BY category, label ORDER BY sample_id) % 2 = 0 THEN 'calib' ELSE 'eval' END AS part FROM i",
    "hash_pool_cap": f"WITH {_SAMPLES} SELECT category, doc_id FROM (SELECT category, doc_id, row_number() OVER (PARTITION BY category ORDER BY (doc_id * 1103515245 + 12345) % 2147483647, doc_id) AS k FROM i) WHERE k <= 50",
    "synth_holdout": "SELECT lang AS category, greatest(least(count(*), 16), count(*) // 5) AS n_val, count(*) AS n FROM documents GROUP BY 1",
    "latest_run": f"WITH {_LATEST} SELECT run_name, run_id, round(metric, 4) AS metric FROM l",
    "results_refresh": f"WITH {_LATEST} SELECT c_custkey AS run_name, coalesce(CASE WHEN metric > 50000 THEN round(metric / 1000, 3) END, round(c_acctbal, 3)) AS value FROM customer LEFT JOIN l ON run_name = c_custkey",
    "triad_pivot": "SELECT name, round(f, 4) AS F, round(o, 4) AS O, round(p, 4) AS P, round(o - f, 4) AS O_delta, round(p - f, 4) AS P_delta FROM (SELECT o_orderpriority AS name, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1)",
    "metric_filter": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'price,ratio' ELSE 'price' END AS names FROM orders",
    "process_missing_antijoin": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "invariant_violations": """WITH c AS (SELECT c_nationkey, avg(c_acctbal) AS mean, avg(round(c_acctbal, -2)) AS point, min(c_acctbal) AS lo, quantile_cont(c_acctbal, 0.55) AS hi, min(c_acctbal / 10000) AS least, max(c_acctbal / 10000) AS most, c_nationkey % 3 = 0 AS off, count(*) FILTER (WHERE c_acctbal > 0) * count(*) FILTER (WHERE c_acctbal <= 0) > 0 AS signs FROM customer GROUP BY 1)
SELECT c_nationkey, 'bracket' AS rule FROM c WHERE NOT point BETWEEN lo AND hi UNION ALL SELECT c_nationkey, 'aggregate' FROM c WHERE abs(point - mean) > 1e-6 UNION ALL SELECT c_nationkey, 'range' FROM c WHERE c_nationkey % 2 = 0 AND (least < 0 OR most > 1) UNION ALL SELECT c_nationkey, 'reconciles' FROM c WHERE off AND signs""",
    "table_mean": "SELECT round(avg(round(m, 3)), 3) AS of_rounded, round(avg(m), 3) AS rounded FROM (SELECT avg(l_discount) AS m FROM lineitem GROUP BY l_suppkey)",
    "paired_arms": "WITH e AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2) SELECT count(*) AS n, round(avg(b.m - a.m), 6) AS delta FROM e a JOIN e b USING (user_id) WHERE a.event_type = 'view' AND b.event_type = 'click'",
    "score_quantiles": f"SELECT category, round(quantile_cont(score, 0.025), 6) AS lo, round(quantile_cont(score, 0.975), 6) AS hi FROM ({IMAGE_SCORES_SQL}) GROUP BY 1",
}
