"""Bootstrap queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.operators import bootstrap
from gridlight.plans.metrics import IMAGE_SCORES_SQL, image_scores
from gridlight.sources.tables import table

#: Draws of every interval.
DRAWS = 1000


def boot_ci_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean score over images, without strata."""
    n = bootstrap.positions(image_scores(spark, sf_dir).select("doc_id", "score"), [], ["doc_id"])
    d = bootstrap.mean_of(bootstrap.weights(n, DRAWS), DRAWS, "score")
    return d.agg(*(F.round(c, 6).alias(a) for c, a in zip(bootstrap.interval(d, "m"), ("lo", "hi"))))


def boot_delta_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired arms (sessions of the same user): interval of mean B minus mean A under the same draws."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("b")).where("a is not null and b is not null")
    n = bootstrap.positions(e.select("user_id", (F.col("b") - F.col("a")).alias("delta")), [], ["user_id"])
    d = bootstrap.mean_of(bootstrap.weights(n, DRAWS), DRAWS, "delta")
    return d.agg(*(F.round(c, 6).alias(a) for c, a in zip(bootstrap.interval(d, "m"), ("lo", "hi"))))


def boot_macro_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are drawn within their category; a draw's figure is the mean over categories of the defined AUROCs."""
    n = bootstrap.positions(image_scores(spark, sf_dir).select("doc_id", "category", "score", "label"), ["category"], ["doc_id"])
    d = bootstrap.auroc_draws(bootstrap.weights(n, DRAWS), DRAWS, ["category"]).groupBy("draw").agg(F.avg("auroc").alias("m"))
    return d.agg(*(F.round(c, 8).alias(a) for c, a in zip(bootstrap.interval(d, "m"), ("lo", "hi"))))


def boot_macro_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired and stratified: AUROC by length minus AUROC by a second score, on the same draws."""
    s = image_scores(spark, sf_dir).select("doc_id", "category", "score", "label", ((F.col("doc_id") * 37) % 101).cast("double").alias("other"))
    d = bootstrap.weights(bootstrap.positions(s, ["category"], ["doc_id"]), DRAWS)
    a = bootstrap.auroc_draws(d, DRAWS, ["category"]).withColumnRenamed("auroc", "a")
    b = bootstrap.auroc_draws(d, DRAWS, ["category"], "other").withColumnRenamed("auroc", "b")
    m = a.join(b, ["draw", "category"]).groupBy("draw").agg((F.avg("b") - F.avg("a")).alias("m"))
    return m.agg(*(F.round(c, 8).alias(x) for c, x in zip(bootstrap.interval(m, "m"), ("lo", "hi"))))


#: Strata numbers: DuckDB has no crc32, so those of the four languages are given.
_STRATA = {c: __import__("zlib").crc32(c.encode()) % 1000003 for c in ("en", "de", "fr", "es")}
_CASE = "CASE category " + " ".join(f"WHEN '{c}' THEN {k}" for c, k in _STRATA.items()) + " END"


def _draws(rows: str, stratum: str, part: str, key: str) -> str:
    return f"""n AS (SELECT *, CAST({stratum} AS BIGINT) AS st, row_number() OVER (PARTITION BY {part} ORDER BY {key}) - 1 AS pos, count(*) OVER (PARTITION BY {part}) AS n FROM ({rows})),
w AS (SELECT d.i AS draw, st, ((d.i * 1103515245 + pos * 12345 + st * 7919) % 2147483647) * 48271 % 2147483647 % n AS pos FROM n, range(0, {DRAWS}) d(i)),
x AS (SELECT w.draw, n.* FROM w JOIN n USING (st, pos))"""


def _auc(score: str, name: str) -> str:
    return f"""{name} AS (SELECT draw, category, CASE WHEN p > 0 AND m > p THEN (sp - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * (m - p)) END AS auc FROM (SELECT draw, category, count(*) AS m, sum(label) AS p, sum(CASE WHEN label = 1 THEN rk END) AS sp FROM (SELECT draw, category, label, rank() OVER (PARTITION BY draw, category ORDER BY {score}) + (count(*) OVER (PARTITION BY draw, category, {score}) - 1) / 2.0 AS rk FROM x) GROUP BY 1, 2))"""


_CI = "SELECT round(quantile_cont(m, 0.025), {r}) AS lo, round(quantile_cont(m, 0.975), {r}) AS hi FROM"
_ROWS = f"SELECT * FROM ({IMAGE_SCORES_SQL})"

QUERIES = {f.__name__: f for f in (boot_ci_mean, boot_delta_paired, boot_macro_auroc, boot_macro_delta)}
ORACLES = {
    "boot_ci_mean": f"WITH {_draws(_ROWS, '0', '1', 'doc_id')} {_CI.format(r=6)} (SELECT avg(score) AS m FROM x GROUP BY draw)",
    "boot_delta_paired": f"WITH {_draws('''SELECT * FROM (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL''', '0', '1', 'user_id')} {_CI.format(r=6)} (SELECT avg(b - a) AS m FROM x GROUP BY draw)",
    "boot_macro_auroc": f"WITH {_draws(_ROWS, _CASE, 'category', 'doc_id')}, {_auc('score', 'g')} {_CI.format(r=8)} (SELECT avg(auc) AS m FROM g GROUP BY draw)",
    "boot_macro_delta": f"WITH {_draws(f'SELECT *, CAST((doc_id * 37) % 101 AS DOUBLE) AS other FROM ({IMAGE_SCORES_SQL})', _CASE, 'category', 'doc_id')}, {_auc('score', 'g')}, {_auc('other', 'h')} {_CI.format(r=8)} (SELECT avg(h.auc) - avg(g.auc) AS m FROM g JOIN h USING (draw, category) GROUP BY draw)",
}
