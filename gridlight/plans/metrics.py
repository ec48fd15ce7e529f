"""Image-level and pixel-level metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.functions import calibration, ranking
from gridlight.operators import harness, regions
from gridlight.plans.grids import PIXELS_SQL, scans
from gridlight.sources.tables import table


def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image-level scores: length of a document against its quality label, by language; its source is the defect type."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.col("source").alias("defect"), F.col("n_chars").cast("double").alias("score"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel probabilities with targets and validity: discounts of line items scaled to 0..1."""
    return table(spark, sf_dir, "lineitem").select(((F.col("l_discount") + F.lit(0.0)) * 10).alias("p"), (F.col("l_returnflag") == "R").alias("target"), (F.col("l_quantity") > 5).alias("valid"))


def image_auroc_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.auroc(image_scores(spark, sf_dir), ["category"]).select("category", "n", "n_pos", F.round("auroc", 9).alias("auroc"))


def macro_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over categories of the defined AUROCs, beside the pooled one (they differ)."""
    s = image_scores(spark, sf_dir)
    pooled = ranking.auroc(s.withColumn("all", F.lit(1)), ["all"]).select(F.col("auroc").alias("pooled"))
    macro = ranking.auroc(s, ["category"]).agg(F.avg("auroc").alias("macro"), F.count("auroc").alias("n_defined"))
    return macro.join(pooled, how="cross").select(F.round("macro", 9).alias("macro"), F.round("pooled", 9).alias("pooled"), "n_defined")


def auroc_by_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.auroc_by_type(image_scores(spark, sf_dir), "defect")
    return found.select("defect", "n", F.round("auroc", 9).alias("auroc"))


def ece_15bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.ece(probabilities(spark, sf_dir), 15).select(F.round("ece", 9).alias("ece"), "n")


def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.bins(probabilities(spark, sf_dir), 15).select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("mean_t", 9).alias("mean_t"))


def topk_image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the 16 largest valid pixel scores of every image; 0 without a valid pixel."""
    return regions.topk_score(scans(spark, sf_dir), 16).select("vec_id", F.round("score", 9).alias("score"))


def region_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8-connected regions of every image's mask: first pixel and number of pixels."""
    return regions.components(scans(spark, sf_dir)).select("vec_id", F.col("first").cast("long").alias("first_pix"), F.size("pixels").cast("long").alias("n_pix"))


def au_pro_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions.au_pro(scans(spark, sf_dir), ["category"])
    return found.select(F.col("category").cast("long").alias("category"), "n_regions", F.round("au_pro", 9).alias("au_pro"))


def au_pro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.au_pro(scans(spark, sf_dir), ["category"]).agg(F.round(F.avg("au_pro"), 9).alias("au_pro"), F.count("au_pro").alias("n_categories"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with an image label (whether a pixel is masked) and a defect type."""
    s = scans(spark, sf_dir).withColumn("label", F.exists("mask", lambda x: x).cast("int"))
    return s.withColumn("defect", F.when(F.col("label") == 1, F.concat(F.lit("type"), F.col("vec_id") % 3)).otherwise("good"))


def harness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of the scans as a method's maps: by category, by defect type, and macro means with their intervals."""
    return _ninth(harness.report(scored(spark, sf_dir)), "img_auroc", "au_pro", "img_auroc_lo", "img_auroc_hi", "au_pro_lo", "au_pro_hi", "ece")


def au_pro_by_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ninth(harness.au_pro_by_defect(scored(spark, sf_dir)), "au_pro")


def boot_macro_au_pro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the macro AU-PRO over 1,000 stratified draws of images."""
    s = scans(spark, sf_dir)
    return _ninth(harness.boot_macro(s.select("vec_id", "category"), harness.pixel_au_pro(regions.summaries(s, ["category"]))), "point", "lo", "hi")


def _ninth(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


IMAGE_SCORES_SQL = "SELECT d.doc_id, lang AS category, source AS defect, CAST(n_chars AS DOUBLE) AS score, quality AS label FROM documents d JOIN labels l USING (doc_id)"


def auroc_sql(rows: str, key: str) -> str:
    """DuckDB: (key, n, n_pos, auroc) by mid-ranks."""
    return f"""SELECT {key}, CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS n_pos, CASE WHEN p > 0 AND n > p THEN (sp - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * (n - p)) END AS auroc
FROM (SELECT {key}, count(*) AS n, sum(label) AS p, sum(CASE WHEN label = 1 THEN rk END) AS sp FROM (
  SELECT {key}, label, rank() OVER (PARTITION BY {key} ORDER BY score) + (count(*) OVER (PARTITION BY {key}, score) - 1) / 2.0 AS rk FROM ({rows})) GROUP BY {key})"""


_PROBABILITIES = "SELECT (l_discount + 0e0) * 10 AS p, CAST(l_returnflag = 'R' AS INT) AS t FROM lineitem WHERE l_quantity > 5"
_BINS = f"""SELECT least(greatest(len(list_filter(range(0, 16), lambda k: k * (1e0 / 15) <= p)) - 1, 0), 14) AS bin, count(*) AS n, avg(p) AS mean_p, avg(t) AS mean_t FROM ({_PROBABILITIES}) GROUP BY 1"""

REGIONS_SQL = f"""px AS ({PIXELS_SQL}),
m AS (SELECT vec_id, category, pix, v, u, amap FROM px WHERE mask),
reach AS (SELECT vec_id, pix AS src, pix AS dst FROM m UNION SELECT r.vec_id, r.src, b.pix FROM reach r JOIN m a ON a.vec_id = r.vec_id AND a.pix = r.dst JOIN m b ON b.vec_id = a.vec_id AND abs(a.v - b.v) <= 1 AND abs(a.u - b.u) <= 1),
lab AS (SELECT vec_id, src AS pix, min(dst) AS first_pix FROM reach GROUP BY 1, 2)"""

AU_PRO_SQL = f"""WITH RECURSIVE {REGIONS_SQL},
reg AS (SELECT m.category, m.vec_id, l.first_pix, m.amap FROM m JOIN lab l USING (vec_id, pix)),
nor AS (SELECT category, amap FROM px WHERE valid AND NOT mask),
lim AS (SELECT category, min(amap) AS lo, max(amap) AS hi FROM (SELECT category, amap FROM reg UNION ALL SELECT category, amap FROM nor) GROUP BY 1),
th AS (SELECT category, i, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199) END AS th FROM lim, range(0, 200) t(i)),
fp AS (SELECT th.category, th.i, count(*) FILTER (WHERE amap > th) AS fp, count(*) AS n FROM th JOIN nor USING (category) GROUP BY 1, 2),
ov AS (SELECT category, i, avg(share) AS pro FROM (SELECT th.category, i, vec_id, first_pix, avg(CASE WHEN amap > th THEN 1e0 ELSE 0e0 END) AS share FROM th JOIN reg USING (category) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
env AS (SELECT category, fp, max(fp / CAST(n AS DOUBLE)) AS fpr, max(pro) AS pro FROM fp JOIN ov USING (category, i) GROUP BY 1, 2),
seg AS (SELECT *, lead(fpr) OVER w AS fpr2, lead(pro) OVER w AS pro2, min(fpr) OVER (PARTITION BY category) AS f0, max(fpr) OVER (PARTITION BY category) AS f1 FROM env WINDOW w AS (PARTITION BY category ORDER BY fp)),
grid AS (SELECT category, k, 0.3e0 * k / 255 AS x FROM (SELECT DISTINCT category FROM env), range(0, 256) t(k)),
y AS (SELECT g.category, g.k, max(CASE WHEN x < s.f0 AND s.fpr = s.f0 THEN s.pro WHEN s.fpr2 IS NULL AND x >= s.fpr THEN s.pro WHEN x >= s.fpr AND x < s.fpr2 THEN s.pro + (x - s.fpr) / (s.fpr2 - s.fpr) * (s.pro2 - s.pro) END) AS y FROM grid g JOIN seg s USING (category) GROUP BY 1, 2),
nreg AS (SELECT category, count(*) AS n_regions FROM (SELECT DISTINCT category, vec_id, first_pix FROM reg) GROUP BY 1),
area AS (SELECT category, sum((y + y2) / 2) / 255 AS au_pro FROM (SELECT category, y, lead(y) OVER (PARTITION BY category ORDER BY k) AS y2 FROM y) WHERE y2 IS NOT NULL GROUP BY 1)"""

_TYPES = f"""WITH s AS ({IMAGE_SCORES_SQL}), t AS (SELECT DISTINCT defect FROM s WHERE label = 1),
r AS (SELECT defect, score, label FROM s WHERE label = 1 UNION ALL SELECT t.defect, s.score, 0 FROM s, t WHERE s.label = 0)
SELECT defect, n_pos AS n, round(auroc, 9) AS auroc FROM ({auroc_sql('SELECT * FROM r', 'defect')})"""

QUERIES = {f.__name__: f for f in (image_auroc_by_category, macro_auroc, auroc_by_defect, ece_15bin, ece_bins, topk_image_score, region_components, au_pro_by_category, au_pro_macro, harness_report, au_pro_by_defect, boot_macro_au_pro)}
ORACLES = {
    "image_auroc_by_category": f"SELECT category, n, n_pos, round(auroc, 9) AS auroc FROM ({auroc_sql(IMAGE_SCORES_SQL, 'category')})",
    "macro_auroc": f"SELECT round(macro, 9) AS macro, round(pooled, 9) AS pooled, n_defined FROM (SELECT avg(auroc) AS macro, count(auroc) AS n_defined FROM ({auroc_sql(IMAGE_SCORES_SQL, 'category')})), (SELECT auroc AS pooled FROM ({auroc_sql(f'SELECT 1 AS al, score, label FROM ({IMAGE_SCORES_SQL})', 'al')}))",
    "auroc_by_defect": _TYPES,
    "ece_15bin": f"SELECT round(sum(n * abs(mean_t - mean_p)) / sum(n), 9) AS ece, CAST(sum(n) AS BIGINT) AS n FROM ({_BINS})",
    "ece_bins": f"SELECT CAST(bin AS INT) AS bin, n, round(mean_p, 9) AS mean_p, round(mean_t, 9) AS mean_t FROM ({_BINS})",
    "topk_image_score": f"SELECT vec_id, round(coalesce(avg(amap) FILTER (WHERE rn <= 16), 0), 9) AS score FROM (SELECT vec_id, amap, CASE WHEN valid THEN row_number() OVER (PARTITION BY vec_id, valid ORDER BY amap DESC) END AS rn FROM ({PIXELS_SQL})) GROUP BY vec_id",
    "region_components": f"WITH RECURSIVE {REGIONS_SQL} SELECT vec_id, CAST(first_pix AS BIGINT) AS first_pix, count(*) AS n_pix FROM lab GROUP BY 1, 2",
    "au_pro_by_category": f"{AU_PRO_SQL} SELECT CAST(category AS BIGINT) AS category, n_regions, round(au_pro, 9) AS au_pro FROM area JOIN nreg USING (category)",
    "au_pro_macro": f"{AU_PRO_SQL} SELECT round(avg(au_pro), 9) AS au_pro, count(au_pro) AS n_categories FROM area",
}
