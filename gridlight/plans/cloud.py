"""Point-cloud and synthesis queries."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.operators import clouds, grid
from gridlight.plans.banks import _C, _cloud
from gridlight.plans.grids import _GRAZING, PIXELS_SQL, scans, surface, lattice_sql
from gridlight.sources.tables import table


def radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of neighbours within 0.08 of every point."""
    return clouds.neighbours(_cloud(spark, sf_dir), 0.08).groupBy(F.col("a").alias("vec_id")).agg(F.count("*").alias("n"))


def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the cloud; noise has cluster -1."""
    return clouds.dbscan(_cloud(spark, sf_dir), 0.08, 5).fillna(-1, ["cluster"])


def largest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = dbscan_clusters(spark, sf_dir).where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "cluster").limit(1)


def fpfh_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature histograms of each category's cloud."""
    return clouds.descriptors(_cloud(spark, sf_dir), "category", 10)


def noise_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic defect masks: value noise above a threshold drawn for each image, on the object; the masked heights are blended with noise."""
    s = clouds.noise_defect(surface(spark, sf_dir).where("valid"), 3.0)
    return s.groupBy("vec_id").agg(F.round(F.avg("m"), 7).alias("mean"), F.sum(F.col("hit").cast("long")).alias("n_mask"), (F.round(F.sum("blended"), 6) + F.lit(0.0)).alias("blended"))


def sensor_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axial noise of the sensor model, along z only: its deviation grows with 1 / cos, and so does the chance of a spike."""
    g = grid.grazing(surface(spark, sf_dir)).where("valid")
    hit = clouds.lattice(F.col("vec_id") + 2, F.col("u") + 5, F.col("v") + 11) < grid.SPIKES * grid.excess()
    z = grid.SIGMA * (1 + grid.excess()) * clouds.gauss(F.col("vec_id"), F.col("u"), F.col("v")) + F.when(hit, grid.SPIKE_SIZE * clouds.gauss(F.col("vec_id") + 3, F.col("u"), F.col("v"))).otherwise(0.0)
    return g.withColumn("dz", z).groupBy("vec_id").agg(F.round(F.sum("dz"), 6).alias("sum_dz"), F.round(F.max(F.abs("dz")), 6).alias("max_dz"))


def pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear autoencoder as anomaly score: error of each vector after projection on 8 principal axes (a substitute for trained networks)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    dims = 64
    mean = e.agg(*(F.avg(F.col("e")[i]) for i in range(dims))).first()
    centred = e.select("vec_id", array_to_vector(F.zip_with("e", F.array(*map(F.lit, mean)), lambda a, b: a - b)).alias("x"))
    coded = PCA(k=8, inputCol="x", outputCol="p").fit(centred).transform(centred)
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, v: a + v * v)
    return coded.select("vec_id", F.round(F.greatest(square("x") - square("p"), F.lit(0.0)), 7).alias("error"))


def organized_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid to point cloud: invalid pixels dropped, scores to 0..1 colours, masked ones marked."""
    s = grid.long_form(scans(spark, sf_dir)).where("valid")
    colour = F.least(F.greatest((F.col("amap") + 1) / 2, F.lit(0.0)), F.lit(1.0))
    return s.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum(F.col("mask").cast("long")).alias("red"), F.round(F.sum(colour), 7).alias("colour"))


_P8 = f"{_C}, nb AS (SELECT a.vec_id AS a, b.vec_id AS b FROM c a, c b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.08e0 * 0.08e0)"
_DB = f"""{_P8}, co AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= 5), ln AS (SELECT nb.a, nb.b FROM nb JOIN co ON co.a = nb.a JOIN co d ON d.a = nb.b),
re AS (SELECT a AS s, a AS t FROM co UNION SELECT re.s, ln.b FROM re JOIN ln ON ln.a = re.t), cm AS (SELECT s AS b, min(t) AS comp FROM re GROUP BY 1),
db AS (SELECT c.vec_id, coalesce(min(comp) FILTER (WHERE nb.b = c.vec_id), min(comp)) AS cluster FROM c LEFT JOIN nb ON nb.a = c.vec_id LEFT JOIN cm ON cm.b = nb.b GROUP BY 1)"""


_X, _Y = "CAST(floor(u / 3e0) AS BIGINT)", "CAST(floor(v / 3e0) AS BIGINT)"
_NOISE = f"(1 - (v / 3e0 - {_Y})) * ((1 - (u / 3e0 - {_X})) * {lattice_sql('vec_id', _X, _Y)} + (u / 3e0 - {_X}) * {lattice_sql('vec_id', _X + ' + 1', _Y)}) + (v / 3e0 - {_Y}) * ((1 - (u / 3e0 - {_X})) * {lattice_sql('vec_id', _X, _Y + ' + 1')} + (u / 3e0 - {_X}) * {lattice_sql('vec_id', _X + ' + 1', _Y + ' + 1')})"

def _gauss(seed: str) -> str:
    return f"(sqrt(-2 * ln({lattice_sql(seed, 'u', 'v')} + 1e-9)) * cos(2 * pi() * {lattice_sql(seed + ' + 1', 'u + 17', 'v + 31')}))"


QUERIES = {f.__name__: f for f in (radius_pairs, dbscan_clusters, largest_cluster, fpfh_descriptors, noise_mask, sensor_jitter, pca_reconstruction, organized_points)}
ORACLES = {
    "radius_pairs": f"WITH {_P8} SELECT a AS vec_id, count(*) AS n FROM nb GROUP BY 1",
    "dbscan_clusters": f"WITH RECURSIVE {_DB} SELECT vec_id, coalesce(cluster, -1) AS cluster FROM db",
    "largest_cluster": f"WITH RECURSIVE {_DB} SELECT cluster, count(*) AS n FROM db WHERE cluster IS NOT NULL GROUP BY 1 ORDER BY n DESC, cluster LIMIT 1",
    "noise_mask": f"WITH n AS (SELECT vec_id, u, v, amap + 2 AS z, {_NOISE} AS m, 0.6e0 + 0.2e0 * {lattice_sql('vec_id', '41', '43')} AS low, 0.2e0 + 0.8e0 * {lattice_sql('vec_id', '47', '53')} AS beta FROM ({PIXELS_SQL}) WHERE valid), d AS (SELECT vec_id, stddev_pop(z) AS sd FROM n GROUP BY 1) SELECT vec_id, round(avg(m), 7) AS mean, CAST(sum(CAST(m > low AS INT)) AS BIGINT) AS n_mask, round(sum(CASE WHEN m > low THEN beta * sd * {_gauss('vec_id + 5')} + (1 - beta) * z ELSE z END), 6) + 0.0 AS blended FROM n JOIN d USING (vec_id) GROUP BY 1",
    "sensor_jitter": f"WITH {_GRAZING}, q1 AS (SELECT *, 1 / least(greatest(cos, 0.15e0), 1e0) - 1 AS ex FROM g WHERE valid) SELECT vec_id, round(sum(dz), 6) AS sum_dz, round(max(abs(dz)), 6) AS max_dz FROM (SELECT vec_id, 8e-4 * (1 + ex) * {_gauss('vec_id')} + CASE WHEN {lattice_sql('vec_id + 2', 'u + 5', 'v + 11')} < 0.02e0 * ex THEN 0.02e0 * {_gauss('vec_id + 3')} ELSE 0 END AS dz FROM q1) GROUP BY 1",
    "organized_points": f"SELECT vec_id, count(*) AS n, CAST(sum(CAST(mask AS INT)) AS BIGINT) AS red, round(sum(least(greatest((amap + 1) / 2, 0), 1)), 7) AS colour FROM ({PIXELS_SQL}) WHERE valid GROUP BY 1",
}
