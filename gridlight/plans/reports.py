"""Reporting and training-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlight.operators import report, training
from gridlight.plans.grids import PIXELS_SQL, scans
from gridlight.sources.tables import table


def render_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results table in Markdown: mean order price by priority with an interval where there is one."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((F.avg("o_totalprice") / 1e6).alias("m"), F.when(F.min("o_orderpriority") != "5-LOW", F.percentile("o_totalprice", 0.25) / 1e6).alias("lo"), (F.percentile("o_totalprice", 0.75) / 1e6).alias("hi"))
    return report.markdown(o, "o_orderpriority", [F.col("o_orderpriority"), report.with_interval("m", "lo", "hi"), report.number("lo", 2)], ["priority", "mean", "low"])


def fill_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(1, "a\n<!-- results:x -->\nold $1\n<!-- /results:x -->\nb"), (2, "nothing")], "id int, text string")
    return t.select("id", report.fill_block(F.col("text"), "x", F.concat(F.lit("cost $"), "id", F.lit(" \\ done"))).alias("text"))


def inline_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of nations put into marked spans of their names."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("value"))
    refs = n.select(F.concat(F.lit("n."), F.col("c_nationkey").cast("string")).alias("ref"), "value")
    texts = table(spark, sf_dir, "nation").join(n.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(": <!--r:n."), "n_nationkey", F.lit("-->0<!--/r--> and <!--r:n."), "n_nationkey", F.lit("-->old<!--/r-->.")).alias("text"))
    return report.inline(texts, refs)


def model_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card of each market segment: headline and a line for each nation, taken from a map of metrics by its key's prefix."""
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    m = c.groupBy("c_mktsegment").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n/"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")), "n"))).alias("m"), F.sum("n").alias("total"))
    kept = F.array_sort(F.map_entries(F.map_filter("m", lambda k, _: k.startswith("n/0"))))
    lines = F.array_join(F.transform(kept, lambda e: F.concat(F.lit("| "), F.substring(e["key"], 3, 9), F.lit(" | "), e["value"].cast("string"), F.lit(" |"))), "\n")
    return m.select("c_mktsegment", F.concat(F.lit("# Card of "), "c_mktsegment", F.lit("\n- rows "), "total", F.lit("\n"), lines).alias("card"))


def ema_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights of event types by their values' moving average; one kind is never seen."""
    e = table(spark, sf_dir, "events")
    losses = training.ema(e.where("event_type != 'error'"), ["event_type"], ["ts", "event_id"], "value", 0.3)
    w = training.curriculum(losses, e.select("event_type").distinct(), "event_type")
    return w.select("event_type", F.round("weight", 7).alias("weight"))


def early_stop_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs are a user's events; training stops after 5 without a new best value."""
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    s = table(spark, sf_dir, "events").select("user_id", t.cast("long").alias("epoch"), "value")
    return training.early_stop(s, ["user_id"], "epoch", "value", 5).select("user_id", "stop_epoch", "best_epoch", F.round("best", 6).alias("best"))


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scans(spark, sf_dir).select("vec_id", "category", F.posexplode(F.arrays_zip("amap", F.reverse("amap").alias("other"), "valid", "mask")).alias("pix", "p"))
    return s.select("vec_id", "category", "pix", F.col("p.amap").alias("x"), F.col("p.other").alias("r"), F.col("p.valid").alias("valid"), F.col("p.mask").alias("mask"))


def masked_recon_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).groupBy("category").agg(F.round(training.masked_loss("x", "r", "valid"), 9).alias("loss")).select(F.col("category").cast("long").alias("category"), "loss")


def kl_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).agg(F.round(training.kl_loss("x", "r"), 9).alias("kl"))


def weighted_bce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).agg(F.round(training.weighted_bce("x", "mask", "valid"), 9).alias("bce"))


def residual_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared residuals and sigmoid scores, zero off the object, summed up by image."""
    r = _losses(spark, sf_dir).withColumns({"res": F.when(F.col("valid"), (F.col("r") - F.col("x")) ** 2).otherwise(0.0), "sig": F.when(F.col("valid"), 1 / (1 + F.exp(-F.col("x")))).otherwise(0.0)})
    return r.groupBy("vec_id").agg(F.round(F.sum("res"), 8).alias("residual"), F.round(F.sum("sig"), 7).alias("sigmoid"))


def inpaint_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 4 x 4 tile predicted by the mean of the others, as its squared error."""
    p = _losses(spark, sf_dir).withColumn("tile", F.expr("(pix div 32) * 2 + (pix % 8) div 4").cast("int"))
    t = p.groupBy("vec_id", "tile").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("vec_id")
    pred = t.select("vec_id", "tile", ((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n"))).alias("pred"))
    return p.join(pred, ["vec_id", "tile"]).groupBy("vec_id", "tile").agg(F.round(F.sum((F.col("x") - F.col("pred")) ** 2), 8).alias("error"))


def adabn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of batches of line items by return flag, averaged over batches."""
    o = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 16).alias("batch"), "l_returnflag", "l_quantity")
    return training.batch_statistics(o, "batch", "l_returnflag", "l_quantity").select("l_returnflag", F.round("mean", 7).alias("mean"), F.round("var", 6).alias("var"))


def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss and throughput of every epoch: orders by year."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("epoch")).agg(F.round(F.avg("o_totalprice"), 4).alias("loss"), F.count("*").alias("n"))
    return o


def eta_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each user's events: done, elapsed hours and the time left."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("done"), F.count("*").over(w).alias("total"), ((F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 3.6e9).alias("hours"))
    return e.select("user_id", "event_id", "done", F.round(training.eta(F.col("hours"), F.col("done"), F.col("total")), 4).alias("left_hours"))


def int8_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors quantised to int8 over their own range and back: largest error of each."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumns({"lo": F.array_min("e"), "hi": F.array_max("e")}).select("vec_id", "lo", "hi", F.explode("e").alias("x"))
    code, back = training.quantise(F.col("x"), F.col("lo"), F.col("hi"))
    return e.withColumns({"code": code, "back": back}).groupBy("vec_id").agg(F.min("code").cast("int").alias("min_code"), F.max("code").cast("int").alias("max_code"), F.round(F.max(F.abs(F.col("back") - F.col("x"))), 6).alias("worst"))


def sessions_stream_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours of events, by the same expression as the streaming job."""
    from gridlight.streaming.episodes import hourly

    return hourly(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


_L = f"p AS (SELECT a.vec_id, a.category, a.pix, a.amap AS x, b.amap AS r, a.valid, a.mask FROM ({PIXELS_SQL}) a JOIN ({PIXELS_SQL}) b ON a.vec_id = b.vec_id AND b.pix = 63 - a.pix)"
_EV = "s AS (SELECT user_id, event_id, ts, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch FROM events)"

QUERIES = {f.__name__: f for f in (render_table, fill_blocks, inline_refs, model_card, ema_curriculum, early_stop_epoch, masked_recon_loss, kl_loss, weighted_bce, residual_map, inpaint_tiles, adabn_stats, epoch_means, eta_progress, int8_quantise, sessions_stream_batch)}
ORACLES = {
    "render_table": "WITH o AS (SELECT o_orderpriority AS p, avg(o_totalprice) / 1e6 AS m, CASE WHEN o_orderpriority <> '5-LOW' THEN quantile_cont(o_totalprice, 0.25) / 1e6 END AS lo, quantile_cont(o_totalprice, 0.75) / 1e6 AS hi FROM orders GROUP BY 1) SELECT '| priority | mean | low |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || p || ' | ' || CASE WHEN lo IS NULL THEN printf('%.3f', m) ELSE printf('%.3f [%.3f, %.3f]', m, lo, hi) END || ' | ' || coalesce(printf('%.2f', lo), '—') || ' |', chr(10) ORDER BY p) AS text FROM o",
    "fill_blocks": "SELECT * FROM (VALUES (1, 'a' || chr(10) || '<!-- results:x -->' || chr(10) || 'cost $1 \\ done' || chr(10) || '<!-- /results:x -->' || chr(10) || 'b'), (2, 'nothing')) t(id, text)",
    "inline_refs": "SELECT n_nationkey AS id, n_name || ': <!--r:n.' || n_nationkey || '-->' || printf('%.3f', v) || '<!--/r--> and <!--r:n.' || n_nationkey || '-->' || printf('%.3f', v) || '<!--/r-->.' AS text FROM nation JOIN (SELECT c_nationkey, avg(c_acctbal) AS v FROM customer GROUP BY 1) ON c_nationkey = n_nationkey",
    "model_card": "WITH c AS (SELECT c_mktsegment, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_mktsegment, '# Card of ' || c_mktsegment || chr(10) || '- rows ' || CAST(sum(n) AS BIGINT) || chr(10) || string_agg('| ' || lpad(CAST(k AS VARCHAR), 2, '0') || ' | ' || n || ' |', chr(10) ORDER BY k) FILTER (WHERE k < 10) AS card FROM c GROUP BY 1",
    "ema_curriculum": f"WITH RECURSIVE {_EV}, k AS (SELECT event_type, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM s WHERE event_type <> 'error'), r AS (SELECT event_type, i, v AS e FROM k WHERE i = 1 UNION ALL SELECT k.event_type, k.i, 0.7e0 * e + 0.3e0 * v FROM r JOIN k ON k.event_type = r.event_type AND k.i = r.i + 1), l AS (SELECT t.event_type, coalesce(arg_max(e, i), (SELECT max(e) FROM (SELECT arg_max(e, i) AS e FROM r GROUP BY event_type))) AS l FROM (SELECT DISTINCT event_type FROM events) t LEFT JOIN r USING (event_type) GROUP BY 1), z AS (SELECT event_type, exp((l - avg(l) OVER ()) / (stddev_pop(l) OVER () + 1e-6)) AS e FROM l) SELECT event_type, round(e / sum(e) OVER (), 7) AS weight FROM z",
    "early_stop_epoch": f"WITH {_EV}, b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM s), c AS (SELECT *, max(CASE WHEN pm IS NULL OR value > pm THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS le FROM b), d AS (SELECT *, min(CASE WHEN epoch - le >= 5 THEN epoch END) OVER (PARTITION BY user_id) AS st FROM c) SELECT user_id, st AS stop_epoch, arg_max(epoch, value) AS best_epoch, round(max(value), 6) AS best FROM (SELECT * FROM d WHERE st IS NULL OR epoch <= st ORDER BY user_id, epoch) GROUP BY 1, 2",
    "masked_recon_loss": f"WITH {_L} SELECT CAST(category AS BIGINT) AS category, round(sum((r - x) ** 2) FILTER (WHERE valid) / (count(*) FILTER (WHERE valid) + 1e-8), 9) AS loss FROM p GROUP BY 1",
    "kl_loss": f"WITH {_L} SELECT round(-0.5 * avg(1 + r - x * x - exp(r)), 9) AS kl FROM p",
    "weighted_bce": f"WITH {_L} SELECT round(sum(CASE WHEN valid THEN greatest(x, 0) - x * CAST(mask AS INT) + ln(1 + exp(-abs(x))) ELSE 0 END) / count(*), 9) AS bce FROM p",
    "residual_map": f"WITH {_L} SELECT vec_id, round(sum(CASE WHEN valid THEN (r - x) ** 2 ELSE 0 END), 8) AS residual, round(sum(CASE WHEN valid THEN 1 / (1 + exp(-x)) ELSE 0 END), 7) AS sigmoid FROM p GROUP BY 1",
    "inpaint_tiles": f"WITH {_L}, t AS (SELECT *, CAST(pix // 32 * 2 + pix % 8 // 4 AS INT) AS tile FROM p), m AS (SELECT a.vec_id, a.tile, avg(b.x) AS pred FROM (SELECT DISTINCT vec_id, tile FROM t) a JOIN t b ON a.vec_id = b.vec_id AND a.tile <> b.tile GROUP BY 1, 2) SELECT vec_id, tile, round(sum((x - pred) ** 2), 8) AS error FROM t JOIN m USING (vec_id, tile) GROUP BY 1, 2",
    "adabn_stats": "SELECT l_returnflag, round(avg(m), 7) AS mean, round(avg(v), 6) AS var FROM (SELECT l_orderkey % 16 AS b, l_returnflag, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "epoch_means": "SELECT CAST(year(o_orderdate) AS INT) AS epoch, round(avg(o_totalprice), 4) AS loss, count(*) AS n FROM orders GROUP BY 1",
    "eta_progress": f"WITH {_EV}, h AS (SELECT user_id, event_id, epoch + 1 AS done, count(*) OVER (PARTITION BY user_id) AS total, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS hours FROM s) SELECT user_id, event_id, done, round(hours / done * (total - done), 4) AS left_hours FROM h",
    "int8_quantise": "WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id, min(x) AS lo, (max(x) - min(x)) / 255 AS st FROM e GROUP BY 1) SELECT vec_id, CAST(min(c) AS INT) AS min_code, CAST(max(c) AS INT) AS max_code, round(max(abs((c + 128) * st + lo - x)), 6) AS worst FROM (SELECT vec_id, x, lo, st, CAST(round_even((x - lo) / st, 0) AS INT) - 128 AS c FROM e JOIN m USING (vec_id)) GROUP BY 1",
    "sessions_stream_batch": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
