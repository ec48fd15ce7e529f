"""Control queries: users' events as episodes, and simulated point masses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlight.operators import control
from gridlight.sources.tables import table


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes: a user's events in order; reward is the value, a purchase succeeds, an error ends."""
    e = table(spark, sf_dir, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", t.cast("long").alias("t"), F.col("value").alias("reward"), (F.col("event_type") == "purchase").alias("success"), (F.col("event_type") == "error").alias("done"), F.when(F.col("user_id") % 2 == 0, "sim").otherwise("real").alias("arm"), F.expr("user_id div 2").alias("seed"))


def rollout_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.truncate(steps(spark, sf_dir), ["user_id"], 20).select("user_id", "t", "success", "done")


def success_rate_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = control.episodes(control.truncate(steps(spark, sf_dir), ["user_id"], 20), ["arm", "user_id"])
    return control.summary(e, ["arm"]).select("arm", *(F.round(c, 6).alias(c) for c in ("success_rate", "mean_return", "steps_to_goal")))


def steps_to_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.episodes(steps(spark, sf_dir), ["user_id"]).select("user_id", "n_steps", "first_done", F.round("ret", 6).alias("ret"))


def policy_gap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success of the simulated minus the real arm over matched seeds, as a fraction."""
    e = control.episodes(control.truncate(steps(spark, sf_dir), ["user_id"], 20), ["arm", "seed", "user_id"])
    a, b = (e.where(F.col("arm") == x).select("seed", F.col("success").cast("double").alias(x)) for x in ("sim", "real"))
    return a.join(b, "seed").agg(F.count("*").alias("n"), F.round(F.avg(F.col("sim") - F.col("real")), 6).alias("gap"))


def conditions(spark: SparkSession, payloads: list[float], seeds: int, episodes: int) -> DataFrame:
    """Payload x seed x episode, the goal on a circle by the episode's seed alone."""
    p = spark.createDataFrame([(x,) for x in payloads], "payload double")
    i = spark.range(seeds * episodes).select((F.col("id") % seeds).alias("seed"), F.expr(f"id div {seeds}").alias("episode"))
    angle = (F.col("seed") * 31 + F.col("episode") * 17) % 360 * F.lit(0.017453292519943295)
    grid = i.crossJoin(F.broadcast(p)).withColumns({"gx": 0.5 * F.cos(angle), "gy": 0.5 * F.sin(angle)})
    return grid.withColumns({"mass": 1.0 + F.col("payload"), "gain": F.lit(1.0), "drag": F.lit(0.1)})


def pointmass_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = control.simulate(conditions(spark, [0.0, 0.5, 1.0], 3, 20), 40, 0.05, 1.0, 0.05)
    return done.select("payload", "seed", "episode", F.col("end.n").alias("n"), F.col("end.ok").alias("ok"), F.round("end.x", 8).alias("x"), F.round("end.y", 8).alias("y"), F.round("end.ret", 8).alias("ret"))


def gap_sweep_multiseed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success gap to the nominal payload in percentage points: mean and deviation over seeds."""
    done = control.simulate(conditions(spark, [0.0, 0.5, 1.0, 2.0], 3, 20), 40, 0.05, 1.0, 0.05)
    rate = done.groupBy("payload", "seed").agg(F.avg(F.col("end.ok").cast("double")).alias("s"))
    base = rate.where("payload = 0").select("seed", F.col("s").alias("b"))
    gap = rate.join(base, "seed").withColumn("gap", 100 * (F.col("b") - F.col("s")))
    return gap.groupBy("payload").agg(F.round(F.avg("gap"), 6).alias("gap_pp"), F.round(F.coalesce(F.stddev_samp("gap"), F.lit(0.0)), 6).alias("std_pp"))


def action_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = control.chunks(steps(spark, sf_dir), ["user_id"], "reward", 4)
    return c.select("user_id", "t", F.array_join(F.transform("chunk", lambda x: F.format_string("%.3f", x)), ",").alias("chunk"))


def proprio_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).select("user_id", "t", F.col("reward").alias("vel"), (F.col("reward") / 100).alias("action"))
    p = control.proprioception(s, ["user_id"])
    gain = control.estimated_gain(F.col("dv"), F.col("last_action"), 50.0)
    return p.select("user_id", "t", F.round("last_action", 8).alias("last_action"), F.round("dv", 8).alias("dv"), F.round(gain, 8).alias("gain"))


def bc_linear_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour cloning of a linear expert by least squares: slope and intercept from one aggregate."""
    o = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (4.0 * F.col("l_quantity") - 2.0 + F.col("l_tax")).alias("y"))
    return o.agg(F.round(F.regr_slope("y", "x"), 8).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


def schedule(spark: SparkSession) -> DataFrame:
    """The linear noise schedule of 50 steps."""
    t = spark.range(50).select(F.col("id").alias("t"), (F.lit(1e-4) + F.col("id") * ((0.02 - 1e-4) / 49)).alias("beta"))
    # alpha_bar by a fold over the schedule's own, fixed number of steps
    bar = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("t")), F.lit(1.0), lambda a, i: a * (1 - (F.lit(1e-4) + i * ((0.02 - 1e-4) / 49))))
    return t.withColumns({"alpha": 1 - F.col("beta"), "alpha_bar": bar})


def ddpm_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(spark).select("t", *(F.round(c, 10).alias(c) for c in ("beta", "alpha", "alpha_bar")))


def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noised values and the posterior mean that leads back, for each line item at step orderkey % 50."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("x0"), F.col("l_tax").alias("eps"), (F.col("l_orderkey") % 50).alias("t"))
    s = x.join(F.broadcast(schedule(spark)), "t")
    q = s.withColumn("q", F.sqrt("alpha_bar") * F.col("x0") + F.sqrt(1 - F.col("alpha_bar")) * F.col("eps"))
    mean = (F.col("q") - F.col("beta") / F.sqrt(1 - F.col("alpha_bar")) * F.col("eps")) / F.sqrt("alpha")
    return q.select("l_orderkey", "l_linenumber", F.round("q", 8).alias("q"), F.round(mean, 8).alias("posterior_mean"))


def expert_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped PD commands: clip(4 (goal - position) - 2 velocity)."""
    o = table(spark, sf_dir, "lineitem")
    a = F.least(F.greatest(4.0 * (F.lit(0.05) - F.col("l_discount")) - 2.0 * F.col("l_tax"), F.lit(-0.15)), F.lit(0.15))
    return o.groupBy("l_returnflag").agg(F.round(F.avg(a), 8).alias("mean_action"), F.sum((F.abs(a) >= 0.15).cast("long")).alias("clipped"))


_STEPS = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS reward, event_type = 'purchase' AS success, event_type = 'error' AS done, CASE WHEN user_id % 2 = 0 THEN 'sim' ELSE 'real' END AS arm, user_id // 2 AS seed FROM events)"
_CUT = f"{_STEPS}, c AS (SELECT s.*, bool_or(success) OVER (PARTITION BY user_id ORDER BY t) AS sticky FROM s WHERE t <= coalesce((SELECT min(t) FROM s d WHERE d.user_id = s.user_id AND d.done), 1000000) AND t < 20), ep AS (SELECT arm, seed, user_id, bool_or(success) AS ok, sum(reward) AS ret, min(t) FILTER (WHERE done) + 1 AS fd FROM c GROUP BY 1, 2, 3)"


def _sim(payloads: str) -> str:
    far = "sqrt((gx - (x + 0.05e0 * nvx)) ** 2 + (gy - (y + 0.05e0 * nvy)) ** 2)"
    return f"""k AS (SELECT payload, i % 3 AS seed, i // 3 AS episode, 0.5e0 * cos((i % 3 * 31 + i // 3 * 17) % 360 * 0.017453292519943295e0) AS gx, 0.5e0 * sin((i % 3 * 31 + i // 3 * 17) % 360 * 0.017453292519943295e0) AS gy FROM range(0, 60) t(i), (SELECT unnest([{payloads}]) AS payload)),
r AS (SELECT payload, seed, episode, gx, gy, 0e0 AS x, 0e0 AS y, 0e0 AS vx, 0e0 AS vy, 0e0 AS ret, false AS ok, 0 AS n FROM k
UNION ALL SELECT payload, seed, episode, gx, gy, x + 0.05e0 * nvx, y + 0.05e0 * nvy, nvx, nvy, ret - {far} * 0.05e0, {far} < 0.05e0, n + 1
FROM (SELECT *, vx + 0.05e0 * (least(greatest(4e0 * (gx - x) - 2e0 * vx, -1e0), 1e0) - 0.1e0 * vx) / (1 + payload) AS nvx, vy + 0.05e0 * (least(greatest(4e0 * (gy - y) - 2e0 * vy, -1e0), 1e0) - 0.1e0 * vy) / (1 + payload) AS nvy FROM r WHERE NOT ok AND n < 40)),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payload, seed, episode ORDER BY n DESC) AS q FROM r) WHERE q = 1)"""


_SCHEDULE = "b AS (SELECT t, 1e-4 + t * ((0.02e0 - 1e-4) / 49) AS beta FROM range(0, 50) x(t)), sc AS (SELECT t, beta, 1 - beta AS alpha, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_bar FROM b)"

QUERIES = {f.__name__: f for f in (rollout_truncate, success_rate_return, steps_to_goal, policy_gap_paired, pointmass_rollout, gap_sweep_multiseed, action_chunks, proprio_lag, bc_linear_policy, ddpm_schedule, q_sample, expert_action)}
ORACLES = {
    "rollout_truncate": f"WITH {_CUT} SELECT user_id, t, sticky AS success, done FROM c",
    "success_rate_return": f"WITH {_CUT} SELECT arm, round(avg(CAST(ok AS INT)), 6) AS success_rate, round(avg(ret), 6) AS mean_return, round(avg(fd), 6) AS steps_to_goal FROM ep GROUP BY 1",
    "steps_to_goal": f"WITH {_STEPS} SELECT user_id, count(*) AS n_steps, min(t) FILTER (WHERE done) + 1 AS first_done, round(sum(reward), 6) AS ret FROM s GROUP BY 1",
    "policy_gap_paired": f"WITH {_CUT} SELECT count(*) AS n, round(avg(CAST(a.ok AS INT) - CAST(b.ok AS INT)), 6) AS gap FROM ep a JOIN ep b USING (seed) WHERE a.arm = 'sim' AND b.arm = 'real'",
    "pointmass_rollout": f"WITH RECURSIVE {_sim('0e0, 0.5e0, 1e0')} SELECT payload, seed, episode, n, ok, round(x, 8) AS x, round(y, 8) AS y, round(ret, 8) AS ret FROM z",
    "gap_sweep_multiseed": f"WITH RECURSIVE {_sim('0e0, 0.5e0, 1e0, 2e0')}, s AS (SELECT payload, seed, avg(CAST(ok AS INT)) AS s FROM z GROUP BY 1, 2), g AS (SELECT s.payload, 100 * (b.s - s.s) AS gap FROM s JOIN s b ON b.seed = s.seed AND b.payload = 0) SELECT payload, round(avg(gap), 6) AS gap_pp, round(coalesce(stddev_samp(gap), 0), 6) AS std_pp FROM g GROUP BY 1",
    "action_chunks": f"WITH {_STEPS}, l AS (SELECT user_id, t, [reward, coalesce(lead(reward, 1) OVER w, last_value(reward) OVER f), coalesce(lead(reward, 2) OVER w, last_value(reward) OVER f), coalesce(lead(reward, 3) OVER w, last_value(reward) OVER f)] AS c FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT user_id, t, array_to_string(list_transform(c, lambda x: printf('%.3f', x)), ',') AS chunk FROM l",
    "proprio_lag": f"WITH {_STEPS}, p AS (SELECT user_id, t, coalesce(lag(reward / 100) OVER w, 0) AS la, coalesce(reward - lag(reward) OVER w, 0) AS dv FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, t, round(la, 8) AS last_action, round(dv, 8) AS dv, round(CASE WHEN abs(la) < 1e-3 THEN 1e0 ELSE least(greatest(abs(dv) / (50 * abs(la)), 0.3), 1.5) END, 8) AS gain FROM p",
    "bc_linear_policy": "SELECT round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM (SELECT l_quantity AS x, 4 * l_quantity - 2 + l_tax AS y FROM lineitem)",
    "ddpm_schedule": f"WITH {_SCHEDULE} SELECT t, round(beta, 10) AS beta, round(alpha, 10) AS alpha, round(alpha_bar, 10) AS alpha_bar FROM sc",
    "q_sample": f"WITH {_SCHEDULE}, q AS (SELECT l_orderkey, l_linenumber, sqrt(alpha_bar) * l_discount + sqrt(1 - alpha_bar) * l_tax AS q, l_tax AS eps, beta, alpha, alpha_bar FROM lineitem JOIN sc ON t = l_orderkey % 50) SELECT l_orderkey, l_linenumber, round(q, 8) AS q, round((q - beta / sqrt(1 - alpha_bar) * eps) / sqrt(alpha), 8) AS posterior_mean FROM q",
    "expert_action": "WITH a AS (SELECT l_returnflag, least(greatest(4e0 * (0.05e0 - l_discount) - 2e0 * l_tax, -0.15e0), 0.15e0) AS a FROM lineitem) SELECT l_returnflag, round(avg(a), 8) AS mean_action, CAST(sum(CAST(abs(a) >= 0.15e0 AS INT)) AS BIGINT) AS clipped FROM a GROUP BY 1",
}
