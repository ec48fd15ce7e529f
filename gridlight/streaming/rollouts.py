"""Rollouts on live logs: episodes truncated, stopped and marked successful while their steps arrive, in order of event time.

The batch counterpart is ``control.truncate`` over steps numbered by (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state store: state on disk, so that it may be larger than an executor's memory.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STEP = ["ts", "event_id", "reward", "success", "done"]
#: A waiting step: user, time, id, reward and whether it is null, marks.
STEP = np.dtype([("user_id", "<i8"), ("ts", "<i8"), ("event_id", "<i8"), ("reward", "<f8"), ("unpaid", "?"), ("success", "?"), ("done", "?")])
#: What an episode has come to.
EPISODE = np.dtype([("user_id", "<i8"), ("n", "<i4"), ("success", "?"), ("ret", "<f8"), ("ended", "?")])
STATE = "episodes binary, waiting binary"
#: Users are dealt into so many groups, each with one row of state; a running stream's checkpoint has this number.
GROUPS = 2048


def _packed(f: pd.DataFrame) -> np.ndarray:
    """Steps as an array of STEP; times in microseconds."""
    rows = np.empty(len(f), STEP)
    rows["user_id"], rows["ts"] = f["user_id"].to_numpy(np.int64), f["ts"].to_numpy("datetime64[us]").astype(np.int64)
    rows["event_id"] = f["event_id"].fillna(0).to_numpy(np.int64)
    rows["reward"], rows["unpaid"] = f["reward"].fillna(0.0).to_numpy(float), f["reward"].isna()
    rows["success"], rows["done"] = (f[c].eq(True).fillna(False).to_numpy(bool) for c in ("success", "done"))
    return rows


def _starts(users: np.ndarray) -> np.ndarray:
    """Where each of some sorted users begins."""
    return np.flatnonzero(np.append(True, users[1:] != users[:-1])) if len(users) else np.zeros(0, int)


def _first(rows: np.ndarray, episodes: np.ndarray, most: int) -> np.ndarray:
    """Of each user's steps by (ts, event_id) those that make up ``most`` with the episode's, none after the first done or of an ended episode: no others can count, whatever arrives later."""
    rows = rows[np.lexsort((rows["event_id"], rows["ts"], rows["user_id"]))]
    starts = _starts(rows["user_id"])
    sizes = np.diff(np.append(starts, len(rows)))
    begin = np.repeat(starts, sizes)
    dones = np.cumsum(rows["done"]) - rows["done"]  # before each row
    at = np.searchsorted(episodes["user_id"], rows["user_id"])
    held = np.append(episodes, np.zeros(1, EPISODE))[at]
    known = (at < len(episodes)) & (held["user_id"] == rows["user_id"])
    n = np.where(known, held["n"], 0) + np.arange(len(rows)) - begin
    return rows[(n < most) & (dones == dones[begin]) & ~(known & held["ended"])] if len(rows) else rows


def _folded(max_steps: int):
    """What happens to a group of episodes (its state) as steps arrive or the watermark passes the earliest that waits."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packed = state.get if state.exists else (b"", b"")
        episodes, waiting = np.frombuffer(packed[0], EPISODE), np.frombuffer(packed[1], STEP)
        past = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            waiting = _first(np.concatenate([waiting, *map(_packed, frames)]), episodes, max_steps)
        ready = waiting["ts"] // 1000 < past  # the first ones of each user
        out, waiting = waiting[ready], waiting[~ready]
        if len(out):
            held = {e[0]: e[1:] for e in episodes.tolist()}
            starts = _starts(out["user_id"])
            ts, good, paid = np.empty(len(out), np.int32), np.empty(len(out), bool), np.empty(len(out))
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(out)).tolist()):
                user = int(out["user_id"][a])
                n, success, ret, _ = held.get(user, (0, False, 0.0, False))
                ts[a:b] = n + np.arange(b - a)
                good[a:b] = np.logical_or.accumulate(out["success"][a:b]) | success
                paid[a:b] = np.cumsum(np.append(ret, out["reward"][a:b]))[1:]
                n += b - a
                held[user] = n, good[b - 1], paid[b - 1], out["done"][b - 1] or n >= max_steps
            episodes = np.array([(u, *held[u]) for u in sorted(held)], EPISODE)
            yield pd.DataFrame({"user_id": out["user_id"], "t": ts, "reward": np.where(out["unpaid"], np.nan, out["reward"]), "success": good, "done": out["done"], "ret": paid})
        state.update((episodes.tobytes(), waiting.tobytes()))  # nothing waits behind an end
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting["ts"].min()) // 1000, past))  # fires once the watermark is beyond it

    return run


def rollouts(steps: DataFrame, max_steps: int, late: str = "10 minutes") -> DataFrame:
    """(user_id, t, reward, success, done, ret) of a stream (user_id, ts, event_id, reward, success, done), appended as the watermark passes each step.

    An episode ends with its first done step, or with ``max_steps``; later steps are dropped as they arrive. ``success`` stays true
    once it is and ``ret`` is the return so far. Steps may arrive in any order within ``late``; later ones are dropped, as any watermark does.
    Rows without a user or time are left out, null marks count as false and null rewards as zero in the return.
    State is what each episode came to, and of its waiting steps those that can still count, ``max_steps`` at most; users share
    ``GROUPS`` rows of it, so that a call serves many. The session needs the state store that ``prepare`` names.
    """
    plain = steps.where("user_id is not null and ts is not null").select(F.col("user_id").cast("long").alias("user_id"), *_STEP).withWatermark("ts", late)
    made = "user_id long, t int, reward double, success boolean, done boolean, ret double"
    plain = plain.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)))
    return plain.groupBy("part").applyInPandasWithState(_folded(max_steps), made, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def prepare(spark: SparkSession) -> None:
    """Names the state store in the session; streams that run already keep theirs."""
    spark.conf.set(*STORE)


def drain(df: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that the stream's source has now to the Parquet table ``path``, and returns; called again with the same ``checkpoint`` it goes on from there."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
