"""Stateful processors: rankings that change, rows put in order, alarms by timers, state that expires.

Each keeps its state in the state store, reads it back in every batch, and goes on from a checkpoint after a stop. Where keys may be
many, they are dealt to shards by hash: a shard's keys share one value of state, one timer and the calls of a batch, which cost
milliseconds each, so what a batch costs grows with its rows and not with its keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..registry import query
from ..storage import fresh_path
from .events import Drain, event_stream, packed, read_feed, shard, unpacked, write_feed

_PROVIDER, _IDLE = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def rocksdb(spark: SparkSession, clock: bool = False) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, as processors of one's own want. clock: processors go by the clock, for
    which Spark would run batches without rows for ever."""
    wanted = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"} | ({_IDLE: "false"} if clock else {})
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def changing_ranks(rows: DataFrame, k: int, key: str, value: str, row_id: str) -> DataFrame:
    """key, rank, row_id, value of each place of a key's first k that a batch changes, in update mode: the greatest values, ties to
    the smaller id. State: k rows a key. key and row_id are whole numbers or strings, value is a double."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, row_id)}

    class Best(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.best = handle.getListState("best", f"value double, id {kinds[row_id]}")

        def handleInputRows(self, keys, batches, timerValues) -> Iterator[pd.DataFrame]:
            old = [tuple(r) for r in self.best.get()] if self.best.exists() else []
            new = list(old)
            for b in batches:
                b = b[[value, row_id]].dropna(subset=[value]).sort_values([value, row_id], ascending=[False, True]).head(k)
                new += list(b.itertuples(index=False, name=None))
            new = sorted(set(new), key=lambda r: (-r[0], r[1]))[:k]
            changed = [(keys[0], i + 1, r[1], r[0]) for i, r in enumerate(new) if i >= len(old) or old[i] != r]
            if changed:
                self.best.put(new)
                yield pd.DataFrame(changed, columns=[key, "rank", row_id, value])

        def close(self) -> None:
            pass

    schema = f"{key} {kinds[key]}, rank long, {row_id} {kinds[row_id]}, {value} double"
    return rows.select(key, value, row_id).groupBy(key).transformWithStateInPandas(Best(), schema, "update", "none")


def in_order(rows: DataFrame, key: str, time: str, row_id: str) -> DataFrame:
    """key, row_id, place: each key's rows in order of time (then id), numbered from 1, as soon as the watermark has passed them.

    rows has a watermark on time. Rows wait in their shard's table; the first one's time sets a timer.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, row_id)}

    class Sorter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.timer = Timer(handle)
            self.waiting, self.places = (handle.getValueState(c, "rows binary") for c in ("waiting", "places"))

        def handleInputRows(self, keys, batches, timerValues) -> Iterator[pd.DataFrame]:
            new = [b[["key", "at", "id"]] for b in batches]
            waiting = pd.concat([unpacked(self.waiting.get()[0]), *new] if self.waiting.exists() else new)
            self.waiting.update((packed(waiting),))
            self.timer.set(int(waiting["at"].min()))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            until = self.timer.gone(timerValues, expiredTimerInfo)
            if not self.waiting.exists():
                return
            waiting = unpacked(self.waiting.get()[0])
            due, rest = waiting[waiting["at"] < until].sort_values(["at", "id"], kind="stable"), waiting[waiting["at"] >= until]
            if len(rest):
                self.waiting.update((packed(rest),))
                self.timer.set(int(rest["at"].min()))
            else:
                self.waiting.clear()
            if len(due):
                told = unpacked(self.places.get()[0]) if self.places.exists() else pd.DataFrame({"key": due["key"][:0], "n": []})
                before = due[["key"]].merge(told, "left", "key")["n"].fillna(0).to_numpy().astype("int64")
                place = due.groupby("key", dropna=False).cumcount().to_numpy() + 1 + before
                out = pd.DataFrame({"key": due["key"].to_numpy(), "id": due["id"].to_numpy(), "place": place})
                last = out.groupby("key", dropna=False)["place"].max().rename("n").reset_index()
                self.places.update((packed(pd.concat([told, last]).groupby("key", dropna=False)["n"].max().astype("int64").reset_index()),))
                yield out

        def close(self) -> None:
            pass

    timed = rows.select(shard(key).alias("shard"), F.col(key).cast("string").alias("key"), time, F.unix_micros(time).alias("at"), F.col(row_id).alias("id"))
    out = timed.groupBy("shard").transformWithStateInPandas(Sorter(), f"key string, id {kinds[row_id]}, place long", "append", "eventTime")
    return out.select(F.col("key").cast(kinds[key]).alias(key), F.col("id").alias(row_id), "place")


class Timer:
    """The one timer of a shard, for the first of the times (in microseconds) that it waits for."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def set(self, at: int) -> None:
        wanted, there = at // 1000 + 1, list(self.handle.listTimers())
        for t in there:
            if t != wanted:
                self.handle.deleteTimer(t)
        if wanted not in there:
            self.handle.registerTimer(wanted)

    def gone(self, timerValues, expiredTimerInfo) -> int:
        """Until when times are over, by the watermark."""
        return max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000


def silences(rows: DataFrame, key: str, time: str, minutes: int) -> DataFrame:
    """key, since: an alarm for each time of a key after which it has no other row for so many minutes, once the watermark says so.

    rows has a watermark on time. A shard's table holds the times that may still be followed; a timer stands for the first of them.
    """
    kind, gap = rows.schema[key].dataType.simpleString(), minutes * 60_000_000

    class Alarm(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.timer = Timer(handle)
            self.times = handle.getValueState("times", "rows binary")

        def handleInputRows(self, keys, batches, timerValues) -> Iterator[pd.DataFrame]:
            new = [b[["key", "at"]] for b in batches]
            times = pd.concat([unpacked(self.times.get()[0]), *new] if self.times.exists() else new).drop_duplicates()
            self.times.update((packed(times),))
            self.timer.set(int(times["at"].min()) + gap)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            until = self.timer.gone(timerValues, expiredTimerInfo)
            if not self.times.exists():
                return
            times = unpacked(self.times.get()[0]).sort_values("at", kind="stable")
            over = times["at"] + gap < until
            after = times.groupby("key", dropna=False)["at"].shift(-1, fill_value=2**63 - 1)
            alarms, rest = times[over & (after > times["at"] + gap)], times[~over]
            if len(rest):
                self.times.update((packed(rest),))
                self.timer.set(int(rest["at"].min()) + gap)
            else:
                self.times.clear()
            if len(alarms):
                yield pd.DataFrame({"key": alarms["key"].to_numpy(), "since": alarms["at"].to_numpy()})

        def close(self) -> None:
            pass

    timed = rows.select(shard(key).alias("shard"), F.col(key).cast("string").alias("key"), time, F.unix_micros(time).alias("at"))
    out = timed.groupBy("shard").transformWithStateInPandas(Alarm(), "key string, since long", "append", "eventTime")
    return out.select(F.col("key").cast(kind).alias(key), F.timestamp_micros("since").alias("since"))


def first_seen(rows: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """The keys of rows that haven't been seen for so many seconds of the clock: state goes by itself after that time (TTL).

    A shard has a map with an entry for each key, and each entry a time to live of its own.
    """
    text = [F.col(c).cast("string").alias(f"key_{i}") for i, c in enumerate(keys)]
    kinds, names = [rows.schema[c].dataType.simpleString() for c in keys], [f"key_{i}" for i in range(len(keys))]
    schema = ", ".join(f"{c} string" for c in names)

    class Seen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getMapState("seen", schema, "n long", ttlDurationMs=seconds * 1000)

        def handleInputRows(self, key, batches, timerValues) -> Iterator[pd.DataFrame]:
            asked = dict.fromkeys(k for b in batches for k in b[names].drop_duplicates().itertuples(index=False, name=None))
            known = {tuple(k) for k in self.seen.keys()} if self.seen.exists() else set()
            new = [k for k in asked if k not in known]
            for k in new:
                self.seen.updateValue(k, (1,))
            if new:
                yield pd.DataFrame(new, columns=names)

        def close(self) -> None:
            pass

    out = rows.select(shard(*keys).alias("shard"), *text).groupBy("shard").transformWithStateInPandas(Seen(), schema, "append", "processingTime")
    return out.select(*[F.col(n).cast(k).alias(c) for n, k, c in zip(names, kinds, keys)])


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank, event_id, value FROM events QUALIFY rank <= 3")
def st_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three greatest values of each type, from the changes that the batches have told."""
    with rocksdb(spark):
        told = Drain(spark, "update").run(changing_ranks(event_stream(spark, sf_dir), 3, "event_type", "value", "event_id"))
    last = told.groupBy("event_type", "rank").agg(F.max_by(F.struct("event_id", "value"), "batch").alias("r"))
    return last.select("event_type", "rank", "r.event_id", "r.value")


@query(f"SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events) WHERE ts < {_CLOSED}")
def st_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order of time, of those that the watermark has passed, though they come out of order."""
    with rocksdb(spark):
        return Drain(spark, "append").run(in_order(event_stream(spark, sf_dir).withWatermark("ts", "1 hour"), "user_id", "ts", "event_id"))


@query(f"SELECT user_id, ts AS since FROM (SELECT DISTINCT user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 1 DAY FOLLOWING) AS next FROM events) WHERE next = ts AND ts + INTERVAL 1 DAY < {_CLOSED}")
def st_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without an event for a day. The stream ends after three parts and goes on from its checkpoint when two more come."""
    path, drain = fresh_path(spark, "stream-timers"), Drain(spark, "append")
    with rocksdb(spark):
        for parts in (range(3), range(3, 5)):
            write_feed(spark, sf_dir, path, parts)
            found = drain.run(silences(read_feed(spark, sf_dir, path).withWatermark("ts", "1 hour"), "user_id", "ts", 24 * 60))
    return found.select("user_id", F.col("since").cast("timestamp_ntz").alias("since"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def st_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs when they are first seen, or again after an hour of the clock."""
    with rocksdb(spark, clock=True):
        return Drain(spark, "append").run(first_seen(event_stream(spark, sf_dir), ["user_id", "event_type"], 3600))
