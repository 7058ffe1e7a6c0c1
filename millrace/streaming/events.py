"""Streams over the table events. Each query runs a stream to the end of what is there and returns what it has written."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..registry import query
from ..storage import exists, fresh_path
from ..tables import table


#: Parts that events come in, files of each, and how far they may be out of order; watermarks wait for longer.
PARTS, FILES, DISORDER_MINUTES = 5, 1, 30
_feeds: dict[tuple[str, str], str] = {}


def write_feed(spark: SparkSession, sf_dir: str, path: str, parts: range = range(PARTS)) -> None:
    """Writes these parts of events, as files that a stream reads one part after the other: events as they might arrive, up to
    DISORDER_MINUTES late."""
    e = table(spark, sf_dir, "events")
    arrival = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")) + F.pmod(F.xxhash64("event_id"), F.lit(DISORDER_MINUTES * 60_000_000))
    low, high = e.agg(F.min(arrival), F.max(arrival)).first()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for part in parts:
        number = F.lit(0) if low is None else F.floor((arrival - low) * PARTS / (high - low + 1))
        e.where(number == part).repartition(FILES).write.mode("overwrite").parquet(f"{path}/part={part}")
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
        system = folder.getFileSystem(conf)
        for f in system.listStatus(folder):  # files are read in order of their times, which may be equal or in whole seconds
            system.setTimes(f.getPath(), 1_700_000_000_000 + part * 10_000, -1)


def event_feed(spark: SparkSession, sf_dir: str) -> str:
    """A folder with all parts of events, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _feeds or not exists(spark, _feeds[key]):
        path = fresh_path(spark, "event-feed")
        write_feed(spark, sf_dir, path)
        _feeds[key] = path
    return _feeds[key]


def read_feed(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """A feed as a stream, a part in each batch; its times are instants, as watermarks want."""
    schema = table(spark, sf_dir, "events").schema
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/part=*")
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of PARTS batches."""
    return read_feed(spark, sf_dir, event_feed(spark, sf_dir))


#: Groups that keys are dealt to where Python keeps their state: a call costs milliseconds, whatever it is given, so keys share calls.
SHARDS = 1_024


def shard(*keys: str) -> Column:
    """The group that a key's state is kept in; the same for a key for ever, as checkpoints hold it."""
    return F.pmod(F.xxhash64(*keys), F.lit(SHARDS))


def packed(rows: pd.DataFrame) -> bytes:
    """A small table as one value of state."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_pandas()


class Drain:
    """Runs a stream to the end of what is there. It may run again, on the same checkpoint, when more has come.

    Append goes to files that a stream's log makes whole; of complete the last batch stands, of update each batch has a folder
    of its own, which a batch that runs again replaces. batches: how many have run.
    """

    def __init__(self, spark: SparkSession, mode: str) -> None:
        self.spark, self.mode, self.batches = spark, mode, 0
        self.out, self.log = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-log")

    def run(self, df: DataFrame) -> DataFrame:
        writer = df.writeStream.outputMode(self.mode).option("checkpointLocation", self.log).trigger(availableNow=True)
        if self.mode == "append":
            stream = writer.format("parquet").start(self.out)
        else:
            stream = writer.foreachBatch(self._write).start()
        stream.awaitTermination()
        if stream.lastProgress:
            self.batches = stream.lastProgress["batchId"] + 1
        return self.spark.read.schema(df.schema).parquet(self.out) if self.mode == "append" else self.spark.read.parquet(self.out)

    def _write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(self.out if self.mode == "complete" else f"{self.out}/batch={number}")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """What a stream has written when it has come to its end."""
    return Drain(df.sparkSession, mode).run(df)


_HOUR = "date_trunc('hour', ts)"


@query(f"SELECT {_HOUR}::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drained(e.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "complete")


@query("SELECT (date_trunc('hour', ts) - to_minutes(15 * k) + to_minutes(15 * (date_part('minute', ts) // 15)::INT))::TIMESTAMP AS start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL")
def st_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return drained(e.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session")
def st_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return drained(e.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("SELECT start, n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed, in append mode."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return drained(e.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "append")


@query("SELECT DISTINCT user_id, event_type FROM events")
def st_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(event_stream(spark, sf_dir).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query("SELECT event_id, user_id * 2 AS twice FROM events WHERE event_type = 'purchase'")
def st_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).where("event_type = 'purchase'")
    return drained(e.select("event_id", (F.col("user_id") * 2).alias("twice")), "append")


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def st_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    e = event_stream(spark, sf_dir).join(c, F.col("user_id") == F.col("c_custkey"))
    return drained(e.select("event_id", "c_name"), "append")


@query("SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def st_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir)
    a = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("a"), F.col("ts").alias("a_ts")).withWatermark("a_ts", "1 hour")
    b = event_stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("b"), F.col("ts").alias("b_ts")).withWatermark("b_ts", "1 hour")
    return drained(a.join(b, F.expr("a = b AND b_ts BETWEEN a_ts AND a_ts + INTERVAL 1 HOUR")).select("view_id", "purchase_id"), "append")


def _views_and_purchases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = event_stream(spark, sf_dir)
    a = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("a"), F.col("ts").alias("a_ts")).withWatermark("a_ts", "1 hour")
    e = event_stream(spark, sf_dir)
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("b"), F.col("ts").alias("b_ts")).withWatermark("b_ts", "1 hour")
    return a, b


_WITHIN = "a = b AND b_ts BETWEEN a_ts AND a_ts + INTERVAL 1 HOUR"
_WITHIN_SQL = "a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR"


@query(f"SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON {_WITHIN_SQL} WHERE a.ts < (SELECT min(t) - INTERVAL 3 HOUR FROM (SELECT max(ts) AS t FROM events WHERE event_type IN ('view', 'purchase') GROUP BY event_type))")
def st_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with purchases within an hour, or none; of views that the watermark has closed (with two hours to spare), as one
    without a purchase comes once the watermark has passed it."""
    a, b = _views_and_purchases(spark, sf_dir)
    done = drained(a.join(b, F.expr(_WITHIN), "left").select("view_id", "a_ts", "purchase_id"), "append")
    last = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')").groupBy("event_type").agg(F.max(F.col("ts").cast("timestamp")).alias("t")).agg(F.min("t").alias("t"))
    return done.join(F.broadcast(last), F.expr("a_ts < t - INTERVAL 3 HOURS")).select("view_id", "purchase_id")


@query(f"SELECT a.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'view') a SEMI JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON {_WITHIN_SQL}")
def st_join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with a purchase within an hour, each once."""
    a, b = _views_and_purchases(spark, sf_dir)
    return drained(a.join(b, F.expr(_WITHIN), "left_semi").select("view_id"), "append")


@query("SELECT least(count(*), 100)::BIGINT AS n FROM events")
def st_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of a stream; which ones they are turns with the files."""
    return drained(event_stream(spark, sf_dir).select("event_id").limit(100), "append").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT start, n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out of order: the first half of the month comes last, when the watermark of two batches before has passed it, so it counts
    nowhere."""
    path, e = fresh_path(spark, "stream-late"), table(spark, sf_dir, "events")
    for number, part in enumerate(("day(ts) BETWEEN 15 AND 24", "day(ts) >= 25", "day(ts) < 15")):
        e.where(part).coalesce(1).write.parquet(f"{path}/part={number}")
        time.sleep(1.1)  # files are read in order of their times, which some stores keep in seconds
    read = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    counted = read.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return drained(counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "append")


@query("SELECT DISTINCT event_id FROM events")
def st_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedup whose state goes when the watermark has passed it."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark(["event_id"])
    return drained(e.select("event_id"), "append")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st_foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's counts are written under its number, so a batch that runs again replaces itself."""
    out, log = fresh_path(spark, "stream-batches"), fresh_path(spark, "stream-log")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    event_stream(spark, sf_dir).writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def st_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state of one's own for each user, kept with those of its shard; the last write of each user is its result."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat([f.groupby("user", dropna=False)["event_id"].agg(n="size", last="max").reset_index() for f in frames])
        old = unpacked(state.get[0]) if state.exists else new[:0]
        users = pd.concat([old, new]).groupby("user", dropna=False).agg(n=("n", "sum"), last=("last", "max")).reset_index()
        state.update((packed(users),))
        yield users[users["user"].isin(new["user"])]

    e = event_stream(spark, sf_dir).select(shard("user_id").alias("shard"), F.col("user_id").cast("string").alias("user"), "event_id")
    folded = e.groupBy("shard").applyInPandasWithState(fold, "user string, n long, last long", "users binary", "update", GroupStateTimeout.NoTimeout)
    written = drained(folded, "update")
    return written.groupBy(F.col("user").cast("long").alias("user_id")).agg(F.max("n").alias("n"), F.max("last").alias("last"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY event_type")
def st_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number of users, and whether the stream's estimate is within a tenth of it."""
    e = event_stream(spark, sf_dir).groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"))
    exact = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return drained(e, "complete").join(exact, "event_type").select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users")).alias("near"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def st_transform_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stateful processor with a value for each shard of users."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Count(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("users", "users binary")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new = pd.concat([r.groupby("user", dropna=False).size().rename("n").reset_index() for r in rows])
            old = unpacked(self.state.get()[0]) if self.state.exists() else new[:0]
            users = pd.concat([old, new]).groupby("user", dropna=False)["n"].sum().reset_index()
            self.state.update((packed(users),))
            yield users[users["user"].isin(new["user"])]

        def close(self) -> None:
            pass

    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        e = event_stream(spark, sf_dir).select(shard("user_id").alias("shard"), F.col("user_id").cast("string").alias("user"))
        counted = e.groupBy("shard").transformWithStateInPandas(Count(), "user string, n long", "update", "none")
        return drained(counted, "update").groupBy(F.col("user").cast("long").alias("user_id")).agg(F.max("n").alias("n"))
    finally:
        spark.conf.set(name, before)
