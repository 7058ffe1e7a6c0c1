"""Streams over several batches: state is read back, a stop and a crash do no harm."""

import time

import pytest
from pyspark.sql import functions as F
from support import SF

from millrace import tables
from millrace.storage import fresh_path
from millrace.streaming import events, stateful


def test_a_stream_has_several_batches_out_of_order(spark, monkeypatch):
    monkeypatch.setattr(events, "DISORDER_MINUTES", 600)
    path = fresh_path(spark, "disorder")
    events.write_feed(spark, SF, path)
    e = events.read_feed(spark, SF, path)
    drain = events.Drain(spark, "update")
    rows = drain.run(e.select("event_id", "ts"))
    assert drain.batches >= events.PARTS
    assert rows.count() == tables.table(spark, SF, "events").count()
    by = rows.groupBy("batch").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("batch").collect()
    assert len(by) == events.PARTS
    behind = [(x["b"] - y["a"]).total_seconds() / 60 for x, y in zip(by, by[1:])]
    assert max(behind) > 0 and max(behind) <= events.DISORDER_MINUTES


def test_state_is_read_back(spark):
    """Counts of users who come in several batches."""
    e = events.event_stream(spark, SF).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    drain = events.Drain(spark, "update")
    told = drain.run(e)
    again = told.groupBy("user_id").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"))
    assert again.where("times > 2").count() > 0
    exact = {r["user_id"]: r["count"] for r in tables.table(spark, SF, "events").groupBy("user_id").count().collect()}
    assert {r["user_id"]: r["n"] for r in again.collect()} == exact


def test_a_crash_in_a_batch_is_made_good(spark):
    """The third batch fails after it has written; the stream goes on from its checkpoint to the same ranks."""

    class Crashing(events.Drain):
        broken = False

        def _write(self, batch, number):
            super()._write(batch, number)
            if number == 2 and not self.broken:
                Crashing.broken = True
                raise RuntimeError("crash")

    drain = Crashing(spark, "update")
    with stateful.rocksdb(spark):
        ranks = stateful.changing_ranks(events.event_stream(spark, SF), 3, "event_type", "value", "event_id")
        with pytest.raises(Exception, match="crash"):
            drain.run(ranks)
        told = drain.run(stateful.changing_ranks(events.event_stream(spark, SF), 3, "event_type", "value", "event_id"))
    last = told.groupBy("event_type", "rank").agg(F.max_by(F.struct("event_id", "value"), "batch").alias("r")).select("event_type", "rank", "r.event_id", "r.value")
    from pyspark.sql import Window

    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    exact = tables.table(spark, SF, "events").withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3").select("event_type", "rank", "event_id", "value")
    assert sorted(last.collect()) == sorted(exact.collect())


def test_alarms_do_not_depend_on_stops(spark):
    """One run over five parts, and two runs on one checkpoint."""
    found = []
    for cuts in ([range(5)], [range(2), range(2, 5)]):
        path, drain = fresh_path(spark, "stops"), events.Drain(spark, "append")
        with stateful.rocksdb(spark):
            for parts in cuts:
                events.write_feed(spark, SF, path, parts)
                rows = drain.run(stateful.silences(events.read_feed(spark, SF, path).withWatermark("ts", "1 hour"), "user_id", "ts", 600))
        found.append(sorted(map(tuple, rows.collect())))
    assert found[0] == found[1] and found[0]


def test_state_expires(spark):
    """After its time to live a pair is new again."""
    path, drain = fresh_path(spark, "ttl"), events.Drain(spark, "append")
    schema = "user_id long, event_type string"

    def run(number):
        spark.createDataFrame([(1, "view"), (1, "view"), (2, "view")], schema).coalesce(1).write.parquet(f"{path}/part={number}")
        read = spark.readStream.schema(schema).parquet(f"{path}/part=*")
        with stateful.rocksdb(spark, clock=True):
            return drain.run(stateful.first_seen(read, ["user_id", "event_type"], 20)).count()

    assert [run(0), run(1)] == [2, 2]
    time.sleep(21)
    assert run(2) == 4


@pytest.mark.parametrize("name", ["st_sort", "st_timers", "st_ttl", "st_state", "st_transform_state"])
def test_keys_share_a_shard(name, same_as_sql, monkeypatch):
    """All keys in two groups, which calls and state values are for."""
    from millrace import registry

    monkeypatch.setattr(events, "SHARDS", 2)
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])
