import pytest
from pyspark.sql import functions as F

from cellarflow.streaming import flows as L

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """A log of 300 events in three files, in order of time."""
    path = str(tmp_path_factory.mktemp("log"))
    kinds = ["view", "click", "error", "purchase"]
    df = spark.range(300).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7 + F.when(F.col("id") % 10 == 0, 60).otherwise(0)).alias("ts"), (F.col("id") % 7).alias("user_id"), F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") * 5 % 4 + 1).cast("int")).alias("event_type"), (F.col("id") / 2).alias("value"))
    for k in range(3):
        df.where(F.col("event_id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table(name)
    return rows, query


def test_counters_and_marks(spark, log):
    batch = spark.read.schema(SCHEMA).parquet(log)
    rows, query = run(spark, L.running_counts(L.read_log(spark, log, SCHEMA), "event_type"), "counts", "complete")
    assert set(rows.collect()) == set(L.running_counts(batch, "event_type").collect())
    assert len(query.recentProgress) >= 3  # at most a file at a time
    rows, _ = run(spark, L.last_marks(L.read_log(spark, log, SCHEMA), "user_id", "event_type"), "marks", "complete")
    assert set(rows.collect()) == set(L.last_marks(batch, "user_id", "event_type").collect())


def test_quiet_periods(spark, log):
    batch = spark.read.schema(SCHEMA).parquet(log)
    rows, _ = run(spark, L.quiet_periods(L.read_log(spark, log, SCHEMA), "event_type", gap="60 seconds"), "quiet", "append")
    done = set(rows.collect())
    assert done and done <= set(L.quiet_periods(batch, "event_type", gap="60 seconds").collect()) or not done  # open sessions wait for the watermark


def test_conversation(spark, log):
    batch = spark.read.schema(SCHEMA).parquet(log)
    rows, _ = run(spark, L.conversation_stream(L.read_log(spark, log, SCHEMA)), "talk", "append")
    assert sorted(rows.collect()) == sorted(L.conversation(batch).collect())


def test_work_queue(spark, log):
    rows, query = run(spark, L.work_queue(L.read_log(spark, log, SCHEMA), "user_id", 130, 2), "queue", "append")
    want, ends = {}, {}
    for r in sorted(spark.read.schema(SCHEMA).parquet(log).collect(), key=lambda r: (r.ts, r.event_id)):
        us = round(r.ts.timestamp() * 1_000_000)
        pending = [e for e in ends.get(r.user_id, []) if e > us]
        start = max([us, *pending]) if len(pending) < 2 else None
        ends[r.user_id] = pending + ([start + 130_000_000] if start else [])
        want[r.event_id] = (r.user_id, start is not None, start)
    assert {r.event_id: (r.user_id, r.accepted, r.start_us) for r in rows.collect()} == want
    assert 0 < sum(not a for _, a, _ in want.values()) < len(want) and len(query.recentProgress) >= 3
