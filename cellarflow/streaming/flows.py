"""Flows over an event log: each function takes a batch or a streaming DataFrame and means the same on both."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str, most_files: int = 1) -> DataFrame:
    """A stream of a folder of Parquet files; at most ``most_files`` of them wait in one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def running_counts(events: DataFrame, key: str) -> DataFrame:
    """(key, n, total): counters since the start; on a stream in update or complete mode."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def quiet_periods(events: DataFrame, key: str, time: str = "ts", gap: str = "15 seconds", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): while a gate is closed: from an event to ``gap`` after the last that came before it opened.

    Half open, as session windows are. On a stream, events up to ``late`` behind still count.
    """
    source = events.withWatermark(time, late) if events.isStreaming else events
    rows = source.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n) by tumbling window."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def last_marks(events: DataFrame, key: str, mark: str, order: str = "event_id") -> DataFrame:
    """(key, mark): the last mark of each key wins; on a stream in update mode."""
    return events.groupBy(key).agg(F.max_by(mark, order).alias(mark))


def log_statistics(events: DataFrame) -> DataFrame:
    """One row: events, users, days, users whose last mark is a purchase, and their share to three digits."""
    last = last_marks(events, "user_id", "event_type")
    whole = events.agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))
    users = last.agg(F.count("*").alias("users"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    return whole.crossJoin(users).withColumn("share", F.round(F.col("bought") / F.greatest("users", F.lit(1)), 3))


def conversation(events: DataFrame, most: int = 12) -> DataFrame:
    """(event_id, user_id, shown, refused): the context that each turn sees: up to ``most`` turns before, a refusal that sticks."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    shown = F.least(F.row_number().over(order) - 1, F.lit(most))
    refused = F.coalesce(F.bool_or(F.col("event_type") == "error").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return events.select("event_id", "user_id", shown.alias("shown"), refused.alias("refused"))


def conversation_stream(events: DataFrame, most: int = 12) -> DataFrame:
    """The same on a stream, whose events of a user come in order: state is the turns so far and the refusal."""

    def turn(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, refused = state.get if state.exists else (0, False)
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            shown, stuck = [], []
            for kind in frame.event_type:
                shown.append(min(n, most))
                stuck.append(bool(refused))
                n, refused = n + 1, refused or kind == "error"
            yield pd.DataFrame({"event_id": frame.event_id, "user_id": key[0], "shown": shown, "refused": stuck})
        state.update((n, refused))

    return events.groupBy("user_id").applyInPandasWithState(turn, "event_id long, user_id long, shown int, refused boolean", "n int, refused boolean", "append", "NoTimeout")


def work_queue(events: DataFrame, key: str, seconds: float, most: int) -> DataFrame:
    """(event_id, key, accepted, start_us): a worker for each key that takes ``seconds`` for a job and lets ``most`` pend.

    For a stream of (event_id, ts, key) whose jobs of a key come in order. A job is rejected if ``most`` are pending or
    in work when it comes, else it starts when the one before it ends. All that is kept of a key is when its pending jobs
    end, at most ``most`` numbers; ended ones are dropped. A rejected job has no start. Null times are rejected.
    """
    kind = events.schema[key].dataType.simpleString()
    took = round(seconds * 1_000_000)

    def admit(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ends = list(state.get[0]) if state.exists else []
        # what one trigger brings of a key, in pieces of no order; the trigger's files bound it
        frame = pd.concat(list(frames)).sort_values(["us", "event_id"])
        starts: list[int | None] = []
        for us in frame.us.tolist():
            ends = [e for e in ends if e > us] if us == us else ends
            if us != us or len(ends) >= most:
                starts.append(None)
                continue
            starts.append(max(int(us), ends[-1] if ends else 0))
            ends.append(starts[-1] + took)
        state.update((ends,))
        yield pd.DataFrame({"event_id": frame.event_id, key: keys[0], "accepted": [x is not None for x in starts], "start_us": pd.array(starts, "Int64")})

    jobs = events.select("event_id", key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return jobs.groupBy(key).applyInPandasWithState(admit, f"event_id long, {key} {kind}, accepted boolean, start_us long", "ends array<long>", "append", "NoTimeout")


def append_in_order(events: DataFrame, time: str, path: str, rows: int = 500_000, least: int = 4) -> None:
    """Appends the events to a log folder, days together, a file for about ``rows`` of them after the other in order of time.

    A log grows so by itself; this makes one of a table. There are at least ``least`` files if there are as many days.
    """
    days = events.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n")).orderBy("day").collect()
    most, slices, held = max(1, min(rows, sum(d.n for d in days) // least)), [], 0
    for d in days:
        if not slices or held >= most:
            slices.append([])
            held = 0
        slices[-1].append(d.day)
        held += d.n
    for days in slices:
        known = [d for d in days if d is not None]
        inside = F.to_date(time).between(known[0], known[-1]) if known else F.lit(False)
        events.where(F.coalesce(inside, F.lit(None in days))).coalesce(1).write.mode("append").parquet(path)


def replayed(stream: DataFrame, path: str) -> DataFrame:
    """What a stream gives for all that is there now, written to ``path`` and read back."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
