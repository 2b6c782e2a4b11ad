"""Queries of the event log, as a batch replay of what the streams keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellarflow.session import Scratch
from cellarflow.sources.tables import table
from cellarflow.streaming import flows as L


def ss01_queue(spark, d):
    """Each user's events as jobs of twelve hours, of which three may pend: a stream over the table, replayed to its end."""
    root, events = Scratch(spark, "queue").root, table(spark, d, "events").select("event_id", "ts", "user_id")
    L.append_in_order(events, "ts", f"{root}/log")
    return L.replayed(L.work_queue(L.read_log(spark, f"{root}/log", events.schema), "user_id", 12 * 3600, 3), root)


def ss02_last_marks(spark, d):
    return L.last_marks(table(spark, d, "events"), "user_id", "event_type")


def ss03_quiet(spark, d):
    rows = L.quiet_periods(table(spark, d, "events").where("event_type = 'view'"), "user_id", gap="2 hours")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select("user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n")


def ss04_counters(spark, d):
    return L.running_counts(table(spark, d, "events"), "event_type").select("event_type", "n", F.round("total", 2).alias("total"))


def ss04_daily(spark, d):
    rows = L.windowed_counts(table(spark, d, "events"))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def ss06_context(spark, d):
    return L.conversation(table(spark, d, "events"))


def ag32_log_statistics(spark, d):
    return L.log_statistics(table(spark, d, "events"))


QUERIES = {f.__name__: f for f in (ss01_queue, ss02_last_marks, ss03_quiet, ss04_counters, ss04_daily, ss06_context, ag32_log_statistics)}
SQL = {
    "ss01_queue": """with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
      r(event_id, user_id, i, us, pend, start_us) as (select null::bigint, user_id, 0::bigint, 0::bigint, []::bigint[], null::bigint from (select distinct user_id from e) union all
        select e.event_id, e.user_id, e.i, e.us, case when len(list_filter(r.pend, lambda x: x > e.us)) < 3 then list_append(list_filter(r.pend, lambda x: x > e.us), greatest(e.us, coalesce(list_max(list_filter(r.pend, lambda x: x > e.us)), 0)) + 43200000000) else list_filter(r.pend, lambda x: x > e.us) end,
          case when len(list_filter(r.pend, lambda x: x > e.us)) < 3 then greatest(e.us, coalesce(list_max(list_filter(r.pend, lambda x: x > e.us)), 0)) end from r join e on e.user_id = r.user_id and e.i = r.i + 1)
      select event_id, user_id, start_us is not null as accepted, start_us from r where i > 0""",
    "ss02_last_marks": "select user_id, arg_max(event_type, event_id) as event_type from events group by 1",
    "ss03_quiet": """with e as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) > interval 2 hours as far, ts - lag(ts) over (partition by user_id order by ts) = interval 2 hours as even from events where event_type = 'view'),
      g as (select *, sum(coalesce(far or even, false)::int) over (partition by user_id order by ts rows unbounded preceding) as g from e) select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 2 hours) as end_us, count(*) as n from g group by user_id, g""",
    "ss04_counters": "select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1",
    "ss04_daily": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2",
    "ss06_context": "select event_id, user_id, least(row_number() over w - 1, 12)::int as shown, coalesce(bool_or(event_type = 'error') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) as refused from events window w as (partition by user_id order by ts, event_id)",
    "ag32_log_statistics": "with l as (select user_id, arg_max(event_type, event_id) as t from events group by 1) select (select count(*) from events) as n, (select count(distinct ts::date) from events) as days, count(*) as users, count(*) filter (t = 'purchase') as bought, round(count(*) filter (t = 'purchase') / count(*)::double, 3) as share from l",
}
