"""Batch twins of the streaming operators; the streams themselves are run in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows as st
from ..tables import load
from .registry import query


def _events(spark, d):
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def stream_daily(spark, d):
    return st.tumbling(_events(spark, d), "1 day", "2 hours", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("""select date_trunc('hour', ts)::timestamp - to_hours(k::int) as start, event_type, count(*) as n from events, range(0, 3) r(k) group by 1, 2""")
def stream_sliding(spark, d):
    return st.sliding(_events(spark, d), "3 hours", "1 hour", "2 hours", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as opens from events), s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select min(ts) as start, max(ts) + interval 6 hour as "end", user_id, count(*) as n from s group by user_id, k""")
def stream_session(spark, d):
    return st.sessions(_events(spark, d), "6 hours", "1 day", "user_id").select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by 1")
def stream_latest(spark, d):
    return st.latest(_events(spark, d), ["user_id"], "event_type", "event_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query()
def rate_limit(spark, d):
    return st.rate_limit(_events(spark, d), "user_id")


@query("""with a as (select user_id as key, epoch_us(ts) as tm, event_id + event_id * 37 % 400 * 3 + event_id * 1000000 * (event_id % 50 = 7)::int as arrival, event_id, value from events),
o as (select *, row_number() over (order by arrival, event_id) as place from a), t as (select *, tm - tm % 21600000000 as start, max(tm) over (partition by key order by place rows between unbounded preceding and 1 preceding) - 43200000000 as clock from o),
l as (select *, coalesce(start + 21600000000 <= clock, false) as late from t), c as (select key, max(tm) - 43200000000 as last from l group by 1)
select key, 'window' as kind, make_timestamp(start) as start, count(*) as n, round(sum(value), 4) as total, null::bigint as arrival, null::timestamp as ts from l join c using (key) where not late group by key, start, last having start + 21600000000 <= last
union all select key, 'late', null, null, null, arrival, make_timestamp(tm) from l where late""")
def stream_late(spark, d):
    """Windows of six hours a user, closed twelve hours behind the latest event, and the events that came after that; every fiftieth event is very late."""
    arrival = F.expr("event_id + event_id * 37 % 400 * 3 + event_id * 1000000 * cast(event_id % 50 = 7 as int)")
    found = st.with_late_batch(_events(spark, d).withColumn("arrival", arrival), "user_id", 6 * 3600, 12 * 3600)
    return found.select("key", "kind", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"), "arrival", F.col("ts").cast("timestamp_ntz").alias("ts"))
