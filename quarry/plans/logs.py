"""Log analytics and conversation windows over ``events``, ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, metrics, windows
from ..tables import load
from .registry import query


def _micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


@query("select event_type, count(*) as n from events group by 1")
def log_by_outcome(spark, d):
    return load(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("none")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(ts as date) as day, count(*) as n, count(distinct user_id) as n_users from events group by 1")
def log_daily(spark, d):
    return load(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("select event_id, user_id, event_type from events where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-05' + interval 1 day")
def log_range(spark, d):
    return load(spark, d, "events").where("ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-05' + interval 1 day").select("event_id", "user_id", "event_type")


@query("""select event_type, count(*) filter (value > 50) as high, count(*) filter (value <= 50) as low, sum(case when value is null then 1 else 0 end)::bigint as missing from events group by 1""")
def cond_counts(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"), F.count_if(F.col("value").isNull()).alias("missing"))


@query("select count(distinct user_id) as n_users, count(distinct event_type) as n_types, count(distinct cast(ts as date)) as n_days, count(*) as n from events")
def stats_distinct(spark, d):
    return load(spark, d, "events").agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("event_type").alias("n_types"), F.countDistinct(F.to_date("ts")).alias("n_days"), F.count(F.lit(1)).alias("n"))


@query("""with f as (select l.l_orderkey, l.l_suppkey, s.s_suppkey from lineitem l join supplier s on l.l_suppkey % 5 = s.s_suppkey % 5 )
select count(*) as fanned_out, count(distinct l_orderkey) as corrected from f""")
def stats_fanout(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("k"))
    s = load(spark, d, "supplier").groupBy((F.col("s_suppkey") % 5).alias("k")).agg(F.count(F.lit(1)).alias("copies"))  # the fan-out counted, not made
    return li.join(s, "k").agg(F.sum("copies").alias("fanned_out"), F.countDistinct("l_orderkey").alias("corrected"))


@query("""select event_type, list_sort(list(value))[least(count(*), floor(count(*) * 0.5)::bigint + 1)] as p50, list_sort(list(value))[least(count(*), floor(count(*) * 0.95)::bigint + 1)] as p95 from events where value is not null group by 1""")
def latency_pct(spark, d):
    return metrics.index_percentiles(load(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""select event_type, quantile_cont(value, 0.5) as p50, list_sort(list(value))[least(count(*), floor(count(*) * 0.95)::bigint + 1)] as p95 from events where value is not null group by 1""")
def eval_latency(spark, d):
    e = load(spark, d, "events")
    p95 = metrics.index_percentiles(e, ["event_type"], "value", {"p95": 0.95})
    return e.groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50")).join(p95, "event_type")


@query("""with s as (select user_id, cast(ts as date) as day, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 as minutes, count(*) as n from events group by 1, 2)
select day, round(avg(minutes), 2) as avg_minutes, count(*) as n_sessions from s where n > 1 group by 1""")
def avg_session_minutes(spark, d):
    s = load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(((_micros(F.max("ts")) - _micros(F.min("ts"))) / 60_000_000).alias("minutes"), F.count(F.lit(1)).alias("n"))
    return s.where("n > 1").groupBy("day").agg(F.round(F.avg("minutes"), 2).alias("avg_minutes"), F.count(F.lit(1)).alias("n_sessions"))


@query("""select event_type, count(*) as n, min(value) as low, max(value) as high, round(avg(value), 4) as mean from events where ts < timestamp '2024-02-01' group by 1""")
def usage_report(spark, d):
    return load(spark, d, "events").where("ts < timestamp '2024-02-01'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("mean"))


@query("select event_id, (props->>'k')::int as k, case when (props->>'k')::int > 50 then 'high' else 'low' end as band from events")
def json_props(spark, d):
    k = F.variant_get(F.parse_json("props"), "$.k", "int")
    return load(spark, d, "events").select("event_id", k.alias("k"), F.when(k > 50, "high").otherwise("low").alias("band"))


@query("""select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1""")
def latest_per_key(spark, d):
    return windows.first_per(load(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""with l as (select user_id, arg_max(event_type, (ts, event_id)) as decision from events where event_type in ('click', 'purchase', 'view') group by 1)
select c_custkey as user_id, coalesce(decision, 'pending') as decision from customer left join l on c_custkey = user_id""")
def review_status(spark, d):
    e = load(spark, d, "events").where(F.col("event_type").isin("click", "purchase", "view"))
    latest = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(latest, "user_id", "left").na.fill("pending", ["decision"])


@query("select event_id, user_id, ts from events where ts >= (select max(ts) from events) - interval 7 day")
def retention_keep(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("interval 7 days")).drop("newest")  # one row


@query("""select event_id, user_id, n_before, since from (select event_id, user_id, row_number() over w - 1 as n_before, epoch_us(ts) - epoch_us(lag(ts) over w) as since from events window w as (partition by user_id order by ts, event_id))""")
def event_gaps(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("event_id", "user_id", (F.row_number().over(w) - 1).cast("long").alias("n_before"), (_micros(F.col("ts")) - F.lag(_micros(F.col("ts"))).over(w)).alias("since"))


@query("""with a as (select conv_id, turn, text, (select max(turn) from conversations u where u.conv_id = c.conv_id and u.role = 'user' and u.turn <= c.turn) as at from conversations c where role = 'assistant')
select a.conv_id, a.turn, q.text as question from a left join conversations q on q.conv_id = a.conv_id and q.turn = a.at""")
def asof_question(spark, d):
    c = joins.asof_last(load(spark, d, "conversations"), ["conv_id"], ["turn"], "text", F.col("role") == "user", "question")
    return c.where("role = 'assistant'").select("conv_id", "turn", "question")


@query("""select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as previous from conversations""")
def prev_user_turn(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return load(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("previous"))


@query("""select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn <= 8""")
def last_n_turns(spark, d):
    return windows.first_per(load(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 8).select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("""select conv_id, string_agg(role || ':' || length(text), ' ' order by turn) as trace, arg_max(text, turn) as final from conversations group by 1""")
def fold_events(spark, d):
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.length("text")).alias("x")))), lambda s: s["x"]), " ")
    return load(spark, d, "conversations").groupBy("conv_id").agg(trace.alias("trace"), F.max_by("text", "turn").alias("final"))


@query("select lang, source, count(*) as n, grouping_id(lang, source)::bigint as level from documents group by cube (lang, source)")
def feedback_matrix(spark, d):
    return load(spark, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("select lang, count(*) as n, count(*) filter (n_chars < 500) as short, count(*) filter (n_chars >= 500 and n_chars < 5000) as middle, count(*) filter (n_chars >= 5000) as long from documents group by 1")
def coverage_report(spark, d):
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    p = load(spark, d, "documents").withColumn("band", band).groupBy("lang").pivot("band", ["short", "middle", "long"]).count()
    return p.na.fill(0).select("lang", (F.col("short") + F.col("middle") + F.col("long")).alias("n"), "short", "middle", "long")


@query("select min(n_chars) as low, max(n_chars) as high, round(avg(n_chars)) as mean, count(*) as n from documents")
def chunk_stats(spark, d):
    return load(spark, d, "documents").agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.round(F.avg("n_chars")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""select source, count(*) as total, count(*) filter (lang = 'en') as active, count(*) filter (quality = 1) as verified, max(doc_id) as newest from documents left join labels using (doc_id) group by 1""")
def kb_summary(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", "lang").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "en").alias("active"), F.count_if(F.col("quality") == 1).alias("verified"), F.max("doc_id").alias("newest"))


@query("""select avg(quality) as mean_quality, avg(toxic) as mean_toxic, coalesce(avg(quality) >= 0.5, false) and coalesce(avg(toxic) <= 0.2, false) as passed from labels""")
def quality_gate(spark, d):
    m = load(spark, d, "labels").agg(F.avg("quality").alias("mean_quality"), F.avg("toxic").alias("mean_toxic"))
    ok = lambda c: F.coalesce(c, F.lit(False))  # noqa: E731  unmeasured fails
    return m.withColumn("passed", ok(F.col("mean_quality") >= 0.5) & ok(F.col("mean_toxic") <= 0.2))


@query("""with b as (select build, row_number() over (order by build desc) as rn from (select distinct strftime(ts, '%Y%m%d%H') as build from events)) select build from b where rn > 3 and build <> '2024010100'""")
def prune_builds(spark, d):
    b = load(spark, d, "events").select(F.date_format("ts", "yyyyMMddHH").alias("build")).distinct()
    newest = b.orderBy(F.desc("build")).limit(3)
    return b.join(newest, "build", "left_anti").where("build <> '2024010100'")
