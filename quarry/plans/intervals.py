"""Interval algebra: ``events`` as half-open intervals of ``value`` minutes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, windows
from ..tables import load
from .registry import query

_IV = """iv as (select event_id, user_id, event_type, cast(ts as date) as day, (epoch_us(ts) - epoch_us(cast(ts as date)::timestamp)) // 60000000 as s, (epoch_us(ts) - epoch_us(cast(ts as date)::timestamp)) // 60000000 + cast(floor(value) as bigint) as e from events)"""


def _intervals(spark, d):
    """Minutes of the day, start and end."""
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), F.expr("hour(ts) * 60L + minute(ts)").alias("s"), "value")
    return e.withColumn("e", F.col("s") + F.floor("value")).drop("value")


@query(f"with {_IV} select a.day, a.user_id, a.event_id as a, b.event_id as b from iv a join iv b on a.user_id = b.user_id and a.day = b.day and a.event_id < b.event_id and a.s < b.e and b.s < a.e")
def overlap_pairs(spark, d):
    return joins.overlaps(_intervals(spark, d), ["day", "user_id"], "event_id", "s", "e")


@query(f"with {_IV} select a.day, a.user_id, a.event_id as a, b.event_id as b from iv a join iv b on a.user_id = b.user_id and a.day = b.day and a.event_id < b.event_id and a.s < b.e and b.s < a.e")
def overlap_pairs_binned(spark, d):
    return joins.overlaps(_intervals(spark, d), ["day", "user_id"], "event_id", "s", "e", bin_size=120)


@query(f"""with {_IV}, c as (select a.day, a.user_id, a.event_id as a, b.event_id as b from iv a join iv b on a.user_id = b.user_id and a.day = b.day and a.event_id < b.event_id and a.s < b.e and b.s < a.e and a.event_type <> b.event_type)
select day, count(*) as n_clashes, list(a || '-' || b order by a, b)[1:6] as first_six from c group by 1""")
def clash_report(spark, d):
    iv = _intervals(spark, d)
    kinds = iv.select("event_id", "event_type")
    pairs = joins.overlaps(iv, ["day", "user_id"], "event_id", "s", "e")
    pairs = pairs.join(kinds.select(F.col("event_id").alias("a"), F.col("event_type").alias("ka")), "a").join(kinds.select(F.col("event_id").alias("b"), F.col("event_type").alias("kb")), "b").where("ka <> kb")
    w = Window.partitionBy("day").orderBy("a", "b")
    ranked = pairs.withColumn("rn", F.row_number().over(w))
    return ranked.groupBy("day").agg(F.count(F.lit(1)).alias("n_clashes"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 6, F.struct("a", "b")))), lambda x: F.concat_ws("-", x["a"], x["b"])).alias("first_six"))


@query(f"""with {_IV}, days as (select distinct user_id, day from iv), slots as (select user_id, day, h * 60 as slot_start, h * 60 + 60 as slot_end from days, range(24) t(h))
select user_id, day, slot_start, slot_end from slots z where not exists (select 1 from iv where iv.user_id = z.user_id and iv.day = z.day and z.slot_start < iv.e and iv.s < z.slot_end)""")
def free_slots(spark, d):
    iv = _intervals(spark, d)
    slots = iv.select("user_id", "day").distinct().select("user_id", "day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("h"))
    slots = slots.select("user_id", "day", (F.col("h") * 60).alias("slot_start"), (F.col("h") * 60 + 60).alias("slot_end"))
    return joins.without_overlap(slots, iv, ["user_id", "day"], "slot_start", "slot_end", "s", "e")


@query(f"""with {_IV}, u as (select distinct user_id from iv), span as (select min(day) as a, max(day) as b from iv), d as (select unnest(generate_series(a, b, interval 1 day))::date as day from span)
select u.user_id, d.day from u, d where not exists (select 1 from iv where iv.user_id = u.user_id and iv.day = d.day and iv.s < 720 and 600 < iv.e)""")
def free_rooms(spark, d):
    """Every room and day of the calendar without a booking in the slot."""
    iv = _intervals(spark, d)
    span = iv.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    slots = iv.select("user_id").distinct().crossJoin(F.broadcast(span))  # one row
    slots = slots.select("user_id", F.explode(F.sequence("a", "b")).alias("day"), F.lit(600).alias("from"), F.lit(720).alias("to"))
    return joins.without_overlap(slots, iv, ["user_id", "day"], "from", "to", "s", "e").select("user_id", "day")


@query(f"""with {_IV} select event_id from iv a where user_id <> 5 and not exists (select 1 from iv b where b.user_id = 5 and a.day = b.day and a.s < b.e and b.s < a.e)""")
def alt_sections(spark, d):
    iv = _intervals(spark, d)
    taken = iv.where("user_id = 5")
    return joins.without_overlap(iv.where("user_id <> 5"), taken, ["day"], "s", "e", "s", "e").select("event_id")


@query(f"with {_IV} select event_id, user_id from iv where s - 20 <= 615 and 615 < e")
def tt_at_time(spark, d):
    return _intervals(spark, d).where("s - 20 <= 615 and 615 < e").select("event_id", "user_id")


@query(f"""with {_IV}, n as (select *, rank() over (partition by user_id, day order by s) as r from iv where s >= 600) select user_id, day, event_id, s from n where r = 1""")
def next_class(spark, d):
    w = Window.partitionBy("user_id", "day").orderBy("s")
    return _intervals(spark, d).where("s >= 600").withColumn("r", F.rank().over(w)).where("r = 1").select("user_id", "day", "event_id", "s")


@query(f"""with {_IV}, m as (select *, max(e) over (partition by user_id, day order by s, e rows between unbounded preceding and 1 preceding) as reach from iv),
g as (select *, sum(case when reach is null or s - reach > 3 then 1 else 0 end) over (partition by user_id, day order by s, e rows unbounded preceding) as island from m)
select user_id, day, min(s) as s, max(e) as e, count(*) as n_merged from g group by user_id, day, island""")
def merge_adjacent(spark, d):
    return windows.islands(_intervals(spark, d).select("user_id", "day", "s", "e"), ["user_id", "day"], "s", "e", gap=3)


@query(f"with {_IV} select event_id, e - s as minutes from iv where e <= s or e - s < 5 or e - s > 90")
def check_duration(spark, d):
    return _intervals(spark, d).where("e <= s or e - s < 5 or e - s > 90").select("event_id", (F.col("e") - F.col("s")).alias("minutes"))


@query(f"""with {_IV} select day, s // 60 as hour, count(*) as n, list_sort(list(distinct event_type)) as kinds from iv group by 1, 2""")
def tt_entries(spark, d):
    return _intervals(spark, d).groupBy("day", F.expr("s div 60").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("event_type")).alias("kinds"))


@query("""select event_id, isodow(ts)::int as weekday from events order by isodow(ts), event_id""")
def weekday_order(spark, d):
    order = F.when(F.dayofweek("ts") == 1, 7).otherwise(F.dayofweek("ts") - 1)
    return load(spark, d, "events").select("event_id", order.alias("weekday")).orderBy("weekday", "event_id")


@query("""with t as (select (year(o_orderdate) || '-' || quarter(o_orderdate)) as term, o_orderpriority as p, count(*) as n from orders group by 1, 2) select term, p, n, n - lag(n) over (partition by p order by term) as change from t""")
def cohort_changes(spark, d):
    term = F.concat_ws("-", F.year("o_orderdate"), F.quarter("o_orderdate"))
    t = load(spark, d, "orders").groupBy(term.alias("term"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("p").orderBy("term")))


@query("""with c as (select c_custkey, c_nationkey % 4 as start, c_acctbal from customer where c_nationkey % 4 <= 2) select c_custkey, start from c where start = (select max(start) from c)""")
def newest_cohort(spark, d):
    c = load(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 4).alias("start")).where("start <= 2")
    newest = c.agg(F.max("start").alias("start"))
    return c.join(F.broadcast(newest), "start").select("c_custkey", "start")  # one row


@query("""with v as (select p_brand, p_type, count(distinct p_size) as n_sizes, max(p_retailprice) as best from part group by 1, 2), r as (select *, row_number() over (partition by p_brand order by n_sizes desc, best desc, p_type) as rn from v) select p_brand, p_type, n_sizes from r where rn = 1""")
def best_version(spark, d):
    v = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.countDistinct("p_size").alias("n_sizes"), F.max("p_retailprice").alias("best"))
    return windows.first_per(v, ["p_brand"], [F.desc("n_sizes"), F.desc("best"), F.col("p_type")]).select("p_brand", "p_type", "n_sizes")
