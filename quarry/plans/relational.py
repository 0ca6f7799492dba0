"""Filters, joins, aggregations, set operations and ordering over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, sets, windows
from ..tables import load
from .registry import query


@query("select doc_id, lang, n_chars from documents where n_chars <= 500")
def scan_docs(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang", "n_chars").where("n_chars <= 500")


@query("select vec_id, cast(len(embedding) as int) as dim, label from embeddings")
def scan_vectors(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dim"), "label")


@query("""select r_name, cast(count(*) as bigint) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name""")
def star_join(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    place = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = li.join(o, "l_orderkey").join(c, "c_custkey").join(place, "n_nationkey")
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("""select c_custkey, c_name, o_orderkey from customer left join (select * from orders where o_orderstatus = 'F' and o_totalprice > 200000) on c_custkey = o_custkey""")
def left_source(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return load(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left")


@query("""with b as (select l_orderkey as k, list_sort(list(distinct p_brand)) as brands from lineitem join part on l_partkey = p_partkey group by 1),
s as (select l_orderkey as k, list_sort(list(distinct s_name)) as suppliers from lineitem join supplier on l_suppkey = s_suppkey group by 1)
select o_orderkey, coalesce(brands, []) as brands, coalesce(suppliers, []) as suppliers from orders left join b on o_orderkey = b.k left join s on o_orderkey = s.k""")
def schedule_complete(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    brands = li.join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))
    names = li.join(load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("s_name")).alias("suppliers"))
    empty = F.array().cast("array<string>")
    out = load(spark, d, "orders").select("o_orderkey").join(brands, "o_orderkey", "left").join(names, "o_orderkey", "left")
    return out.select("o_orderkey", F.coalesce("brands", empty).alias("brands"), F.coalesce("suppliers", empty).alias("suppliers"))


_IN_1998 = "o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01'"


@query(f"select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and {_IN_1998})")
def semi_has(spark, d):
    o = load(spark, d, "orders").where(_IN_1998).select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query(f"select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and {_IN_1998})")
def anti_no_match(spark, d):
    o = load(spark, d, "orders").where(_IN_1998).select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("""select p_partkey, p_name from part where p_size < 10 and p_partkey not in (select l_partkey from lineitem where l_quantity >= 50 and l_discount > 0.05)""")
def not_completed(spark, d):
    done = load(spark, d, "lineitem").where("l_quantity >= 50 and l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, d, "part").where("p_size < 10").select("p_partkey", "p_name").join(done, "p_partkey", "left_anti")


@query("""select o_orderkey, cast(o_orderdate as date) as effective_from, cast(o_orderdate as date) + 90 as effective_to from orders
where cast(o_orderdate as date) <= date '1996-06-15' and cast(o_orderdate as date) + 90 >= date '1996-06-15'""")
def effective_asof(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("effective_from"))
    o = o.withColumn("effective_to", F.date_add("effective_from", 90))
    return o.where("effective_from <= date '1996-06-15' and (effective_to is null or effective_to >= date '1996-06-15')")


@query("""select o_orderkey, cast(o_orderdate as date) + 30 as expires_at from orders where cast(o_orderdate as date) + 30 >= date '1998-06-01' """)
def deadlines_open(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 30).alias("expires_at")).where("expires_at >= date '1998-06-01'")


@query("""select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT' and o_totalprice >= 100000""")
def schedule_filter(spark, d):
    out = load(spark, d, "orders")
    for column, value in {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None}.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.where("o_totalprice >= 100000").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""select p_partkey, p_brand from part where upper(replace(p_brand, '#', '')) = upper('brand12')""")
def course_lookup(spark, d):
    return load(spark, d, "part").where(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))) == F.upper(F.lit("brand12"))).select("p_partkey", "p_brand")


@query("""select doc_id, left(text, 200) as preview from documents where text ilike '%license%' or source ilike '%c1%'""")
def search_ilike(spark, d):
    return load(spark, d, "documents").where(F.col("text").ilike("%license%") | F.col("source").ilike("%c1%")).select("doc_id", F.left("text", F.lit(200)).alias("preview"))


@query("""select s_suppkey, s_name from supplier where contains(s_name, '#00')""")
def teacher_contains(spark, d):
    return load(spark, d, "supplier").where(F.contains("s_name", F.lit("#00"))).select("s_suppkey", "s_name")


@query("""with v(lo, hi, grade) as (values (0, 10, 'D'), (11, 25, 'C'), (26, 40, 'B'), (41, 1000, 'A')) select p_partkey, p_size, grade from part join v on p_size between lo and hi""")
def grade_band(spark, d):
    bands = spark.createDataFrame([(0, 10, "D"), (11, 25, "C"), (26, 40, "B"), (41, 1000, "A")], "lo int, hi int, grade string")
    return load(spark, d, "part").join(F.broadcast(bands), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "p_size", "grade")


@query("""select p.p_partkey, count(l.l_orderkey) as n_lines, coalesce(sum(case when l.l_returnflag = 'R' then 1 else 0 end), 0)::bigint as n_returned from part p left join lineitem l on l.l_partkey = p.p_partkey group by 1""")
def counts_per_parent(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    return load(spark, d, "part").select("p_partkey").join(n, "p_partkey", "left").na.fill(0, ["n_lines", "n_returned"])


@query("""with j as (select l.l_orderkey, l.l_linenumber, l.l_suppkey, s.s_suppkey, s.s_nationkey, (s.s_nationkey % 5 = l.l_linenumber % 5) as ok from lineitem l join supplier s on l.l_suppkey = s.s_suppkey),
a as (select *, max(ok) over (partition by l_orderkey) as any_ok from j) select l_orderkey, l_linenumber, l_suppkey, s_nationkey from a where ok or not any_ok""")
def fallback_join(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    out = joins.fallback_join(li, s, ["l_suppkey"], "l_orderkey", F.col("s_nationkey") % 5 == F.col("l_linenumber") % 5)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "s_nationkey")


@query("""with r as (select p_brand, p_type, count(*) as n, min(p_partkey) as t from part where p_size < 12 group by 1, 2)
select p.p_partkey, case when n is null then 'missing' when n > 1 then 'ambiguous' else 'linked' end as link_status, case when n = 1 then t end as target from part p left join r using (p_brand, p_type)""")
def link_unique(spark, d):
    p = load(spark, d, "part")
    right = p.where("p_size < 12").select("p_brand", "p_type", F.col("p_partkey").alias("target"))
    return joins.unique_link(p.select("p_partkey", "p_brand", "p_type"), right, ["p_brand", "p_type"], "p_partkey", "target").select("p_partkey", "link_status", "target")


@query("""with listing as (select lower(c_name) as k, c_mktsegment as segment from customer where c_custkey % 3 = 0) select c.c_custkey, coalesce(l.segment, 'unlisted') as segment from customer c left join listing l on lower(c.c_name) = l.k""")
def merge_listing(spark, d):
    c = load(spark, d, "customer")
    listing = c.where("c_custkey % 3 = 0").select(F.lower("c_name").alias("k"), F.col("c_mktsegment").alias("segment"))
    return c.withColumn("k", F.lower("c_name")).join(listing, "k", "left").select("c_custkey", F.coalesce("segment", F.lit("unlisted")).alias("segment"))


@query("""with e(r, expected) as (values ('AFRICA', 5), ('AMERICA', 5), ('ASIA', 5), ('EUROPE', 6), ('NOWHERE', 1)),
a as (select r_name, count(*) as actual from nation join region on n_regionkey = r_regionkey group by 1)
select r as name, expected::bigint as expected, actual from e left join a on r = r_name where actual is null or actual <> expected""")
def expected_vs_actual(spark, d):
    expected = spark.createDataFrame([("AFRICA", 5), ("AMERICA", 5), ("ASIA", 5), ("EUROPE", 6), ("NOWHERE", 1)], "name string, expected long")
    actual = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name")).agg(F.count(F.lit(1)).alias("actual"))
    return expected.join(actual, "name", "left").where("actual is null or actual <> expected")


@query("select 'orders' as name, count(*) as n from orders union all select 'lineitem', count(*) from lineitem union all select 'customer', count(*) from customer union all select 'part', count(*) from part")
def table_counts(spark, d):
    out = None
    for name in ("orders", "lineitem", "customer", "part"):
        n = load(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@query("""with a as (select l_linenumber % 5 + 1 as semester, l_quantity as credits from lineitem union all select p_size % 6 + 1, 1.0 from part)
select cast(s as bigint) as semester, coalesce(sum(credits), 0) as credits from range(1, 9) t(s) left join a on a.semester = s group by 1""")
def credits_by_semester(spark, d):
    a = load(spark, d, "lineitem").select((F.col("l_linenumber") % 5 + 1).cast("long").alias("semester"), F.col("l_quantity").alias("credits"))
    b = load(spark, d, "part").select((F.col("p_size") % 6 + 1).cast("long").alias("semester"), F.lit(1.0).alias("credits"))
    total = a.unionByName(b).groupBy("semester").agg(F.sum("credits").alias("credits"))
    return spark.range(1, 9).withColumnRenamed("id", "semester").join(total, "semester", "left").na.fill(0.0, ["credits"])


_OLD, _NEW = "month(o_orderdate) % 2 = 1", "month(o_orderdate) % 2 = 0"


@query(f"""with o as (select distinct o_custkey, o_orderstatus from orders where {_OLD}), n as (select distinct o_custkey, o_orderstatus from orders where {_NEW})
select (select count(*) from (select * from n except select * from o)) as added, (select count(*) from (select * from o except select * from n)) as removed, (select count(*) from (select * from o intersect select * from n)) as unchanged""")
def version_diff(spark, d):
    rows = load(spark, d, "orders")
    pick = lambda c: rows.where(c).select("o_custkey", "o_orderstatus")
    return sets.version_counts(pick(_OLD), pick(_NEW))


def _versions(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    new = p.where("p_partkey % 7 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    new = new.withColumn("p_brand", F.when(F.col("p_partkey") % 11 == 0, F.lit("Brand#99")).otherwise(F.col("p_brand")))
    return p, new.unionByName(p.where("p_partkey < 10").withColumn("p_partkey", -1 - F.col("p_partkey")))


_VERSIONS = """old as (select p_partkey, p_brand, p_size, p_retailprice from part),
new as (select p_partkey, case when p_partkey % 11 = 0 then 'Brand#99' else p_brand end as p_brand, case when p_partkey % 5 = 0 then p_size + 1 else p_size end as p_size, p_retailprice from part where p_partkey % 7 <> 0
  union all select -1 - p_partkey, p_brand, p_size, p_retailprice from part where p_partkey < 10)"""


@query(f"""with {_VERSIONS} select coalesce(o.p_partkey, n.p_partkey) as p_partkey, case when o.p_partkey is null then 'new' when n.p_partkey is null then 'gone' when o.p_brand <> n.p_brand or o.p_size <> n.p_size then 'changed' else 'unchanged' end as change,
case when o.p_partkey is null or n.p_partkey is null then [] else list_filter([case when o.p_brand <> n.p_brand then 'p_brand' end, case when o.p_size <> n.p_size then 'p_size' end], lambda x: x is not null) end as changed from old o full join new n on o.p_partkey = n.p_partkey""")
def field_diff(spark, d):
    old, new = _versions(spark, d)
    return sets.classify_changes(old, new, ["p_partkey"], ["p_brand", "p_size", "p_retailprice"])


@query(f"""with {_VERSIONS}, c as (select case when o.p_partkey is null then 'new' when n.p_partkey is null then 'gone' when md5(o.p_brand || '|' || o.p_size) <> md5(n.p_brand || '|' || n.p_size) then 'changed' else 'unchanged' end as change from old o full join new n on o.p_partkey = n.p_partkey) select change, count(*) as n from c group by 1""")
def change_classify(spark, d):
    old, new = _versions(spark, d)
    sum_of = lambda df, n: df.select("p_partkey", F.md5(F.concat_ws("|", "p_brand", "p_size")).alias(n))
    both = sum_of(old, "a").join(sum_of(new, "b"), "p_partkey", "full")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def _overlay(spark, d):
    base = load(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    edited = base.where("p_partkey % 10 = 1").select("p_partkey", F.round(F.col("p_retailprice") * 1.1, 2).alias("p_retailprice"))
    edited = edited.unionByName(spark.createDataFrame([(10_000_001, 1.0), (10_000_002, 2.0)], "p_partkey long, p_retailprice double"))
    added = base.where("p_partkey < 5").select((-F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.lit(" (new)")).alias("p_name"), "p_retailprice")
    return base, edited, base.where("p_partkey % 10 = 2").select("p_partkey"), added


@query("""select p_partkey, p_name, case when p_partkey % 10 = 1 then round(p_retailprice * 1.1, 2) else p_retailprice end as p_retailprice from part where p_partkey % 10 <> 2
union all select -p_partkey - 1, p_name || ' (new)', p_retailprice from part where p_partkey < 5""")
def overlay_merge(spark, d):
    return sets.overlay(*_overlay(spark, d), "p_partkey")


@query("select 10000001::bigint as p_partkey, 1.0::double as p_retailprice union all select 10000002, 2.0")
def overlay_orphans(spark, d):
    base, edited, _, _ = _overlay(spark, d)
    return sets.orphans(base, edited, "p_partkey")


@query("""select p_brand, p_type, p_name, list_sort(list(distinct p_size)) as sizes from part group by 1, 2, 3 having count(distinct p_size) > 1""")
def source_conflicts(spark, d):
    return sets.conflicts(load(spark, d, "part"), ["p_brand", "p_type", "p_name"], "p_size").withColumnRenamed("values", "sizes")


@query("""with u as (select o_custkey as k, o_orderkey as v, o_orderstatus as s, 0 as n from orders where o_orderkey % 2 = 0 union all select o_custkey, o_orderkey, nullif(o_orderstatus, 'O'), 1 from orders where o_orderkey % 2 = 1),
f as (select *, first_value(s ignore nulls) over (partition by k order by n, v rows between unbounded preceding and unbounded following) as first_s, row_number() over (partition by k order by n desc, v desc) as rn from u)
select k as o_custkey, v as o_orderkey, first_s as o_orderstatus from f where rn = 1""")
def upsert_latest(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    change = o.where("o_orderkey % 2 = 1").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O")))
    return windows.upsert(o.where("o_orderkey % 2 = 0"), change, ["o_custkey"], "o_orderkey", ["o_orderstatus"])


@query("""with t as (select l_partkey, count(*) as n_rows from lineitem group by 1), x as (select l_partkey from lineitem where l_quantity > 30 group by 1)
select case when t.l_partkey is null then 'insert' when x.l_partkey is not null then 'skip' else 'update' end as action, count(*) as n from part p left join t on p.p_partkey = t.l_partkey left join x on p.p_partkey = x.l_partkey group by 1""")
def bulk_upsert_plan(spark, d):
    li = load(spark, d, "lineitem")
    seen = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q"))
    action = F.when(F.col("q").isNull(), "insert").when(F.col("q") > 30, "skip").otherwise("update")
    return load(spark, d, "part").select("p_partkey").join(seen, "p_partkey", "left").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("select p_brand, p_type, count(*) as n from part group by 1, 2 having count(*) > 12")
def check_unique(spark, d):
    return load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query("""select (select count(*) from orders where year(o_orderdate) = 1997) as old_n, (select count(*) from orders where year(o_orderdate) = 1998) as new_n,
(select count(*) from orders where year(o_orderdate) = 1998) < 0.8 * (select count(*) from orders where year(o_orderdate) = 1997) as dropped""")
def check_drop(spark, d):
    y = F.year("o_orderdate")
    n = load(spark, d, "orders").agg(F.count_if(y == 1997).alias("old_n"), F.count_if(y == 1998).alias("new_n"))
    return n.withColumn("dropped", F.col("new_n") < 0.8 * F.col("old_n"))


@query("""select c_custkey, c_name, c_acctbal from (select *, case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 else null end as o from customer) order by o nulls last, c_acctbal desc, c_custkey limit 50""")
def order_nulls_last(spark, d):
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2)
    return load(spark, d, "customer").withColumn("o", rank).orderBy(F.asc_nulls_last("o"), F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_name", "c_acctbal")


@query("""select o_orderkey, o_totalprice, (select count(*) from orders) as total, (select count(*) from orders) > 60 as has_next from orders order by o_totalprice desc, o_orderkey limit 20 offset 40""")
def page_with_total(spark, d):
    return windows.page(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)


@query("""with r as (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rn from customer)
select c_mktsegment, c_custkey, cast(rn as int) as rn from r order by rn, c_mktsegment limit 9""")
def interleave(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return load(spark, d, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 9").orderBy("rn", "c_mktsegment").limit(9).select("c_mktsegment", "c_custkey", "rn")


@query("""select o_custkey, min(case when rn = 1 then o_orderkey end) as latest, count(*) as n from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) group by 1""")
def latest_version(spark, d):
    o = load(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count(F.lit(1)).alias("n"))


@query("""select c_mktsegment, n_name, grouping_id(c_mktsegment, n_name)::bigint as level, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by grouping sets ((c_mktsegment, n_name), (c_mktsegment), ())""")
def log_grouping_sets(spark, d):
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("c_mktsegment", "n_name").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""with m as (select distinct l_orderkey, l_suppkey, l_linenumber, l_quantity from lineitem)
select l_suppkey, count(distinct l_orderkey) as n_meetings, count(distinct l_linenumber) as n_courses, count(distinct (l_orderkey, l_linenumber)) as n_pairs, count(*) as n_rows, sum(l_quantity) as minutes from m group by 1""")
def weekly_load(spark, d):
    m = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity").distinct()
    return m.groupBy("l_suppkey").agg(
        F.countDistinct("l_orderkey").alias("n_meetings"), F.countDistinct("l_linenumber").alias("n_courses"), F.countDistinct("l_orderkey", "l_linenumber").alias("n_pairs"),
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("minutes"),
    )


@query("""select l_orderkey, case when count(distinct l_linenumber) >= 4 then sum(l_quantity) end as total from lineitem group by 1""")
def complete_sum(spark, d):
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.countDistinct("l_linenumber") >= 4, F.sum("l_quantity")).alias("total"))


@query("""select s_nationkey, string_agg(s_name, ', ' order by s_name) as names from supplier group by 1""")
def teachers_concat(spark, d):
    return load(spark, d, "supplier").groupBy("s_nationkey").agg(F.expr("listagg(s_name, ', ') within group (order by s_name)").alias("names"))


@query("""select p_brand, count(*) as n, cast(count(distinct p_type) as bigint) as n_types from part group by 1""")
def room_util(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("n_types"))


@query("""select l_suppkey, l_returnflag, list_sort(list(distinct l_shipdate::date)) as days from lineitem group by 1, 2""")
def history_sets(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sort_array(F.collect_set(F.to_date("l_shipdate"))).alias("days"))


@query("""with b as (select p_brand, ceil(row_number() over (partition by p_brand order by p_name, p_partkey) / 30.0)::int as page, p_partkey from part) select p_brand, page, list(p_partkey order by p_partkey) as parts from b group by 1, 2""")
def paged_list(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    return load(spark, d, "part").withColumn("page", F.ceil(F.row_number().over(w) / 30).cast("int")).groupBy("p_brand", "page").agg(F.sort_array(F.collect_list("p_partkey")).alias("parts"))


@query("""select w as word, p_partkey // 1000 as block, count(*) as n, list_sort(list(p_partkey)) as parts from (select p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) as w from part) group by 1, 2""")
def invert_index(spark, d):
    words = load(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    # a posting list in blocks of 1000 ids, so that a common word is many rows and no long one
    return words.groupBy("word", F.expr("p_partkey div 1000").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("parts"))


@query("""select p_type, case when count(distinct p_brand) = 1 then min(p_brand) end as fact, count(distinct p_brand) > 1 as conflict from part where p_size <= 3 group by 1""")
def fact_or_conflict(spark, d):
    return load(spark, d, "part").where("p_size <= 3").groupBy("p_type").agg(F.when(F.countDistinct("p_brand") == 1, F.min("p_brand")).alias("fact"), (F.countDistinct("p_brand") > 1).alias("conflict"))


@query("""with d as (select c_custkey % 100 as k, c_mktsegment, c_acctbal, c_custkey, row_number() over (partition by c_custkey % 100 order by c_acctbal desc, c_custkey) as rn from customer) select k, c_custkey from d where rn <= 2""")
def diversify(spark, d):
    c = load(spark, d, "customer").withColumn("k", F.col("c_custkey") % 100)
    return windows.first_per(c, ["k"], [F.desc("c_acctbal"), F.col("c_custkey")], 2).select("k", "c_custkey")


@query("""with runs as (select o_custkey as k, o_orderkey as v, o_orderpriority as run from orders), base as (select c_custkey as k from customer),
l as (select k, arg_max(v, (run, v)) as v from runs group by 1) select base.k, coalesce(l.v, -1) as v from base left join l using (k)""")
def override_latest(spark, d):
    runs = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey")).alias("v"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(runs, "k", "left").select("k", F.coalesce("v", F.lit(-1).cast("long")).alias("v"))
