"""Rules and lookups: loads, progression, weighted means, recommendations, fees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, windows
from ..tables import load
from .registry import query


@query("""with l as (select l_orderkey, sum(l_quantity)::int as credits, bool_or(l_returnflag = 'R') as approved from lineitem group by 1) select l_orderkey, case when credits between 15 and 18 then 'normal' when credits between 12 and 21 and approved then 'approved' when credits < 15 then 'under' else 'over' end as verdict from l""")
def rule_load(spark, d):
    load_ = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("credits"), F.bool_or(F.col("l_returnflag") == "R").alias("approved"))
    return load_.select("l_orderkey", rules.semester_load(F.col("credits"), F.col("approved")).alias("verdict"))


@query("""select c_custkey, case when g < 1 then 'dropped' when g < 2 then case when c_nationkey % 4 < 3 then 'probation' else 'dropped' end else 'good' end as standing from (select c_custkey, c_nationkey, round((c_acctbal + 1000) / 2750, 2) as g from customer)""")
def rule_progression(spark, d):
    g = F.round((F.col("c_acctbal") + 1000) / 2750, 2)
    return load(spark, d, "customer").select("c_custkey", rules.progression(g, F.col("c_nationkey") % 4).alias("standing"))


@query("select p_partkey, p_size <= 40 and p_retailprice > 1000 and p_brand <> 'Brand#11' as exempt from part")
def rule_exemption(spark, d):
    return load(spark, d, "part").select("p_partkey", ((F.col("p_size") <= 40) & (F.col("p_retailprice") > 1000) & (F.col("p_brand") != "Brand#11")).alias("exempt"))


@query("""select l_orderkey, ((200 * sum(l_quantity * l_linenumber)::bigint + sum(l_quantity)::bigint) // (2 * sum(l_quantity)::bigint)) / 100.0::double as mean from lineitem where l_quantity > 0 and l_quantity <= 30 group by 1 having count(*) <= 40""")
def weighted_gpa(spark, d):
    return rules.weighted_mean(load(spark, d, "lineitem").withColumn("grade", F.col("l_linenumber")), "l_orderkey", "l_quantity", "grade", least=0, most=30)


@query("""with t as (select p_brand, p_type, min(p_retailprice) as a, max(p_retailprice) as b, sum(p_retailprice) as total, count(*) as n from part group by 1, 2) select p_brand, p_type, round(total, 2) as total, case when n = 2 then round(a + b, 2) = round(total, 2) end as adds_up from t""")
def fee_core(spark, d):
    t = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"), F.sum("p_retailprice").alias("total"), F.count(F.lit(1)).alias("n"))
    return t.select("p_brand", "p_type", F.round("total", 2).alias("total"), F.when(F.col("n") == 2, F.round(F.col("a") + F.col("b"), 2) == F.round("total", 2)).alias("adds_up"))


@query("""select o_orderkey, v.head, v.value from orders, lateral (select unnest(['regular', 'self']) as head, unnest([o_totalprice, o_totalprice * 2]) as value) v""")
def fee_matrix(spark, d):
    o = load(spark, d, "orders").withColumn("values", F.array("o_totalprice", F.col("o_totalprice") * 2))
    return o.select("o_orderkey", F.posexplode("values").alias("at", "value")).select("o_orderkey", F.get(F.array(F.lit("regular"), F.lit("self")), F.col("at")).alias("head"), "value")


@query("""select p_partkey, case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then null else (p_size * 1000)::bigint end as amount, case when p_partkey % 5 = 0 then 'none' when p_partkey % 5 = 1 then 'formula' else 'number' end as kind from part""")
def fee_value(spark, d):
    k = F.col("p_partkey") % 5
    cell = F.when(k == 0, F.lit("-")).when(k == 1, F.lit("as per credit")).otherwise(F.format_number(F.col("p_size") * 1000, 0))
    return load(spark, d, "part").select("p_partkey", cell.alias("cell")).select("p_partkey", *rules.fee_cell(F.col("cell")))


@query("""select p_partkey, (p_size % 4 + 1 + p_size % 2)::int as total, (p_size % 4 + 1)::int as lecture, (p_size % 2)::int as lab from part""")
def credit_parse(spark, d):
    lec, lab = F.col("p_size") % 4 + 1, F.col("p_size") % 2
    text = F.when(F.col("p_partkey") % 2 == 0, F.format_string("%d(%d+%d)", lec + lab, lec, lab)).otherwise(F.format_string("%d+%d", lec, lab))
    return load(spark, d, "part").select("p_partkey", *rules.credits(text))


@query("""select o_orderkey, 'Spring Summer Fall' as terms, year(o_orderdate) * 10 + case when month(o_orderdate) <= 5 then 1 when month(o_orderdate) <= 8 then 2 else 3 end as term_key from orders""")
def term_order(spark, d):
    m = F.month("o_orderdate")
    term = F.concat_ws(" ", F.when(m <= 5, "Spring").when(m <= 8, "Summer").otherwise("Fall"), F.year("o_orderdate"))
    return load(spark, d, "orders").select("o_orderkey", F.lit("Spring Summer Fall").alias("terms"), rules.term_key(term).cast("long").alias("term_key"))


@query("""with e as (select p_partkey, p_brand, p_size, row_number() over (partition by p_brand order by p_size desc, p_partkey) as rn from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 50)) select p_brand, p_partkey, p_size from e where rn <= 5""")
def recommend(spark, d):
    taken = load(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    open_ = load(spark, d, "part").join(taken, "p_partkey", "left_anti")
    return windows.first_per(open_, ["p_brand"], [F.desc("p_size"), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "p_size")


@query("""select l_suppkey, l_partkey, max(case when l_returnflag = 'R' then 3 when l_returnflag = 'N' then 2 else 1 end)::int as level from lineitem group by 1, 2""")
def status_precedence(spark, d):
    level = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "N", 2).otherwise(1)
    return load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max(level).alias("level"))


@query("""select p_type, case when count(distinct p_brand) = 1 then min(p_brand) end as quote from part where p_size = 1 group by 1""")
def unique_quote(spark, d):
    return load(spark, d, "part").where("p_size = 1").groupBy("p_type").agg(F.when(F.countDistinct("p_brand") == 1, F.min("p_brand")).alias("quote"))


@query("""select s_suppkey, p_partkey from (select s_suppkey, p_partkey, row_number() over (partition by s_suppkey order by p_partkey) as rn from supplier join part on p_partkey % 1000 = s_suppkey % 1000) where rn <= 8""")
def candidates(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 1000).alias("k"))
    p = load(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1000).alias("k"))
    first = windows.first_per(p, ["k"], [F.col("p_partkey")], 8)  # no later part of a remainder is among the first of a supplier
    return windows.first_per(s.join(first, "k"), ["s_suppkey"], [F.col("p_partkey")], 8).select("s_suppkey", "p_partkey")
