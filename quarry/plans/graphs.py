"""Graph queries: parts form a tree, p needs p div 2 (p >= 1).

Where a second parent matters, small parts need p div 3 as well, so nodes have
chains of several lengths to the root.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..store import materialize
from ..tables import load
from .registry import query

_E = "e as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey >= 1)"
_UP = f"{_E}, w(start, node, depth) as (select child, child, 0 from e union all select w.start, e.parent, w.depth + 1 from w join e on e.child = w.node)"
_DOWN = f"{_E}, w(start, node, depth) as (select distinct parent, parent, 0 from e union all select w.start, e.child, w.depth + 1 from w join e on e.parent = w.node)"


def _edges(spark, d):
    p = load(spark, d, "part").where("p_partkey >= 1")
    return graph.edges(p.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent")))


@query(f"with {_E} select child, parent from e")
def graph_edges(spark, d):
    return _edges(spark, d)


@query(f"with {_E} select parent as node, count(*) as n, list_sort(list(child)) as children from e group by 1")
def direct_prereqs(spark, d):
    return _edges(spark, d).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("child")).alias("children"))


@query(f"with recursive {_UP} select start, node, min(depth) as depth from w where depth > 0 group by 1, 2")
def closure_up(spark, d):
    return graph.closure(_edges(spark, d))


@query(f"with recursive {_DOWN} select start, node, min(depth) as depth from w where depth > 0 group by 1, 2")
def closure_down(spark, d):
    return graph.closure(_edges(spark, d), down=True)


_DAG = "e as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey >= 1 union select p_partkey, p_partkey // 3 from part where p_partkey >= 1 and p_size <= 10)"
_CHAINS = f"{_DAG}, w(start, node, depth) as (select child, child, 0 from e union select parent, parent, 0 from e union select w.start, e.parent, w.depth + 1 from w join e on e.child = w.node)"


def _dag(spark, d):
    k, p = F.col("p_partkey"), load(spark, d, "part").where("p_partkey >= 1")
    second = p.where("p_size <= 10").select(k.alias("child"), F.expr("p_partkey div 3").alias("parent"))
    return graph.edges(p.select(k.alias("child"), F.expr("p_partkey div 2").alias("parent")).union(second))


@query(f"with recursive {_CHAINS} select start as node, max(depth)::int as depth from w group by 1")
def depth_levels(spark, d):
    """The longest chain of each part, where parts have one or two parents."""
    return graph.levels(_dag(spark, d))


@query(f"with recursive {_CHAINS}, l as (select start, max(depth) as depth from w group by 1), b as (select start, depth::int as depth, start // 500 as block from l) select depth, block, string_agg(start::varchar, ' ' order by start) as nodes from b group by 1, 2")
def level_string(spark, d):
    """The nodes of each level as text, 500 numbers a row at most, so a wide level is many rows."""
    levels = graph.levels(_dag(spark, d)).withColumn("block", F.expr("node div 500"))
    return levels.groupBy("depth", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string")), " ").alias("nodes"))


@query(f"with recursive {_DOWN} select start as node, count(*) filter (depth = 1) as direct, count(*) filter (depth > 1) as indirect from w where depth > 0 group by 1")
def impact_count(spark, d):
    return graph.closure(_edges(spark, d), down=True).groupBy(F.col("start").alias("node")).agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"))


@query(f"with recursive {_E}, w(start, node, path) as (select child, child, [child] from e where child in (100, 301, 511) union all select w.start, e.parent, list_append(w.path, e.parent) from w join e on e.child = w.node) select start, node, path from w where len(path) > 1")
def shortest_path(spark, d):
    starts = spark.createDataFrame([(100,), (301,), (511,)], "n long")
    return graph.shortest_paths(_edges(spark, d), starts)


@query(f"""with recursive {_E}, u as (select child as s, parent as t from e union select parent, child from e), w(start, node, path) as (select 9::bigint, 9::bigint, [9::bigint] union all select w.start, u.t, list_append(w.path, u.t) from w join u on u.s = w.node where not list_contains(w.path, u.t))
select start, node, path from w where len(path) > 1""")
def shortest_path_undirected(spark, d):
    return graph.shortest_paths(_edges(spark, d), spark.createDataFrame([(9,)], "n long"), directed=False)


@query(f"with recursive {_DAG}, w(node, path) as (select distinct child, [child] from e union all select e.parent, list_append(w.path, e.parent) from w join e on e.child = w.node) select path from w where node not in (select child from e)")
def all_paths(spark, d):
    """Every chain from every part to the root."""
    return graph.root_paths(_dag(spark, d)).select("path")


_WHEEL = "e as (select p_partkey as child, p_partkey // 16 * 16 + (p_partkey * 7 + p_size) % 16 as parent from part)"


@query(f"""with recursive {_WHEEL}, w(start, node, path) as (select child, parent, [child, parent] from e where child <> parent union all select w.start, e.parent, list_append(w.path, e.parent) from w join e on e.child = w.node where not list_contains(w.path[1 : len(w.path) - 1], w.node))
select path from w where node = start and start = list_min(path)""")
def find_cycles(spark, d):
    """Each part points at one of the sixteen around it; some of these chains come back."""
    k = F.col("p_partkey")
    return graph.cycles(graph.edges(load(spark, d, "part").select(k.alias("child"), F.expr("p_partkey div 16 * 16 + (p_partkey * 7 + p_size) % 16").alias("parent"))))


_CONCEPTS = f"""{_DAG}, same as (select p_partkey as a, min(p_partkey) over (partition by p_name, p_brand, p_size) as b from part union select p_partkey, p_partkey + 1 from part where p_partkey % 50 = 0 and p_partkey + 1 in (select p_partkey from part)),
pairs as (select a, b from same union select b, a from same), reach(node, other) as (select p_partkey, p_partkey from part union select r.node, b.b from reach r join pairs b on b.a = r.other),
c as (select node, min(other) as concept from reach group by 1), n as (select concept, any_value(p_name order by p_partkey) as title, count(*) as members, 'CSC-' || concept as code from c join part on p_partkey = node group by 1),
ce as (select distinct a.concept as child, b.concept as parent from e join c a on a.node = e.child join c b on b.node = e.parent where a.concept <> b.concept),
up(start, node, depth) as (select child, parent, 1 from ce union select u.start, ce.parent, u.depth + 1 from up u join ce on ce.child = u.node where u.depth < 60 and ce.parent <> u.start),
closure as (select start, node, min(depth) as depth from up group by 1, 2)"""


@query(f"""with recursive {_CONCEPTS}, name as (select concept, title || ' (' || code || case when members > 1 then ' and ' || members - 1 || ' more' else '' end || ')' as name from n),
rows as (select child as concept, 'needs' as kind, parent as other, 0 as depth from ce union all select start, 'sequence', node, depth from closure union all select parent, 'unlocks', child, 0 from ce where parent in (select child from ce)),
placed as (select *, (row_number() over (partition by concept, kind order by depth desc, other) - 1) // 200 as block from rows)
select p.concept, kind, block, any_value(m.name) || ' ' || kind || ': ' || replace(string_agg(o.name, '; ' order by depth desc, other), '; ', case when kind = 'sequence' then ' > ' else '; ' end) as text from placed p join name m on m.concept = p.concept join name o on o.concept = p.other group by 1, 2, 3""")
def graph_documents(spark, d):
    """Text for search: what each concept needs, its whole sequence (earliest first) and what it unlocks, 200 names a row at most.

    Parts of one name, brand and size are one concept, and so are renumbered ones (p and p + 1 at each fiftieth).
    """
    k, part = F.col("p_partkey"), load(spark, d, "part")
    first = part.groupBy("p_name", "p_brand", "p_size").agg(F.min("p_partkey").alias("b"))
    same = part.join(first, ["p_name", "p_brand", "p_size"]).select(k.alias("a"), "b")
    moved = part.where("p_partkey % 50 = 0").select(k.alias("a"), (k + 1).alias("b")).join(part.select(k.alias("b")), "b", "left_semi").select("a", "b")
    canon = graph.components(same.union(moved)).withColumnsRenamed({"node": "code", "comp": "canonical"})
    e = materialize(graph.edges(_dag(spark, d), canon), "concept-edges")
    members = part.join(canon.withColumnRenamed("code", "p_partkey"), "p_partkey", "left").withColumn("concept", F.coalesce("canonical", "p_partkey"))
    more = F.when(F.count(F.lit(1)) > 1, F.concat(F.lit(" and "), F.count(F.lit(1)) - 1, F.lit(" more"))).otherwise("")
    names = members.groupBy("concept").agg(F.concat(F.min_by("p_name", "p_partkey"), F.lit(" (CSC-"), F.col("concept"), more, F.lit(")")).alias("name"))
    return graph.documents(e, names)


@query(f"with {_E}, s as (select p_partkey as n from part where p_size between 5 and 15) select child, parent from e where child in (select n from s) and parent in (select n from s)")
def set_conflicts(spark, d):
    s = load(spark, d, "part").where("p_size between 5 and 15").select(F.col("p_partkey").alias("n"))
    e = _edges(spark, d)
    return e.join(s.withColumnRenamed("n", "child"), "child", "left_semi").join(s.withColumnRenamed("n", "parent"), "parent", "left_semi").select("child", "parent")


_DONE = "done as (select distinct l_suppkey as who, l_partkey as node from lineitem where l_linestatus = 'F'), want as (select distinct l_suppkey as who, l_partkey as node from lineitem where l_linestatus = 'O')"


def _orders(spark, d, status):
    """Who had (F) or still wants (O) which part."""
    return load(spark, d, "lineitem").where(F.col("l_linestatus") == status).select(F.col("l_suppkey").alias("who"), F.col("l_partkey").alias("node")).distinct()


@query(f"""with {_E}, {_DONE}
select w.who, w.node, count(e.parent) as needs, list_sort(coalesce(list(e.parent) filter (d.node is null and e.parent is not null), [])) as missing from want w left join e on e.child = w.node left join done d on d.who = w.who and d.node = e.parent group by 1, 2""")
def missing_prereqs(spark, d):
    return graph.missing(_edges(spark, d), _orders(spark, d, "O"), _orders(spark, d, "F"))


@query(f"""with {_E}, {_DONE},
open as (select w.* from want w left join done d using (who, node) where d.who is null), n as (select o.who, o.node, count(e.parent) as needs, count(e.parent) filter (d.node is null) as lacks from open o left join e on e.child = o.node left join done d on d.who = o.who and d.node = e.parent group by 1, 2)
select who, case when needs = 0 then 'no_prerequisite' when lacks = 0 then 'eligible' else 'not_eligible' end as status, count(*) as n from n group by 1, 2""")
def eligibility_split(spark, d):
    done = _orders(spark, d, "F")
    found = graph.missing(_edges(spark, d), _orders(spark, d, "O").join(done, ["who", "node"], "left_anti"), done)
    status = F.when(F.col("needs") == 0, "no_prerequisite").when(F.size("missing") == 0, "eligible").otherwise("not_eligible")
    return found.groupBy("who", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with recursive {_UP}, q(x, y) as (values (10, 5), (5, 10), (40, 5), (7, 9)), c as (select start, node, min(depth) as depth from w where depth > 0 group by 1, 2)
select x, y, case when a.depth = 1 then 'direct' when a.depth is not null then 'indirect' when b.depth is not null then 'no' else 'independent' end as answer from q left join c a on a.start = y and a.node = x left join c b on b.start = x and b.node = y""")
def order_check(spark, d):
    q = spark.createDataFrame([(10, 5), (5, 10), (40, 5), (7, 9)], "x int, y int")
    c = graph.closure(_edges(spark, d))
    a = c.select(F.col("start").alias("y"), F.col("node").alias("x"), F.col("depth").alias("fwd"))
    b = c.select(F.col("start").alias("x"), F.col("node").alias("y"), F.col("depth").alias("back"))
    answer = F.when(F.col("fwd") == 1, "direct").when(F.col("fwd").isNotNull(), "indirect").when(F.col("back").isNotNull(), "no").otherwise("independent")
    return q.join(a, ["x", "y"], "left").join(b, ["x", "y"], "left").select("x", "y", answer.alias("answer"))


@query("""with n as (select p_partkey, regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g') as concept from part), e as (select a.concept as child, b.concept as parent from n a join n b on b.p_partkey = a.p_partkey // 2 where a.p_partkey >= 1) select child, parent, count(*) as n from e where child <> parent group by 1, 2""")
def concept_edges(spark, d):
    n = load(spark, d, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z]+", " ").alias("concept"))
    a = n.where("p_partkey >= 1").select(F.expr("p_partkey div 2").alias("k"), F.col("concept").alias("child"))
    e = a.join(n.select(F.col("p_partkey").alias("k"), F.col("concept").alias("parent")), "k").where("child <> parent")
    return e.groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_E}, b as (select child, parent from e where child % 3 > 0), a as (select child, parent + (child % 5 = 0)::int as parent from e where child % 3 < 2) select coalesce(a.child, b.child) as child, case when a.child is null or b.child is null then 'silent' else 'differs' end as kind from a full join b on a.child = b.child where a.parent is distinct from b.parent")
def graph_conflicts(spark, d):
    e = _edges(spark, d)
    a = e.where("child % 3 < 2").select("child", (F.col("parent") + (F.col("child") % 5 == 0).cast("int")).alias("pa"))
    b = e.where("child % 3 > 0").select("child", F.col("parent").alias("pb"))
    both = a.join(b, "child", "full").where(~F.col("pa").eqNullSafe(F.col("pb")))
    return both.select("child", F.when(F.col("pa").isNull() | F.col("pb").isNull(), "silent").otherwise("differs").alias("kind"))


@query(f"with {_E}, x as (select child, parent, 'ok' as q from e union all select 3, 3, 'ok' union all select 9, 999999, 'ok' union all select 8, 4, null) select child, parent, case when child = parent then 'self' when parent not in (select p_partkey from part) then 'unknown' when q is null then 'no quote' end as problem from x where child = parent or parent not in (select p_partkey from part) or q is null")
def check_edges(spark, d):
    x = _edges(spark, d).withColumn("q", F.lit("ok")).union(spark.createDataFrame([(3, 3, "ok"), (9, 999999, "ok"), (8, 4, None)], "child long, parent long, q string"))
    known = load(spark, d, "part").select(F.col("p_partkey").alias("parent"), F.lit(True).alias("known"))
    problem = F.when(F.col("child") == F.col("parent"), "self").when(F.col("known").isNull(), "unknown").when(F.col("q").isNull(), "no quote")
    return x.join(known, "parent", "left").withColumn("problem", problem).where("problem is not null").select("child", "parent", "problem")
