"""Queries of routing, change tables, relational shapes and the dependency order."""

from pyspark.sql import functions as F

from tallyfold.operators import contacts, graph, numbering, relational, render
from tallyfold.plans.fixtures import duck, frame, table
from tallyfold.plans.registry import query

RISK = "Potential risk"
_A, _B = "coalesce(status_a = 'Potential risk', false)", "coalesce(status_b = 'Potential risk', false)"
_ROUTED = f"""routed as (select *, 'A' as route from screening where {_A} union all select *, 'B' from screening where {_B}
 union all select *, 'NONE' from screening where not {_A} and not {_B})"""


@query("split_numeric_ids", duck("screening", "select id_num, case when regexp_matches(id_unique, '^[0-9]+$') then 'numeric' else 'other' end as route from screening"))
def split_numeric_ids(spark, sf):
    return contacts.split_numeric_ids(frame(spark, sf, "screening"), "id_unique").select("id_num", "route")


@query("route_screening", duck("screening", "select id_num, route from routed", _ROUTED))
def route_screening(spark, sf):
    return contacts.route_screening(frame(spark, sf, "screening"), "status_a", "status_b", RISK).select("id_num", "route")


@query("screening_overlap", duck("screening", f"select count(*) filter (where {_A}) as in_a, count(*) filter (where {_B}) as in_b, count(*) filter (where {_A} and {_B}) as in_both from screening"))
def screening_overlap(spark, sf):
    return contacts.screening_overlap(frame(spark, sf, "screening"), "status_a", "status_b", RISK)


@query(
    "contact_changes",
    duck("contacts", """select id, coalesce(telephone1, '') as phone1, nullif(telephone2, '') as phone2,
 concat('UPDATE SENDER SET SEN_PHONE_NUMBER1=''', coalesce(telephone1, ''), '''',
  case when coalesce(telephone2, '') <> '' then concat(', SEN_PHONE_NUMBER2=''', telephone2, '''') else '' end, ' WHERE SEN_ID=', cast(id as varchar), ';') as line from contacts"""),
)
def contact_changes(spark, sf):
    return contacts.contact_changes(frame(spark, sf, "contacts"))


@query(
    "segment_changes",
    duck("screening", """select id_unique as id, route, code1, code2, concat('UPDATE SENDER SET DATA2="', code1, '", DATA3="', code2, '" WHERE SEN_ID = ', id_unique, ';') as line
from routed join (values ('A', 'D', 'BLACKLIST'), ('B', 'A', 'PPE'), ('NONE', 'A', 'RAS')) c(r, code1, code2) on r = route where id_unique <> ''""", _ROUTED),
)
def segment_changes(spark, sf):
    routed = contacts.route_screening(frame(spark, sf, "screening"), "status_a", "status_b", RISK)
    return contacts.segment_changes(routed, "id_unique")


@query(
    "city_inserts",
    """select 0 as ord, concat(c_name, '''s') as name, concat('INSERT INTO ville VALUES (S_VILLE.nextval, ''', c_name, '''''s'', ', cast(c_nationkey as varchar), ', ', cast(c_custkey % 2 as varchar),
 ', ''', c_mktsegment, ''', ''O''''Neil'', SYSDATE, SYSDATE);') as line from customer
union all select 1, null, '' union all select 2, null, 'COMMIT;'""",
)
def city_inserts(spark, sf):
    cities = table(spark, sf, "customer").select(
        F.concat("c_name", F.lit("'s")).alias("VI_LIBELLE"), F.col("c_nationkey").alias("VI_ZN_ID"),
        (F.col("c_custkey") % 2).alias("STATUT"), F.col("c_mktsegment").alias("USER_CREATE"), F.lit("O'Neil").alias("USER_MODIF"),
    )
    return render.city_inserts(cities)


@query(
    "batch_inserts",
    """with r as (select o_orderkey, concat('(', cast(o_orderkey as varchar), ', ', concat('''', replace(o_orderpriority, '''', ''''''), ''''), ', ',
 cast(cast(o_totalprice as decimal(18,2)) as varchar), ', ', concat('''', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ''''), ')') as t,
 cast(floor((row_number() over (order by o_orderkey) - 1) / 1000) as bigint) as batch from orders)
select 'orders' as table_name, batch, count(*) as n_rows,
 concat('INSERT INTO orders (o_orderkey, o_orderpriority, price, o_orderdate) VALUES', chr(10), string_agg(t, ',' || chr(10) order by o_orderkey), ';') as line from r group by batch""",
)
def batch_inserts(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderdate")
    return render.batch_inserts(orders, "orders", "o_orderkey")


@query(
    "ordered_list_by_key",
    """select o_custkey, part, string_agg(cast(o_orderkey as varchar), ', ' order by o_orderkey) as items, count(*) as n_items from
 (select o_custkey, o_orderkey, cast(floor((row_number() over (partition by o_custkey order by o_orderkey) - 1) / 1000) as bigint) as part from orders) group by 1, 2""",
)
def ordered_list_by_key(spark, sf):
    return numbering.ordered_list_by_key(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_orderkey")


@query(
    "keyed_detail_join",
    """select o_custkey, n_name, r_name, part, string_agg(o_orderpriority, ', ' order by o_orderkey) as items, count(*) as n_items from
 (select o_custkey, n_name, r_name, o_orderkey, o_orderpriority, cast(floor((row_number() over (partition by o_custkey order by o_orderkey) - 1) / 1000) as bigint) as part
  from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey) group by 1, 2, 3, 4""",
)
def keyed_detail_join(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    details = [
        (table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"]),
        (table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"), ["c_nationkey"]),
        (table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), ["n_regionkey"]),
    ]
    return relational.keyed_detail_join(base, details, ["o_custkey", "n_name", "r_name"], "o_orderkey", "o_orderpriority")


@query("inner_edge_join", "select distinct c_name as child, n_name as parent from customer join nation on c_nationkey = n_nationkey where c_name <> n_name")
def inner_edge_join(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_name")
    right = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return relational.inner_edge_join(left, right, "k", "c_name", "n_name")


@query("filter_not_in_subquery", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def filter_not_in_subquery(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return relational.filter_not_in_subquery(table(spark, sf, "customer"), "c_custkey", urgent, "o_custkey").select("c_custkey", "c_name")


@query("filter_like_prefix", "select o_orderkey, o_orderpriority from orders where o_orderpriority like '4-%'")
def filter_like_prefix(spark, sf):
    return relational.filter_like_prefix(table(spark, sf, "orders"), "o_orderpriority", "4-").select("o_orderkey", "o_orderpriority")


@query(
    "sort_case_priority",
    "select c_nationkey, c_custkey, cast(case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 when 'HOUSEHOLD' then 3 else 4 end as bigint) as priority from customer order by 1, 3, 2",
)
def sort_case_priority(spark, sf):
    ranked = relational.sort_case_priority(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"], then=["c_custkey"])
    return ranked.select("c_nationkey", "c_custkey", "priority")


@query(
    "dependency_levels",
    duck("edges", "select node, max(level) as level, false as blocked from walk group by 1",
         """pairs as (select distinct child, parent from edges where child <> parent),
 walk as (select * from (with recursive w(node, level) as (select distinct parent, 0 from pairs where parent not in (select child from pairs)
  union select p.child, w.level + 1 from w join pairs p on p.parent = w.node) select node, level from w))"""),
)
def dependency_levels(spark, sf):
    return graph.dependency_levels(frame(spark, sf, "edges"))


# Reachability from every node, by recursion; a node that reaches itself is on a cycle.
_REACH = """reach as (select * from (with recursive r(a, b) as (select distinct child, parent from loops
  union select r.a, p.parent from r join loops p on p.child = r.b) select a, b from r)),
 cyclic as (select x.a as node, min(x.b) as cycle from reach x join reach y on y.a = x.b and y.b = x.a group by 1)"""


@query("dependency_cycles", duck("loops", "select node, cycle from cyclic", _REACH))
def dependency_cycles(spark, sf):
    return graph.dependency_cycles(frame(spark, sf, "loops"))


@query(
    "dependency_order",
    duck("loops", """select u.node, cast(max(w.level) as integer) as level, any_value(u.cycle) as cycle from units u join walk w on w.unit = u.unit group by 1""",
         _REACH + """, nodes as (select child as node from loops union select parent from loops),
 units as (select n.node, c.cycle, coalesce(c.cycle, n.node) as unit from nodes n left join cyclic c on c.node = n.node),
 between as (select distinct a.unit as child, b.unit as parent from loops l join units a on a.node = l.child join units b on b.node = l.parent where a.unit <> b.unit),
 walk as (select * from (with recursive w(unit, level) as (select distinct unit, 0 from units where unit not in (select child from between)
  union select b.child, w.level + 1 from w join between b on b.parent = w.unit) select unit, level from w))"""),
)
def dependency_order(spark, sf):
    """Levels of a graph with cycles; those behind a cycle have theirs as well."""
    return graph.dependency_order(frame(spark, sf, "loops"))
