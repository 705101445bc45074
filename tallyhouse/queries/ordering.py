"""Positions, order and hashes of whole tables, and two tables compared by ranges of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering, ranges
from .base import query, table


@query("global_positions", 'select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as "position" from orders')
def global_positions(spark, sf_dir):
    return ordering.positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "position")


@query("order_breaks", """select event_id, user_id, before from (select event_id, user_id, lag(user_id) over (order by ts, event_id) as before from events) where user_id < before""")
def order_breaks(spark, sf_dir):
    """Events in the order of time whose user is less than that of the event before."""
    found = ordering.order_breaks(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), ["ts", "event_id"], ["user_id"])
    return found.select("event_id", "user_id", F.col("before.user_id").alias("before"))


@query("sorted_keys", "select o_orderkey from (select o_orderkey, lag(o_orderkey) over (order by o_orderkey) as before from orders) where o_orderkey < before")
def sorted_keys(spark, sf_dir):
    """A table in the order of its key has no break."""
    return ordering.order_breaks(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], ["o_orderkey"]).select("o_orderkey")


ORDERED = "select sha256(cast(c_custkey as string) || chr(0) || c_name || chr(0) || c_mktsegment) as h, row_number() over (order by c_mktsegment, c_custkey) as place from customer"
SWAPPED = ORDERED.replace("order by c_mktsegment, c_custkey", "order by c_mktsegment, case c_custkey when 1 then 2 when 2 then 1 else c_custkey end")


def hashed(df, order):
    return ordering.ordered_hash(df, order, ["c_custkey", "c_name", "c_mktsegment"])


@query("ordered_hash", ordering.sql_ordered_hash(ORDERED))
def ordered_hash(spark, sf_dir):
    return hashed(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_custkey"])


@query("ordered_hash_by_price", ordering.sql_ordered_hash("select sha256(cast(p_partkey as string) || chr(0) || p_name) as h, row_number() over (order by p_retailprice desc, sha256(cast(p_partkey as string) || chr(0) || p_name)) as place from part"))
def ordered_hash_by_price(spark, sf_dir):
    """Rows of one price count in the order of their own hashes."""
    return ordering.ordered_hash(table(spark, sf_dir, "part"), [F.col("p_retailprice").desc()], ["p_partkey", "p_name"])


CHANGED = """select l_orderkey, l_linenumber, l_partkey, case when l_orderkey % 97 = 0 then l_linenumber + 10 else l_linenumber end as line from lineitem where l_orderkey % 89 <> 0
    union all select -l_orderkey, l_linenumber, l_partkey, l_linenumber from lineitem where l_orderkey % 101 = 0"""


@query("changed_rows", f"""with a as (select l_orderkey, l_linenumber, l_partkey, l_linenumber as line from lineitem), b as ({CHANGED})
    select *, 'left' as only_in from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)""")
def changed_rows(spark, sf_dir):
    """A table against one with changed, lost and added rows; most ranges are as they were."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").alias("line"))
    b = a.withColumn("line", F.when(F.col("l_orderkey") % 97 == 0, F.col("line") + 10).otherwise(F.col("line"))).where("l_orderkey % 89 <> 0")
    b = b.unionByName(a.where("l_orderkey % 101 = 0").withColumn("l_orderkey", -F.col("l_orderkey")))
    return ranges.changed_rows(a, b, ["l_orderkey", "l_linenumber"])


@query("changed_rows_in_one_range", """select o_orderkey, o_orderstatus, 'left' as only_in from orders where o_orderkey between 100 and 120 and o_orderstatus <> 'X' union all select o_orderkey, 'X', 'right' from orders where o_orderkey between 100 and 120""")
def changed_rows_in_one_range(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey").between(100, 120), "X").otherwise(F.col("o_orderstatus")))
    return ranges.changed_rows(a, b, ["o_orderkey"])
