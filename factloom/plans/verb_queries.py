"""Registered queries for the notebook verbs on the given data tables, each with its check."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import hot_join, verbs
from factloom.plans.registry import query
from factloom.session import scratch_path
from factloom.sources import file_table


def _money(column: str):
    return F.col(column).cast("decimal(15,2)")


@query("d01_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def _(f):
    return f("lineitem").filter((F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("d02_select", "SELECT o_orderkey AS id, o_totalprice, upper(o_orderstatus) AS status FROM orders")
def _(f):
    return f("orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.upper("o_orderstatus").alias("status"))


@query("d03_select_expr", "SELECT c_custkey AS id, c_name, c_nationkey AS nation FROM customer")
def _(f):
    return f("customer").selectExpr("c_custkey AS id", "c_name", "c_nationkey nation")


@query("d04_with_column", "SELECT p_partkey, upper(p_name) AS p_name, p_size, p_size * 2 AS doubled FROM part")
def _(f):
    part = f("part").select("p_partkey", "p_name", "p_size")
    return part.withColumn("p_name", F.upper("p_name")).withColumn("doubled", F.col("p_size") * 2)


@query("d05_with_columns", "SELECT p_partkey, p_size + 1 AS p_size, p_size * 10 AS scaled FROM part")
def _(f):
    return f("part").select("p_partkey", "p_size").withColumns({"p_size": F.col("p_size") + 1, "scaled": F.col("p_size") * 10})


@query("d06_with_column_renamed", "SELECT s_suppkey AS supplier_id, s_name, s_nationkey FROM supplier")
def _(f):
    return f("supplier").select("s_suppkey", "s_name", "s_nationkey").withColumnRenamed("s_suppkey", "supplier_id")


@query("d07_drop", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(f):
    return f("orders").drop("o_orderpriority")


@query("d08_to_df", "SELECT s_suppkey AS a, s_name AS b, s_nationkey AS c, s_acctbal AS d FROM supplier")
def _(f):
    return f("supplier").toDF("a", "b", "c", "d")


def _keyed(f):
    orders = f("orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    events = f("events").select((F.col("event_id") * 2).alias("id"), "event_type")
    return orders, events


_KEYED = "o AS (SELECT o_orderkey AS id, o_orderstatus FROM orders), e AS (SELECT event_id * 2 AS id, event_type FROM events)"

for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    @query(f"d09_join_{_how}", f"WITH {_KEYED} SELECT id, o_orderstatus, event_type FROM o {_join} e USING (id)")
    def _(f, how=_how):
        orders, events = _keyed(f)
        return orders.join(events, ["id"], how)


@query("d09_join_three", """
SELECT n_name, c_mktsegment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment""")
def _(f):
    return (
        f("orders").join(f("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(f("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "c_mktsegment")
        .agg(F.count("*").alias("orders"), F.sum(_money("o_totalprice")).cast("double").alias("total"))
    )


# Half of the lines are of one key; the other side is an aggregate, behind which adaptive execution splits nothing.
_HOT_LINES = "SELECT CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE l_orderkey END AS id, l_returnflag AS flag, l_quantity AS quantity FROM lineitem"
_HOT_ORDERS = "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey END AS id, count(*) AS orders, max(o_orderpriority) AS priority FROM orders GROUP BY 1"

for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("full", "FULL JOIN")):

    @query(f"d09_join_hot_{_how}", f"""
WITH l AS ({_HOT_LINES}), o AS ({_HOT_ORDERS})
SELECT id, flag, priority, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(orders) AS BIGINT) AS orders FROM l {_join} o USING (id) GROUP BY id, flag, priority""")
    def _(f, how=_how):
        joined = hot_join.hot_join(f.sql(_HOT_LINES), f.sql(_HOT_ORDERS), ["id"], how)
        return joined.groupBy("id", "flag", "priority").agg(
            F.count("*").alias("n"), F.sum("quantity").cast("double").alias("quantity"), F.sum("orders").alias("orders"))


@query("d10_left_semi", f"WITH {_KEYED} SELECT id, o_orderstatus FROM o WHERE id IN (SELECT id FROM e)")
def _(f):
    orders, events = _keyed(f)
    return orders.join(events, ["id"], "left_semi")


@query("d10_left_anti", f"WITH {_KEYED} SELECT id, o_orderstatus FROM o WHERE id NOT IN (SELECT id FROM e)")
def _(f):
    orders, events = _keyed(f)
    return orders.join(events, ["id"], "left_anti")


_BANDS = "SELECT r_regionkey AS band, r_regionkey * 60000.0 AS low, (r_regionkey + 1) * 60000.0 AS high FROM region"


@query("d11_theta_join", f"""
SELECT o_orderkey, band FROM orders JOIN (SELECT band, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM ({_BANDS}) x) b ON o_totalprice >= low AND o_totalprice < high""")
def _(f):
    bands = f.sql(_BANDS).select("band", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    points = f("orders").select("o_orderkey", "o_totalprice")
    return verbs.range_join(points, "o_totalprice", bands, "low", "high").select("o_orderkey", "band")


@query("d12_union", "SELECT o_orderkey AS id, o_orderstatus AS kind FROM orders UNION ALL SELECT event_id, event_type FROM events")
def _(f):
    orders = f("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"))
    return orders.union(f("events").select("event_id", "event_type"))


@query("d13_union_by_name", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(f):
    customers = f("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return customers.unionByName(f("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


def _users(f):
    return f("orders").select(F.col("o_custkey").alias("id")), f("events").select(F.col("user_id").alias("id"))


for _verb, _sql in (("intersect", "INTERSECT"), ("intersectAll", "INTERSECT ALL"), ("subtract", "EXCEPT"), ("exceptAll", "EXCEPT ALL")):
    _number = 14 if _verb.startswith("intersect") else 15

    @query(f"d{_number}_{_verb}", f"SELECT o_custkey AS id FROM orders {_sql} SELECT user_id FROM events")
    def _(f, verb=_verb):
        left, right = _users(f)
        return getattr(left, verb)(right)


@query("d16_group_by_agg", """
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS sum_price,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))) AS DOUBLE) AS revenue,
 round(avg(l_quantity), 6) AS avg_qty, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(f):
    revenue = _money("l_extendedprice") * (F.lit(1) - _money("l_discount"))
    return f("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.sum(_money("l_extendedprice")).cast("double").alias("sum_price"),
        F.sum(revenue).cast("double").alias("revenue"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
    )


@query("d17_agg_dict", 'SELECT l_returnflag, sum(l_quantity) AS "sum(l_quantity)", max(l_linenumber) AS "max(l_linenumber)" FROM lineitem GROUP BY l_returnflag')
def _(f):
    return f("lineitem").groupBy("l_returnflag").agg({"l_quantity": "sum", "l_linenumber": "max"})


@query("d18_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(f):
    return f("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("d18_drop_duplicates", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) e WHERE n = 1""")
def _(f):
    events = f("events").select("user_id", "event_id", "event_type", "ts")
    return verbs.first_per_key(events, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("d19_order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(f):
    return f("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("d19_sort_within_partitions", "SELECT o_orderkey, o_custkey FROM orders")
def _(f):
    return f("orders").select("o_orderkey", "o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")


@query("d20_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(f):
    return f("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("d20_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def _(f):
    return f("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


_HOLES = "SELECT event_id, nullif(event_type, 'error') AS event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events"


@query("d21_dropna", f"SELECT * FROM ({_HOLES}) h WHERE event_type IS NOT NULL AND value IS NOT NULL")
def _(f):
    return f.sql(_HOLES).dropna()


@query("d21_fillna", f"SELECT event_id, coalesce(event_type, 'unknown') AS event_type, coalesce(value, -1.0) AS value FROM ({_HOLES}) h")
def _(f):
    return f.sql(_HOLES).fillna({"event_type": "unknown", "value": -1.0})


@query("d21_replace", "SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE event_type END AS event_type FROM events")
def _(f):
    return f("events").select("event_id", "event_type").replace({"click": "tap", "view": "look"}, subset=["event_type"])


@query("d22_sample", "SELECT o_orderkey, o_custkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) < '4000'")
def _(f):
    return verbs.hash_sample(f("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 25)


@query("d24_expressions", """
SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS state,
 nullif(o_orderpriority, '5-LOW') IS NULL AS low, o_totalprice BETWEEN 1000 AND 50000 AS usual, substr(o_orderpriority, 1, 1) AS digit FROM orders""")
def _(f):
    status = F.col("o_orderstatus")
    return f("orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("bigint").alias("whole"),
        F.when(status == "F", "done").when(status == "O", "open").otherwise("other").alias("state"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).isNull().alias("low"),
        F.col("o_totalprice").between(1000, 50000).alias("usual"),
        F.col("o_orderpriority").substr(1, 1).alias("digit"),
    ).orderBy(F.col("state").asc_nulls_last(), F.col("whole").desc_nulls_first())


@query("d25_over", """
SELECT o_orderkey, row_number() OVER w AS n, lag(o_orderkey) OVER w AS previous, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def _(f):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return f("orders").select(
        "o_orderkey",
        F.row_number().over(w).cast("bigint").alias("n"),
        F.lag("o_orderkey").over(w).alias("previous"),
        F.sum(_money("o_totalprice")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"),
    )


@query("d26_variant_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(f):
    return f("events").select("event_id", verbs.variant_field(F.col("props"), "$.k", "bigint").alias("k"))


@query("d26_stored_variant", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 20")
def _(f):
    """The text is parsed at load; the filter is on a field that was written beside the VARIANT."""
    events = f("events").select("event_id", "props")
    stored = verbs.load_variant(events, "props", {"k": ("$.k", "bigint")}, scratch_path(f.spark, "variant"))
    return stored.filter("k < 20").select("event_id", "k")


_CTE = """WITH per_customer AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey),
 named AS (SELECT c.c_name AS name, p.n, p.top FROM per_customer p JOIN customer c ON c.c_custkey = p.o_custkey)
SELECT x.* FROM (SELECT * FROM named WHERE n > 5) x WHERE x.top > (SELECT avg(o_totalprice) FROM orders)"""


@query("d27_cte_subquery", _CTE)
def _(f):
    return f.sql(_CTE)


@query("d28_temp_view_chain", """
SELECT c_mktsegment, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 1000) s JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def _(f):
    f("orders").filter("o_totalprice > 1000").select("o_custkey").createOrReplaceTempView("factloom_staged")
    joined = f.spark.sql("SELECT c_mktsegment FROM {customer} JOIN factloom_staged ON c_custkey = o_custkey", customer=f("customer"))
    f.spark.catalog.dropTempView("factloom_staged")
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("d29_create_and_insert", "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT event_id, event_type FROM events")
def _(f):
    created = f("orders").select("o_orderkey", "o_orderstatus")
    return verbs.write_and_read(created, f("events").selectExpr("event_id AS o_orderkey", "event_type AS o_orderstatus"))


@query("d29_insert_overwrite", "SELECT event_id AS o_orderkey, event_type AS o_orderstatus FROM events")
def _(f):
    created = f("orders").select("o_orderkey", "o_orderstatus")
    return verbs.write_and_read(created, overwrite=f("events").selectExpr("event_id AS o_orderkey", "event_type AS o_orderstatus"))


# Source rows without a customer come twice, and some have no key; customers match at most one row.
_MERGED = """SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN -(o_orderkey % 50) ELSE o_orderkey END AS id, o_totalprice AS amount, o_orderstatus AS tag,
 o_orderpriority AS priority FROM orders WHERE o_orderpriority <> '5-LOW'"""
_MERGE_TARGET = "SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey END AS id, c_acctbal AS amount, c_mktsegment AS tag FROM customer"


@query("d30_merge", f"""
WITH t AS ({_MERGE_TARGET}), s AS ({_MERGED})
SELECT coalesce(s.id, t.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.amount ELSE t.amount END AS amount, CASE WHEN s.id IS NOT NULL THEN s.tag ELSE t.tag END AS tag
FROM t LEFT JOIN s ON s.id = t.id WHERE NOT coalesce(s.tag = 'P', false)
UNION ALL SELECT id, amount, tag FROM s WHERE id IS NULL OR id NOT IN (SELECT id FROM t WHERE id IS NOT NULL)""")
def _(f):
    return verbs.merge_rows(f.sql(_MERGE_TARGET), f.sql(_MERGED), ["id"], delete_when=F.col("s.tag") == "P")


@query("d30_merge_clauses", f"""
WITH t AS ({_MERGE_TARGET}), s AS ({_MERGED})
SELECT t.id, CASE WHEN s.priority = '1-URGENT' THEN t.amount + s.amount ELSE t.amount END AS amount, t.tag FROM t LEFT JOIN s ON s.id = t.id
UNION ALL SELECT id, amount, NULL FROM s WHERE (id IS NULL OR id NOT IN (SELECT id FROM t WHERE id IS NOT NULL)) AND amount > 100000""")
def _(f):
    """SET and INSERT lists, and a condition of each clause."""
    return verbs.merge_rows(
        f.sql(_MERGE_TARGET), f.sql(_MERGED), ["id"],
        update={"amount": F.col("t.amount") + F.col("s.amount")}, update_when=F.col("s.priority") == "1-URGENT",
        insert={"amount": F.col("s.amount")}, insert_when=F.col("s.amount") > 100000)


@query("d31_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def _(f):
    orders = f("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return verbs.update_rows(orders, F.col("o_orderstatus") == "O", {"o_totalprice": F.col("o_totalprice") * 2})


@query("d31_delete", f"SELECT * FROM ({_HOLES}) h WHERE NOT coalesce(value > 50, false)")
def _(f):
    return verbs.delete_rows(f.sql(_HOLES), F.col("value") > 50)


@query("d31_copy_on_write", f"""
WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey < 400 THEN o_totalprice + 1 ELSE o_totalprice END AS amount, o_orderstatus AS tag FROM orders
  WHERE NOT (o_orderkey BETWEEN 1000 AND 1500 AND o_orderstatus = 'F')),
s AS (SELECT o_orderkey - 200 AS id, o_totalprice * 2 AS amount, 'M' AS tag FROM orders WHERE o_orderkey BETWEEN 200 AND 600 AND o_custkey % 3 <> 0)
SELECT id, amount, tag FROM a WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT id, amount, tag FROM s""")
def _(f):
    """UPDATE, DELETE and MERGE in a row on one table, each of which rewrites only the files it touches."""
    orders = f("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("tag"))
    table = file_table.FileTable(f.spark, scratch_path(f.spark, "table"), orders.schema)
    table.append(orders.repartitionByRange(16, "id"))
    table.update(F.col("id") < 400, {"amount": F.col("amount") + 1})
    table.delete(F.col("id").between(1000, 1500) & (F.col("tag") == "F"))
    table.merge(f("orders").filter("o_orderkey BETWEEN 200 AND 600 AND o_custkey % 3 <> 0").select(
        (F.col("o_orderkey") - 200).alias("id"), (F.col("o_totalprice") * 2).alias("amount"), F.lit("M").alias("tag")), ["id"])
    return table.read()
