"""Selection and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import resolve_roles
from ..operators import selection as op
from ..operators import spatial
from .fixtures import BOX, POINTS, d2, points, rounded, table

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
TOP = 500


def b2_top_threshold(spark, sf):
    items = table(spark, sf, "lineitem")
    threshold = op.order_statistic(items, "l_extendedprice", TOP)
    return op.threshold_members(items, "l_extendedprice", threshold).withColumn("threshold", F.lit(threshold))


def b4_exact_top(spark, sf):
    return op.exact_top(table(spark, sf, "lineitem"), "l_quantity", TOP, ROW).select(*ROW, "l_quantity")


def b6_uniform_sample(spark, sf):
    return op.uniform_sample(points(spark, sf), 100, ["id"], 12345)


def b7_nearest_point(spark, sf):
    return op.nearest_point(points(spark, sf), (50.0, 50.0, 99.0), BOX)


def b7_cube(spark, sf):
    return rounded(op.cube_around(points(spark, sf), (5.0, 50.0, 98.0), 20.0, BOX).select("id", "dx", "dy", "dz"))


def pair_list(spark, sf):
    p = points(spark, sf)
    n = p.count()
    from ..functions import periodic_distance2

    other = p.select(F.col("id").alias("id_j"), *[F.col(c).alias(f"{c}j") for c in "xyz"])
    joined = p.withColumn("id_j", (F.col("id") * 37) % n + 1).filter("id != id_j").join(other, "id_j")
    return joined.select(F.col("id").alias("id_i"), "id_j", F.sqrt(periodic_distance2([F.col(c) for c in "xyz"], [F.col(f"{c}j") for c in "xyz"], BOX)).alias("distance"))


def b8_stratified_pairs(spark, sf):
    return rounded(op.stratified_pairs(pair_list(spark, sf), "distance", [20.0, 35.0, 50.0, 65.0], 10, [F.col("id_i"), F.col("id_j")]))


def b9_finite_positive(spark, sf):
    accounts = table(spark, sf, "customer").withColumn("v", F.expr("case when c_custkey % 7 = 0 then double('NaN') else c_acctbal end"))
    return op.finite_positive(accounts, ["v"]).select("c_custkey", "v")


def b10_range(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


def b11_membership(spark, sf):
    chosen = table(spark, sf, "customer").filter("c_acctbal < 0")
    return table(spark, sf, "orders").join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


def b12_numbers(spark, sf):
    return op.to_numbers(table(spark, sf, "orders").selectExpr("o_orderkey", "case when o_orderkey % 3 = 0 then o_orderpriority else substring(o_orderpriority, 1, 1) end as level"), ["level"])


def b13_roles(spark, sf):
    roles = {"time": ["step", "O_OrderDate"], "value": ["o_totalprice", "price"], "key": ["id", "o_orderkey"]}
    return resolve_roles(table(spark, sf, "orders"), roles).select("key", F.year("time").alias("year"), "value")


def b16_keep_last(spark, sf):
    return op.keep_last(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def b17_keep_first(spark, sf):
    return op.keep_first(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def b18_distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


def b20_log_clip(spark, sf):
    return rounded(op.log_clip(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "log_value"))


def c1_cells(spark, sf):
    return spatial.with_cells(points(spark, sf), BOX, 6).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (b2_top_threshold, b4_exact_top, b6_uniform_sample, b7_nearest_point, b7_cube, b8_stratified_pairs, b9_finite_positive, b10_range, b11_membership, b12_numbers, b13_roles, b16_keep_last, b17_keep_first, b18_distinct, b20_log_clip, c1_cells)}


def image(c: str, centre: float) -> str:
    return f"({c} - {centre} - 100 * round_even(({c} - {centre}) / 100, 0))"


KEEP = "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {0}, o_orderkey {0}) AS n FROM orders) WHERE n = 1"
ORACLE_SQL = {
    "b2_top_threshold": f"WITH t AS (SELECT min(v) AS threshold FROM (SELECT l_extendedprice AS v FROM lineitem ORDER BY v DESC LIMIT {TOP})) SELECT count(*) FILTER (l_extendedprice > threshold) AS n_above, count(*) FILTER (l_extendedprice = threshold) AS n_equal, any_value(threshold) AS threshold FROM lineitem, t",
    "b4_exact_top": f"SELECT {', '.join(ROW)}, l_quantity FROM lineitem ORDER BY l_quantity DESC, {', '.join(ROW)} LIMIT {TOP}",
    "b7_nearest_point": f"WITH {POINTS}, c AS (SELECT 50.0 AS x, 50.0 AS y, 99.0 AS z) SELECT p.id FROM points p, c ORDER BY {d2('p', 'c')}, p.id LIMIT 1",
    "b7_cube": f"WITH {POINTS}, d AS (SELECT id, {image('x', 5.0)} AS dx, {image('y', 50.0)} AS dy, {image('z', 98.0)} AS dz FROM points) SELECT id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz FROM d WHERE abs(dx) < 20 AND abs(dy) < 20 AND abs(dz) < 20",
    "b8_stratified_pairs": f"""WITH {POINTS}, pairs AS (
        SELECT a.id AS id_i, b.id AS id_j, sqrt({d2("a", "b")}) AS distance FROM points a JOIN points b ON b.id = (a.id * 37) % (SELECT count(*) FROM points) + 1 AND a.id <> b.id
      ), binned AS (SELECT *, floor((distance - 20) / 15)::INT AS bin FROM pairs WHERE distance >= 20 AND distance < 65)
      SELECT id_i, id_j, round(distance, 6) AS distance, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY id_i, id_j) AS n FROM binned) WHERE n <= 10""",
    "b9_finite_positive": "SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_custkey % 7 <> 0 AND c_acctbal > 0",
    "b10_range": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "b11_membership": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "b12_numbers": "SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level FROM orders WHERE o_orderkey % 3 <> 0",
    "b13_roles": "SELECT o_orderkey AS key, year(o_orderdate) AS year, o_totalprice AS value FROM orders",
    "b16_keep_last": KEEP.format("DESC"),
    "b17_keep_first": KEEP.format("ASC"),
    "b18_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "b20_log_clip": "SELECT c_custkey, round(log10(greatest(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.02) FROM customer WHERE c_acctbal > 0))), 6) AS log_value FROM customer",
    "c1_cells": f"WITH {POINTS} SELECT floor(x / (100.0 / 6))::INT AS cx, floor(y / (100.0 / 6))::INT AS cy, floor(z / (100.0 / 6))::INT AS cz, count(*) AS n FROM points GROUP BY 1, 2, 3",
}
