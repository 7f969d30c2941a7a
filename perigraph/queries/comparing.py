"""Comparisons of distributions, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as op
from ..operators import fits
from .fixtures import TRACE, boot, boot_means, quantiles, rounded, table, windowed


def sample(spark, sf, where):
    """b, value: mean spectral dimension over the later half of each replicate; every ninth is missing."""
    curves = fits.centred_dimension(boot_means(spark, sf, where), ["b"], "t", "p", 7)
    out = fits.plateau(curves, ["b"], "t", "ds", 5).select("b", F.round("plateau_mean", 6).alias("value"))
    return out.withColumn("value", F.when(F.col("b") % 9 != 0, F.col("value")))


EVEN, ODD = "probe_index % 2 = 0", "probe_index % 2 = 1"


def first(spark, sf):
    return sample(spark, sf, EVEN)


def second(spark, sf):
    return sample(spark, sf, ODD).withColumn("value", F.when(F.col("b") % 7 != 0, F.col("value")))


def pairs(spark, sf):
    return op.paired(first(spark, sf), second(spark, sf))


def o1_paired(spark, sf):
    return rounded(pairs(spark, sf))


def o1_paired_summary(spark, sf):
    return rounded(op.paired_summary(pairs(spark, sf)))


def o2_pair_counts(spark, sf):
    return op.pair_order_counts(first(spark, sf), second(spark, sf))


def o3_all_pairs_quantile(spark, sf):
    a, b = (d.select("value") for d in (first(spark, sf), second(spark, sf)))
    return spark.range(1).select(F.round(F.lit(op.all_pairs_quantile(a, b, 0.5)).cast("double"), 6).alias("median_difference"))


def o4_independent(spark, sf):
    return rounded(op.independent_summary(first(spark, sf), second(spark, sf)))


def o5_all_pairs_ratio(spark, sf):
    return rounded(op.all_pairs_ratio(first(spark, sf), second(spark, sf)))


def o6_ratio_bounds(spark, sf):
    a, b = (op.quantile_columns(d, [], "value", "", [F.count("value").alias("n")]) for d in (first(spark, sf), second(spark, sf)))
    return rounded(op.ratio_bounds(a, b))


def o7_prediction(spark, sf):
    return rounded(op.prediction_summary(pairs(spark, sf), 0.05))


PRICE = 300000.0


def survival(spark, sf):
    """Days from 1995-01-01 to a customer's first order above a price, censored at the last order otherwise."""
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1995-01-01"))).alias("day"), F.col("o_custkey").alias("c"))
    return o.groupBy(F.col("c").alias("custkey")).agg(F.min(F.when(F.col("o_totalprice") > PRICE, F.col("day"))).alias("hit"), F.max("day").alias("last")).select("custkey", F.coalesce("hit", "last").alias("time"), F.col("hit").isNotNull().alias("event"))


SURVIVAL = f"survival AS (SELECT o_custkey AS custkey, coalesce(min(day) FILTER (o_totalprice > {PRICE}), max(day)) AS time, min(day) FILTER (o_totalprice > {PRICE}) IS NOT NULL AS event FROM (SELECT *, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS day FROM orders) GROUP BY 1)"
KM = f"{SURVIVAL}, risk AS (SELECT time, sum(event::INT) AS n_events, sum(count(*)) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM survival GROUP BY time), km AS (SELECT time, n_events::BIGINT AS n_events, at_risk::BIGINT AS at_risk, CASE WHEN max((n_events = at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN n_events < at_risk THEN ln(1 - n_events / at_risk::DOUBLE) ELSE 0 END) OVER w) END AS survival FROM risk WHERE n_events > 0 WINDOW w AS (ORDER BY time))"


def o8_kaplan_meier(spark, sf):
    return rounded(op.kaplan_meier(survival(spark, sf)))


def o9_survival_quantile(spark, sf):
    return op.survival_quantile(op.kaplan_meier(survival(spark, sf)), 0.5)


def o10_censored(spark, sf):
    return rounded(op.censored_offsets(survival(spark, sf).withColumn("predicted", (F.col("custkey") % 800).cast("double"))))


def o11_groups(spark, sf):
    flagged = table(spark, sf, "customer").withColumn("flag", F.col("c_mktsegment") == "BUILDING")
    return rounded(op.group_comparison(flagged, "flag", "c_acctbal"))


def o11_probability(spark, sf):
    flagged = table(spark, sf, "customer").withColumn("flag", F.col("c_mktsegment") == "BUILDING")
    return rounded(op.probability_greater(flagged, "flag", "c_acctbal"))


def o12_differences(spark, sf):
    runs = {n: fits.centred_dimension(boot_means(spark, sf, w), ["b"], "t", "p", 7) for n, w in (("even", EVEN), ("odd", ODD + " and diffusion_time <= 20"))}
    return rounded(op.curve_differences(runs, "even"))


def o13_flattened(spark, sf):
    return rounded(op.flattened({"paired": op.paired_summary(pairs(spark, sf)), "independent": op.independent_summary(first(spark, sf), second(spark, sf))}).select("label", "median", "probability_gt_0"))


def o14_error_bars(spark, sf):
    return rounded(op.error_bars(op.paired_summary(pairs(spark, sf))).select("error_low", "error_high"))


def o15_sensitivity(spark, sf):
    curve = boot_means(spark, sf)
    parts = None
    for width in (3, 5, 7):
        p = fits.plateau(fits.centred_dimension(curve, ["b"], "t", "p", width), ["b"], "t", "ds", 5).select("b", "plateau_mean")
        parts = p if parts is None else parts.unionByName(p)
    return rounded(op.value_range(parts, ["b"], "plateau_mean"))


def o17_split(spark, sf):
    from .fixtures import curve

    return rounded(op.split_at(curve(spark, sf), "t", 20))


def o18_common_range(spark, sf):
    from .fixtures import curve

    c = curve(spark, sf)
    return rounded(op.common_range(c.filter("t <= 12"), c, "t"))


def p_left_join(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "region").filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


def q_set_operations(spark, sf):
    customers, suppliers = (table(spark, sf, t).select(F.col(c).alias("nation")).distinct() for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    common = customers.intersect(suppliers).withColumn("kind", F.lit("both"))
    return common.unionByName(customers.exceptAll(suppliers).withColumn("kind", F.lit("customers only")))


def q_event_documents(spark, sf):
    """Nested documents in text: the first path that is there, and a document made of what was found."""
    e = table(spark, sf, "events")
    value = F.coalesce(*[F.get_json_object("props", p) for p in ("$.missing.path", "$.k", "$.page", "$.a")])
    return e.select("event_id", F.to_json(F.struct("event_type", F.col("user_id"))).alias("doc"), value.isNotNull().alias("found"))


QUERIES = {f.__name__: f for f in (o1_paired, o1_paired_summary, o2_pair_counts, o3_all_pairs_quantile, o4_independent, o5_all_pairs_ratio, o6_ratio_bounds, o7_prediction, o8_kaplan_meier, o9_survival_quantile, o10_censored, o11_groups, o11_probability, o12_differences, o13_flattened, o14_error_bars, o15_sensitivity, o17_split, o18_common_range, p_left_join, q_set_operations, q_event_documents)}


def plateau_of(source: str, name: str, extra: str = "") -> str:
    return f"{windowed(source, ['b'], 't', 'p', 7, source + '_s')}, {name} AS (SELECT b, CASE WHEN b % 9 <> 0 {extra} THEN round(CASE WHEN count(*) >= 3 THEN avg(ds) END, 6) END AS value FROM {source}_s WHERE t >= 5 AND ds IS NOT NULL GROUP BY b)"


SAMPLES = f"{TRACE}, {boot(EVEN, 'e')}, {boot(ODD, 'o', False)}, {plateau_of('e', 'fs')}, {plateau_of('o', 'sn', 'AND b % 7 <> 0')}"
PAIRS = f"{SAMPLES}, pairs AS (SELECT b, fs.value AS first, sn.value AS second, sn.value - fs.value AS delta, (sn.value - fs.value) / fs.value AS fraction FROM fs JOIN sn USING (b) WHERE fs.value IS NOT NULL AND sn.value IS NOT NULL)"
ALL = f"{SAMPLES}, x AS (SELECT f.value AS a, s.value AS b FROM fs f, sn s WHERE f.value IS NOT NULL AND s.value IS NOT NULL)"
PAIRED_SUMMARY = f"SELECT {quantiles('delta')}, count(*) AS n, round(avg((delta > 0)::INT), 6) AS probability_gt_0, round(avg((delta < 0)::INT), 6) AS probability_lt_0 FROM pairs"
WIDTHS = ", ".join(windowed("boot", ["b"], "t", "p", w, f"w{w}") for w in (3, 5, 7))
ORACLE_SQL = {
    "o1_paired": f"WITH {PAIRS} SELECT b, first, second, round(delta, 6) AS delta, round(fraction, 6) AS fraction FROM pairs",
    "o1_paired_summary": f"WITH {PAIRS} {PAIRED_SUMMARY}",
    "o2_pair_counts": f"WITH {ALL} SELECT count(*) AS n_pairs, count(*) FILTER (b < a) AS n_below, count(*) FILTER (b = a) AS n_equal, count(*) FILTER (b > a) AS n_above FROM x",
    "o3_all_pairs_quantile": f"WITH {ALL}, d AS (SELECT b - a AS d, row_number() OVER (ORDER BY b - a) AS i, count(*) OVER () AS n FROM x) SELECT round(min(d), 6) AS median_difference FROM d WHERE i >= 0.5 * n",
    "o4_independent": f"WITH {ALL} SELECT count(*) AS n_pairs, round(avg((b > a)::INT), 6) AS probability_gt_0, round(avg((b < a)::INT), 6) AS probability_lt_0 FROM x",
    "o5_all_pairs_ratio": f"WITH {ALL} SELECT {quantiles('a / b')}, count(*) AS n_pairs FROM x",
    "o6_ratio_bounds": f"WITH {SAMPLES}, a AS (SELECT quantile_cont(value, 0.16) AS l, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.84) AS h FROM fs), b AS (SELECT quantile_cont(value, 0.16) AS l, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.84) AS h FROM sn) SELECT round(a.m / b.m, 6) AS ratio, round(a.l / b.h, 6) AS ratio_low, round(a.h / b.l, 6) AS ratio_high FROM a, b",
    "o7_prediction": f"WITH {PAIRS} SELECT {quantiles('delta')}, count(*) AS n, round(quantile_cont(second / first, 0.5), 6) AS ratio_median, round(quantile_cont(fraction, 0.5), 6) AS fraction_median, round(avg((abs(delta) < 0.05)::INT), 6) AS probability_close, round(avg((delta > 0)::INT), 6) AS probability_gt_0, round(corr(first, second), 6) AS correlation FROM pairs",
    "o8_kaplan_meier": f"WITH {KM} SELECT time, n_events, at_risk, round(survival, 6) AS survival FROM km",
    "o9_survival_quantile": f"WITH {KM} SELECT min(time) FILTER (survival <= 0.5 + 1e-12) AS quantile FROM km",
    "o10_censored": f"WITH {SURVIVAL}, x AS (SELECT event, time - custkey % 800 AS d FROM survival) SELECT count(*) AS n, count(*) FILTER (event) AS n_observed, round(quantile_cont(d::DOUBLE, 0.5) FILTER (event), 6) AS offset_median, round(quantile_cont(d::DOUBLE, 0.5), 6) AS lower_bound_median, round(avg((d > 0)::INT), 6) AS probability_bound_gt_0 FROM x",
    "o11_groups": f"SELECT c_mktsegment = 'BUILDING' AS flag, {quantiles('c_acctbal')}, count(*) AS n FROM customer GROUP BY 1",
    "o11_probability": "WITH x AS (SELECT a.c_acctbal AS a, b.c_acctbal AS b FROM customer a, customer b WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment <> 'BUILDING') SELECT count(*) AS n_pairs, round(avg(CASE WHEN b > a THEN 1 WHEN b = a THEN 0.5 ELSE 0 END), 6) AS probability FROM x",
    "o12_differences": f"WITH {TRACE}, {boot(EVEN, 'e')}, {boot(ODD + ' AND diffusion_time <= 20', 'o', False)}, {windowed('e', ['b'], 't', 'p', 7, 'es')}, {windowed('o', ['b'], 't', 'p', 7, 'os')}, d AS (SELECT t, os.ds - es.ds AS d FROM es JOIN os USING (b, t)) SELECT 'odd' AS run, t, {quantiles('d')}, count(d) AS n FROM d GROUP BY t",
    "o13_flattened": f"WITH {PAIRS}, x AS (SELECT f.value AS a, s.value AS b FROM fs f, sn s WHERE f.value IS NOT NULL AND s.value IS NOT NULL) SELECT 'paired' AS label, round(quantile_cont(delta, 0.5), 6) AS median, round(avg((delta > 0)::INT), 6) AS probability_gt_0 FROM pairs UNION ALL SELECT 'independent', NULL, round(avg((b > a)::INT), 6) FROM x",
    "o14_error_bars": f"WITH {PAIRS} SELECT round(quantile_cont(delta, 0.5) - quantile_cont(delta, 0.16), 6) AS error_low, round(quantile_cont(delta, 0.84) - quantile_cont(delta, 0.5), 6) AS error_high FROM pairs",
    "o15_sensitivity": f"WITH {TRACE}, {boot()}, {WIDTHS}, m AS ("
    + " UNION ALL ".join(f"SELECT b, avg(ds) AS v FROM w{w} WHERE t >= 5 AND ds IS NOT NULL GROUP BY b" for w in (3, 5, 7))
    + ") SELECT b, round(min(v), 6) AS least, round(max(v), 6) AS most, round(max(v) - min(v), 6) AS spread FROM m GROUP BY b",
    "o17_split": f"WITH {TRACE}, c AS (SELECT diffusion_time AS t, round(avg(individual_trace_estimate), 6) AS p FROM trace GROUP BY 1) SELECT t, p, 'main' AS part FROM c WHERE t <= 20 UNION ALL SELECT t, p, 'extended' FROM c WHERE t >= 20",
    "o18_common_range": f"WITH {TRACE}, c AS (SELECT diffusion_time AS t, round(avg(individual_trace_estimate), 6) AS p FROM trace GROUP BY 1) SELECT t, p, 'first' AS run FROM c WHERE t <= 12 UNION ALL SELECT t, p, 'second' FROM c WHERE t <= 12",
    "p_left_join": "SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey",
    "q_set_operations": "SELECT nation, 'both' AS kind FROM (SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT nation, 'customers only' FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
    "q_event_documents": "SELECT event_id, json_object('event_type', event_type, 'user_id', user_id)::VARCHAR AS doc, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.page'), json_extract_string(props, '$.a')) IS NOT NULL AS found FROM events",
}
