"""Inputs that the queries derive from the test tables, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, graph, spatial

BOX, K, PROBES, REPLICATES = 100.0, 6, 16, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums have no fixed order; minus zero is zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as places in the box. Keys and squares are taken modulo the prime, so that no product leaves 64 bits, however large the keys."""
    p = "(cast(p_partkey as bigint) % 1000003)"
    square = f"({p} * {p} % 1000003)"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id",
        f"(({square} * 7919 + {p} * 104729) % 1000003) / cast(1000003 as double) * 100 as x",
        f"(({square} * 15485863 + {p} * 32452843) % 1000003) / cast(1000003 as double) * 100 as y",
        f"(({square} * 49979687 + {p} * 67867967) % 1000003) / cast(1000003 as double) * 100 as z",
    )


POINTS = """points AS (
  SELECT p_partkey AS id,
    ((p_partkey * p_partkey * 7919 + p_partkey * 104729) % 1000003) / 1000003::DOUBLE * 100 AS x,
    ((p_partkey * p_partkey * 15485863 % 1000003 + p_partkey * 32452843) % 1000003) / 1000003::DOUBLE * 100 AS y,
    ((p_partkey * p_partkey * 49979687 % 1000003 + p_partkey * 67867967) % 1000003) / 1000003::DOUBLE * 100 AS z
  FROM part)"""


def d2(a: str, b: str) -> str:
    """Squared periodic distance of two table aliases in SQL."""
    return " + ".join(f"pow(least(abs({a}.{c} - {b}.{c}), 100 - abs({a}.{c} - {b}.{c})), 2)" for c in "xyz")


def neighbours(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return spatial.nearest_neighbours(points(spark, sf_dir), k, BOX)


KNN = f"""{POINTS}, knn AS (
  SELECT src, rank, dst, sqrt(d2) AS dist FROM (
    SELECT a.id AS src, b.id AS dst, {d2("a", "b")} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {d2("a", "b")}, b.id) AS rank
    FROM points a JOIN points b ON a.id <> b.id
  ) WHERE rank <= {K})"""


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbour_graph(neighbours(spark, sf_dir))


GRAPH = f"""{KNN}, graph AS (
  SELECT src, dst, 1.0::DOUBLE AS w FROM knn UNION SELECT dst, src, 1.0::DOUBLE FROM knn),
deg AS (SELECT src AS id, sum(w) AS degree FROM graph GROUP BY src)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe trace: days are times, users modulo 16 are probes."""
    return table(spark, sf_dir, "events").filter("value > 0").groupBy((F.col("user_id") % PROBES).cast("int").alias("probe_index"), F.dayofmonth("ts").alias("diffusion_time")).agg((F.avg("value") * F.first(F.pow(F.dayofmonth("ts").cast("double"), F.lit(-1.5)))).alias("individual_trace_estimate"))


TRACE = f"""trace AS (
  SELECT (user_id % {PROBES})::INT AS probe_index, day(ts)::INT AS diffusion_time, avg(value) * pow(day(ts), -1.5) AS individual_trace_estimate
  FROM events WHERE value > 0 GROUP BY 1, 2, day(ts))"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).groupBy(F.col("diffusion_time").alias("t")).agg(F.avg("individual_trace_estimate").alias("p"))


CURVE = f"""{TRACE}, curve AS (SELECT diffusion_time AS t, avg(individual_trace_estimate) AS p FROM trace GROUP BY diffusion_time)"""


def windowed(source: str, keys: list[str], x: str, y: str, width: int, name: str = "spectral") -> str:
    """Centred window fits of source in SQL: its columns with ds, r2, rms."""
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    h = width // 2
    return f"""{name} AS (
      SELECT * EXCLUDE (lx, ly, n, slope, rr, sxx, syy, sxy), CASE WHEN n = {width} THEN -2 * slope END AS ds, CASE WHEN n = {width} THEN rr END AS r2,
        CASE WHEN n = {width} THEN sqrt(greatest(0, syy - sxy * sxy / sxx) / {width}) END AS rms
      FROM (SELECT *, count(lx + ly) OVER w AS n, regr_slope(ly, lx) OVER w AS slope, regr_r2(ly, lx) OVER w AS rr, regr_sxx(ly, lx) OVER w AS sxx, regr_syy(ly, lx) OVER w AS syy, regr_sxy(ly, lx) OVER w AS sxy
        FROM (SELECT *, ln({x}::DOUBLE) AS lx, CASE WHEN {y} > 0 THEN ln({y}) END AS ly FROM {source})
        WINDOW w AS ({by}ORDER BY {x} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)))"""


SPECTRAL = f"{CURVE}, {windowed('curve', [], 't', 'p', 7)}"


def boot_means(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """b, t, p: resampled mean curves by the arithmetic draws."""
    counts = bootstrap.multiplicities(bootstrap.lattice_draws(spark, REPLICATES, PROBES))
    values = trace(spark, sf_dir).filter(where).withColumnRenamed("diffusion_time", "t")
    return bootstrap.resampled_means(values, counts, "probe_index", "t", "individual_trace_estimate").select("b", "t", F.col("mean").alias("p"))


def boot(where: str = "true", name: str = "boot", draws: bool = True) -> str:
    head = f"""draws AS (
      SELECT b, ((b * 1103 + i * 7919 + b * i * 31 + b * b * 17) % 10007) % {PROBES} AS unit, count(*) AS c
      FROM range({REPLICATES}) r(b), range({PROBES}) s(i) GROUP BY 1, 2), """ if draws else ""
    return f"""{head}{name} AS (
      SELECT b, diffusion_time AS t, sum(c * individual_trace_estimate) / sum(c) AS p
      FROM trace JOIN draws ON unit = probe_index WHERE {where} GROUP BY b, diffusion_time)"""


BOOT = f"{TRACE}, {boot()}"
BOOT_SPECTRAL = f"{BOOT}, {windowed('boot', ['b'], 't', 'p', 7, 'bs')}"


def persistent(condition: str, at: str, keys: list[str], n: int = 3) -> str:
    """SQL text: a run of n passes starts at this row."""
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    w = f"OVER ({by}ORDER BY {at} ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"(min(coalesce(({condition})::INT, 0)) {w} = 1 AND count(*) {w} = {n})"


def crossing(source: str, keys: list[str], at: str, margin: str, ok: str = "true", scale: str = "log", gate: bool = True, n: int = 3) -> str:
    """SQL of the interpolated persistent crossing per key: keys, crossing."""
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    lag = lambda e: f"lag({e}) OVER ({by}ORDER BY {at})"
    f, inverse = ("ln({}::DOUBLE)", "exp({})") if scale == "log" else ("({})::DOUBLE", "{}")
    between = inverse.format(f"{f.format('pt')} + ({f.format(at)} - {f.format('pt')}) * (0 - pm) / (m - pm)")
    usable = "pt IS NOT NULL AND pm < 0" + (" AND pok" if gate else "")
    groups = ", ".join(keys)
    return f"""SELECT {groups + "," if keys else ""} min_by(CASE WHEN {usable} THEN {between} ELSE {at}::DOUBLE END, {at}) FILTER (run) AS crossing FROM (
      SELECT *, {persistent("m >= 0 AND okk", at, keys, n)} AS run, {lag("m")} AS pm, {lag(at)} AS pt, {lag("okk")} AS pok
      FROM (SELECT *, ({margin})::DOUBLE AS m, coalesce({ok}, false) AS okk FROM {source})
    ) {"GROUP BY " + groups if keys else ""}"""


def quantiles(value: str, prefix: str = "") -> str:
    """SQL select list of the five quantiles, rounded."""
    return ", ".join(f"round(quantile_cont({value}, {q}), 6) AS {prefix}{n}" for n, q in bootstrap.QUANTILES.items())
