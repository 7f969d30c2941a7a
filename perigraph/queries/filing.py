"""Sources and sinks: what is written comes back the same, checked against the tables that it was made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import columns
from ..operators import diffusion
from ..session import fresh_path, require
from ..sources import arrays, documents, files
from ..streaming import read_sample, sample_stream
from .fixtures import GRAPH, POINTS, TRACE, knn_graph, points, rounded, table, trace

TRACE_SCHEMA = "diffusion_time int, probe_index int, individual_trace_estimate double"


def ordered_trace(spark, sf):
    return trace(spark, sf).select("diffusion_time", "probe_index", "individual_trace_estimate")


def a3_points(spark, sf):
    """Points written as raw float32 parts and read by byte ranges; ids are row numbers."""
    path = fresh_path(spark, "a3")
    arrays.write_points(points(spark, sf), path)
    return rounded(arrays.read_points(spark, path), 3)


def a4_array(spark, sf):
    """A two-dimensional array of order totals, by customer and key."""
    path = fresh_path(spark, "a4")
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice as price", "cast(o_custkey as double) as customer")
    arrays.write_array(orders, path, ["o_orderkey"], ["price", "customer"])
    return rounded(arrays.read_array(spark, path), 2)


def a5_bundle(spark, sf):
    """A column of a deflated bundle; the other members are not read."""
    path = fresh_path(spark, "a5")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    arrays.write_bundle(lines, path, ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"])
    return arrays.read_bundle(spark, path, "l_partkey", ["row", "value"]).select("row", F.col("value").cast("long").alias("part"))


def a6_sparse_matrix(spark, sf):
    """The neighbour graph as compressed rows, and back."""
    path = fresh_path(spark, "a6")
    arrays.write_sparse_matrix(knn_graph(spark, sf), path)
    return arrays.read_sparse_matrix(spark, path)


def a17_raw_sink(spark, sf):
    """Bytes of the parts of a raw table, and that a second write is refused."""
    path = fresh_path(spark, "a17")
    arrays.write_points(points(spark, sf), path)
    try:
        arrays.write_points(points(spark, sf), path)
        refused = False
    except Exception:  # noqa: BLE001 - Spark's own error around the sink's
        refused = True
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return parts.agg(F.sum("length").alias("bytes")).withColumn("overwrite_refused", F.lit(refused))


#: A draw that any engine can repeat; for comparisons, not for statistics.
DRAW = "(l_orderkey * 1000003 + l_partkey * 7919 + l_suppkey * 31 + l_linenumber * 104729) % 2147483647"


def b5_reservoir(spark, sf):
    """The lines of all orders, arriving as four files in two batches, and the sample that the stream's reservoirs hold."""
    path, columns = fresh_path(spark, "b5"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = table(spark, sf, "lineitem").select(*columns)
    lines.repartition(4).write.parquet(f"{path}/lines")
    rows = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/lines")
    sample_stream(rows, 200, columns, f"{path}/sample", f"{path}/checkpoint", draw=F.expr(DRAW)).awaitTermination()
    return read_sample(spark, f"{path}/sample", 200, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")


def b14_required(spark, sf):
    """Columns that a table of points must have: their sums; a table that lacks one is refused."""
    p = columns.require_columns(points(spark, sf), ["id", "x", "y", "z"])
    try:
        columns.require_columns(p.drop("z"), ["id", "x", "y", "z"])
        refused = False
    except ValueError:
        refused = True
    return rounded(p.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "xyz"]), 3).withColumn("refused", F.lit(refused))


def a7_csv(spark, sf):
    """A CSV table written in order and read with its schema."""
    path = fresh_path(spark, "a7")
    files.write_csv(ordered_trace(spark, sf), path, ["diffusion_time", "probe_index"])
    return rounded(spark.read.schema(TRACE_SCHEMA).option("header", True).csv(path))


def a8_commented_table(spark, sf):
    """Lines of two numbers between white space, among comments, words and values that are not positive."""
    path = fresh_path(spark, "a8")
    c = table(spark, sf, "customer")
    lines = c.select(F.expr("case when c_custkey % 11 = 0 then concat('# ', c_custkey) when c_custkey % 7 = 0 then concat('  ', c_custkey, '\t word') else concat(' ', c_custkey, if(c_custkey % 2 = 0, '  ', '\t'), c_acctbal) end").alias("value"))
    lines.write.text(path)
    return rounded(files.read_commented_table(spark, path, ["key", "balance"]))


def a9_probe_directory(spark, sf):
    """A folder for every time; rows are held against the time in its name."""
    path = fresh_path(spark, "a9")
    named = ordered_trace(spark, sf).withColumn("folder", F.format_string("t%06d", F.col("diffusion_time")))
    named.repartition("folder").write.partitionBy("folder").option("header", True).csv(path)
    rows = files.read_probe_directory(spark, path, TRACE_SCHEMA, r"folder=t0*([0-9]+)/")
    return rounded(rows.drop("file"))


def a10_discovery(spark, sf):
    """Tables below a folder by how many roles their headers fill, best first."""
    path = fresh_path(spark, "a10")
    t = ordered_trace(spark, sf)
    files.write_csv(t, f"{path}/whole", ["diffusion_time"])
    files.write_csv(t.select("diffusion_time"), f"{path}/times", ["diffusion_time"])
    files.write_csv(t.select(F.col("probe_index").alias("other")), f"{path}/other", ["other"])
    found = files.discover_tables(spark, path, {"time": ["t", "diffusion_time"], "value": ["individual_trace_estimate"]})
    best = {}
    for score, name in found:
        best.setdefault(name.split("/")[-2], score)
    return spark.createDataFrame(list(best.items()), "folder string, score int")


def a12_documents(spark, sf):
    """Nested documents, one to a nation; a value by the first of some paths that has one."""
    path = fresh_path(spark, "a12")
    n = table(spark, sf, "nation")
    nested = n.select(F.col("n_nationkey").alias("key"), F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name")).alias("best"), F.struct(F.struct(F.col("n_name").alias("name")).alias("deep")).alias("other"))
    documents.write_document(nested, path)
    read = spark.read.json(path)
    return read.select("key", documents.first_path(read, ["none.name", "best.name", "other.deep.name"]).alias("name"))


def a13_summary(spark, sf):
    """A nested summary, written as one document and read as one."""
    path = fresh_path(spark, "a13")
    t = ordered_trace(spark, sf)
    one = t.agg(F.count(F.lit(1)).alias("n"), F.struct(F.min("diffusion_time").alias("first"), F.max("diffusion_time").alias("last")).alias("times"))
    documents.write_document(one, path)
    read = documents.read_document(spark, path)
    return read.select("n", "times.first", "times.last")


def a15_append_once(spark, sf):
    """Overlapping parts, one of them twice: every time and probe stands once."""
    path = fresh_path(spark, "a15")
    t = ordered_trace(spark, sf)
    added = [files.append_times(t.filter(c), path) for c in ("diffusion_time <= 12", "diffusion_time >= 9", "diffusion_time <= 12")]
    return spark.read.parquet(path).groupBy("diffusion_time").agg(F.count(F.lit(1)).alias("n")).withColumn("added_again", F.lit(added[-1]).cast("long"))


def a19_checked_write(spark, sf):
    """Rows written; a second write to the same place and a wrong number of rows are refused."""
    t, path = ordered_trace(spark, sf), fresh_path(spark, "a19")
    n, refused = files.checked_write(t, path), []
    for where, expected in ((path, n), (f"{path}-more", n + 1)):
        try:
            files.checked_write(t, where, expected)
            refused.append(False)
        except Exception:  # noqa: BLE001 - Spark's own error, or the count's
            refused.append(True)
    return spark.createDataFrame([(n, *refused)], "n_rows long, overwrite_refused boolean, count_refused boolean")


def a20_saved_times(spark, sf):
    """Only states whose write was completed count as checkpoints."""
    folder = fresh_path(spark, "a20")
    state = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lit(1.0).alias("y0"))
    for time in (0, 4, 16):
        diffusion.save_state(state, folder, time)
    system, where = files.file_handle(spark, f"{folder}/step=16/_SUCCESS")
    require(system.delete(where, False), "no completion marker")
    return spark.createDataFrame([(t,) for t in diffusion.saved_times(spark, folder)], "time int")


def a21_digests(spark, sf):
    """The digest of a file of the regions' names, a line each."""
    path = fresh_path(spark, "a21")
    table(spark, sf, "region").orderBy("r_name").select("r_name").coalesce(1).write.text(path)
    return files.file_digests(spark, f"{path}/part-*").select("length", "sha256")


QUERIES = {f.__name__: f for f in (a3_points, a4_array, a5_bundle, a6_sparse_matrix, a17_raw_sink, b5_reservoir, b14_required, a7_csv, a8_commented_table, a9_probe_directory, a10_discovery, a12_documents, a13_summary, a15_append_once, a19_checked_write, a20_saved_times, a21_digests)}

ROWS = f"WITH {TRACE} SELECT diffusion_time, probe_index, round(individual_trace_estimate, 6) AS individual_trace_estimate FROM trace"
ORACLE_SQL = {
    "a3_points": f"WITH {POINTS} SELECT row_number() OVER (ORDER BY id) - 1 AS id, round(x::FLOAT, 3)::FLOAT AS x, round(y::FLOAT, 3)::FLOAT AS y, round(z::FLOAT, 3)::FLOAT AS z FROM points",
    "a4_array": """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_totalprice, o_custkey FROM orders)
        SELECT row, 0::BIGINT AS col, round(o_totalprice, 2) AS value FROM o UNION ALL SELECT row, 1::BIGINT, o_custkey::DOUBLE FROM o""",
    "a5_bundle": "SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) - 1 AS row, l_partkey AS part FROM lineitem",
    "a6_sparse_matrix": f"WITH {GRAPH} SELECT src, dst, w FROM graph",
    "a17_raw_sink": "SELECT (12 * count(*))::BIGINT AS bytes, true AS overwrite_refused FROM part",
    "b5_reservoir": f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem ORDER BY {DRAW}, l_orderkey LIMIT 200",
    "b14_required": f"WITH {POINTS} SELECT count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(z), 3) AS z, true AS refused FROM points",
    "a7_csv": ROWS,
    "a8_commented_table": "SELECT c_custkey::DOUBLE AS key, round(c_acctbal::DOUBLE, 6) AS balance FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AND c_acctbal > 0",
    "a9_probe_directory": ROWS,
    "a10_discovery": "SELECT * FROM (VALUES ('whole', 2), ('times', 1), ('other', 0)) t(folder, score)",
    "a12_documents": "SELECT n_nationkey AS key, n_name AS name FROM nation",
    "a13_summary": f"WITH {TRACE} SELECT count(*) AS n, min(diffusion_time)::BIGINT AS first, max(diffusion_time)::BIGINT AS last FROM trace",
    "a15_append_once": f"WITH {TRACE} SELECT diffusion_time, count(*) AS n, 0::BIGINT AS added_again FROM trace GROUP BY 1",
    "a19_checked_write": f"WITH {TRACE} SELECT count(*) AS n_rows, true AS overwrite_refused, true AS count_refused FROM trace",
    "a20_saved_times": "SELECT unnest([0, 4])::INT AS time",
    "a21_digests": "SELECT sum(strlen(r_name) + 1)::BIGINT AS length, sha256(string_agg(r_name, chr(10) ORDER BY r_name) || chr(10)) AS sha256 FROM region",
}
