"""Session settings and the null policy."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(name: str = "perigraph", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time; conf is added as it is."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values are NULL everywhere: NaN would sort above all numbers and pass every >= test."""
    columns = columns or [c for c, kind in df.dtypes if kind in ("float", "double")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


#: A table is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 24 << 20


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted size is under BROADCAST_BYTES, else as it is. df should be cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local sessions get one of
    their own, and clusters an error, as a folder of one machine would lose rows."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        require(re.fullmatch(r"local(\[.*\])?", context.master) is not None, "spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="perigraph-"))
        found = context.getCheckpointDir()
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, column: str, dealt: bool = False) -> DataFrame:
    """materialize, bucketed by a column into as many buckets as the session's shuffles have partitions, so that joins and
    groups by the column move nothing. dealt: rows of a bucket are together already. The table stays in the catalog until drop_table."""
    spark, table = df.sparkSession, f"perigraph_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets, path = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_path(spark, name)
    (df if dealt else df.repartition(buckets, column)).write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
    out = spark.table(table)
    KEPT[id(out)] = (weakref.ref(out), table, path)
    return out


#: Name and folder of each table of materialize_by that is still in the catalog, by the DataFrame that reads it.
KEPT: dict[int, tuple[weakref.ref, str, str]] = {}


def drop_table(df: DataFrame) -> None:
    """Removes the table of materialize_by that df is, from the catalog and from the shared folder; other DataFrames are left."""
    held, table, path = KEPT.pop(id(df), (lambda: None, "", ""))
    if held() is not df:
        return
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
