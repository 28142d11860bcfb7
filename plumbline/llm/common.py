"""Shared folders, table access and small column helpers of the training-data operators.

Intermediate tables are Parquet in the folder named by ``spark.checkpoint.dir``, which every
executor sees, so that a lost executor costs a re-read and never a recomputation of the lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches between the JVM and Python hold so many bytes at most, whatever the rows' lengths.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in a local session that names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}-{name}"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_BYTES``, so that no task's memory follows the texts' lengths;
    a session that has set a bound of its own, below Spark's default, keeps it."""
    now = spark.conf.get(_BATCHES, None)
    if now is None or now.rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def trim_driver(spark: SparkSession) -> None:
    """Has the driver's JVM give freed native memory back to the system: planning and compiling many small
    queries otherwise leaves over a hundred MB with its allocator.  A JVM without that command goes on as it is."""
    jvm = spark.sparkContext._jvm
    try:
        # The server's own class is not exported, so its method is called by the interface.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 1)
        args[2][0], args[3][0] = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0), "[Ljava.lang.String;"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and returns a DataFrame that reads it back.

    No ``_SUCCESS`` is left: a failed write raises, and on a local file system the driver would start two programs
    for it, each a moment long a second process with all of the driver's memory.
    """
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def every_column(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of ``df`` (or those named), whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names or df.columns]


def scanned(df: DataFrame) -> DataFrame:
    """``df`` itself if it is read straight from files, so that its rows keep their numbers whenever it is
    read; else a stored copy.  Operators that number rows and come back to them start from this."""
    small_batches(df.sparkSession)
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    plain = all(line.strip(" :+-").startswith(("Project", "Filter", "Relation")) for line in lines if line.strip())
    return df if plain and len(df.inputFiles()) else stored(df, "rows")


def keep_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``df`` (a scan) whose monotonically_increasing_id() is among ``rows`` (row), with its columns."""
    own = fresh(df, "row")
    kept = rows.select(F.col("row").alias(own))
    return df.withColumn(own, F.monotonically_increasing_id()).join(kept, own, "left_semi").select(*every_column(df))


def or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint only where the counted rows are within ``limit``; else the planner's own join.

    ``limit`` bounds bytes only for rows of fixed size: callers pass ids, numbers and hashes, not texts.
    """
    return F.broadcast(df) if rows <= limit else df


def shuffle_parts(spark: SparkSession, df: DataFrame | None = None, per_part: int = 48 << 20) -> int:
    """Partitions for data of the size Catalyst estimates, never under the session's own number."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df is None:
        return least
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(200_000, size // per_part + 1))
