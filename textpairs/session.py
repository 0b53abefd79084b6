"""Session construction, scratch space and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "textpairs") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or os.environ.get("TEXTPAIRS_SHUFFLE_PARTITIONS")
    if parts:  # else the cluster's own setting
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", os.environ.get("TEXTPAIRS_MAX_PARTITION_BYTES", "64m"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TEXTPAIRS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


# What the readers need of any session: of a repeated JSON key the last value counts.
DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"
# A generated method above HotSpot's limit of 8000 bytes is interpreted for ever; such a stage runs operator
# by operator instead, each in methods that the JVM compiles.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the library needs, for a session that was built elsewhere too."""
    spark.conf.set(DUPLICATE_KEYS, "true")
    spark.conf.set(*METHOD_LIMIT)
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    Taken from the session (``spark.checkpoint.dir`` or an already set checkpoint dir).
    Only when neither is set on a local master (local runs and tests) a private temporary
    folder is used; on a cluster, where executors could not read it, this is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="textpairs-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root for a derived table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/scratch/{'/'.join([*_RUNS, ''])}{name}-{uuid.uuid4().hex[:12]}"


_RUNS: list[str] = []


@contextmanager
def scratch_run(spark: SparkSession):
    """Scratch tables written inside are removed at the end: for a caller that has read or written its
    results by then. Runs may be nested; nothing else in the scratch folder is touched."""
    _RUNS.append(f"run-{uuid.uuid4().hex[:12]}")
    folder = f"{checkpoint_root(spark).rstrip('/')}/scratch/{'/'.join(_RUNS)}"
    try:
        yield folder
    finally:
        _RUNS.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Largest side we ship to every executor; dimension tables (vocabulary, confusion sets, label
# maps) are far below it.
BROADCAST_BYTE_LIMIT = 32 * 1024 * 1024


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of constants as a local relation, whose size the optimizer knows (one made from Python
    rows is an RDD of unknown size)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in fields], fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields))


def plan_size_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of ``df`` (exact for local relations, huge where unknown)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Broadcast ``df`` when the optimizer's size estimate, in bytes, is within the bound.

    No job is run for it. Otherwise the unhinted frame is returned: the planner uses a
    shuffled join and AQE converts it at run time if the real size allows.
    """
    return F.broadcast(df) if plan_size_bytes(df) <= max_bytes else df


# Rows of a counted table that is shipped: narrow rows (keys and a number) of some 64 bytes.
BROADCAST_ROW_LIMIT = 400_000


def counted_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast the narrow table ``df`` when it has at most ``max_rows`` rows, counted exactly.

    ``df`` is written first (checkpoint) and so computed once, and what comes back is the written
    table: for aggregates whose size the optimizer can only bound by their input's."""
    checkpoint_root(df.sparkSession)
    kept = df.checkpoint(eager=True)
    return F.broadcast(kept) if kept.count() <= max_rows else kept
