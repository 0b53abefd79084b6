"""Shared plumbing: table access, lineage cuts, Arrow batch mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

# ASCII white space, the only white space of the word rule ``[^\x20\x09-\x0D]+``.
WS = "[ \\t\\n\\x0B\\f\\r]"

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared checkpoint folder and read it back:
    lineage ends there, so a lost executor costs only its running tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return to_arrow_schema(st)


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with record batches of about ``BATCH_BYTES``, however long the texts are, so that
    a task's memory does not follow the length of its rows."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, schema: str,
                fn: Callable[[pa.RecordBatch], Iterator[dict[str, object]]]) -> DataFrame:
    """:func:`arrow_map` with a generator of column dicts."""
    sch = arrow_schema(schema)
    names = sch.names

    def run(batches):
        for b in batches:
            if b.num_rows:
                for cols in fn(b):
                    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=sch.field(n).type)
                              for n, c in ((n, cols[n]) for n in names)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=sch)

    return arrow_map(df, run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and bind it for ``body`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_bucket(key: Column, n: int = 4) -> Column:
    """crc32 of the key's decimal text, modulo ``n`` (null key: null)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one like it that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
