"""Sinks (A14-A20) and the corpus fingerprint (A21). All writes are distributed
(one file set per partition); nothing is collected to the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import annotate_text, punct_equal_text


def committed(spark: SparkSession, folder: str) -> bool:
    """Whether the job that wrote ``folder`` ended: its commit mark is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_lines(rows: DataFrame, folder: str, value: str, order: Sequence[str | Column] = (), partition_by: str | None = None,
                made: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Text lines of column ``value``, in files whose path order is ``order`` (within a partition folder
    too). A value with a line feed is an error, since it could not be read back. ``made`` adds ``value`` to
    the ordered rows, so that the shuffle carries only what it is made of. Returns the rows written, after
    checking the commit mark."""
    line = F.when(F.instr(value, "\n") > 0, F.raise_error(F.lit("line feed in a line"))).otherwise(F.coalesce(F.col(value), F.lit("")))
    seen = Observation()
    if order:
        spark = rows.sparkSession
        keys = [c if isinstance(c, Column) else F.col(c) for c in order]
        rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
        rows = rows.sortWithinPartitions(*([F.col(partition_by)] if partition_by else []), *keys)
    rows = made(rows) if made else rows
    out = rows.select(*([partition_by] if partition_by else []), line.alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).text(folder)
    if not committed(rows.sparkSession, folder):
        raise OSError(f"no commit mark in {folder}")
    return seen.get["n"]


def read_committed(spark: SparkSession, folder: str, fmt: str = "text", schema: str | None = None) -> DataFrame:
    """What a finished job wrote, partition folders as columns; a folder without a commit mark is an error."""
    if not committed(spark, folder):
        raise OSError(f"no commit mark in {folder}: not written to the end")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(fmt).load(folder)


def bucket_rows(triples: DataFrame, src: str = "src", tgt: str = "tgt", pred: str = "pred") -> DataFrame:
    """A14 rows: one row per (sentence, bucket) with the annotation of that bucket.

    tp and fn annotate (s,t); fp annotates (t,p); wp annotates (s,p). A sentence is in at
    most one of tp/fn/wp (positives) or fp (negatives).
    """
    s, t, p = F.col(src), F.col(tgt), F.col(pred)
    bucket = (F.when((s != t) & (p == t), F.lit("tp"))
              .when((s != t) & (p == s), F.lit("fn"))
              .when((s != t), F.lit("wp"))
              .when(p != t, F.lit("fp")))
    ann = (F.when(F.col("bucket").isin("tp", "fn"), annotate_text(s, t))
           .when(F.col("bucket") == "fp", annotate_text(t, p))
           .when(F.col("bucket") == "wp", annotate_text(s, p)))
    return triples.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).withColumn("annotation", ann)


def write_buckets(rows: DataFrame, folder: str, order: Sequence[str | Column] = ()) -> int:
    """Text files per bucket (``bucket=tp/`` ...)."""
    return write_lines(rows, folder, "annotation", order, "bucket")


def response_line(src_tokens: str | Column, trg_tokens: str | Column, pred_tokens: str | Column) -> Column:
    """``input: … <TAB>label: … <TAB>prediction: … <TAB>correct|wrong``."""
    s, t, p = (F.col(x) if isinstance(x, str) else x for x in (src_tokens, trg_tokens, pred_tokens))
    verdict = F.when(t == p, F.lit("correct")).otherwise(F.lit("wrong"))
    return F.concat(F.lit("input: "), F.array_join(s, " "), F.lit("\tlabel: "), F.array_join(t, " "),
                    F.lit("\tprediction: "), F.array_join(p, " "), F.lit("\t"), verdict)


def write_responses(df: DataFrame, folder: str, line_col: str = "line", order: Sequence[str | Column] = (),
                    made: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Response lines."""
    return write_lines(df, folder, line_col, order, made=made)


def prediction_type(input_text: str | Column, prediction: str | Column) -> Column:
    """``correct`` when input and prediction are punctuation-blind equal."""
    return F.when(punct_equal_text(input_text, prediction), F.lit("correct")).otherwise(F.lit("wrong"))


def write_predictions(df: DataFrame, folder: str) -> None:
    """JSONL ``{input, prediction, type}``."""
    df.select("input", "prediction", "type").write.mode("overwrite").json(folder)


def write_messages(df: DataFrame, folder: str) -> None:
    """Messages as JSONL (not one array: splittable)."""
    df.select("src", "trg", "pred").write.mode("overwrite").json(folder)


def append_runs(df: DataFrame, path: str) -> None:
    """Append-only evaluation log."""
    df.write.mode("append").parquet(path)


CATEGORY_ORDER = ["gam", "enc", "cot", "mec", "car", "nov", "new", "sig"]


def report_json(per_cat: DataFrame, category: str, metrics: Sequence[str], dropped: Sequence[str],
                average: DataFrame, order: Sequence[str] = CATEGORY_ORDER) -> DataFrame:
    """One JSON document: ``results`` per category in the fixed order (unknown
    categories after them), each with its ``dropped`` counts, plus ``average``."""
    pos = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(category))
    entry = F.struct(F.upper(F.col(category)).alias("cat"), *[F.col(m) for m in metrics],
                     F.struct(*[F.col(d) for d in dropped]).alias("dropped"))
    ranked = per_cat.select(F.when(pos > 0, pos).otherwise(F.lit(len(order) + 1)).alias("_o"), F.col(category).alias("_c"), entry.alias("e"))
    res = ranked.agg(F.sort_array(F.collect_list(F.struct("_o", "_c", "e"))).alias("_r"))
    res = res.select(F.map_from_entries(F.transform("_r", lambda x: F.struct(x["e"]["cat"], x["e"].dropFields("cat")))).alias("results"))
    avg = average.select(F.struct(*average.columns).alias("average"))
    return res.crossJoin(avg).select(F.to_json(F.struct("results", "average")).alias("report"))


def write_shards(df: DataFrame, folder: str, rows_per_file: int = 100_000, fmt: str = "text") -> None:
    """Corpus shards of at most ``rows_per_file`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).format(fmt).save(folder)


def fingerprint(spark: SparkSession, folder: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """sha256 per file under ``folder`` (found and read by Spark, in parallel), then sha256 over
    the sorted ``name:digest`` lines, names relative to the folder: a moved corpus keeps its digest.
    Returns (per-file digests, one-row corpus summary).

    A file is read whole by one task (binaryFile), so this is for corpus files up to 2 GB.
    """
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    name = F.element_at(F.split("path", f"/{root}/", 2), -1)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
             .select(name.alias("name"), "length", F.sha2(F.col("content"), 256).alias("digest")))
    lines = F.sort_array(F.collect_list(F.struct("name", "digest")))
    total = files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"),
                      F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x["name"], F.lit(":"), x["digest"])), "\n"), 256).alias("corpus_digest"))
    return files, total


def content_digest(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A21 on rows: number and order-free checksum of the rows (sum of 32 bits of each row's md5)."""
    row = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in cols])
    bits = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bits).alias("checksum"))
