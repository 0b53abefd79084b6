"""Structured Streaming jobs.

The stream is a growing folder of JSONL pair files read with the file source
(``maxFilesPerTrigger`` bounds memory, exactly-once file tracking in the checkpoint).
The same Column functions as the batch path parse, classify and lay out the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, layouts, metrics, vocab as V
from ..sources.readers import with_json_pair


def pair_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1,
                blank_as: str = "empty") -> DataFrame:
    """Streaming scan of JSONL pairs (src, tgt, valid, error, file_path)."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger).load(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("file_path"), "value")
    return with_json_pair(lines, "value", blank_as=blank_as).select("file_path", "valid", "error", "src", "tgt")


def classified_stream(stream: DataFrame, vocab: DataFrame, max_seq: int = 128) -> DataFrame:
    """B03 on the stream (stream-static broadcast of the vocabulary map)."""
    return clean.classify_pairs(stream.withColumn("src", F.coalesce("src", F.lit("")))
                                .withColumn("tgt", F.coalesce("tgt", F.lit(""))), vocab, max_seq)


def feature_stream(classified: DataFrame, vocab: DataFrame, max_seq: int = 128) -> DataFrame:
    """Accepted rows encoded and laid out as I01 training features."""
    cv = V.CharVocab(vocab)
    acc = clean.encode_accepted(classified, cv)
    f = layouts.rephrase_stream("src_ids", "tgt_ids", max_seq, *(cv.id_of(x) for x in (V.CLS, V.SEP, V.MASK, V.PAD)))
    return acc.select("file_path", f.alias("f")).select("file_path", "f.*")


def append(rows: DataFrame, out: str, checkpoint: str):
    """Rows to a Parquet folder, exactly once (the sink's own commit log)."""
    return (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def route(classified: DataFrame, good: str, bad: str, checkpoint: str):
    """Accepted rows to one folder, rejected rows (with reason) to another, without stopping
    the stream. Each micro-batch overwrites its own ``batch_id=`` folder, so a retried batch leaves
    one copy; the batch is computed once for both. Returns the started query (availableNow)."""
    def write(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        held.where(F.col("reason") == "accepted").select("src", "tgt") \
            .write.mode("overwrite").parquet(f"{good}/batch_id={epoch}")
        held.where(F.col("reason") != "accepted").select("file_path", "reason", "error", "src", "tgt") \
            .write.mode("overwrite").parquet(f"{bad}/batch_id={epoch}")
        held.unpersist()
    return (classified.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def running_stats(classified: DataFrame) -> DataFrame:
    """Stateful counters per reason (tokens and UNKs too)."""
    return classified.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tok").cast("bigint").alias("n_tok"),
                                            F.sum("n_unk").cast("bigint").alias("n_unk"))


def snapshot(agg: DataFrame, out: str, checkpoint: str):
    """Write the complete aggregate state after each micro-batch (overwrite);
    restarting with the same checkpoint resumes the counts (exactly-once file source)."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)
    return (agg.writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def running_eval(triples: DataFrame, by: list[str]) -> DataFrame:
    """Outcome counts as a streaming aggregate; ratios are computed on read
    (``metrics.ratios``)."""
    return metrics.outcome_counts(metrics.with_outcome(triples), by)
