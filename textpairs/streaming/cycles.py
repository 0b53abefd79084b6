"""Endless, sharded, shuffled stream over a fixed set of text files.

Source. ``cycle_stream`` replays the files of a manifest (path, lines, first line index) as cycles 0, 1,
2, ... without end or up to a number. Its offset is (cycle, file), kept in the query's own checkpoint, so a
restart goes on at the file it stopped at. What the source itself yields are orders of one file each;
executors read the ordered files in Arrow batches, so memory follows neither files nor cycles. After a
cycle's last file every shard gets an end mark.

Shuffle. ``shuffled`` keeps a buffer of at most ``size`` rows per shard in streaming state. Rows enter in the
order of their index; once the buffer is full each new row takes the place of a drawn one, which leaves, and
the end mark lets the rest go in a drawn order. A draw is a hash of (seed, cycle, shard, number of the
row in its shard), so the result is the same however rows fall into micro-batches and after a restart. A
cycle in which a shard gave no row is an error.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

SOURCE = "textpairs_cycles"
STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
GIVEN = 10_000  # rows that a buffer hands on at once
ORDER = "cycle bigint, file_no bigint, path string, first bigint, last boolean"
LINE = "cycle bigint, raw_idx bigint, value string, shard bigint, ended boolean"


# ------------------------------------------------------------------------------ source

def manifest(spark: SparkSession, folder: str, glob: str = "*") -> list[tuple[str, int, int]]:
    """(path, lines, index of the first line) of the folder's text files in path order, counted by Spark.
    One entry a file; a folder without files is an error."""
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(folder)
             .select(F.col("_metadata.file_path").alias("path")))
    rows = sorted((r["path"], r["n"]) for r in lines.groupBy("path").agg(F.count("*").alias("n")).collect())
    if not rows:
        raise ValueError(f"no lines in {folder}")
    out, first = [], 0
    for path, n in rows:
        out.append((path, n, first))
        first += n
    return out


class _Orders(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["manifest"])
        self.cycles, self.step = int(options.get("cycles", 0)), int(options.get("filespertrigger", 1))

    def initialOffset(self) -> dict:
        return {"cycle": 0, "file": 0}

    def _walk(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        cycle, file, rows = start["cycle"], start["file"], []
        while (len(rows) < self.step) if end is None else ((cycle, file) < (end["cycle"], end["file"])):
            if self.cycles and cycle >= self.cycles:
                break
            path, _, first = self.files[file]
            file += 1
            last = file == len(self.files)
            rows.append((cycle, file - 1, path, first, last))
            if last:
                cycle, file = cycle + 1, 0
        return rows, {"cycle": cycle, "file": file}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._walk(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._walk(start, end)[0])


class CycleSource(DataSource):
    """Orders to read one file each, cycle after cycle."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return ORDER

    def simpleStreamReader(self, schema) -> _Orders:
        return _Orders(self.options)


def _lines(path: str, size: int = 1 << 20) -> Iterator[list[str]]:
    """Lines of a file in lists of about ``size`` bytes, split at line feeds only."""
    from pyarrow import fs
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    rest = b""
    with where.open_input_stream(name) as f:
        while chunk := f.read(size):
            *whole, rest = (rest + chunk).split(b"\n")
            if whole:
                yield [x.removesuffix(b"\r").decode("utf-8", "replace") for x in whole]
    if rest:
        yield [rest.removesuffix(b"\r").decode("utf-8", "replace")]


def cycle_stream(spark: SparkSession, files: list[tuple[str, int, int]], shards: int = 1, cycles: int = 0,
                 files_per_trigger: int = 1, tasks: int | None = None) -> DataFrame:
    """K01 + J03: (cycle, raw_idx, value, shard, ended) of the manifest's files, ``cycles`` times (0: without
    end). ``shard`` is ``raw_idx % shards`` (J01); an end mark per shard follows each cycle."""
    spark.dataSource.register(CycleSource)
    orders = (spark.readStream.format(SOURCE).option("manifest", json.dumps(files)).option("cycles", cycles)
              .option("filesPerTrigger", files_per_trigger).load())
    names = [f.split()[0] for f in LINE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches):
        for b in batches:
            for o in b.to_pylist():
                at = o["first"]
                for lines in _lines(o["path"]):
                    idx = range(at, at + len(lines))
                    at += len(lines)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([o["cycle"]] * len(lines), pa.int64()), pa.array(idx, pa.int64()), pa.array(lines, pa.string()),
                        pa.array([i % shards for i in idx], pa.int64()), pa.array([False] * len(lines))], schema=schema)
                if o["last"]:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([o["cycle"]] * shards, pa.int64()), pa.array([at] * shards, pa.int64()), pa.nulls(shards, pa.string()),
                        pa.array(range(shards), pa.int64()), pa.array([True] * shards)], schema=schema)

    n = tasks or max(1, min(files_per_trigger, spark.sparkContext.defaultParallelism))
    return orders.repartition(n, "cycle", "file_no").mapInArrow(read, LINE)


# ------------------------------------------------------------------------------ shuffle

def draw(seed: int, cycle: int, shard: int, n: int, of: int) -> int:
    """Number in [0, of) for the ``n``-th draw of a shard's cycle."""
    return int(hashlib.md5(f"{seed}:{cycle}:{shard}:{n}".encode()).hexdigest()[:15], 16) % of


class Buffer(StatefulProcessor):
    """State of one shard: the buffer's rows by slot, and (cycle, rows seen, rows given)."""

    def __init__(self, columns: list[str], schema: StructType, size: int, seed: int):
        self.columns, self.schema, self.size, self.seed = columns, schema, size, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot bigint", self.schema)
        self.mark = handle.getValueState("mark", "cycle bigint, seen bigint, given bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (shard,) = key
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["cycle", "raw_idx", "ended"], kind="stable")
        cycle, seen, given = self.mark.get() if self.mark.exists() else (0, 0, 0)
        before = {int(k[0]): tuple(v) for k, v in self.slots.iterator()} if self.slots.exists() else {}
        # rows go by their places: those of the buffer by slot, then the batch's
        kept = [before[slot] for slot in range(len(before))]
        new = batch[self.columns].astype(object).where(batch[self.columns].notna(), None)
        values = [self._column([row[j] for row in kept], new[c]) for j, c in enumerate(self.columns)]
        held, out = list(range(len(kept))), []
        for at, (ended, in_cycle) in enumerate(zip(batch["ended"].tolist(), batch["cycle"].tolist()), len(kept)):
            if not ended:
                cycle = in_cycle
                if len(held) < self.size:
                    held.append(at)
                else:
                    slot = draw(self.seed, cycle, shard, seen, self.size)
                    out.append(held[slot])
                    held[slot] = at
                    given += 1
                seen += 1
                continue
            if not seen:
                raise ValueError(f"cycle without output in shard {shard}")
            order = list(range(len(held)))
            for i in range(len(order) - 1, 0, -1):  # Fisher and Yates
                j = draw(self.seed, cycle, shard, seen + i, i + 1)
                order[i], order[j] = order[j], order[i]
            out += [held[i] for i in order]
            held, seen, given, cycle = [], 0, 0, cycle + 1
        for slot, at in enumerate(held):
            if at != slot or slot >= len(kept):
                self.slots.updateValue((slot,), tuple(v[at] for v in values))
        for slot in range(len(held), len(kept)):
            self.slots.removeKey((slot,))
        self.mark.update((cycle, seen, given))
        for i in range(0, len(out), GIVEN):
            yield pd.DataFrame({c: v[out[i:i + GIVEN]] for c, v in zip(self.columns, values)})

    @staticmethod
    def _column(kept: list, new: pd.Series) -> np.ndarray:
        out = np.empty(len(kept) + len(new), dtype=object)
        out[:len(kept)] = kept
        out[len(kept):] = new.to_numpy()
        return out

    def close(self) -> None:
        pass


def shuffled(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """The rows of a cycle stream (with ``cycle``, ``raw_idx``, ``shard``, ``ended`` and what was made of the
    line) without the end marks, mixed within a buffer of ``size`` rows per shard; 0 leaves the order."""
    columns = [c for c in rows.columns if c != "ended"]
    if size <= 0:
        return rows.where("NOT ended").select(*columns)
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "ended"])
    return (rows.groupBy("shard").transformWithStateInPandas(Buffer(columns, schema, size, seed), schema, "Append", "None"))


def state_partitions(spark: SparkSession, shards: int) -> int:
    """Partitions for the state of ``shards`` shards: as few as spread them best. Each has a store that is opened and
    committed in every micro-batch, so their number must not follow the session's, which follows the corpus."""
    hashes = [r[0] for r in spark.range(shards).select(F.hash("id")).collect()]
    return min(range(shards, 4 * shards + 1), key=lambda n: (max(Counter(h % n for h in hashes).values()), n))


@contextmanager
def stateful(spark: SparkSession, shards: int | None = None):
    """Around the start of a shuffled stream: the state store that its keyed state needs and, when the number of
    shards is given, the partitions (a stream that goes on from a checkpoint keeps those it began with)."""
    confs = {STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if shards:
        confs[PARTITIONS] = str(state_partitions(spark, shards))
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_available(rows: DataFrame, out: str, checkpoint: str, shards: int | None = None) -> None:
    """Append all rows of a stream with a last cycle to a Parquet folder, exactly once; run again with the
    same checkpoint, it goes on where it stopped."""
    with stateful(rows.sparkSession, shards):
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
