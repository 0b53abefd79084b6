"""Files scanned in byte ranges and put together again in order.

Spark's text source cuts files into splits at a separator and reads them in parallel. What a reader of one
whole file would know at each place (inside a string or not, how deep, which line) is computed per range
for every state it could begin in and composed over the ranges in order, so a single file of any
size is many tasks and gives the same result however it is cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.text import chars
from ..plans.indexing import line_index, row_index
from ..session import checkpoint_root

# ---------------------------------------------------------------- A12: inventory


def list_files(spark: SparkSession, folder: str | Sequence[str], glob: str = "*", allow_example: bool = False) -> DataFrame:
    """(file_path, file_name, n_bytes) of the files below ``folder`` whose name matches, read from the
    listing alone. No file, or a name with ``.example.`` unless allowed, is an error before any scan. Spark's
    readers do not list files of no bytes: they count as absent here and below."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
             .select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"),
                     F.col("length").alias("n_bytes")))
    found = files.agg(F.count("*").alias("n"), F.min(F.when(F.col("file_name").contains(".example."), F.col("file_path"))).alias("example")).first()
    if not found["n"]:
        raise FileNotFoundError(f"no file matches {glob} below {folder}")
    if found["example"] and not allow_example:
        raise ValueError(f"example file as input: {found['example']}")
    return files


def lines_of(spark: SparkSession, folder: str | Sequence[str], glob: str = "*") -> DataFrame:
    """(file_path, idx, value): lines as they stand between line feeds (a carriage return stays), ``idx``
    from 0 in each file."""
    read = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(folder))
    lines = line_index(read).select("file_path", F.col("line_idx").alias("at"), "value")
    first = lines.groupBy("file_path").agg(F.min("at").alias("first"))  # one row a file
    from ..session import counted_broadcast
    return lines.join(counted_broadcast(first), "file_path").select("file_path", (F.col("at") - F.col("first")).alias("idx"), "value")


def text_inventory(spark: SparkSession, folder: str | Sequence[str], glob: str = "*", allow_example: bool = False) -> DataFrame:
    """One row per text file with its bytes, lines and rows (lines that are not blank); splits are
    counted on their own and added up."""
    files = list_files(spark, folder, glob, allow_example)
    counts = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(folder)
              .select(F.col("_metadata.file_path").alias("file_path"), "value").groupBy("file_path")
              .agg(F.count("*").alias("n_lines"), F.count_if(F.trim(F.translate("value", "\t\r\x0b\x0c", "    ")) != "").alias("n_rows")))
    return files.join(counts, "file_path").select("file_path", "file_name", "n_bytes", "n_lines", "n_rows")


# ---------------------------------------------------------------- A21: digests over ranges

FAN = 1024


def tree_digests(leaves: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """(group, n, digest): one digest per group. ``FAN`` consecutive digests in order (``order`` counts
    from 0 in each group) become the digest of their concatenation, until each group has one; a
    group of one leaf is that leaf. No task holds more than ``FAN`` digests of a node."""
    level = leaves.select(F.col(group).alias("g"), F.col(order).alias("i"), F.col(digest).alias("h"))
    sizes = leaves.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = level.groupBy("g", F.floor(F.col("i") / FAN).alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("r"))
        alone = (F.size("r") == 1) & (F.col("i") == 0)  # a group that is done already
        level = run.select("g", "i", F.when(alone, F.col("r.h")[0]).otherwise(F.sha2(F.array_join("r.h", ""), 256)).alias("h"))
        most = -(-most // FAN)
    return level.select("g", "h").join(sizes, "g").select(F.col("g").alias(group), "n", F.col("h").alias(digest))


def file_digests(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(name, n_bytes, n_lines, digest) per file. Lines are hashed in parallel, whatever the file's size, and
    composed in order; the digest covers the file's bytes, since its length tells whether it ends in a
    line feed. Names are relative to the folder."""
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    files = list_files(spark, folder, glob, allow_example=True)
    lines = lines_of(spark, folder, glob).select("file_path", "idx", F.sha2(F.col("value").cast("binary"), 256).alias("digest"))
    lines = lines.checkpoint()  # digests only; each level reads them again
    made = tree_digests(lines, "file_path", "idx", "digest")
    return files.join(made, "file_path").select(
        F.element_at(F.split("file_path", f"/{root}/", 2), -1).alias("name"), "n_bytes", F.col("n").alias("n_lines"),
        F.sha2(F.concat_ws(":", F.col("n_bytes").cast("string"), F.col("n").cast("string"), "digest"), 256).alias("digest"))


def corpus_digest(files: DataFrame) -> DataFrame:
    """One row (n_files, n_bytes, corpus_digest) over the files' names and digests in name order."""
    leaf = files.select("name", F.sha2(F.concat_ws(":", "name", "digest"), 256).alias("corpus_digest"))
    placed = row_index(leaf, ["name"], out_col="i").withColumn("all", F.lit(1))
    whole = tree_digests(placed, "all", "i", "corpus_digest")
    return files.agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes")).crossJoin(
        F.broadcast(whole.select("corpus_digest")))  # one row beside one row


# ---------------------------------------------------------------- A11: one JSON array, in parallel

_ESCAPED = re.compile("\\\\[^\n\r\x85\u2028\u2029]")
_COUNTS = pa.map_(pa.int64(), pa.int64())
_SPAN = pa.schema([("file_path", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()), ("out", pa.int64()),
                   ("out_at", _COUNTS), ("in", pa.int64()), ("in_at", _COUNTS)])
_GROUP = pa.schema([("file_path", pa.string()), ("block", pa.int64()), ("obj", pa.int64()), ("text", pa.string()),
                    ("ended", pa.int32()), ("left", pa.int64())])
GROUP_CHARS = 1 << 22  # of texts handed back at once


def _step(piece: str) -> tuple[int, tuple[int, int]]:
    """Quotes of a piece that ends in front of a closing brace (without escaped ones), and the change of depth up
    to that brace, when the piece begins outside strings and when it begins inside of one."""
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    out, inside = "".join(parts[::2]), "".join(parts[1::2])
    return len(parts) - 1, (out.count("{") + out.count("[") - out.count("]"),
                            inside.count("{") + inside.count("[") - inside.count("]"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Neighbouring rows that differ in their last column alone: what they share, and that column's values."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    return ((key, (row[-1] for row in run)) for key, run in groupby(rows, key=lambda row: row[:-1]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: its quotes, and for both possible starts the change of depth and how many braces outside
    strings close at which depth (counted from the range's start)."""
    for (path, block), pieces in _runs(batches):
        quotes, depth, at = 0, [0, 0], (Counter(), Counter())
        for piece in pieces:
            n, change = _step(piece)
            for start in (0, 1):
                closes = (quotes + n + start) % 2 == 0
                depth[start] += change[(quotes + start) % 2] - closes
                if closes:
                    at[start][depth[start]] += 1
            quotes += n
        yield _batch([(path, block, quotes, depth[0], list(at[0].items()), depth[1], list(at[1].items()))], _SPAN)


def _groups(borders: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The objects' texts, from ranges whose start is known: those that lie in one range, or else (``borders``) the
    parts of those that a range's border may cut. The text behind a file's last object comes last."""
    def found(batches):
        for (path, block, inside, depth, obj, first, last), pieces in _runs(batches):
            if depth is None:
                raise ValueError(f"files are cut into other ranges than when they were scanned: {path}")
            held, cut, state = [], not first, [inside, depth]

            def take(piece, brace, state=state, held=held):
                n, change = _step(piece)
                closes = brace and (state[0] + n) % 2 == 0  # the piece's brace is not in a string
                state[1] += change[state[0] % 2] - closes
                state[0] += n
                held.append(piece + "}" if brace else piece)
                return closes and state[1] == 1

            piece = next(pieces)
            for following in pieces:
                if take(piece, True):
                    if cut == borders:
                        yield path, block, obj, "".join(held), 1, None
                    held.clear()
                    obj, cut = obj + 1, False
                piece = following
            ended = take(piece, not last)
            if (cut or not (last or ended)) == borders:
                yield path, block, obj, "".join(held), int(ended), state[1] if last else None

    def run(batches):
        rows, size = [], 0
        for row in found(batches):
            rows.append(row)
            size += len(row[3])
            if size > GROUP_CHARS:
                yield _batch(rows, _GROUP)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _GROUP)

    return run


def json_array_objects(spark: SparkSession, path: str | Sequence[str], glob: str = "*") -> DataFrame:
    """(file_path, obj, json): the objects of files that hold one JSON array of objects each, in order.

    Pieces end at closing braces and come in their order in each range. A first pass makes one row per range, for
    both possible starts: the quotes (without escaped ones), the change of depth, and the closing braces by depth.
    Composed in order these give the state at each range's start and the number of objects before it. The
    second pass finds in each range the braces that end an object of the array; a piece belongs to the object that
    the next of those ends. No text is kept or shuffled but that of objects cut by a range's border, which a
    pass of its own puts together. Text between objects other than commas and the array's brackets is an error."""
    read = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "}").text(path))
    pieces = read.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), "value")
    checkpoint_root(spark)
    spans = pieces.mapInArrow(_spans, from_arrow_schema(_SPAN)).checkpoint()  # one row a range, as all that follows here
    order = Window.partitionBy("file_path").orderBy("block")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = spans.withColumn("inside", F.pmod(before("quotes"), F.lit(2)))
    for c, name in ((F.col("out"), "in"), (F.col("out_at"), "in_at")):
        s = s.withColumn(name, F.when(F.col("inside") == 1, F.col(name)).otherwise(c))
    s = s.withColumn("depth", before("in"))
    s = s.withColumn("obj", before(F.coalesce(F.try_element_at("in_at", 1 - F.col("depth")), F.lit(0))))
    starts = s.select("file_path", "block", "inside", "depth", "obj", F.lag("block").over(order).isNull().alias("first"),
                      F.lead("block").over(order).isNull().alias("last"))
    group = from_arrow_schema(_GROUP)
    placed = pieces.join(F.broadcast(starts.checkpoint()), ["file_path", "block"], "left").select(*starts.columns, "value")
    cut = placed.mapInArrow(_groups(True), group).groupBy("file_path", "obj").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "text")))["text"], "").alias("text"),
        F.sum("ended").alias("ended"), F.max("left").alias("left"))  # at most two rows a range
    whole = placed.mapInArrow(_groups(False), group).select("file_path", "obj", "text", "ended", "left").unionByName(cut.checkpoint())
    rest = F.trim(F.translate("text", "\t\r\n", "   "))
    bad = lambda: F.raise_error(F.concat(F.lit("not a JSON array of objects: "), F.col("file_path")))
    first = F.col("obj") == 0
    body = F.regexp_replace("text", r"^[\s,\[]*", "")
    opener = F.regexp_extract("text", r"^([\s,\[]*)", 1)
    mark = F.regexp_replace(opener, r"\s", "")
    ok_object = (F.col("ended") == 1) & F.when(first, mark == "[").otherwise(mark == ",") & body.startswith("{")
    ok_tail = (F.col("ended") == 0) & (F.col("left") == 0) & F.when(first, rest.rlike(r"^\[\s*\]$")).otherwise(rest == "]")
    return (whole.withColumn("json", F.when(ok_object, body).when(ok_tail, F.lit(None)).otherwise(bad()))
            .where("json IS NOT NULL").select("file_path", "obj", "json"))


def read_message_array(spark: SparkSession, path: str | Sequence[str], glob: str = "*") -> DataFrame:
    """Saved messages from JSON arrays of ``{src, trg, pred}``, scanned in parallel, with char lists and the
    object's number in its file."""
    m = F.from_json("json", "src string, trg string, pred string", {"mode": "FAILFAST"})
    rows = json_array_objects(spark, path, glob).select("file_path", "obj", m.alias("m")).select("file_path", "obj", "m.*")
    return rows.select("*", *[chars(c).alias(f"{c}_tokens") for c in ("src", "trg", "pred")])
