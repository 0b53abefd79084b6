"""Operator 7, packing of tokenised documents into sequences of at most ``CAPACITY`` tokens.

A document's ids are those of a public byte-level tokenizer followed by the end id. Documents over
the capacity are cut into full pieces, the first one taking the remainder; full pieces fill a
sequence alone, so one piece per document is left to pack.

Those are dealt by hash into groups of about ``GROUP`` pieces, whatever the corpus size, and each
group is packed by the sum-of-squares rule, longest piece first: of the open bins that have room,
take the residual gap for which the sum over gaps of (open bins with that gap) squared becomes
smallest; open a bin only when nothing fits. The state is one counter per gap. A group's loss is
a fraction of a per cent plus its last bin, so grouping costs about 1 sequence in GROUP / 2.

Edge cases: null text counts as empty and is the end id alone; a null doc_id is passed through;
repeated rows are packed each time; equal lengths go by row; an empty table gives no rows; other
columns, clashing names included, are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, cut, table

CAPACITY, END_ID, GROUP, TOKENIZER = 1024, 2, 16_384, "byte_bpe_50k.json"
CACHE_WORDS = 800_000

# Fixed value: the published word pattern of this vocabulary family, with its letter and number classes
# written out for the characters of PLAIN, whose classes are the same in every Unicode version. Texts of
# those alone are split here and their words encoded once each; any other text, and every text for a tokenizer of
# another family, goes to the tokenizer whole.
PLAIN = re.compile(r"[\t\n\r -~¡-ɏ‐-‧‰-⁞€]*+")
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")


def splits_by_word(spec: dict) -> bool:
    """Whether a ``tokenizers`` file cuts texts by WORD and nothing else, so that words may be encoded on their own."""
    cut_ = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and cut_.get("type") == "ByteLevel" and cut_.get("use_regex", True)
            and not cut_.get("add_prefix_space", True) and (spec.get("model") or {}).get("dropout") is None)


class Encoder:
    """Token ids (little-endian uint32 bytes) of whole texts by a ``tokenizers`` file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        if not os.path.isabs(path):
            import public_tokenizers
            path = public_tokenizers.path(path)
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.words = splits_by_word(json.load(f))
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.words and PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        split = [WORD.findall(t) if p else None for t, p in zip(texts, plain)]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = list(set().union(*(ws for ws in split if ws)).difference(self.known))
        self.known.update(zip(new, self._whole(new)))
        rest = iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        get = self.known.__getitem__
        return [next(rest) if ws is None else b"".join(map(get, ws)) for ws in split]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process, so its words serve all the tasks that run there."""
    return Encoder(path)


def _slices(texts: list[str], chars: int = 2_000_000):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = True) -> DataFrame:
    """One row per piece: iid (unique number), doc_id, piece, start, length, ids_crc32 and, if wanted, ids.
    Written once, so that every later reading sees the same iid."""
    schema = "iid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    sch = arrow_schema(schema)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        tok, next_iid = encoder(tokenizer), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _slices(texts):
                doc, num, start, length, crc, parts = [], [], [], [], [], []
                for i, raw in enumerate(tok.encode(texts[lo:hi]), lo):
                    raw += end
                    total, view = len(raw) // 4, memoryview(raw)
                    at, p = 0, 0
                    while at < total:
                        n = (total % capacity or capacity) if p == 0 else capacity
                        doc.append(i)
                        num.append(p)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * at:4 * (at + n)]))
                        at, p = at + n, p + 1
                    parts.append(raw)
                iid = np.arange(next_iid, next_iid + len(doc), dtype=np.int64)
                next_iid += len(doc)
                cols = [pa.array(iid), batch.column(0).take(pa.array(doc, pa.int64())), pa.array(num, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)]).astype(np.int32)
                    ids = np.frombuffer(b"".join(parts), dtype="<u4").view(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)).cast(sch.field("ids").type))
                yield pa.RecordBatch.from_arrays(cols, schema=sch)

    return cut(arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema), "pieces")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given (longest first is best)."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by residual gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    none = np.iinfo(np.int64).max
    for i, x in enumerate(lengths.tolist()):
        have = count[x:capacity]  # gaps x and up; a closed bin has no gap and counts nothing
        # (n - 1)^2 - n^2 for the gap left, (m + 1)^2 - m^2 for the gap reached (none when closed)
        gain = 2 * count[:capacity - x] + 1
        gain[:1] = 0
        cost = np.where(have > 0, gain - 2 * have + 1, none)
        j = int(cost.argmin()) if len(cost) else 0
        if len(cost) and have[j]:
            gap = x + j
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        if gap > x:
            open_bins[gap - x].append(b)
            count[gap - x] += 1
        bins[i], offsets[i] = b, capacity - gap
    return bins, offsets


def place(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows that have iid and length (any other columns stay)."""
    full = (parts.where(F.col("length") >= capacity)
            .withColumn("sequence_id", -F.col("iid") - 1).withColumn("offset", F.lit(0).cast("bigint")))
    short = parts.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))
    dealt = (short.withColumn("_g", F.pmod(F.xxhash64("iid"), F.lit(groups)).cast("bigint"))
             .repartition("_g").sortWithinPartitions("_g", F.desc("length"), "iid"))
    names = parts.columns
    schema = full.schema
    sch = arrow_schema(schema)

    def packed(rows: pa.Table):
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        g = rows["_g"][0].as_py()
        out = rows.select(names).append_column("sequence_id", pa.array((g << 32) + bins))
        yield from out.append_column("offset", pa.array(offsets)).cast(sch).to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                g = b.column(b.schema.get_field_index("_g")).to_numpy()
                n = int(np.searchsorted(g, g[0], side="right"))
                if held and held[0].column(held[0].schema.get_field_index("_g"))[0].as_py() != g[0]:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(0, n))
                b = b.slice(n)
        if held:
            yield from packed(pa.Table.from_batches(held))

    return full.unionByName(arrow_map(dealt, run, schema))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces with their ids and places: doc_id, piece, start, length, ids, sequence_id, offset."""
    parts = pieces(docs, tokenizer)
    placed = place(parts.select("iid", "length")).select("iid", "sequence_id", "offset")
    return parts.join(placed, "iid").select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def digest(docs: DataFrame) -> DataFrame:
    """Places of all pieces with the crc32 of their ids instead of the ids."""
    return place(pieces(docs, with_ids=False)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_packing(spark, sf_dir) -> DataFrame:
    """Sum-of-squares packing of all documents into sequences of at most 1024 tokens."""
    return digest(table(spark, sf_dir, "documents"))
