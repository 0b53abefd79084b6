"""Operator 6, SimHash near-duplicates with anchor points of a covering code.

Fingerprint: majority vote over the XXH64 hashes (seed 42) of the text's four-word shingles.
Links: pairs at ``MAX_BITS`` = 4 or fewer differing bits.

Search. Four differing bits leave one 32-bit half with at most two. The anchors of a half are the
words of the perfect Hamming [31,26] code, covering radius 1, on its low 31 bits, beside its top
bit. Between two halves that differ in two bits lies a word at distance one from each, and
that word's anchor is within 1 + 1 bits of both; so every fingerprint is replicated to all anchors
within covering radius plus one (at most 17 of 2^27 per half), and every link meets in at
least one of them. Equal fingerprints are one row before this, so copies cost nothing.

Per anchor the members are compared in sorted Arrow batches; what leaves a task is a spanning
forest of the links found, at most one edge per member, never all pairs. An anchor with more than
``GROUP`` members is cut into hashed blocks, and pairs of blocks are compared in separate groups.

Edge cases: null, empty or blank text has fingerprint zero and links like any other; repeated rows
and equal texts share a fingerprint; a null doc_id is passed through and never a component's id
unless the whole component has none (then null); an empty table gives no rows; other columns,
clashing names included, are ignored (``deduplicate`` keeps them).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow_map, arrow_schema, cut, map_columns, table, unused
from .components import connected_components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
GROUP = 2048


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[SHINGLE - 1:])),
                             dtype=np.uint64, count=len(words) - SHINGLE + 1)
    n, votes = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 255):  # counts of a chunk fit a byte
        bits = np.unpackbits(hashes[i:i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, out: str = "fp", text: str = "text") -> DataFrame:
    """The input with a bigint column ``out`` (a clashing one is replaced)."""
    docs = docs.select(*[c for c in docs.columns if c != out])
    full = StructType([*docs.schema.fields, StructField(out, LongType())])
    sch = arrow_schema(full)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            fps = np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], schema=sch)

    return arrow_map(docs, run, full)


# ------------------------------------------------------------------------------ anchors

def _syndrome(a: np.ndarray) -> np.ndarray:
    """Hamming [31,26] syndrome: XOR of the 1-based places of the set bits."""
    s = np.zeros(a.shape, dtype=np.uint64)
    for k in range(5):
        mask = np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1))
        s |= (np.bitwise_count(a & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return s


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors within covering radius plus one of each fingerprint's halves.
    An anchor is half number, top bit and 31-bit code word."""
    one, rows, found = np.uint64(1), [], []
    at = np.arange(len(fps))
    for half in (0, 1):
        word = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        low, top = word & np.uint64(0x7FFFFFFF), word >> np.uint64(31)
        s = _syndrome(low)
        home = np.where(s > 0, low ^ (one << (s - one * (s > 0))), low)
        tag = np.uint64(half) << np.uint64(32)
        for t in (top, top ^ one):  # the step may also go to the top bit
            rows.append(at)
            found.append(tag | t << np.uint64(31) | home)
        for i in range(1, 32):  # code words two steps away: places i < j with i ^ j = syndrome
            j = s ^ np.uint64(i)
            ok = (s > 0) & (j > np.uint64(i))
            rows.append(at[ok])
            found.append((tag | top << np.uint64(31) | low ^ (one << np.uint64(i - 1)))[ok] ^ (one << (j[ok] - one)))
    return np.concatenate(rows), np.concatenate(found)


def _replicas(distinct: DataFrame) -> DataFrame:
    """(anchor, fp) for every fingerprint of the one-column table ``distinct``."""
    def run(batch: pa.RecordBatch):
        fps = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(fps), 20_000):
            part = fps[i:i + 20_000]
            row, anchor = anchors(part)
            yield {"anchor": pa.array(anchor.view(np.int64)), "fp": pa.array(part[row].view(np.int64))}

    return map_columns(distinct.select("fp"), "anchor bigint, fp bigint", run)


# ----------------------------------------------------------------------------- comparing

def _merge(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union of the links (u, v) into the forest ``root`` (smallest member leads)."""
    while True:
        ru, rv = root[u], root[v]
        if not (ru != rv).any():
            return root
        low = np.minimum(ru, rv)
        np.minimum.at(root, ru, low)
        np.minimum.at(root, rv, low)
        while (nxt := root[root]).tobytes() != root.tobytes():
            root = nxt


def forest(group: np.ndarray, block: np.ndarray, fps: np.ndarray, max_bits: int = MAX_BITS):
    """Spanning forest of the links inside each run of equal ``group`` (rows sorted by it): pairs
    (member, root) as fingerprints. Groups of two different blocks compare across blocks only."""
    n = len(fps)
    root, pending, held = np.arange(n), [], 0
    i = np.arange(n)
    for k in range(1, n):
        i = i[i + k < n]
        i = i[group[i] == group[i + k]]
        if not len(i):
            break
        hit = (np.bitwise_count(fps[i] ^ fps[i + k]) <= max_bits) & ((block[i] < 0) | (block[i] != block[i + k]))
        if hit.any():
            pending.append((i[hit], i[hit] + k))
            held += len(pending[-1][0])
            if held > 1_000_000:
                root = _merge(root, *(np.concatenate(x) for x in zip(*pending)))
                pending, held = [], 0
    if pending:
        root = _merge(root, *(np.concatenate(x) for x in zip(*pending)))
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(u, v) edges whose components are those of all links between distinct fingerprints."""
    if max_bits > MAX_BITS:
        raise ValueError("the anchors cover up to four differing bits")
    rep = _replicas(distinct)
    crowded = cut(rep.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > group)
                  .select("anchor", F.ceil(F.col("n") / group).cast("int").alias("s")), "anchors")
    own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    pairs = F.when(F.col("s").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("s") - 1),
                    lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"))))
    keyed = (rep.join(crowded, "anchor", "left")
             .select("anchor", "fp", own.alias("own"), F.explode(pairs).alias("p"))
             # block -1: compare all members of the group
             .select("anchor", "p.i", "p.j", F.when(F.col("p.i") == F.col("p.j"), -1)
                     .otherwise(F.col("own")).alias("block"), "fp"))
    keyed = keyed.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp")
    sch = arrow_schema("u bigint, v bigint")

    def run(batches):
        rest: list[np.ndarray] | None = None

        def edges(cols, size):
            a, i, j, block, fp = (c[:size] for c in cols)
            new = np.ones(size, dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            u, v = forest(np.cumsum(new), block, fp.view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=sch)

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            a, i, j = cols[:3]
            same = (a == a[-1]) & (i == i[-1]) & (j == j[-1]) if len(a) else np.zeros(0, bool)
            done = len(a) - int(same.sum())  # the last group may go on in the next batch
            if done:
                yield edges(cols, done)
            rest = [c[done:] for c in cols]
        if rest is not None and len(rest[0]):
            yield edges(rest, len(rest[0]))

    return arrow_map(keyed, run, "u bigint, v bigint").distinct()


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """From (doc_id, fp) rows: (fp, component_id, rep_fp), one row per distinct fingerprint.
    The component's representative is its smallest doc_id and that document's fingerprint."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    comp = connected_components(links(distinct, max_bits))
    rooted = cut(distinct.join(comp, distinct["fp"] == comp["node"], "left")
                 .select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    # a struct with null first compares lowest, so null ids are set behind all others
    lead = cut(rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("m"))
               .select("root", F.col("m.first").alias("component_id"), F.col("m.fp").alias("rep_fp")), "leads")
    return cut(rooted.join(lead, "root").select("fp", "component_id", "rep_fp"), "classes")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    fps = cut(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"), "doc-fp")
    return fps.join(classes(fps).select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The input's columns and rows, one document of each component: the smallest doc_id. Of
    repeated rows of that document one stays."""
    names = docs.columns
    fp, lead, rep = unused(docs, "fp_", "lead_id", "lead_fp")
    marked = cut(with_fingerprint(docs, fp), "docs-fp")
    found = classes(marked.select("doc_id", F.col(fp).alias("fp")))
    keep = found.select(F.col("component_id").alias(lead), F.col("rep_fp").alias(rep)).distinct()
    return (marked.join(keep, marked["doc_id"].eqNullSafe(keep[lead]) & (marked[fp] == keep[rep]), "left_semi")
            .dropDuplicates(["doc_id", fp]).select(*names))


def op6_simhash(spark, sf_dir) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return components(table(spark, sf_dir, "documents"))
