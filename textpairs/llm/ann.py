"""Operator 9, approximate nearest neighbours by inner product over shifted Hilbert orderings.

Equal vectors are one class, which carries its ``K + 1`` smallest ids: more of them can never be in
a result, so a vector shared by a third of the rows costs one entry. Class vectors are lengthened by
one coordinate that makes all norms equal (largest inner product = nearest), rotated, and cut
into groups of ``DIMS`` projected coordinates; each group, shifted by a random offset, is one Hilbert
curve. Spark range-partitions every curve's keys and numbers them. On every curve a query is scored
against the items whose rank lies within its key window, no others; the best of all windows are merged
and reranked with exact scores. Blocks of ``BLOCK`` consecutive ranks only bound what a task holds at once.

The window is measured, not fixed: for ``SAMPLE`` queries (smallest hashes) the exact neighbours are
found by one scan, and the window is the key distance that reaches ``TARGET`` of them on at least
one curve. Data with structure get short windows, a small share of the rows; data without any (random
directions in many dimensions) get wide ones, at the recall asked for: no ordering helps there, and the
windows of all curves together may hold more items than the table has rows.

Edge cases: vectors that are null, zero, hold null or non-finite components, or are not of the
commonest length take no part, nor do rows without an id; equal scores go to the smaller id; repeated
rows count once; fewer candidates than ``K`` give fewer rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, cut, map_columns, table

K, EVERY = 20, 20
CURVES, DIMS, BITS, BLOCK, SPARE = 16, 8, 7, 4096, 4
SAMPLE, TARGET, SEED = 256, 0.96, 7


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each row of cell numbers (n, dims) on the Hilbert curve of that many bits a
    dimension: undo the excess rotations from the highest bit down, Gray-decode, interleave."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = (one << np.uint64(b)) - one
        for i in range(len(x)):
            up = (x[i] >> np.uint64(b) & one).astype(bool)
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, np.uint64(0)) ^ swap
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> np.uint64(b) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << one | (row >> np.uint64(b) & one)
    return key.astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    v = F.col("embedding")
    big = F.lit(float("inf"))
    rows = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0))
    dim = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size(v) == F.lit(dim["d"] if dim else 0))


def vector_classes(rows: DataFrame, is_query) -> DataFrame:
    """(cid, ids, embedding, asked): one row per different vector; ids are its K + 1 smallest."""
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= K + 1)
    kept = few.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    asked = rows.where(is_query).select("embedding").distinct().withColumn("asked", F.lit(True))
    return cut(kept.join(asked, "embedding", "left")
               .select(F.get("ids", F.lit(0)).alias("cid"), "ids", "embedding",
                       F.coalesce("asked", F.lit(False)).alias("asked")), "classes")


class Curves:
    """Projections, shifts and value ranges of all curves."""

    def __init__(self, dim: int, norm: float, curves: int = CURVES, dims: int = DIMS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dims, self.norm = min(dims, dim + 1), norm
        per = (dim + 1) // self.dims
        turns = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, :per * self.dims]
                 for _ in range(-(-curves // per))]
        self.axes = np.concatenate(turns, axis=1)[:, :curves * self.dims]
        self.shift = rng.random(self.axes.shape[1])
        self.low, self.high = np.zeros(self.axes.shape[1]), np.ones(self.axes.shape[1])

    def project(self, v: np.ndarray, query: bool) -> np.ndarray:
        size = np.linalg.norm(v, axis=1)
        if query:
            v, extra = v * (self.norm / size)[:, None], np.zeros(len(v))
        else:
            extra = np.sqrt(np.maximum(self.norm ** 2 - size ** 2, 0))
        return np.column_stack([v, extra]) @ self.axes

    def keys(self, v: np.ndarray, query: bool):
        """(curve, key of each row)."""
        y = (self.project(v, query) - self.low) / np.maximum(self.high - self.low, 1e-300)
        cells = np.clip((y + self.shift) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
        for c in range(self.axes.shape[1] // self.dims):
            yield c, hilbert(cells[:, c * self.dims:(c + 1) * self.dims])


def fit_curves(classes: DataFrame) -> Curves | None:
    """Largest norm, then the range of every projected coordinate: two passes, bounded results."""
    def norms(b: pa.RecordBatch):
        m = matrix(b.column(0))
        yield {"d": [m.shape[1]], "n": [float(np.linalg.norm(m, axis=1).max())]}

    top = map_columns(classes.select("embedding"), "d int, n double", norms).agg(F.max("d"), F.max("n")).first()
    if top[0] is None:
        return None
    curves = Curves(top[0], top[1])

    def ranges(b: pa.RecordBatch):
        y = curves.project(matrix(b.column(0)), False)
        yield {"i": list(range(y.shape[1])), "low": y.min(axis=0), "high": y.max(axis=0)}

    for r in map_columns(classes.select("embedding"), "i int, low double, high double", ranges).groupBy("i").agg(
            F.min("low").alias("low"), F.max("high").alias("high")).collect():
        curves.low[r["i"]], curves.high[r["i"]] = r["low"], r["high"]
    return curves


def ranks(classes: DataFrame, curves: Curves) -> DataFrame:
    """(curve, rank, query, cid): place of every item and query on every curve. Range partitions
    number their own rows; only their counts are added up."""
    def keyed(b: pa.RecordBatch):
        cid, v, asked = b.column(0), matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
        for query, pick in ((False, np.arange(len(v))), (True, np.flatnonzero(asked))):
            if len(pick):
                for c, key in curves.keys(v[pick], query):
                    yield {"curve": np.full(len(pick), c, np.int32), "key": key,
                           "query": np.full(len(pick), query), "cid": cid.take(pa.array(pick))}

    rows = map_columns(classes.select("cid", "embedding", "asked"),
                       "curve int, key bigint, query boolean, cid bigint", keyed)
    order = ["curve", "key", "cid", "query"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    sch = arrow_schema("part int, curve int, place bigint, query boolean, cid bigint")

    def number(batches):
        from pyspark import TaskContext
        part, last, nxt = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            c = b.column(0).to_numpy()
            first = np.searchsorted(c, c, side="left")
            place = np.arange(len(c)) - first + np.where(c == last, nxt, 0)
            last, nxt = int(c[-1]) if len(c) else last, int(place[-1]) + 1 if len(c) else nxt
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), b.column(0),
                                              pa.array(place.astype(np.int64)), b.column(2), b.column(3)], schema=sch)

    placed = cut(rows.mapInArrow(number, "part int, curve int, place bigint, query boolean, cid bigint"), "places")
    counts = placed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("curve", "part", F.coalesce(before, F.lit(0)).alias("off"))
    return cut(placed.join(offsets, ["curve", "part"]).select(
        "curve", (F.col("off") + F.col("place")).alias("rank"), "query", "cid"), "ranks")


def _best(scores: np.ndarray, n: int, cid: np.ndarray) -> np.ndarray:
    """Column numbers of the n largest of each row, ties to smaller ``cid``."""
    n = min(n, scores.shape[1])
    pick = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    least = np.take_along_axis(scores, pick, axis=1).min(axis=1)
    for r in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > n):
        tied = np.flatnonzero(scores[r] >= least[r])
        pick[r] = tied[np.lexsort((cid[tied], -scores[r, tied]))[:n]]
    return pick


def _top(scored: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("s"), "cid")
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def exact_top(classes: DataFrame, sample: DataFrame, n: int) -> DataFrame:
    """(q, cid, s): the n best classes for each class of the bounded table ``sample``, by a scan."""
    got = sample.select("cid", "embedding").collect()  # SAMPLE rows at most
    ids, q = np.array([r["cid"] for r in got]), np.array([r["embedding"] for r in got], dtype=np.float64)

    def scan(b: pa.RecordBatch):
        s = q @ matrix(b.column(1)).T
        pick = _best(s, n, b.column(0).to_numpy())
        yield {"q": np.repeat(ids, pick.shape[1]), "cid": b.column(0).take(pa.array(pick.ravel())),
               "s": np.take_along_axis(s, pick, axis=1).ravel()}

    return _top(map_columns(classes.select("cid", "embedding"), "q bigint, cid bigint, s double", scan), n)


def window(classes: DataFrame, places: DataFrame, target: float = TARGET, sample: int = SAMPLE) -> int:
    """Key distance that reaches ``target`` of the sampled queries' true neighbours."""
    some = classes.where("asked").orderBy(F.xxhash64("cid"), "cid").limit(sample)
    truth = exact_top(classes, some, K + 1).where("q != cid").select("q", "cid")  # SAMPLE * (K + 1) rows at most
    pairs = F.broadcast(truth)
    items = places.where(~F.col("query")).join(pairs, "cid").select("q", "cid", "curve", F.col("rank").alias("b"))
    own = F.broadcast(truth.select("q").distinct())
    asked = places.where("query").join(own, places["cid"] == own["q"]).select("q", "curve", F.col("rank").alias("a"))
    far = (items.join(asked, ["q", "curve"]).groupBy("q", "cid")
           .agg(F.min(F.abs(F.col("a") - F.col("b"))).alias("far")))
    return int(far.agg(F.percentile("far", F.lit(target)).alias("w")).first()["w"] or 0) + 1


def spans(rank: np.ndarray, near: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query rank the slice of the sorted item ranks ``near`` that its window holds."""
    return np.searchsorted(near, rank - reach), np.searchsorted(near, rank + reach, side="right")


def candidates(classes: DataFrame, places: DataFrame, reach: int, block: int = BLOCK, n: int = K + 1 + SPARE) -> DataFrame:
    """(q, cid, s): the best classes within ``reach`` ranks of each query on any curve, merged. A block of
    consecutive ranks is what a task holds at once; a query visits the blocks that its window touches
    and is scored there against the items inside the window alone."""
    spread = F.when(F.col("query"), F.sequence(F.greatest(F.lit(0), F.floor((F.col("rank") - reach) / block)),
                                               F.floor((F.col("rank") + reach) / block))
                    ).otherwise(F.array(F.floor(F.col("rank") / block)))
    dealt = (places.join(classes.select("cid", "embedding"), "cid")
             .select("curve", F.explode(spread).alias("block"), "query", "rank", "cid", "embedding")
             .repartition("curve", "block").sortWithinPartitions("curve", "block", "query", "rank", "cid"))
    sch = arrow_schema("q bigint, cid bigint, s double")

    def run(batches):
        at, ids, ranks_, vecs = None, [], [], []  # the block being read: items come before queries
        for b in batches:
            curve, blk, query, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cid, v = b.column(4).to_numpy(), matrix(b.column(5))
            edges = np.flatnonzero((np.diff(curve) != 0) | (np.diff(blk) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(curve)]):
                if lo == hi:
                    continue
                if at != (curve[lo], blk[lo]):
                    at, ids, ranks_, vecs = (curve[lo], blk[lo]), [], [], []
                mid = lo + int((~query[lo:hi].astype(bool)).sum())
                if mid > lo:
                    ids, ranks_, vecs = [*ids, cid[lo:mid]], [*ranks_, rank[lo:mid]], [*vecs, v[lo:mid]]
                if hi == mid or not ids:
                    continue
                have, near, mat = (np.concatenate(x) for x in (ids, ranks_, vecs))
                ids, ranks_, vecs = [have], [near], [mat]
                first, last = spans(rank[mid:hi], near, reach)
                k = 0
                while k < hi - mid:  # queries whose windows lie together share one product
                    z = int(np.searchsorted(last[k:], first[k] + 2 * max(last[k] - first[k], 64), side="right")) + k
                    z = min(max(z, k + 1), k + 256)
                    a, e = int(first[k]), int(last[z - 1])
                    if e > a:
                        s = v[mid + k:mid + z] @ mat[a:e].T
                        place = np.arange(a, e)
                        s[(place < first[k:z, None]) | (place >= last[k:z, None])] = -np.inf
                        pick = _best(s, n, have[a:e])
                        score = np.take_along_axis(s, pick, axis=1)
                        inside = np.isfinite(score).ravel()
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.repeat(cid[mid + k:mid + z], pick.shape[1])[inside]),
                            pa.array(have[a:e][pick.ravel()][inside]), pa.array(score.ravel()[inside])], schema=sch)
                    k = z

    found = arrow_map(dealt, run, "q bigint, cid bigint, s double")
    return _top(found.groupBy("q", "cid").agg(F.max("s").alias("s")), n)


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: up to k nearest found for every row with ``is_query``."""
    if k > K:
        raise ValueError(f"classes carry ids for at most {K} neighbours")
    rows = usable(vectors)
    classes = vector_classes(rows, is_query)
    curves = fit_curves(classes)
    empty = classes.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if curves is None:
        return empty
    places = ranks(classes, curves)
    reach = window(classes, places)
    found = candidates(classes, places, reach)
    exact = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a.cast("double") * b.cast("double")),
                        F.lit(0.0), lambda acc, x: acc + x)
    scored = (found.select("q", "cid")
              .join(classes.select(F.col("cid").alias("q"), F.col("embedding").alias("qv")), "q")
              .join(classes.select("cid", "ids", F.col("embedding").alias("cv")), "cid")
              .select("q", "ids", exact.alias("score")))
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = cut(scored.select("q", "score", F.explode("ids").alias("vec_id"))
               .withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).drop("r"), "best")
    asking = cut(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
                 .join(classes.where("asked").select(F.col("cid").alias("q"), "embedding"), "embedding")
                 .select("query_id", "q"), "asking")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asking.join(best, "q").where("vec_id != query_id")
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op9_hilbert_neighbours(spark, sf_dir) -> DataFrame:
    """20 nearest by inner product for every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
