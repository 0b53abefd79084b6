"""Operator 11, near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A hash rotates a vector (three rounds of random signs and a fast Hadamard transform) and takes the signed
axis it lies closest to; a table's code joins ``k`` of them. Every vector goes to the ``probes`` codes that it
lies closest to (squared distance lost at each axis, added up), so a pair meets when any of its
codes agree. ``k`` follows the number of rows, so that buckets of unlike vectors stay small; the
number of tables is then measured on simulated pairs at exactly the threshold, until ``RECALL`` of them
meet: rotations make that independent of the data.

Groups of copies are folded first. Equal vectors are one class. Classes with the same first code are
range-partitioned beside each other and gathered into balls around a member, with a radius of at
most half the threshold's angle, so all members of a ball are linked without comparing them. Balls meet
in buckets by the codes of all their members and are compared by 128-bit sign sketches there (a bound
of 5.5 standard deviations, so a link is missed about twice in 10^8); what leaves a bucket are pairs of
balls. Each pair is then verified with the vectors: by the angle between the leaders and both radii
all members are linked, or none; where that is open, members are compared in blocks with exact
cosines, and only counts per member leave a task. Crowded buckets are cut into hashed blocks that
are compared pairwise in separate groups; nothing is capped.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an
id, link with nothing (no links, their own component, kept); vectors of unlike length never link;
repeated rows are vectors of their own, linked by cosine 1; parallel vectors of unlike norm have cosine 1; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, cut, map_columns, table
from .components import connected_components

THRESHOLD, RECALL, SEED = 0.9, 0.9995, 11
SKETCH, SIGMAS = 128, 5.5
FILL, CHUNK, GROUP = 32, 2048, 2048
SLACK = 1e-6  # radians: an angle this close to a bound is decided by exact cosines


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def width(dim: int) -> int:
    """Power of two that holds the vector, 64 at least."""
    return max(64, 1 << (dim - 1).bit_length())


def padded(unit: np.ndarray) -> np.ndarray:
    out = np.zeros((len(unit), width(unit.shape[1])))
    out[:, :unit.shape[1]] = unit
    return out


def rotated(x: np.ndarray, *number: int) -> np.ndarray:
    """The pseudo-random rotation of that number."""
    signs = np.random.default_rng([SEED, *number]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def codes(x: np.ndarray, tbl: int, k: int, probes: int) -> np.ndarray:
    """The ``probes`` likeliest codes (n, probes) of padded unit vectors in a table, closest first."""
    n, d = x.shape
    best, lost = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
    for f in range(k):
        y = rotated(x, tbl, f)
        size = np.abs(y)
        near = np.argsort(-size, axis=1, kind="stable")[:, :probes]
        length = np.take_along_axis(size, near, axis=1)
        axis = near * 2 + (np.take_along_axis(y, near, axis=1) > 0)
        loss = (length[:, :1] - length) ** 2
        code = (best[:, :, None] * (2 * d) + axis[:, None, :]).reshape(n, -1)
        total = (lost[:, :, None] + loss[:, None, :]).reshape(n, -1)
        take = np.argsort(total, axis=1, kind="stable")[:, :probes]
        best, lost = np.take_along_axis(code, take, axis=1), np.take_along_axis(total, take, axis=1)
    return best


def sketches(x: np.ndarray) -> np.ndarray:
    """Signs of ``SKETCH`` rotated coordinates as 64-bit words (n, 2)."""
    bits = [rotated(x, 1 << 20, i)[:, :64] > 0 for i in range(SKETCH // 64)]
    return np.packbits(np.concatenate(bits, axis=1), axis=1).view(np.int64)


def allowed(angle: np.ndarray) -> np.ndarray:
    """Differing sketch bits that vectors at this angle stay within."""
    p = np.minimum(angle, math.pi) / math.pi
    return np.minimum(SKETCH, np.ceil(SKETCH * p + SIGMAS * np.sqrt(SKETCH * p * (1 - p)) + 1)).astype(np.int64)


class Plan:
    """Hashes a code (k), codes a vector goes to in each table (probes) and tables."""

    def __init__(self, rows: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL):
        self.threshold, self.angle = threshold, math.acos(threshold)
        axes = 2 * width(dim)
        self.k = max(1, math.ceil(math.log(max(rows, 1) / FILL) / math.log(axes))) if rows > FILL else 1
        self.probes = min(2 << self.k, axes)
        rng = np.random.default_rng([SEED, self.k])
        u, w = (rng.normal(size=(4096, max(dim, 2))) for _ in range(2))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        v = threshold * u + math.sqrt(1 - threshold ** 2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        a, b = padded(u), padded(v)
        apart = np.ones(len(u), dtype=bool)
        self.tables = 0
        while apart.mean() > 1 - recall:
            x, y = (codes(m, self.tables, self.k, self.probes) for m in (a, b))
            apart &= ~(x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
            self.tables += 1


def _by_length(column: pa.Array):
    """(row numbers, matrix in double precision) of the vectors of each length."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(d))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # keeps squares of very large or small components finite
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1, 1))


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and embedding (doubles) of the rows that take part."""
    v = F.col("embedding")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("embedding"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0)
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def classes(rows: DataFrame) -> DataFrame:
    """(cid, m, embedding): one row per different vector, its smallest id and its number of rows."""
    return cut(rows.groupBy("embedding").agg(F.min("id").alias("cid"), F.count("*").alias("m")), "classes")


MEMBER = ("cid bigint, m bigint, embedding array<double>, ball bigint, size bigint, radius double, "
          "s0 bigint, s1 bigint")


def gather(found: DataFrame, plan: Plan) -> DataFrame:
    """The classes with their ball, the smallest class id in it, and the ball's radius and sketch; the row
    of that class, the leader, also has the ball's size. A ball lies within one chunk of one code."""
    def home(b: pa.RecordBatch):
        for at, m in _by_length(b.column(2)):
            pick = pa.array(at)
            yield {"len": np.full(len(at), m.shape[1], np.int32), "code": codes(padded(_unit(m)), 0, plan.k, 1)[:, 0],
                   **{n: b.column(i).take(pick) for i, n in enumerate(("cid", "m", "embedding"))}}

    order = ["len", "code", "cid"]
    dealt = (map_columns(found.select("cid", "m", "embedding"),
                         "len int, code bigint, cid bigint, m bigint, embedding array<double>", home)
             .repartitionByRange(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
             .sortWithinPartitions(*order))
    tight = math.cos(plan.angle / 2 - SLACK)

    def balls(b: pa.RecordBatch):
        code = b.column(1).to_numpy()
        cid, weight = b.column(2).to_numpy(), b.column(3).to_numpy()
        for at, m in _by_length(b.column(4)):
            unit, n = _unit(m), len(at)
            lead, radius, size = np.arange(n), np.zeros(n), weight[at].astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(code[at])) + 1), n]
            for lo, hi in zip(edges, edges[1:]):
                for a in range(lo, hi, CHUNK):
                    z = min(a + CHUNK, hi)
                    free = np.arange(a, z)
                    while len(free) > 1:
                        near = unit[free] @ unit[free[0]]
                        mine = near >= tight
                        mine[0] = True
                        if mine.sum() > 1:
                            inside = free[mine]
                            lead[inside] = free[0]
                            size[free[0]] = weight[at[inside]].sum()
                            radius[free[0]] = _angle(near[mine].min()) + SLACK
                        free = free[~mine]
            own = lead == np.arange(n)
            s = sketches(padded(unit))
            yield {"cid": b.column(2).take(pa.array(at)), "m": b.column(3).take(pa.array(at)),
                   "embedding": b.column(4).take(pa.array(at)), "ball": cid[at[lead]],
                   "size": pa.array(size, pa.int64(), mask=~own), "radius": radius[lead], "s0": s[lead, 0], "s1": s[lead, 1]}

    return cut(map_columns(dealt, MEMBER, balls), "balls")


def _runs(dealt: DataFrame, keys: int, schema: str, compare) -> DataFrame:
    """Rows sorted by their first ``keys`` columns, given to ``compare`` in whole groups of equal keys,
    as many as an Arrow batch ends: compare(group numbers, columns) yields column dicts."""
    sch = arrow_schema(schema)

    def emit(table_: pa.Table):
        if not table_.num_rows:
            return
        cols = [c.combine_chunks() for c in table_.columns]
        new = np.zeros(table_.num_rows, dtype=bool)
        for c in cols[:keys]:
            x = c.to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        for out in compare(np.cumsum(new), cols[keys:]):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=sch.field(n).type) for n in sch.names], schema=sch)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            last = np.ones(t.num_rows, dtype=bool)
            for c in t.columns[:keys]:
                x = c.to_numpy()
                last &= x == x[-1]
            done = t.num_rows - int(last.sum())  # the last group may go on
            yield from emit(t.slice(0, done))
            held = t.slice(done)
        if held is not None:
            yield from emit(held)

    return arrow_map(dealt, run, schema)


def ball_pairs(members: DataFrame, plan: Plan, group: int = GROUP) -> DataFrame:
    """(a, b), a < b: balls that share a bucket and whose sketches allow a link."""
    def spread(b: pa.RecordBatch):
        ball, about = b.column(1).to_numpy(), {n: b.column(i).to_numpy() for i, n in ((2, "radius"), (3, "s0"), (4, "s1"))}
        for at, m in _by_length(b.column(0)):
            x = padded(_unit(m))
            for tbl in range(plan.tables):
                c = codes(x, tbl, plan.k, plan.probes)
                # a ball's members share most codes: one row each is left of them in the batch
                pairs = np.column_stack([np.repeat(ball[at], c.shape[1]), c.ravel()])
                rows, first = np.unique(pairs, axis=0, return_index=True)
                own = at[first // c.shape[1]]
                yield {"tbl": np.full(len(rows), m.shape[1] * 1000 + tbl), "code": rows[:, 1], "ball": rows[:, 0],
                       **{n: v[own] for n, v in about.items()}}

    keyed = cut(map_columns(members.select("embedding", "ball", "radius", "s0", "s1"),
                            "tbl bigint, code bigint, ball bigint, radius double, s0 bigint, s1 bigint", spread).distinct(), "buckets")
    crowded = cut(keyed.groupBy("tbl", "code").agg(F.count("*").alias("n")).where(F.col("n") > group)
                  .select("tbl", "code", F.ceil(F.col("n") / group).cast("int").alias("s")), "crowded")
    own = F.pmod(F.xxhash64("ball"), F.col("s")).cast("int")
    parts = F.when(F.col("s").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("s") - 1),
                    lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"))))
    dealt = (keyed.join(crowded, ["tbl", "code"], "left")
             .select("tbl", "code", "ball", "radius", "s0", "s1", own.alias("own"), F.explode(parts).alias("p"))
             # side -1: all members of the group are compared, else those of unlike sides
             .select("tbl", "code", "p.i", "p.j", "ball", "radius", "s0", "s1",
                     F.when(F.col("p.i") == F.col("p.j"), -1).otherwise(F.col("own")).alias("side"))
             .repartition("tbl", "code", "i", "j").sortWithinPartitions("tbl", "code", "i", "j", "ball"))

    def compare(at, cols):
        ball, radius, s0, s1, side = (c.to_numpy(zero_copy_only=False) for c in cols)
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)  # the bit count of a negative number is that of its size
        angle = plan.angle + SLACK
        plain = int(allowed(np.array([angle]))[0])
        wide, left, right, held = bool((radius > 0).any()), [], [], 0
        i, step = np.arange(len(ball)), 0
        while True:
            step += 1
            i = i[i + step < len(ball)]
            i = i[at[i] == at[i + step]]
            if not len(i):
                break
            j = i + step
            apart = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])
            bound = allowed(angle + radius[i] + radius[j]) if wide else plain
            hit = (apart <= bound) & (ball[i] != ball[j]) & ((side[i] < 0) | (side[i] != side[j]))
            if hit.any():
                left.append(ball[i[hit]])
                right.append(ball[j[hit]])
                held += len(left[-1])
            if held > 500_000:
                yield {"a": np.concatenate(left), "b": np.concatenate(right)}
                left, right, held = [], [], 0
        if held:
            yield {"a": np.concatenate(left), "b": np.concatenate(right)}

    found = _runs(dealt, 4, "a bigint, b bigint", compare)
    return cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ball-pairs")


def verify(pairs: DataFrame, members: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, size_a, size_b, sure): pairs of balls whose members are all linked (sure) or may be."""
    side = lambda x: members.where("size IS NOT NULL").select(
        F.col("ball").alias(x), F.col("embedding").alias(f"v_{x}"), F.col("radius").alias(f"r_{x}"), F.col("size").alias(f"size_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(F.size("v_a") == F.size("v_b")).select(
        "a", "b", "size_a", "size_b", "r_a", "r_b", "v_a", "v_b")

    def check(b: pa.RecordBatch):
        r = b.column(4).to_numpy() + b.column(5).to_numpy()
        right = {}
        for at, m in _by_length(b.column(7)):
            right[m.shape[1]] = _unit(m)
        for at, m in _by_length(b.column(6)):
            cosine, rad = (_unit(m) * right[m.shape[1]]).sum(axis=1), r[at]
            angle = _angle(cosine)
            sure = np.where(rad == 0, cosine >= plan.threshold, angle + rad <= plan.angle - SLACK)
            open_ = ~sure & (rad > 0) & (angle - rad <= plan.angle + SLACK)
            keep = np.flatnonzero(sure | open_)
            pick = pa.array(at[keep])
            yield {**{n: b.column(i).take(pick) for i, n in enumerate(("a", "b", "size_a", "size_b"))}, "sure": sure[keep]}

    return cut(map_columns(rows, "a bigint, b bigint, size_a bigint, size_b bigint, sure boolean", check), "near-balls")


def open_links(near: DataFrame, members: DataFrame, plan: Plan, group: int = GROUP) -> DataFrame:
    """(cid, n, a, b): for the pairs of balls that the angles leave open, how many vectors of the other
    ball each member is linked to, by blocks of exact cosines. Only members with links have a row."""
    todo = near.where("NOT sure").select("a", "b")
    if todo.isEmpty():
        return near.sparkSession.createDataFrame([], "cid bigint, n bigint, a bigint, b bigint")
    n = cut(members.groupBy("ball").agg(F.count("*").alias("n")), "ball-classes")
    blocks = lambda x: F.ceil(F.col(x) / group).cast("int")
    todo = (todo.join(n.select(F.col("ball").alias("a"), blocks("n").alias("n_a")), "a")
            .join(n.select(F.col("ball").alias("b"), blocks("n").alias("n_b")), "b"))
    sides = []
    for own, other, first in (("a", "b", True), ("b", "a", False)):
        place = F.pmod(F.xxhash64("cid"), F.col(f"n_{own}")).cast("int")
        across = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))
        both = (todo.join(members.select(F.col("ball").alias(own), "cid", "m", "embedding"), own)
                .select("a", "b", place.alias("x"), across.alias("y"), F.lit(first).alias("left"), "cid", "m", "embedding"))
        sides.append(both if first else both.select("a", "b", F.col("y").alias("x"), F.col("x").alias("y"), "left", "cid", "m", "embedding"))
    dealt = sides[0].unionByName(sides[1]).repartition("a", "b", "x", "y").sortWithinPartitions("a", "b", "x", "y", "left")
    dealt = dealt.select("a", "b", "x", "y", "left", "cid", "m", "embedding", F.col("a").alias("u"), F.col("b").alias("v"))

    def compare(at, cols):
        left = cols[0].to_numpy(zero_copy_only=False).astype(bool)
        cid, m, u, v = (cols[i].to_numpy(zero_copy_only=False) for i in (1, 2, 4, 5))
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
        for lo, hi in zip(edges, edges[1:]):
            mid = hi - int(left[lo:hi].sum())  # the right side comes first
            if lo < mid < hi:
                unit = _unit(next(_by_length(cols[3].slice(lo, hi - lo)))[1])
                linked = unit[mid - lo:] @ unit[:mid - lo].T >= plan.threshold
                count = np.concatenate([linked.T @ m[mid:hi], linked @ m[lo:mid]]).astype(np.int64)
                some = np.flatnonzero(count)
                yield {"cid": cid[lo:hi][some], "n": count[some], "a": u[lo:hi][some], "b": v[lo:hi][some]}

    return cut(_runs(dealt, 4, "cid bigint, n bigint, a bigint, b bigint", compare), "open-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = usable(vectors, id_col, vector)
    found = classes(rows)
    size = found.agg(F.count("*"), F.max(F.size("embedding"))).first()
    every = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"))
    if not size[0]:
        return every.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.lit(True).alias("kept"))
    plan = Plan(size[0], size[1], threshold)
    members = gather(found, plan)
    near = verify(ball_pairs(members, plan), members, plan)
    open_ = open_links(near, members, plan)
    edges = near.where("sure").select("a", "b").unionByName(open_.select("a", "b").distinct())
    roots = connected_components(edges, "a", "b").withColumnRenamed("node", "ball")
    sure = near.where("sure")
    beside = (sure.select(F.col("a").alias("ball"), F.col("size_b").alias("n"))
              .unionByName(sure.select(F.col("b").alias("ball"), F.col("size_a").alias("n")))
              .groupBy("ball").agg(F.sum("n").alias("beside")))
    ball = cut(members.where("size IS NOT NULL").select("ball", "size").join(roots, "ball", "left").join(beside, "ball", "left")
               .select("ball", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("inside"),
                       F.coalesce("root", "ball").alias("component_id")), "ball-results")
    own = open_.groupBy("cid").agg(F.sum("n").alias("open"))
    result = cut(members.select("cid", "embedding", "ball").join(ball, "ball").join(own, "cid", "left")
                 .select("embedding", (F.col("inside") + F.coalesce("open", F.lit(0))).alias("n_links"), "component_id"), "class-results")
    linked = rows.join(result, "embedding").select(F.col("id").cast("bigint").alias("vec_id"), "n_links", "component_id")
    v = F.col(vector).cast("array<double>")
    others = vectors.where(F.col(id_col).isNull() | v.isNull() | ~F.coalesce(
        F.exists(v, lambda x: x.isNotNull() & (x != 0)) & F.forall(
            v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)))
    return linked.unionByName(others.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"),
        F.col(id_col).cast("bigint").alias("component_id"))).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_polytope_duplicates(spark, sf_dir) -> DataFrame:
    """Links, component and verdict of every vector at cosine 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
