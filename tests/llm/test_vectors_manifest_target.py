"""Operators 11, 12 and 13 against brute force."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpairs.llm import manifest, polytope, targeted

# ------------------------------------------------------------------ op11


def duplicates_by_hand(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) as a multiset."""
    def good(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [0] * n
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(i, v) else None for i, v in rows]
    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = defaultdict(lambda: None)
    for i in range(n):
        r = find(i)
        low[r] = rows[i][0] if low[r] is None else min(low[r], rows[i][0])
    return Counter((rows[i][0], links[i], low[find(i)], rows[i][0] == low[find(i)]) for i in range(n))


def vectors(seed, dim=24):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(120)]
    base = rng.normal(size=dim)
    rows += [base + rng.normal(size=dim) * 0.08 for _ in range(60)]  # a tight group
    wide = rng.normal(size=dim)
    rows += [wide + rng.normal(size=dim) * s for s in np.linspace(0.15, 0.5, 90)]  # links near the threshold
    chain = [rng.normal(size=dim)]
    for _ in range(12):
        step = chain[-1] / np.linalg.norm(chain[-1]) + rng.normal(size=dim) * 0.085
        chain.append(step)
    rows += chain
    rows += [rows[5]] * 20 + [rows[6] * 3, rows[6] * 1e-8, rows[125]]
    out = [(i * 7 % 1009, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]
    rng.shuffle(ids := np.arange(len(out)))
    out = [out[i] for i in ids]
    out += [(5001, None), (5002, []), (5003, [0.0] * dim), (5004, [float("nan")] + [1.0] * (dim - 1)),
            (5005, [None] + [1.0] * (dim - 1)), (5006, [float("inf")] + [0.0] * (dim - 1)), (None, out[0][1]),
            (5007, [1.0, 2.0, 3.0]), (5008, [1.0, 2.0, 3.1]), (5009, out[3][1]), (5009, out[3][1])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_vector_links_and_components(spark, seed):
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, 1, 2, True) for i, v in rows],
                               "vec_id bigint, embedding array<float>, ball bigint, n_links int, kept boolean")
    got = polytope.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    by_hand = duplicates_by_hand([(i, v) for i, v in rows if i is not None])
    by_hand[(None, 0, None, True)] += 1
    assert Counter(map(tuple, got.collect())) == by_hand


def test_crowded_buckets_and_large_balls_are_cut_into_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(size=16) * s]) for i, s in enumerate(np.repeat([0.02, 0.2, 0.28], 40))]
    members = polytope.gather(polytope.classes(polytope.usable(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")), plan := polytope.Plan(120, 16))
    whole = {tuple(r) for r in polytope.ball_pairs(members, plan).collect()}
    cut_up = polytope.ball_pairs(members, plan, group=7)
    assert {tuple(r) for r in cut_up.collect()} == whole and whole
    near = polytope.verify(cut_up, members, plan)
    one, many = (Counter((r["cid"], r["a"], r["b"]) for r in polytope.open_links(near, members, plan, g)
                         .groupBy("cid", "a", "b", ).agg(F.sum("n").alias("n")).collect()) for g in (2048, 5))
    assert one == many


def test_simulated_recall_and_rotations():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 64))
    y = polytope.rotated(x, 3)
    assert np.allclose(x @ x.T, y @ y.T)
    for rows, k in ((10, 1), (10_000, 2), (1_000_000, 3)):
        plan = polytope.Plan(rows, 64)
        assert plan.k == k and 1 <= plan.tables <= 8


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert polytope.near_duplicates(none).collect() == []
    only = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, polytope.near_duplicates(only).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


# ------------------------------------------------------------------ op12

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_by_hand(nodes):
    """(root, for each node its levels of (before, after))."""
    paths, level, owner = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        up, owners = [], []
        for k in range(0, len(level), 16):
            run = level[k:k + 16]
            for p in range(len(run)):
                for i in owner[k + p]:
                    paths[i].append(("".join(run[:p]), "".join(run[p + 1:])))
            up.append(sha(*run))
            owners.append([i for o in owner[k:k + 16] for i in o])
        level, owner = up, owners
    return level[0], paths


def manifest_by_hand(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0], sha(*map(enc, (r[0], r[3], r[2], r[4], r[1]))), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree_by_hand([x[1] for x in groups[s]])
    root, tops = tree_by_hand([trees[s][0] for s in order])
    out = Counter()
    for s, top in zip(order, tops):
        for (i, leaf, r), path in zip(groups[s], trees[s][1]):
            node = leaf
            if i is not None and crc32(str(i).encode()) % 5 == 0:
                text = None if r[1] is None else r[1].translate(lower)
                node = sha(*map(enc, (r[0], r[3], r[2], r[4], text)))
            for a, b in path + top:
                node = sha(a, node, b)
            proof = sha(*(a + b for a, b in path + top))
            out[(i, leaf, trees[s][0], root, proof, node, node == root)] += 1
    return out


def manifest_rows(sizes, seed=0):
    rng, rows, n = random.Random(seed), [], 0
    for s, size in sizes.items():
        for _ in range(size):
            rows.append((n, rng.choice(["Ein Text", "lower only", "", None, "ÄÖ Ab\n" * 30]), rng.choice(["de", None]), s, rng.choice([n, None])))
            n += rng.choice([1, 1, 3])
    return rows


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 16, "b": 17, None: 2, "": 1, "é": 256, "z": 257}, {"hot": 4400, "b": 300, **{f"s{i}": 1 for i in range(20)}}])
def test_manifest(spark, sizes, tmp_path):
    rows = manifest_rows(sizes)
    rows += [rows[0], (rows[0][0], "other", None, rows[0][3], None), (None, "No Id", None, rows[0][3], 5)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", leaf string, i int").write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op12_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == manifest_by_hand(rows)


def test_manifest_segments_and_no_rows(spark):
    rows = spark.createDataFrame([("g", i, sha(str(i))) for i in range(40)], "grp string, key bigint, h string")
    found, root = manifest.proofs(rows)
    top, paths = tree_by_hand([sha(str(i)) for i in range(40)])
    assert root == top
    assert {r["key"]: [tuple(s) for s in r["segments"]] for r in found.collect()} == dict(enumerate(paths))
    found, root = manifest.proofs(rows.limit(0))
    assert root is None and found.collect() == []


# ------------------------------------------------------------------ op13

def features_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resample_by_hand(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features_by_hand(text)[1])
    for text in target:
        t.update(features_by_hand(text)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n, f = features_by_hand(text)
        w, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((n, i, len(f), w, score))
    able = sorted((r for r in rows if r[0] >= 20 and r[4] is not None), key=lambda r: (-r[4], r[1], r[3], r[2]))
    out = Counter((*r[1:], None) for r in rows)
    for place, r in enumerate(able[:5 * len(able) // 100], 1):
        out[(*r[1:], None)] -= 1
        out[(*r[1:], place)] += 1
    return +out


def test_target_resampling(spark, docs, clashing):
    target = spark.createDataFrame([("the and of wh er tion",), (None,), ("Über straße " * 20,), ("",)], "text string")
    by_hand = resample_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    for table in (docs, clashing.withColumn("n_words", F.lit(None)).withColumn("rank", F.lit("x"))):
        got = targeted.resample(table, target).select("doc_id", "n_features", "weight", "score", "rank")
        assert Counter(map(tuple, got.collect())) == by_hand
    assert sum(1 for r in by_hand if r[4]) >= 3


def test_target_resampling_without_target_or_rows(spark, docs, nothing):
    by_hand = resample_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [])
    got = targeted.resample(docs, nothing.select("text")).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == by_hand
    assert targeted.resample(nothing, docs.select("text")).collect() == []


def test_long_texts_are_read_in_slices(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["a", "Bc", "日本", "don't", "1.5", "x" * 50, "--"]) for _ in range(400))
    whole = targeted.bucket_counts(text.encode())
    for size in (1, 3, 17, 200):
        monkeypatch.setattr(targeted, "SLICE", size)
        n, counts = targeted.bucket_counts(text.encode())
        assert n == whole[0] and (counts == whole[1]).all()
    n, f = features_by_hand(text)
    assert n == whole[0] and (np.bincount(f, minlength=10000) == whole[1]).all()


def test_bit_planes_give_the_dot_product():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.integers(0, rng.choice([2, 50, 10**7]), 10000) * (rng.random(10000) < 0.1)
        gain = rng.integers(-30000, 30000, 10000)
        assert targeted.SlicedGains(gain).weight(counts) == int(counts @ gain)
    assert targeted.SlicedGains(np.zeros(10000, dtype=int)).weight(counts) == 0
