"""Operator 8, line dedup by winnowing over line hashes.

A document's units are its lines that hold a word, compared by their words (white space does not
count). A window is a shortest run of units with at least ``MIN_WORDS`` words, so winnowing's window
is measured in words instead of lines: one long line is a window, and so are many short ones. Each window
selects the place of its smallest line hash (the rightmost of equal ones); the hashes at the selected places
are a text's fingerprints, about one line in three. Two places that share ``MIN_WORDS`` words share a
window and select the same line of it, so only fingerprints that occur twice or more can begin a match.

Selected places are joined on their fingerprint, and those left are told apart by the hashes of their
windows, so that a common line does not pair places that share nothing else; each is joined with the first
place only (the smallest doc_id, then position), never with all others. What comes out are seeds: a text, the text
where it stood first, and the distance between the two. Every seed is extended line by line both ways
along its distance, on the two texts' hash sequences, and each stretch of enough words is a repeated
run. All its later copies are deleted; blank lines inside a deleted run go with it. Where a run overlaps its
own first place in the same text, only what lies behind that place goes.

Edge cases: null text stays null, empty text stays empty; a text repeated as a whole keeps its row
with what is left (perhaps an empty text); a null doc_id is the earliest document; repeated rows (same
id and text) are one document and change alike; rows that share an id but not the text are different
documents, in order of the text's hash; an empty table gives an empty result; other columns stay, whatever
their names, but for one named like the result, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import arrow_map, arrow_schema, cut, map_columns, table, unused

MIN_WORDS, TEXT_SEED = 50, 42


def units(text: str) -> tuple[list[int], list[int], np.ndarray]:
    """Line number, words and hash of every line that holds a word."""
    at, words, hashes = [], [], []
    for i, line in enumerate(text.encode().split(b"\n")):
        w = line.split()
        if w:
            at.append(i)
            words.append(len(w))
            hashes.append(xxhash.xxh64_intdigest(b" ".join(w)))
    return at, words, np.array(hashes, dtype=np.uint64)


def windows(words: list[int], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Shortest runs (first, last) of at least ``least`` words that begin or end at each unit."""
    found, n = set(), len(words)
    total = last = 0
    for first in range(n):  # forward
        while last < n and total < least:
            total += words[last]
            last += 1
        if total < least:
            break
        found.add((first, last - 1))
        total -= words[first]
    total, first = 0, n - 1
    for end in range(n - 1, -1, -1):  # backward
        while first >= 0 and total < least:
            total += words[first]
            first -= 1
        if total < least:
            break
        found.add((first + 1, end))
        total -= words[end]
    return sorted(found)


def sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, hashes, words): line hashes and word counts of every text with units; th is the text's hash."""
    def run(batch: pa.RecordBatch):
        doc, th, hashes, counts = [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            _, words, h = units(text) if text else (0, [], ())
            if words:
                doc.append(i)
                th.append(xxhash.xxh64_intdigest(text.encode(), TEXT_SEED))
                hashes.append(h.view(np.int64))
                counts.append(words)
        yield {"doc_id": batch.column(0).take(pa.array(doc, pa.int64())), "th": np.array(th, dtype=np.uint64).view(np.int64),
               "hashes": hashes, "words": counts}

    return map_columns(docs.select(F.col("doc_id").cast("bigint"), "text"),
                       "doc_id bigint, th bigint, hashes array<bigint>, words array<int>", run)


def winnow(hashes: np.ndarray, words: list[int], least: int = MIN_WORDS) -> dict[int, list[tuple[int, int]]]:
    """Selected unit -> the windows that select it: of a window the smallest hash, rightmost on ties."""
    chosen: dict[int, list[tuple[int, int]]] = {}
    best = end = -1
    for a, b in windows(words, least):
        if best < a or b < end:  # the last choice is outside
            best = b - int(np.argmin(hashes[a:b + 1][::-1]))
        elif b > end:
            new = b - int(np.argmin(hashes[end + 1:b + 1][::-1]))
            best = new if hashes[new] <= hashes[best] else best
        end = b
        chosen.setdefault(best, []).append((a, b))
    return chosen


def fingerprints(seqs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(fp, doc_id, th, windows): every selected place's hash and, with their hashes, the windows that select it."""
    def run(batch: pa.RecordBatch):
        doc, fp, found = [], [], []
        lists = zip(batch.column(2), batch.column(3).to_pylist())
        for i, (h, words) in enumerate(lists):
            h = h.values.to_numpy()
            for at, ranges in winnow(h.view(np.uint64), words, least).items():
                doc.append(i)
                fp.append(h[at])
                found.append([{"sig": xxhash.xxh64_intdigest(h[a:b + 1].tobytes()) - (1 << 63), "first": a} for a, b in ranges])
        take = pa.array(doc, pa.int64())
        yield {"fp": fp, "doc_id": batch.column(0).take(take), "th": batch.column(1).take(take), "windows": found}

    return map_columns(seqs, "fp bigint, doc_id bigint, th bigint, windows array<struct<sig:bigint,first:int>>", run)


def seeds(seqs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, lead_id, lead_th, shift): texts with a window that stood first in the lead, so many units before."""
    places = cut(fingerprints(seqs, least), "selected")
    shared = cut(places.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "shared")
    alike = cut(places.join(shared, "fp", "left_semi").select("fp", "doc_id", "th", F.inline("windows")), "windows")
    place = F.struct("doc_id", "th", "first")
    lead = cut(alike.groupBy("fp", "sig").agg(F.count("*").alias("n"), F.min(place).alias("lead")).where("n > 1").drop("n"), "leads")
    found = alike.join(lead, ["fp", "sig"]).select(
        "doc_id", "th", F.col("lead.doc_id").alias("lead_id"), F.col("lead.th").alias("lead_th"),
        (F.col("first") - F.col("lead.first")).alias("shift")).distinct()
    return found.where(~(F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("th") == F.col("lead_th")) & (F.col("shift") == 0)))


def extend(own: np.ndarray, words: np.ndarray, lead: np.ndarray, shift: int, same: bool, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Unit ranges of ``own`` that equal ``lead`` so many units before, as long as they go both ways and of
    at least ``least`` words; in the same text only what lies behind the first window of the lead."""
    lo, hi = max(0, shift), min(len(own), len(lead) + shift)
    if lo >= hi:
        return []
    equal = np.concatenate([[False], own[lo:hi] == lead[lo - shift:hi - shift], [False]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(equal))
    total = np.concatenate([[0], np.cumsum(words)])
    out = []
    for a, b in zip(edge[::2] + lo, edge[1::2] + lo - 1):
        if total[b + 1] - total[a] >= least:
            if same:
                a = max(a, int(np.searchsorted(total, total[a - shift] + least)))
            if a <= b:
                out.append((int(a), int(b)))
    return out


def repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, runs): for each text the unit ranges that stood somewhere before."""
    seqs = cut(sequences(docs), "sequences")
    found = cut(seeds(seqs, least), "seeds")
    once = seqs.groupBy("doc_id", "th").agg(F.first("hashes").alias("hashes"), F.first("words").alias("words"))  # repeated rows
    lead = once.select(F.col("doc_id").alias("id_a"), F.col("th").alias("th_a"), F.col("hashes").alias("lead"))
    own = once.select(F.col("doc_id").alias("id_b"), F.col("th").alias("th_b"), "hashes", "words")
    pairs = (found.join(lead, F.col("lead_id").eqNullSafe(F.col("id_a")) & (F.col("lead_th") == F.col("th_a")))
             .join(own, F.col("doc_id").eqNullSafe(F.col("id_b")) & (F.col("th") == F.col("th_b")))
             .select("doc_id", "th", "hashes", "words", "lead", "shift",
                     (F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("th") == F.col("lead_th"))).alias("same")))

    def run(batch: pa.RecordBatch):
        at, runs = [], []
        for i in range(batch.num_rows):
            h, w, lead_ = (batch.column(c)[i].values.to_numpy() for c in (2, 3, 4))
            for a, b in extend(h, w, lead_, batch.column(5)[i].as_py(), batch.column(6)[i].as_py(), least):
                at.append(i)
                runs.append({"a": a, "b": b})
        take = pa.array(at, pa.int64())
        yield {"doc_id": batch.column(0).take(take), "th": batch.column(1).take(take), "run": runs}

    later = map_columns(pairs, "doc_id bigint, th bigint, run struct<a:int,b:int>", run)
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("run")).alias("runs"))


def _without(text: str, runs) -> tuple[str, list[int]]:
    """The text without the lines of ``runs`` (unit ranges) and those lines' numbers."""
    lines, (at, _, _) = text.split("\n"), units(text)
    gone: set[int] = set()
    for r in runs:
        gone.update(range(at[r["a"]], at[r["b"]] + 1))
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), sorted(gone)


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS, out: str = "removed_lines") -> DataFrame:
    """The input with later repeated runs deleted from ``text``, and the numbers of the deleted
    lines (from 0) in ``out``, which replaces a clashing column. ``n_chars``, if there, is the new length."""
    docs = docs.select(*[c for c in docs.columns if c != out])
    names = docs.columns
    doc, own, runs_ = unused(docs, "run_doc", "run_text", "runs")
    found = repeats(docs, least).select(F.col("doc_id").alias(doc), F.col("th").alias(own), F.col("runs").alias(runs_))
    th = F.xxhash64("text")
    joined = docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found[doc]) & (th == found[own]), "left")
    schema = StructType([*docs.schema.fields, StructField(out, ArrayType(IntegerType()))])
    sch = arrow_schema(schema)
    i = names.index("text")

    def run(batches):
        for b in batches:
            texts, gone = b.column(i).to_pylist(), []
            for k, runs in enumerate(b.column(len(names)).to_pylist()):
                lines: list[int] = []
                if runs and texts[k]:
                    texts[k], lines = _without(texts[k], runs)
                gone.append(lines)
            cols = list(b.columns[:len(names)])
            cols[i] = pa.array(texts, type=sch.field("text").type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, type=sch.field(out).type)], schema=sch)

    result = arrow_map(joined.select(*names, runs_), run, schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        result = result.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return result.select(*names, out)


def op8_line_dedup(spark, sf_dir) -> DataFrame:
    """Every document with later repeated runs of lines deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.size("removed_lines").cast("bigint").alias("n_removed"),
                                    F.array_join("removed_lines", ",").alias("removed_lines"), "text")
