"""Operator 2, language ID by compression: one zstandard raw-content dictionary per language.

Training takes a bounded sample of labelled rows: per language at most ``SAMPLE_DOCS`` texts of
``SAMPLE_CHARS`` characters (the smallest text hashes, so any order or split of the rows gives the
same sample; where they are too few, middle slices of longer texts), of which at most ``DICT_BYTES``
become that language's dictionary. The driver holds at most ``4 * DICT_BYTES`` and one text per language. A text is reduced
to its lower-case letters, encoded once with each dictionary, and gets the language whose output
is smallest. The first ``PRIMER_BYTES`` of a dictionary are put in front of the text instead, and
their own cost is taken off again: they give the coder that language's letter statistics, so that
short texts, which hardly compress alone, also differ. What a dictionary saves is a roughly fixed number
of bytes per frame, so a text over ``BLOCK_BYTES`` is encoded in even blocks of at most that size, all of
them, each with its own dictionary, and their sizes are added up: the margin does not shrink as a text
grows. ``margin`` is how much smaller the size is than the runner-up's, relative to the latter;
a text with a margin of ``MIN_MARGIN`` or less is rejected. A tie goes to the language with more
training rows, then by name, and its margin is 0.

Edge cases: null text or no letter (digits, numerals and marks alone are none) gives ``und``, score 0, rejected; null lang is never learned;
with no labelled row at all everything is ``und``; a null doc_id counts as not held out; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, crc_bucket, table

SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, PRIMER_BYTES = 600, (20, 20_000), 64_000, 2_000
BLOCK_BYTES = 32_000
LEVEL, MIN_MARGIN, SHARPNESS = 5, 0.002, 2.0

# Runs of anything but letters (category L) and the marks on them (M), such as vowel signs.
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> bytes:
    """The text's lower-case letters with their marks; nothing if it has no letter."""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode() if text and LETTER.search(text) else b""


def blocks(data: bytes) -> list[bytes]:
    """The whole of ``data`` in even parts of at most ``BLOCK_BYTES``."""
    step = -(-len(data) // max(1, -(-len(data) // BLOCK_BYTES)))
    return [data[i:i + step] for i in range(0, len(data), step)] if data else []


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary), languages with more rows first. ``labelled`` has lang and text.

    Two passes: row counts per language, then only rows whose text hash is under a threshold that
    leaves about twice the wanted number, so no task sorts a whole language. Texts of the wanted lengths
    come first; a language that has too few of them is filled up with slices from the middle of its longer
    texts. What reaches the driver is cut to the dictionaries' bytes in Spark, in the order of use."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    low, high = SAMPLE_CHARS
    fits, long = F.length("text").between(low, high), F.length("text") > high
    counts = sorted(((r["lang"], r["n"], r["fit"], r["long"]) for r in rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(fits).alias("fit"), F.count_if(long).alias("long")).collect()),
        key=lambda x: (-x[1], x[0]))
    if not counts:
        return []
    share = lambda of: F.create_map(*[F.lit(x) for c in counts for x in (c[0], of(c))])[F.col("lang")]
    of_fit = share(lambda c: min(1.0, 4.0 * sample_docs / max(c[2], 1)))
    of_long = share(lambda c: 0.0 if c[2] >= sample_docs else min(1.0, 4.0 * sample_docs / max(c[3], 1)))
    middle = F.substring("text", F.floor((F.length("text") - high) / 2).cast("int") + 1, F.lit(high))
    picked = (rows.withColumn("h", F.xxhash64("text"))
              .withColumn("u", F.col("h") / F.lit(2.0 ** 64) + 0.5)
              .where((fits & (F.col("u") <= of_fit)) | (long & (F.col("u") < of_long)))
              .select("lang", "h", long.cast("int").alias("late"), F.when(long, middle).otherwise(F.col("text")).alias("text"))
              .groupBy("lang", "late", "h").agg(F.min("text").alias("text")))
    by = Window.partitionBy("lang").orderBy("late", "h", "text")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # a letter is a byte at least, and a text shrinks to its letters: twice the bytes leave enough
    kept = (picked.withColumn("r", F.row_number().over(by))
            .withColumn("sofar", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
            .where((F.col("r") <= sample_docs) & (F.col("sofar") < 4 * dict_bytes)).orderBy("lang", "r").collect())
    out = []
    for lang, *_ in counts:
        parts, size = [], 0
        for r in kept:
            b = letters(r["text"]) if r["lang"] == lang else b""
            if b and size + len(b) < dict_bytes:
                parts.append(b)
                size += len(b) + 1
        out.append((lang, b" ".join(parts)))
    return out


def _coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)  # once per task, not once per text
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                    write_checksum=False, write_dict_id=False)


def predict(docs: DataFrame, model: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Every input column plus lang_pred, score (0 to 1), margin and rejected; a clashing column
    of the input is replaced. Whole texts are encoded; the text's own repetitions cost the same
    under every dictionary, so only what a dictionary explains decides."""
    langs = [lang for lang, _ in model]
    added = "lang_pred string, score double, margin double, rejected boolean"
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "margin", "rejected")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [added])

    sch = arrow_schema(schema)

    def run(batches):
        coders = [(_coder(d[PRIMER_BYTES:]), d[:PRIMER_BYTES] + b" ") for _, d in model]
        base = [len(c.compress(p)) for c, p in coders]
        for b in batches:
            got: list[tuple[str, float, float, bool]] = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                data = letters(text)
                if not data or not coders:
                    got.append(("und", 0.0, 0.0, True))
                    continue
                parts = blocks(data)
                sizes = [sum(len(c.compress(p + x)) - n for x in parts) for (c, p), n in zip(coders, base)]
                best = min(sizes)
                i = sizes.index(best)
                second = min([s for j, s in enumerate(sizes) if j != i], default=best)
                margin = (second - best) / max(second, 1) if len(sizes) > 1 else 1.0
                score = 1.0 / sum(2.0 ** (-(s - best) / SHARPNESS) for s in sizes)
                got.append((langs[i], score, margin, margin <= min_margin))
            new = [pa.array(list(c), type=sch.field(n).type) for n, c in
                   zip(("lang_pred", "score", "margin", "rejected"), zip(*got) if got else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + new, schema=sch)

    return arrow_map(docs.select(*keep), run, schema)


def held_out(key="doc_id"):
    return F.coalesce(crc_bucket(F.col(key)) == 2, F.lit(False))


def op2_language_id(spark, sf_dir) -> DataFrame:
    """Language of every whole text of ``documents``, learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
