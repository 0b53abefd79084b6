"""Scans of the reference's formats (A01-A12) as Spark sources.

Text formats are read with ``spark.read.text`` (splittable, one task per file split) and
parsed with Column expressions; line numbers come from E05 (``plans.indexing.line_index``)
instead of a driver-side enumerate. Every parser is also exposed as a Column function so
the same logic runs on a streaming DataFrame (K01).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chars, py_strip, py_trim, spaced_or_chars, ws_tokens
from ..plans.indexing import line_index
from ..session import DUPLICATE_KEYS


def _c(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# ---------------------------------------------------------------- A01 / A02 (TSV pairs)

def parse_tsv_strict(line: str | Column, mode: str = "FAILFAST") -> Column:
    """A01 on one line: ``strip`` then split on tab; must give exactly two fields, else the
    query fails (``FAILFAST``, the reference's behaviour, through ``raise_error``) or the
    row is flagged ``valid`` false (``PERMISSIVE``). Each field is whitespace-split.
    Trap kept: strip runs first, so ``"abc\t"`` is one field."""
    parts = F.split(py_strip(_c(line)), "\t")
    ok = F.size(parts) == 2
    if mode == "FAILFAST":
        parts = F.when(ok, parts).otherwise(F.raise_error(F.concat(
            F.lit("expected src<TAB>trg, got: "), F.substring(_c(line), 1, 80))).cast("array<string>"))
    return F.struct(ok.alias("valid"),
                    F.when(ok, ws_tokens(F.get(parts, 0))).alias("src_tokens"),
                    F.when(ok, ws_tokens(F.get(parts, 1))).alias("trg_tokens"))


def parse_tsv_lenient(line: str | Column) -> Column:
    """A02 on one line: split on tab without strip; not two fields -> ``valid`` false.
    A side containing a space is whitespace-split, else one token per character."""
    parts = F.split(_c(line), "\t")
    ok = F.size(parts) == 2
    return F.struct(ok.alias("valid"),
                    F.when(ok, spaced_or_chars(F.get(parts, 0))).alias("src_tokens"),
                    F.when(ok, spaced_or_chars(F.get(parts, 1))).alias("tgt_tokens"))


def with_tsv_strict(df: DataFrame, line: str, keep: Sequence[str], mode: str = "FAILFAST") -> DataFrame:
    """A01 as columns: ``keep`` with valid, src_tokens and trg_tokens of ``parse_tsv_strict``; each step is
    computed once per line."""
    parts = F.split(py_trim(line), "\t")
    if mode == "FAILFAST":
        bad = F.raise_error(F.concat(F.lit("expected src<TAB>trg, got: "), F.substring(line, 1, 80)))
        sides = once(df, [*keep, line], parts.alias("_parts"))
        parts = F.when(F.size("_parts") == 2, F.col("_parts")).otherwise(bad.cast("array<string>"))
        sides = once(sides, keep, parts.alias("_parts"))
    else:
        sides = once(df, keep, parts.alias("_parts"))
    return _with_sides(sides, keep, ws_tokens, "trg_tokens")


def with_tsv_lenient(df: DataFrame, line: str, keep: Sequence[str]) -> DataFrame:
    """A02 as columns: ``keep`` with valid, src_tokens and tgt_tokens of ``parse_tsv_lenient``; each step is
    computed once per line."""
    sides = once(df, keep, F.split(line, "\t").alias("_parts"))
    return _with_sides(sides, keep, spaced_or_chars, "tgt_tokens")


def _with_sides(parts: DataFrame, keep: Sequence[str], tokens, second: str) -> DataFrame:
    ok = F.size("_parts") == 2
    d = once(parts, keep, ok.alias("valid"), F.when(ok, F.get("_parts", F.lit(0))).alias("_a"),
             F.when(ok, F.get("_parts", F.lit(1))).alias("_b"))
    return once(d, [*keep, "valid"], tokens("_a").alias("src_tokens"), tokens("_b").alias(second))


def read_pairs_tsv(spark: SparkSession, path: str | Sequence[str], split: str = "train",
                   mode: str = "FAILFAST") -> DataFrame:
    """A01 + E05 + B01: strict spaced-pair files with line index and guid."""
    lines = line_index(spark.read.text(path))
    p = with_tsv_strict(lines, "value", ["line_idx", "file_path"], mode)
    return p.select(F.concat(F.lit(split + "-"), F.col("line_idx").cast("string")).alias("guid"),
                    "line_idx", "file_path", "valid", "src_tokens", "trg_tokens")


def read_pairs_lenient(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lenient scan, bad lines kept with ``valid`` false (counted as ``format``)."""
    lines = line_index(spark.read.text(path))
    return with_tsv_lenient(lines, "value", ["line_idx", "file_path"])


# ---------------------------------------------------------------- A03 (JSONL pairs)

def once(df: DataFrame, keep: Sequence[str], *cols: Column) -> DataFrame:
    """``keep`` and ``cols``, computed once: a generator of one row, through which Catalyst pushes no
    filter that would repeat their expressions. They are made in a projection below it, which is compiled
    where a generator's own expressions may be interpreted."""
    made = df.select(*keep, F.struct(*cols).alias("_made"))
    return made.select(*keep, F.explode(F.array("_made")).alias("_once")).select(*keep, "_once.*")


def with_json_pair(df: DataFrame, line: str, a: str = "src", b: str = "tgt", blank_as: str = "empty") -> DataFrame:
    """Strict object test of a stripped line, as columns valid, error, ``a`` and ``b``.

    ``valid`` requires one JSON object, with nothing behind it, whose ``a`` and ``b`` are both
    strings; of a repeated key the last counts. ``error`` is ``bad_json``, ``missing_field`` or
    ``non_string``. A blank line is ``empty`` (stream semantics: two empty strings) or
    ``invalid`` (audit semantics).

    Spark's parser stops behind the first value, so the line is parsed inside an array whose second and
    last item is the line's own hash: it is found there only if the line is one whole value. Every
    step is a column of its own, so that Catalyst computes it once. Repeated keys need
    ``session.prepare``.
    """
    if df.sparkSession.conf.get(DUPLICATE_KEYS) != "true":
        raise ValueError("call session.prepare(spark) first: repeated keys would be errors")
    d = df.withColumn("_js", py_strip(F.col(line)))
    d = d.withColumn("_jh", F.xxhash64("_js"))
    d = d.withColumn("_jv", F.try_parse_json(F.concat(F.lit("["), "_js", F.lit(","), F.col("_jh").cast("string"), F.lit("]"))))
    d = (d.withColumn("_jfa", F.try_variant_get("_jv", f"$[0].{a}", "variant"))
         .withColumn("_jfb", F.try_variant_get("_jv", f"$[0].{b}", "variant"))
         .withColumn("_jend", F.try_variant_get("_jv", "$[1]", "bigint")))
    d = (d.withColumn("_jblank", F.col("_js") == "")
         .withColumn("_jobj", F.coalesce(F.col("_jend") == F.col("_jh"), F.lit(False)) & F.col("_js").startswith("{"))
         .withColumn("_jpresent", F.col("_jfa").isNotNull() & F.col("_jfb").isNotNull())
         .withColumn("_jstr", (F.schema_of_variant("_jfa") == "STRING") & (F.schema_of_variant("_jfb") == "STRING")))
    ok = F.col("_jobj") & F.col("_jpresent") & F.col("_jstr")
    empty_blank = F.col("_jblank") & F.lit(blank_as == "empty")
    valid = F.coalesce(F.when(F.col("_jblank"), F.lit(blank_as == "empty")).otherwise(ok), F.lit(False))
    error = (F.when(F.col("_jblank"), F.lit(None if blank_as == "empty" else "bad_json"))
             .when(~F.col("_jobj"), F.lit("bad_json"))
             .when(~F.col("_jpresent"), F.lit("missing_field"))
             .when(~F.col("_jstr"), F.lit("non_string")))
    d = d.withColumn("_jok", valid)
    text = lambda v: F.when(empty_blank, F.lit("")).when(F.col("_jok"), F.variant_get(v, "$", "string"))
    keep = [c for c in df.columns if c not in ("valid", "error", a, b)]
    return once(d, keep, F.col("_jok").alias("valid"), error.alias("error"), text("_jfa").alias(a), text("_jfb").alias(b))


def read_pairs_jsonl(spark: SparkSession, path: str | Sequence[str], blank_as: str = "empty") -> DataFrame:
    """Validated JSONL pairs with raw line index."""
    lines = line_index(spark.read.text(path))
    return with_json_pair(lines, "value", blank_as=blank_as).select(
        "line_idx", "file_path", "valid", "error", "src", "tgt")


# ---------------------------------------------------------------- A04 / A05 / A06-A08 / A11

def read_source_target(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A04 + F01: union of ``{source, target}`` JSONL files; a missing file is an error
    (the scan fails); bad rows are kept as ``valid`` false (counted as ``format``)."""
    lines = spark.read.text(list(paths)).withColumn("file_path", F.col("_metadata.file_path"))
    p = with_json_pair(lines, "value", "source", "target", blank_as="invalid")
    return p.select("file_path", "valid", "source", "target", F.when(F.col("valid"), chars("source")).alias("src_tokens"),
                    F.when(F.col("valid"), chars("target")).alias("tgt_tokens"))


def read_sentences(spark: SparkSession, path: str | Sequence[str], drop_blank: bool = True) -> DataFrame:
    """One clean sentence per line, stripped (blank lines dropped by default)."""
    s = spark.read.text(path).select(py_strip("value").alias("text"))
    return s.where(F.col("text") != "") if drop_blank else s


def _require(df: DataFrame, cols: Sequence[str], what: str) -> DataFrame:
    """Fail the query on a missing field (the reference raises KeyError)."""
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    return df.where(F.when(missing, F.raise_error(F.lit(f"missing field in {what}"))).otherwise(F.lit(True)))


def read_pair_classification(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``sentence1, sentence2, label`` JSONL; a missing key is an error."""
    df = spark.read.schema("sentence1 string, sentence2 string, label string").option("mode", "FAILFAST").json(path)
    return _require(df, ["sentence1", "sentence2", "label"], "pair classification")


def read_classification(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``sentence, label, label_desc`` JSONL."""
    df = spark.read.schema("sentence string, label string, label_desc string").option("mode", "FAILFAST").json(path)
    return _require(df, ["sentence", "label"], "classification")


def read_instructions(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``instruction, input, response`` JSONL."""
    df = spark.read.schema("instruction string, input string, response string").option("mode", "FAILFAST").json(path)
    return _require(df, ["instruction", "input", "response"], "instructions")


def read_messages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved messages, one JSON array of ``{src, trg, pred}`` (with ``lines`` one object a line,
    as A17 writes them: splittable); char lists added."""
    df = spark.read.schema("src string, trg string, pred string").option("multiLine", not lines).json(path)
    return df.select("src", "trg", "pred", chars("src").alias("src_tokens"), chars("trg").alias("trg_tokens"),
                     chars("pred").alias("pred_tokens"))


# ---------------------------------------------------------------- A10 (confusion sets)

CONFUSION_FILES = {"shape": "stroke.json", "similar_sound": "pinyin_sim.json", "same_sound": "pinyin_sam.json"}


def read_confusion_map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One ``char -> [candidates]`` JSON object file -> long ``(kind, ch, idx, cand)``."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("ch", "cands"))
    return m.select(F.lit(kind).alias("kind"), "ch", F.posexplode("cands").alias("idx", "cand"))


def read_word_list(spark: SparkSession, path: str, drop_blank: bool = True) -> DataFrame:
    """Word list, one character per line -> ``(idx, ch)`` in file order."""
    lines = line_index(spark.read.text(path)).select(py_strip("value").alias("ch"), "line_idx")
    if drop_blank:
        lines = lines.where(F.col("ch") != "")
        from ..plans.indexing import row_index
        return row_index(lines, ["line_idx"], out_col="idx").select(F.col("idx").cast("int"), "ch")
    return lines.select(F.col("line_idx").cast("int").alias("idx"), "ch")


def read_confusions(spark: SparkSession, folder: str, drop_blank: bool = True) -> tuple[DataFrame, DataFrame]:
    """A10: the three maps as one long table plus the word list."""
    parts = [read_confusion_map(spark, f"{folder}/{f}", k) for k, f in CONFUSION_FILES.items()]
    conf = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return conf, read_word_list(spark, f"{folder}/word_freq.txt", drop_blank)


# ---------------------------------------------------------------- A12 (inventory and guard)

def inventory(df: DataFrame, allow_example: bool = False) -> DataFrame:
    """Rows and bytes per input file (sorted by path); a basename containing
    ``.example.`` fails the query unless allowed."""
    t = df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
                  F.col("_metadata.file_size").alias("file_size"))
    if not allow_example:
        t = t.where(F.when(F.col("file_name").contains(".example."),
                           F.raise_error(F.concat(F.lit("example file as input: "), F.col("file_name"))))
                    .otherwise(F.lit(True)))
    return t.groupBy("file_path", "file_name", "file_size").agg(F.count(F.lit(1)).alias("n_rows"))
