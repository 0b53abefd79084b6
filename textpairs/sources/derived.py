"""Reference-shaped tables derived by Spark from the driver's tables.

The driver's ``documents`` hold Latin-script prose, so the correction data is derived:
every line of every document (the whole text, no prefix) becomes one clean sentence
(``tgt``, whitespace removed); H01 noise makes the wrong sentence ``src`` for 4 rows in 5;
a rule-based stand-in corrector gives ``pred``. ``lang`` plays the domain, ``source`` the
evaluation category. The confusion set for Latin letters is a small rule-built table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..operators.noise import inject_noise, replaced
from ..session import constant_table

# ---------------------------------------------------------------------------
# Fixed values of the Latin stand-in confusion set (our own rule, not the reference's
# Chinese tables, which are absent from its checkout).
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
SAME_SOUND_GROUPS = ["aeiouy", "bp", "dt", "ckq", "fv", "sz", "mn", "lr", "gj"]
SHAPE_PAIRS = ["bd", "pq", "il", "oc", "uv", "mw", "nh", "ft", "ea"]
CHAR_CLASS = "[a-z]"
SEED = 42
# ---------------------------------------------------------------------------


def latin_confusion_rows() -> list[tuple[str, str, int, str]]:
    """``(kind, ch, idx, cand)``: same sound = other members of the letter's group,
    similar sound = alphabet neighbours, shape = look-alike partner. h, w, x have no
    same-sound entry, most letters no shape entry: those fall back to the word list."""
    rows = []
    for group in SAME_SOUND_GROUPS:
        for ch in group:
            for i, cand in enumerate(c for c in group if c != ch):
                rows.append(("same_sound", ch, i, cand))
    for k, ch in enumerate(ALPHABET):
        neigh = [ALPHABET[j] for j in (k - 1, k + 1) if 0 <= j < len(ALPHABET)]
        for i, cand in enumerate(neigh):
            rows.append(("similar_sound", ch, i, cand))
    for a, b in SHAPE_PAIRS:
        rows.append(("shape", a, 0, b))
        rows.append(("shape", b, 0, a))
    return rows


def word_rows() -> list[tuple[int, str]]:
    return list(enumerate(ALPHABET))


def confusion_df(spark: SparkSession) -> DataFrame:
    return constant_table(spark, latin_confusion_rows(), "kind string, ch string, idx int, cand string")


def words_df(spark: SparkSession) -> DataFrame:
    return constant_table(spark, word_rows(), "idx int, ch string")


# Tables whose rows carry long texts: the work per row is large, so an input with fewer
# splits than the cluster has cores is spread before the heavy projections.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a driver table. Parquet splits by row group: a file written as one row group is
    one task. If a text table has fewer partitions than the default parallelism it is
    hash-partitioned by its key (deterministic, retry-safe); at cluster scale the file splits
    already give enough tasks and nothing is added."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = TEXT_KEYS.get(name)
    if key is not None:
        par = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par:
            df = df.repartition(par, key)
    return df


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05 stand-in: every line of every document, ``tgt`` without whitespace."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    s = docs.select("doc_id", "lang", "source",
                    F.posexplode(F.split("text", "\n")).alias("sent_no", "line"))
    return (s.withColumn("sent_no", F.col("sent_no").cast("bigint"))
            .withColumn("tgt", F.regexp_replace("line", "[ \\t\\r]+", ""))
            .withColumn("k", rng.row_key("doc_id", "sent_no"))
            .withColumn("guid", F.concat_ws("-", F.col("doc_id").cast("string"),
                                            F.col("sent_no").cast("string"))))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pairs: ``src`` = H01 noise of ``tgt`` on 4 rows of 5, else unchanged."""
    s = sentences(spark, sf_dir)
    negative = F.pmod(rng.hash32(F.col("k"), rng.purpose("neg", SEED)), F.lit(5)) == 0
    return inject_noise(s, "tgt", "k", confusion_df(spark), words_df(spark), len(ALPHABET),
                        seed=SEED, char_class=CHAR_CLASS, out_col="src", apply=~negative)


def stand_in_prediction(src: str = "src", tgt: str = "tgt", key: str = "k", roll=None):
    """Rule corrector: half right, a quarter unchanged, a quarter wrong at the last char."""
    r = roll if roll is not None else F.pmod(rng.hash32(F.col(key), rng.purpose("pred", SEED)), F.lit(4))
    t = F.col(tgt)
    wrong = F.when(F.length(t) == 0, t).otherwise(
        F.concat(t.substr(F.lit(1), F.length(t) - 1), F.lit("#")))
    return F.when(r < 2, t).when(r == 2, F.col(src)).otherwise(wrong)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, tgt, pred) per sentence with ``lang`` (domain) and ``source`` (category)."""
    p = pairs(spark, sf_dir).withColumn("_r", F.pmod(rng.hash32(F.col("k"), rng.purpose("pred", SEED)), F.lit(4)))
    return p.withColumn("pred", stand_in_prediction(roll=F.col("_r"))).drop("_r")


def triple_parts(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """``keep`` and what a triple is made of: ``tgt``, the replaced place and character, the corrector's roll.
    A third of a triple's bytes, for plans that shuffle or sort whole rows; ``from_parts`` makes the rest."""
    p = pairs(spark, sf_dir).withColumn("_r", F.pmod(rng.hash32(F.col("k"), rng.purpose("pred", SEED)), F.lit(4)))
    return p.select(*keep, "tgt", "noise_pos", "noise_to", "_r")


def from_parts(parts: DataFrame) -> DataFrame:
    """``triple_parts`` with src and pred."""
    p = parts.withColumn("src", replaced(F.col("tgt"), F.col("noise_pos"), F.col("noise_to")))
    return p.withColumn("pred", stand_in_prediction(roll=F.col("_r"))).drop("noise_pos", "noise_to", "_r")


# ---------------------------------------------------------------- raw line stand-ins

# Vocabulary stand-in: printable ASCII, ids 5.. after the five specials (non-ASCII -> UNK).
VOCAB_SYMBOLS = "".join(chr(c) for c in range(33, 127))
MAX_SEQ = 128


def vocab(spark: SparkSession) -> DataFrame:
    from ..operators.vocab import basic_vocab
    return basic_vocab(spark, VOCAB_SYMBOLS)


def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSONL pair lines with rule-based breakage (1 line in 13 each): cut JSON, missing
    field, number instead of string, blank line, a space inside src, tgt one shorter,
    empty src, a second object or a bare word behind the object, a repeated key (its last
    value counts); the rest are valid ``{"src":..,"tgt":..}`` lines."""
    p = pairs(spark, sf_dir).withColumn("_f", F.pmod(rng.hash32(F.col("k"), rng.purpose("fmt", SEED)), F.lit(13)))
    f = F.col("_f")
    s, t = F.col("src"), F.col("tgt")
    js = F.to_json(F.struct(s.alias("src"), t.alias("tgt")))
    spaced = F.concat(s.substr(F.lit(1), F.lit(1)), F.lit(" "), s.substr(F.lit(3), F.length(s)))
    shorter = t.substr(F.lit(1), F.greatest(F.length(t) - 1, F.lit(0)))
    line = (F.when(f == 0, F.substring(js, 1, 5))
            .when(f == 1, F.to_json(F.struct(s.alias("src"))))
            .when(f == 2, F.to_json(F.struct(F.lit(7).alias("src"), t.alias("tgt"))))
            .when(f == 3, F.lit(""))
            .when(f == 4, F.to_json(F.struct(spaced.alias("src"), t.alias("tgt"))))
            .when(f == 5, F.to_json(F.struct(s.alias("src"), shorter.alias("tgt"))))
            .when(f == 6, F.to_json(F.struct(F.lit("").alias("src"), t.alias("tgt"))))
            .when(f == 7, F.concat(js, F.lit(' {"c":1}')))
            .when(f == 8, F.concat(js, F.lit(" x}")))
            .when(f == 9, F.concat(F.lit('{"src":0,'), F.substring(js, 2, 1 << 30)))
            .otherwise(js))
    return p.select("guid", "doc_id", "sent_no", "lang", "source", "k", line.alias("line"))


def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaced-pair TSV lines (tokens joined by spaces) with rule-based breakage for the
    lenient reader: no tab, an extra tab, a trailing tab (empty target), char-only sides."""
    p = pairs(spark, sf_dir).withColumn("_f", F.pmod(rng.hash32(F.col("k"), rng.purpose("tsv", SEED)), F.lit(11)))
    f = F.col("_f")
    p = p.withColumns({"_ss": F.array_join(F.split("src", ""), " "), "_ts": F.array_join(F.split("tgt", ""), " ")})
    ss, ts = F.col("_ss"), F.col("_ts")
    line = (F.when(f == 0, ss)
            .when(f == 1, F.concat(ss, F.lit("\t"), ts, F.lit("\t"), ts))
            .when(f == 2, F.concat(ss, F.lit("\t")))
            .when(f == 3, F.concat(F.col("src"), F.lit("\t"), F.col("tgt")))
            .otherwise(F.concat(ss, F.lit("\t"), ts)))
    return p.select("guid", "doc_id", "sent_no", "lang", "source", "k", line.alias("line"))
