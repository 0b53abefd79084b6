import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# columns whose names clash with those that operators add
CLASH = (", kept boolean, score double, spans string, fp bigint, th bigint, ids array<int>, piece int, margin double, "
         "_fp bigint, removed_lines string, lang_pred string")


def words(rng, n, lang="en"):
    stems = {"en": ("the", "and", "tion", "ing", "of", "sh", "wh", "er"), "de": ("der", "und", "ung", "sch", "ein", "ver", "ü", "ß"),
             "fr": ("les", "eau", "oui", "ment", "é", "è", "de", "qu"), "es": ("los", "ción", "ñ", "que", "ado", "mente", "ll", "rr")}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def sample_docs(n=120, seed=1):
    """(doc_id, text, lang): prose in four languages, copies, near copies, repeated lines, odd texts."""
    rng = random.Random(seed)
    out = []
    shared = [words(rng, 60), words(rng, 30) + "\n" + words(rng, 30)]
    for i in range(n):
        lang = ("en", "de", "fr", "es")[i % 4]
        text = "\n".join(words(rng, rng.randint(3, 40), lang) for _ in range(rng.randint(1, 6)))
        if i % 9 == 4:
            text += "\n" + rng.choice(shared) + "\n\n" + words(rng, 5, lang)
        if i % 10 == 7 and out:
            _, text, lang = out[-3]
        if i % 10 == 8 and out:
            text, lang = out[-2][1] + " er", out[-2][2]
        if i % 11 == 5:
            text += "\nmail me: a.b@mail0.example.com or +1 (578) 555-6437, card 4111 1111 1111 1111 at 10.0.0.255"
        out.append((i, text, lang))
    same = "one line of words that comes back " * 3
    out += [(n, None, "en"), (n + 1, "", None), (n + 2, " \t\n\n ", "de"), (n + 3, "a", None), (None, "no id " * 30, "fr"),
            (n + 4, (same + "\n") * 40, "en"), (n + 5, "long " * 30_000, "en"), (n + 6, "x" * 20_000, None),
            (n + 7, "▁ ▁ 日本語 😀\0 é́ <|endoftext|>", None)]
    out += [out[3], out[3], (3, "another text under the same id", "en")]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, la, "src0", None if t is None else len(t)) for i, t, la in sample_docs()]
    return spark.createDataFrame(rows, DOC).cache()


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same rows with columns of clashing names."""
    from pyspark.sql import functions as F
    names = [c.rsplit(" ", 1) for c in CLASH[2:].split(", ")]
    return docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in names])


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 0 if i % 7 == 0 else 1, 0) for i in range(0, 100, 2)] + [(None, 1, 0), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def sf(spark, docs, labels, tmp_path_factory):
    """A folder of tables as the queries read them."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return d
