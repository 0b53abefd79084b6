"""Operators 1 to 5 against brute force, and their odd inputs."""
import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from textpairs.llm import langid, pieces, pii, registry, resample, rules


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# ---------------------------------------------------------------------- 1 pieces

def test_pieces_are_lossless_and_reproducible(docs, clashing, nothing):
    got = pieces.encode(docs)
    table = got.collect()
    assert len(table) == docs.count()
    assert all(r["lossless"] for r in table if r["ids"] is not None)
    assert sum(r["ids"] is None for r in table) == 1
    assert rows(got, "doc_id", "ids") == rows(pieces.encode(clashing.repartition(7)), "doc_id", "ids")
    back = collections.Counter(map(tuple, pieces.decode(got).collect()))
    assert back == collections.Counter(map(tuple, docs.select("doc_id", "text").collect()))
    assert pieces.encode(nothing).count() == 0
    assert rows(pieces.encode(docs, seed=2), "doc_id", "ids") != rows(got, "doc_id", "ids")


def test_pieces_are_drawn_with_their_lattice_weights():
    s = pieces.Sampler()
    n, text = 30_000, "nation of"
    ids, count = s.encode([text] * n, np.arange(n, dtype=np.uint64))
    ends = np.cumsum(count)
    seen = collections.Counter(tuple(ids[e - c:e].tolist()) for e, c in zip(ends, count))
    piece_of = {s.vocab.bytes[i]: i for i in range(3, s.vocab.size) if i not in set(s.vocab.byte_id.tolist())}

    def all_ways(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in piece_of:
                i = piece_of[rest[:k]]
                for tail, w in all_ways(rest[k:]):
                    yield (i, *tail), w + s.vocab.logp[i]

    ways = dict(all_ways(b" nation of"))
    total = sum(map(math.exp, ways.values()))
    assert set(seen) <= set(ways)
    for way, w in ways.items():
        p = math.exp(w) / total
        assert abs(seen[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=6))
def test_any_text_comes_back(texts):
    s = test_any_text_comes_back.__dict__.setdefault("sampler", pieces.Sampler())
    ids, count = s.encode(texts, np.arange(len(texts), dtype=np.uint64))
    ends = np.cumsum(count)
    assert [s.decode(ids[e - c:e].tolist()) for e, c in zip(ends, count)] == texts


def test_long_texts_are_sampled_the_same_in_parts_and_alone():
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcdefghij") for _ in range(4_000)), "a" * 2_500, " " * 1_800, "\n \n" * 700,
             "\u6c49\u5b57\U0001f389" * 900, " a  b\n\n  c " * 300, "word " * 2_000, ""]
    keys = np.arange(len(texts), dtype=np.uint64)
    whole = pieces.Sampler(slice_=10 ** 9, long_=10 ** 9).encode(texts, keys)
    for how in ({}, {"long_": 0}, {"slice_": 1_000}, {"slice_": 50, "long_": 20}):
        for got, want in zip(pieces.Sampler(**how).encode(texts, keys), whole):
            assert np.array_equal(got, want), how
    s, text = pieces.Sampler(), "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.process_time()
    ids, _ = s.encode([text], keys[:1])
    assert s.decode(ids) == text
    assert time.process_time() - began < 30  # a step of the batch for every character took minutes


# ------------------------------------------------------------------ 2 language ID

def test_language_query_marks_held_out_rows(spark, sf, docs):
    got = registry.QUERIES["op2_language_id"](spark, sf).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1


def test_held_out_languages_of_the_given_documents(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in registry.QUERIES["op2_language_id"](spark, d).collect() if r["held_out"]]
    assert len(out) > 200
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.95 * len(out)


def test_language_of_odd_texts(spark, docs, clashing, nothing):
    model = langid.train(docs)
    assert [x for x, _ in model] and all(len(d) <= langid.DICT_BYTES for _, d in model)
    got = {r["doc_id"]: r for r in langid.predict(clashing, model).collect()}
    for i in (120, 121, 122):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert langid.train(docs.repartition(5)) == model
    assert langid.predict(nothing, model).count() == 0
    assert langid.train(nothing) == []
    assert {r["lang_pred"] for r in langid.predict(docs, []).collect()} == {"und"}


def test_texts_without_letters_are_undetermined(spark, docs):
    model = langid.train(docs)
    odd = ["½ ²", "①②", "12 _ 3", "\u0301\u0302", "ⅷ Ⅷ", "...", "٣"]
    got = langid.predict(spark.createDataFrame([(t,) for t in odd], "text string"), model).collect()
    assert all((r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in got)
    assert langid.letters("हिन्दी में १२") == "हिन्दी में".encode()


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(2)
    stems = {"de": ["sch", "ung", "ver", "ein", "der", "ß", "ü"], "en": ["th", "ing", "tion", "of", "wh", "ea"]}
    prose = lambda n, la: " ".join("".join(rng.choice(stems[la]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    long = [(f"{i}", prose(9000, "de"), "de") for i in range(3)]
    short = [(f"s{i}", prose(60, "en"), "en") for i in range(50)]
    model = langid.train(spark.createDataFrame(long + short, "k string, text string, lang string"))
    assert min(len(d) for _, d in model) > 5_000 and all(len(t) > langid.SAMPLE_CHARS[1] for _, t, _ in long)
    new = [(prose(40, la), la) for la in ("de", "en") for _ in range(10)]
    got = langid.predict(spark.createDataFrame(new, "text string, truth string"), model).collect()
    assert sum(r["lang_pred"] == r["truth"] for r in got) >= 18


def test_compressed_sizes_by_hand(spark, docs):
    import zstandard
    model = langid.train(docs)

    def size(dictionary, data):
        primer, rest = dictionary[:langid.PRIMER_BYTES] + b" ", dictionary[langid.PRIMER_BYTES:] or b" " * 8
        def packed(x):  # noqa: E306
            d = zstandard.ZstdCompressionDict(rest, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                                write_dict_id=False).compress(x))
        return sum(packed(primer + p) - packed(primer) for p in langid.blocks(data))

    for r in langid.predict(docs.where("doc_id < 60 OR doc_id = 125"), model).collect():
        sizes = [size(d, langid.letters(r["text"])) for _, d in model]
        best, second = sorted(sizes)[:2]
        assert r["lang_pred"] == model[sizes.index(best)][0]
        assert abs(r["margin"] - (second - best) / second) < 1e-12
        assert r["rejected"] == (r["margin"] <= langid.MIN_MARGIN)


def test_blocks_hold_the_whole_text():
    for n in (0, 1, langid.BLOCK_BYTES, langid.BLOCK_BYTES + 1, 5_000_001):
        data = (b"0123456789" * (n // 10 + 1))[:n]
        parts = langid.blocks(data)
        assert b"".join(parts) == data and all(0 < len(x) <= langid.BLOCK_BYTES for x in parts)
        assert len(parts) == -(-n // langid.BLOCK_BYTES)


def test_long_clean_texts_stay_in_the_corpus(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = docs.where(langid.held_out()).where("lang = 'en' and text is not null").orderBy("doc_id")
    prose = "\n".join(r["text"] for r in held.select("text").collect()) * 2
    long = [(-n, prose[:n], None, "src0", n) for n in (1_000_000, 5_000_000)]
    both = docs.unionByName(spark.createDataFrame(long, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    kept = corpus_pipeline.language(spark, both, d).where("doc_id < 0").select("doc_id", "lang", "text").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in kept) == [(-5_000_000, "en"), (-1_000_000, "en")]
    assert all(r["text"] == prose[:-r["doc_id"]] for r in kept)
    margins = [r["margin"] for r in langid.predict(both, langid.train(docs.where(~langid.held_out())))
               .where("doc_id < 0").collect()]
    assert min(margins) > 0.5 * max(margins) and min(margins) > 5 * langid.MIN_MARGIN


# -------------------------------------------------------------------------- 3 PII

def plain_spans(text):
    """The contract's patterns as they are written."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        odd = sum(int(x) for x in d[::-1][::2]) + sum(sum(map(int, str(2 * int(x)))) for x in d[::-1][1::2])
        if 16 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+%(12 50)é|", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [x[:3] for x in pii.find_spans(text) if x[0] in pii.BASE_KINDS] == plain_spans(text)


def test_checked_and_scored_spans():
    text = "card: 4111-1111-1111-1111 iban GB82 WEST 1234 5698 7654 32, GB82 WEST 1234 5698 7654 33; amex card 378282246310005"
    found = {x[0]: x for x in pii.find_spans(text)}
    assert set(found) == {"card", "iban", "card13"}
    assert found["iban"][3] == 1.0 and text[found["card13"][1]:found["card13"][2]] == "378282246310005"
    assert not pii.find_spans("378282246310005 and 4111 1111 1111 1112 and 300.1.1.1")
    assert pii.redact_text("x a@b.cd 1.2.3.4", pii.find_spans("x a@b.cd 1.2.3.4")) == "x [EMAIL] [IP]"


def ibans(text):
    return [text[s:e] for k, s, e, _ in pii.find_spans(text) if k == "iban"]


def test_ibans_before_capital_words():
    some = ["BE68 5390 0754 7034", "BE68539007547034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332",
            "SE45 5000 0000 0583 9825 7466", "PL61 1090 1014 0000 0712 1981 2874", "NO93 8601 1117 947",
            "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S",
            "DE89370400440532013000"]
    for iban in some:
        for word in ("BIC", "EUR", "USD", "BANK", "A", "EUROS", "BIC EUR", "GEBABEBB", "EUR 12 USD", "and", "1234 BIC"):
            assert ibans(f"to {iban} {word}") == [iban], (iban, word)
            assert pii.redact_text(f"to {iban} {word}.", pii.find_spans(f"to {iban} {word}.")) == f"to [IBAN] {word}."
        for other in some:
            assert ibans(f"{iban} {other} EUR") == [iban, other]
            assert ibans(f"AB12 CDEF GHIJ {iban} {other}") == [iban, other]
        wrong = iban[:2] + f"{(int(iban[2:4]) + 1) % 97:02}" + iban[4:]
        assert not ibans(f"to {wrong} BIC")


def test_ibans_of_unlisted_countries_end_at_a_group():
    body = "1234 5678 9012 3456"
    check = 98 - int("".join(str(int(c, 36)) for c in body.replace(" ", "") + "ZZ00")) % 97
    iban = f"ZZ{check:02} {body}"
    for word in ("BIC", "BANK", "and"):
        assert ibans(f"to {iban} {word}") == [iban]
    assert ibans("x" + iban) == [] and "ZZ" not in pii.IBAN_LENGTH


def test_personal_data_query(spark, sf, docs, clashing, nothing):
    got = registry.QUERIES["op3_personal_data"](spark, sf)
    expected = []
    for i, t in docs.select("doc_id", "text").collect():
        base = plain_spans(t or "")
        n = collections.Counter(x[0] for x in base)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        expected.append((i, n["email"], n["ip"], n["card"], n["phone"], digest))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(expected, key=repr)
    clean = pii.redact(clashing)
    assert clean.columns == clashing.columns and clean.count() == clashing.count()
    assert clean.where("text like '%@mail0%' or n_chars != length(text)").count() == 0
    assert pii.redact(nothing).count() == 0 and pii.detect(nothing).count() == 0


# --------------------------------------------------------------- 4 and 5 quality

def signed(x):
    return x - (1 << 64) if x >> 63 else x


def gram_buckets(text, n):
    tokens = re.findall(r"[^\W]+|[^\w\s]+", (text or "").lower())
    h = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in tokens]
    long = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<q", v), seed & (1 << 64) - 1)
    pairs = [signed(long(b, long(a, 42))) for a, b in zip(h, h[1:])]
    return [x % n for x in h + pairs]


def test_ratio_models_equal_counting_by_hand(spark, docs, labels):
    good_ids = {r["doc_id"] for r in labels.where("quality = 1").collect()} - {None}
    n, raw, good = 512, collections.Counter(), collections.Counter()
    texts = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 100 or doc_id between 119 and 123").collect()]
    for i, t in texts:
        raw.update(b := gram_buckets(t, n))
        if i in good_ids:
            good.update(b)
    some = docs.where("doc_id < 100 or doc_id between 119 and 123")
    model = rules.fit(some, labels, n)
    share = lambda c, b: (c[b] + 1) / (sum(c.values()) + n)
    assert np.allclose(model, [math.log(share(good, b) / share(raw, b)) for b in range(n)])
    got = collections.Counter((r["doc_id"], round(r["score"], 9)) for r in rules.score(some, model).collect())
    expected = collections.Counter()
    for i, t in texts:
        b = gram_buckets(t, n)
        expected[i, round(sum(model[x] for x in b) / len(b), 9) if b else 0.0] += 1
    assert got == expected


def base_by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    cover = {k for p in at.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed


def test_quality_rules_query(spark, sf, docs, clashing, nothing):
    got = registry.QUERIES["op5_quality_rules"](spark, sf)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(got, *cols) == sorted(((i, *base_by_hand(t)) for i, t in docs.select("doc_id", "text").collect()), key=repr)
    assert got.where("kept and (base_failed or score < -0.25) or not kept and not base_failed and score >= -0.25").count() == 0
    flat = rules.fit(docs, nothing.selectExpr("doc_id", "1 as quality"))
    assert set(flat) == {0.0}
    assert rules.score(rules.base_rules(nothing), flat).count() == 0
    assert rules.score(rules.base_rules(clashing.drop("score")), flat).count() == docs.count()


def test_importance_resampling(spark, sf, docs, labels, nothing):
    got = registry.QUERIES["op4_importance_resampling"](spark, sf).collect()
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    k = round(len(got) * resample.target_share(labels))
    assert {r["gumbel_key"] for r in got if r["kept"]} == {x for x in keys if x >= keys[k - 1]}
    assert resample.resample(nothing, labels).count() == 0
    assert resample.resample(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert resample.resample(docs, labels, 0.0).where("kept").count() == 0


def test_importance_weights_and_draws_by_hand(spark, docs, labels):
    """Weight and Gumbel key of every document, from the models' ratios, the id and the seed alone."""
    some = docs.where("doc_id < 60 or doc_id between 119 and 123")
    clash = some.select("*", F.lit(1).alias("buckets"), F.lit("x").alias("trusted_id"), F.lit(2).alias("_b"), F.lit(3).alias("gumbel_key"))
    model = rules.fit(some, labels, resample.BUCKETS)
    word = lambda v, form, seed: xxhash.xxh64_intdigest(struct.pack(form, v), seed & (1 << 64) - 1)
    expected = {}
    for r in some.collect():
        b = gram_buckets(r["text"], resample.BUCKETS)
        u = ((word(resample.SEED, "<i", word(r["doc_id"], "<q", 42)) >> 11) + 0.5) / 2.0 ** 53
        expected[r["doc_id"], r["text"]] = (len(b), sum(model[x] for x in b), -math.log(-math.log(u)))
    assert len({round(x[2], 9) for x in expected.values()}) == len({i for i, _ in expected})
    by_id = collections.defaultdict(list)
    for (i, _), x in expected.items():
        by_id[i].append(x)
    for rows_ in (some, clash):
        for r in resample.weigh(rows_, labels).collect():
            assert any(r["n_grams"] == n and abs(r["log_weight"] - w) < 1e-6 and abs(r["gumbel_key"] - w - g) < 1e-6
                       for n, w, g in by_id[r["doc_id"]])


def test_helper_columns_of_the_rules_do_not_clash(spark, docs):
    names = ["_w", "_lines", "_b", "words", "lines", "buckets", "WORDS_"]
    rows_ = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names if n != "words"],
                        F.col("doc_id").alias("_words"))
    for out in (rules.base_rules(rows_), rules.score(rows_, [0.0] * 8)):
        for r in out.collect():
            assert all(r[n] == (None if r["doc_id"] is None else f"{n}:{r['doc_id']}") for n in names if n != "words")
            assert r["_words"] == r["doc_id"]


def test_kth_largest_narrows_to_the_exact_value(spark, monkeypatch):
    monkeypatch.setattr(resample, "FEW", 5)
    monkeypatch.setattr(resample, "BINS", 4)
    values = [float(x) for x in (3, 3, 3, -1e9, 7, 7.5, 7.25, 0, 0, 1e6, 2, 2, 2, 2, 2, 2, 2)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, len(values) + 1):
        assert resample.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
