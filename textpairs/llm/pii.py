"""Operator 3, personal data: patterns propose spans, checksums confirm them, context scores them.

Every whole text is read once in Arrow batches. Base kinds are ``email``, ``ip``, ``card`` and
``phone``; a proposal that fails its validator is dropped and its characters are not retried.
The method adds ``iban`` (mod-97) and ``card13`` (13 to 15 digits, Luhn; only with a card word
nearby). A capital word behind an IBAN looks like one more of its groups, so its end is not the
pattern's: the country's length decides, or, for a code that is not in ``IBAN_LENGTH``, the last group border
at which mod-97 holds; the search goes on behind that end. Each span has a score: a prior per kind, raised when one of the kind's context words
stands in the ``WINDOW`` characters around it. Base spans are always reported; an added span
needs ``MIN_SCORE``.

Edge cases: null text counts as empty (no spans, digest of the empty string); a null doc_id is
passed through; repeated rows give repeated result rows; an empty table gives an empty result;
other columns of the input are ignored here and kept by :func:`redact`. All patterns are linear:
digit runs are entered only at their start, and addresses are read outward from each ``@``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, map_columns, table

# The kinds in order of output; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "card13")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "card13": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto"),
    "card13": ("card", "visa", "credit", "amex", "karte", "carte", "tarjeta"),
}
BONUS, WINDOW, MIN_SCORE = 0.3, 40, 0.5

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Characters of an IBAN by country code (ISO 13616).
IBAN_LENGTH = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in codes.split()}
NON_DIGIT = re.compile(r"[^0-9]+")
WORDS = {k: re.compile(r"\b(?:" + "|".join(v) + r")", re.IGNORECASE) for k, v in CONTEXT.items()}
LUHN_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += LUHN_DOUBLE[int(c)] if i % 2 else int(c)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    """Around each ``@``: the run of local characters before it (after the last match) and the
    dotted name behind it. Same spans as scanning from the left, without rescanning words."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            nxt = text.find("@", at + 1)
            done, at = at + 1, nxt


def _ibans(text: str):
    """At each proposal the IBAN that starts there, if any. A proposal without one is searched again
    from its second character: it may reach into the next IBAN. It has at most 43 characters, so
    this stays linear."""
    m = IBAN.search(text)
    while m:
        end = _iban_end(m[0])
        if end:
            yield m.start(), m.start() + end
        m = IBAN.search(text, m.start() + (end or 1))


def _iban_end(span: str) -> int:
    """Where the IBAN at the start of ``span`` ends, 0 if there is none."""
    borders = [i for i, c in enumerate(span) if c == " "] + [len(span)]
    known = IBAN_LENGTH.get(span[:2])
    for end in reversed(borders):
        code = span[:end].replace(" ", "")
        if (len(code) == known if known else 15 <= len(code) <= 34) and mod97(code):
            return end
    return 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start; code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() < 13:
            continue
        d = NON_DIGIT.sub("", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found["card" if len(d) >= 16 else "card13"].append(m.span())
    for m in IP.finditer(text):
        if all(map(_octet, m.groups())):
            found["ip"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NON_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
    found["iban"] = list(_ibans(text))
    out = []
    for kind in KINDS:
        for s, e in found[kind]:
            near = WORDS[kind].search(text, max(0, s - WINDOW), s) or WORDS[kind].search(text, e, e + WINDOW)
            score = min(1.0, PRIOR[kind] + BONUS * bool(near))
            if kind in BASE_KINDS or score >= MIN_SCORE:
                out.append((kind, s, e, round(score, 3)))
    return out


def redact_text(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Replace every span by ``[KIND]``; overlapping spans merge under the earliest one's kind."""
    parts, done = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            parts += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join([*parts, text[done:]]) if parts else text


def _render(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ``spans`` array of (kind, start, end, score)."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        rows = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in find_spans(t or "")]
                for t in batch.column(1).to_pylist()]
        yield {"key": batch.column(0), "spans": rows}

    return map_columns(docs.select(docs[key], docs[text]),
                       f"key {key_type}, spans array<struct<kind:string,start:int,end:int,score:double>>",
                       run).withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with every span of ``text`` masked; the other columns as they are, except that
    ``n_chars``, where there is one, is the new length. Null texts stay null."""
    names = docs.columns

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(text)
            new = [None if t is None else redact_text(t, find_spans(t)) for t in b.column(i).to_pylist()]
            yield b.set_column(i, b.schema.field(i), pa.array(new, type=b.schema.field(i).type))

    out = arrow_map(docs, run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length(text).cast(kind), F.col("n_chars")))
    return out.select(*names)


def op3_personal_data(spark, sf_dir) -> DataFrame:
    """Counts and spans of personal data in every whole text of ``documents``."""
    found = detect(table(spark, sf_dir, "documents"))

    def run(batch: pa.RecordBatch):
        spans = [[(x["kind"], x["start"], x["end"], x["score"]) for x in row] for row in batch.column(1).to_pylist()]
        base = [[x for x in row if x[0] in BASE_KINDS] for row in spans]
        yield {"doc_id": batch.column(0),
               **{f"n_{k}": [sum(x[0] == k for x in row) for row in base] for k in BASE_KINDS},
               "base_sha256": [hashlib.sha256(_render(row).encode()).hexdigest() for row in base],
               "spans": [_render(row) for row in spans],
               "scores": [",".join(f"{x[3]:g}" for x in row) for row in spans]}

    return map_columns(found, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                              "base_sha256 string, spans string, scores string", run)
