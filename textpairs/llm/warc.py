"""Operator 10, WARC derivatives: metadata and plain-text conversion records from responses.

A response record is a row with ``record_id``, ``target_uri``, ``date`` and ``block`` (the HTTP response:
status line, headers, blank line, payload). Each gives two linked records: a ``conversion`` (text/plain)
and a ``metadata`` record (application/warc-fields). Both name their source in WARC-Refers-To, keep its
WARC-Target-URI and WARC-Date, and each other in WARC-Concurrent-To; the metadata block keeps the source's
status, HTTP headers, payload and block digests and lengths. Record ids are computed from the source's
id, so a rerun gives the same records. Columns only, one pass, no shuffle.

The text of a conversion follows the source's Content-Type (folded header lines are joined first, names
compare without case): HTML, also where no type is named, is stripped; other text is kept as it is; anything
else has an empty text. Statuses other than 200 are converted like any other and named in the metadata.

Edge cases: a null page, url or html counts as empty text (its records are still made); a block without
a blank line is all headers; an unclosed script, style or comment is kept as text; repeated rows give
repeated records with equal ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

DATE = "2024-01-01T00:00:00Z"

# Elements without visible text, elements that end a line, named character references.
HIDDEN = ("script", "style", "noscript", "template", "title")
BREAKING = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|"
            "nav|ol|p|pre|section|table|td|th|tr|ul")
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·", "hellip": "…",
            "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "euro": "€", "amp": "&"}
TAG_END = "(?:[ \\t\\n\\r\\f/][^>]*)?>"
# One pass: comments and hidden elements, whichever begins first.
UNSEEN = "(?is)<!--.*?-->|" + "|".join(f"<{name}{TAG_END}.*?</{name}[ \\t\\n\\r\\f]*>" for name in HIDDEN)
BREAK = f"(?i)</?(?:{BREAKING}){TAG_END}"
TAG = "<[a-zA-Z/!?][^>]*>"
SPACE = (("[ \\t\\r\\f]{2,}|[\\t\\r\\f]", " "),  # a lone space stays as it is
         (" ?\\n[ \\n]*", "\n"))
TITLE = f"(?is)<title{TAG_END}(.*?)</title"
NUMBER, HEX = "^#[0-9]{1,7}$", "^#[xX][0-9a-fA-F]{1,6}$"


def plain_text(html: Column) -> Column:
    """Visible text: one line per block element, character references decoded once, spaces squeezed."""
    t = F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), "[\\n\\r]+", " ")
    return _finish(F.regexp_replace(F.regexp_replace(t, BREAK, "\n"), TAG, ""))


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    ok = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def _decoded(t: Column) -> Column:
    """Character references decoded, each once: what follows an ampersand up to a semicolon is looked up."""
    names = F.create_map(*[F.lit(x) for name, char in ENTITIES.items() for x in (name, char)])

    def one(x: Column, i: Column) -> Column:
        name = F.substring_index(x, ";", 1)
        known = (F.when(name.rlike(NUMBER), _character(F.substring(name, 2, 7).cast("bigint")))
                 .when(name.rlike(HEX), _character(F.conv(F.substring(name, 3, 6), 16, 10).cast("bigint")))
                 .otherwise(F.try_element_at(names, name)))
        ended = (F.length(name) < F.length(x)) & (F.length(name) <= 9)
        char = F.concat(F.when(ended, known), F.substring(x, F.length(name) + 2, F.length(x)))
        return F.when(i == 0, x).otherwise(F.coalesce(char, F.concat(F.lit("&"), x)))

    return F.array_join(F.transform(F.split(t, "&"), one), "")


def _finish(t: Column) -> Column:
    t = _decoded(t)
    for pattern, to in SPACE:
        t = F.regexp_replace(t, pattern, to)
    return F.btrim(t, F.lit(" \n"))


def _urn(seed: Column) -> Column:
    """A record id from the md5 of its seed."""
    h = F.md5(seed)
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    html = text("html")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                     F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html)
    return pages.select("page_id", _urn(F.concat_ws("|", F.lit("response"), text("page_id"), text("url"))).alias("record_id"),
                        text("url").alias("target_uri"), F.lit(date).alias("date"), block.alias("block"))


def _digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows per response: key, record_type, record_id, refers_to, concurrent_to, target_uri, date,
    content_type, content_length, block_digest, block."""
    block = F.coalesce(F.col("block"), F.lit(""))
    gap = F.instr(block, "\r\n\r\n")
    parts = records.select(
        F.col(key), F.col("record_id").alias("refers_to"), "target_uri", "date",
        F.regexp_replace(F.when(gap > 0, F.substring(block, F.lit(1), gap - 1)).otherwise(block), "\r\n[ \t]+", " ").alias("http"),
        F.when(gap > 0, F.substring(block, gap + 4, F.length(block))).otherwise(F.lit("")).alias("payload"),
        _digest(block).alias("source_block"), F.octet_length(block).alias("source_length"),
        _urn(F.concat(F.lit("conversion|"), F.col("record_id"))).alias("conversion_id"),
        _urn(F.concat(F.lit("metadata|"), F.col("record_id"))).alias("metadata_id"))
    kind = F.lower(F.regexp_extract("http", "(?im)^content-type:[ \\t]*([^;\\r\\n \\t]*)", 1))
    html = kind.isin("", "text/html", "application/xhtml+xml")
    text = F.when(html, plain_text(F.col("payload"))).when(kind.startswith("text/"), F.col("payload")).otherwise("")
    title = _finish(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), "[\\n\\r]+", " "))
    fields = F.concat(
        F.lit("title: "), F.when(html, title).otherwise(""), F.lit("\r\nsource-status: "), F.substring_index("http", "\r\n", 1),
        F.when(F.instr("http", "\r\n") > 0,
               F.concat(F.lit("\r\nsource-header: "),
                        F.replace(F.expr("substring(http, instr(http, '\r\n') + 2)"), F.lit("\r\n"), F.lit("\r\nsource-header: "))))
        .otherwise(F.lit("")),
        F.lit("\r\nsource-payload-digest: "), _digest(F.col("payload")), F.lit("\r\nsource-block-digest: "), F.col("source_block"),
        F.lit("\r\nsource-content-length: "), F.col("source_length").cast("string"),
        F.lit("\r\nconversion-record: "), F.col("conversion_id"), F.lit("\r\n"))
    made = parts.select(key, "refers_to", "target_uri", "date", F.explode(F.array(
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("record_id"),
                 F.col("metadata_id").alias("concurrent_to"), F.lit("text/plain; charset=utf-8").alias("content_type"),
                 text.alias("block")),
        F.struct(F.lit("metadata").alias("record_type"), F.col("metadata_id").alias("record_id"),
                 F.col("conversion_id").alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"),
                 fields.alias("block")))).alias("d"))
    return made.select(key, "d.record_type", "d.record_id", "refers_to", "d.concurrent_to", "target_uri", "date",
                       "d.content_type", F.octet_length("d.block").cast("bigint").alias("content_length"),
                       _digest(F.col("d.block")).alias("block_digest"), "d.block")


def render(derived: DataFrame) -> DataFrame:
    """Adds ``record``: the WARC 1.1 record as text, ready to be written one after the other."""
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"),
        F.lit("\r\nWARC-Date: "), F.col("date"), F.lit("\r\nWARC-Target-URI: "), F.col("target_uri"),
        F.lit("\r\nWARC-Refers-To: "), F.col("refers_to"), F.lit("\r\nWARC-Concurrent-To: "), F.col("concurrent_to"),
        F.lit("\r\nWARC-Block-Digest: "), F.col("block_digest"), F.lit("\r\nContent-Type: "), F.col("content_type"),
        F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"))
    return derived.withColumn("record", F.concat(header, F.col("block"), F.lit("\r\n\r\n")))


def op10_warc_derivatives(spark, sf_dir) -> DataFrame:
    """Metadata and conversion records of every page."""
    return derive(responses(table(spark, sf_dir, "pages")))


# ---------------------------------------------------------------------------- DuckDB

def _q(s: str) -> str:
    """An SQL string literal; line ends are written as chr() so that the text stays on one line."""
    out = "'" + s.replace("'", "''") + "'"
    for char, code in (("\r", 13), ("\n", 10)):
        out = out.replace(char, f"' || chr({code}) || '")
    return f"({out})"


def _sql_replace(t: str, pattern: str, to: str) -> str:
    return f"regexp_replace({t}, {_q(pattern)}, {_q(to)}, 'g')"


def _sql_finish(t: str) -> str:
    names = "MAP {" + ", ".join(f"{_q(name)}: {_q(char)}" for name, char in ENTITIES.items()) + "}"
    name = "split_part(x, ';', 1)"
    code = (f"(CASE WHEN regexp_matches({name}, '{NUMBER}') THEN substr({name}, 2)::BIGINT "
            f"WHEN regexp_matches({name}, '{HEX}') THEN ('0x' || substr({name}, 3))::BIGINT END)")
    known = (f"CASE WHEN {code} IS NULL THEN {names}[{name}] WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 "
             f"THEN chr({code}::INTEGER) ELSE chr(65533) END")
    ended = f"length({name}) < length(x) AND length({name}) <= 9"
    t = (f"array_to_string(list_transform(string_split({t}, '&'), lambda x, i: CASE WHEN i = 1 THEN x ELSE coalesce("
         f"CASE WHEN {ended} THEN {known} || substr(x, length({name}) + 2) END, '&' || x) END), '')")
    for pattern, to in SPACE:
        t = _sql_replace(t, pattern, to)
    return f"trim({t}, ' ' || chr(10))"


def _sql_text(t: str) -> str:
    t = _sql_replace(_sql_replace(t, UNSEEN, ""), "[\\n\\r]+", " ")
    return _sql_finish(_sql_replace(_sql_replace(t, BREAK, "\n"), TAG, ""))


def _sql_urn(t: str) -> str:
    cuts = " || '-' || ".join(f"substr(md5({t}), {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"('<urn:uuid:' || {cuts} || '>')"


NL = "(chr(13) || chr(10))"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(CAST(page_id AS VARCHAR), '') AS pid, coalesce(url, '') AS target_uri,
                  coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, {_sql_urn("'response|' || pid || '|' || target_uri")} AS refers_to,
             'Content-Type: text/html; charset=utf-8' AS h1, 'Content-Length: ' || CAST(strlen(payload) AS VARCHAR) AS h2 FROM p),
b AS (SELECT *, 'HTTP/1.1 200 OK' || {NL} || h1 || {NL} || h2 || {NL} || {NL} || payload AS source,
             {_sql_urn("'conversion|' || refers_to")} AS cid, {_sql_urn("'metadata|' || refers_to")} AS mid FROM r),
d AS (
  SELECT page_id, 'conversion' AS record_type, cid AS record_id, refers_to, mid AS concurrent_to, target_uri,
         'text/plain; charset=utf-8' AS content_type, {_sql_text("payload")} AS block FROM b
  UNION ALL
  SELECT page_id, 'metadata', mid, refers_to, cid, target_uri, 'application/warc-fields',
         'title: ' || {_sql_finish(_sql_replace(f"regexp_extract(payload, {_q(TITLE)}, 1)", "[\\n\\r]+", " "))}
         || {NL} || 'source-status: HTTP/1.1 200 OK' || {NL} || 'source-header: ' || h1 || {NL} || 'source-header: ' || h2
         || {NL} || 'source-payload-digest: sha256:' || sha256(payload) || {NL} || 'source-block-digest: sha256:' || sha256(source)
         || {NL} || 'source-content-length: ' || CAST(strlen(source) AS VARCHAR) || {NL} || 'conversion-record: ' || cid || {NL}
  FROM b)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '{DATE}' AS date, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, block FROM d"""
