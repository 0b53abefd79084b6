"""Independent SQL (DuckDB dialect) for every registered query.

Written by hand against the driver's views; shares nothing with the Spark code but the
fixed values (confusion rule, hash layout). Used as the correctness oracle.
"""

from __future__ import annotations

from ..sources.derived import ALPHABET, SEED, latin_confusion_rows, word_rows


def H(key: str, name: str, seed: int = SEED, cycle: int = 0) -> str:
    """Same integer as ``rng.hash32``: first 8 hex digits of md5(key || ':name.seed.cycle')."""
    return f"(('0x' || substr(md5(({key}) || ':{name}.{seed}.{cycle}'), 1, 8))::BIGINT)"


def _values_conf() -> str:
    rows = ", ".join(f"('{k}', '{c}', {i}, '{d}')" for k, c, i, d in latin_confusion_rows())
    return f"conf(kind, ch, idx, cand) AS (VALUES {rows})"


def _values_words() -> str:
    rows = ", ".join(f"({i}, '{c}')" for i, c in word_rows())
    return f"words(idx, ch) AS (VALUES {rows})"


SENT = """sent AS (
  SELECT doc_id, lang, source, sent_no, line,
         regexp_replace(line, '[ \\t\\r]+', '', 'g') AS tgt,
         CAST(doc_id AS VARCHAR) || ':' || CAST(sent_no AS VARCHAR) AS k,
         CAST(doc_id AS VARCHAR) || '-' || CAST(sent_no AS VARCHAR) AS guid
  FROM (SELECT doc_id, lang, source, unnest(range(len(parts))) AS sent_no, unnest(parts) AS line
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents) d0) d1
)"""


def noise_ctes(base: str, text: str, out: str, apply: str = "TRUE", cls: str = "[a-z]",
               seed: int = SEED, prefix: str = "n", elig: str | None = None) -> tuple[str, str]:
    """CTEs applying H01 to ``base``; returns (sql, name of last CTE). ``elig`` replaces
    the eligible-position list (1-based) when given."""
    p = prefix
    elig_sql = elig if elig is not None else (
        f"list_filter(range(1, length({text}) + 1), lambda i: regexp_matches(substr({text}, i, 1), '^{cls}$'))")
    kind = (f"CASE WHEN {H('k', 'kind', seed)} % 10 < 4 THEN 'same_sound' "
            f"WHEN {H('k', 'kind', seed)} % 10 < 7 THEN 'similar_sound' "
            f"WHEN {H('k', 'kind', seed)} % 10 < 9 THEN 'shape' ELSE 'word' END")
    sql = f"""{p}0 AS (
  SELECT *, CASE WHEN NOT ({apply}) THEN []::BIGINT[] ELSE {elig_sql} END AS _elig
  FROM {base}),
{p}1 AS (SELECT *, CASE WHEN len(_elig) > 0 THEN _elig[{H('k', 'pos', seed)} % len(_elig) + 1] END AS noise_pos
       FROM {p}0),
{p}2 AS (SELECT *, CASE WHEN noise_pos IS NOT NULL THEN substr({text}, noise_pos, 1) END AS noise_from,
              CASE WHEN noise_pos IS NOT NULL THEN {kind} END AS noise_kind
       FROM {p}1),
{p}3 AS (SELECT {p}2.*, ca.cands AS _cands, w.ch AS _wch
       FROM {p}2 LEFT JOIN confa ca ON ca.kind = {p}2.noise_kind AND ca.ch = {p}2.noise_from
                 LEFT JOIN words w ON w.idx = {H(p + '2.k', 'cand', seed)} % {len(ALPHABET)}),
{p}4 AS (SELECT * EXCLUDE (_elig, _cands, _wch),
              CASE WHEN noise_pos IS NULL THEN NULL
                   WHEN len(_cands) > 0 THEN _cands[{H('k', 'cand', seed)} % len(_cands) + 1]
                   ELSE _wch END AS noise_to
       FROM {p}3),
{p}5 AS (SELECT *, CASE WHEN noise_pos IS NULL THEN {text}
                      ELSE substr({text}, 1, noise_pos - 1) || noise_to || substr({text}, noise_pos + 1) END AS {out}
       FROM {p}4)"""
    return sql, f"{p}5"


def base_ctes(level: str = "triples") -> str:
    """WITH-list up to ``sent`` / ``pairs`` / ``triples``."""
    parts = [_values_conf(), _values_words(),
             "confa AS (SELECT kind, ch, list(cand ORDER BY idx) AS cands FROM conf GROUP BY kind, ch)",
             SENT]
    if level == "sent":
        return "WITH " + ",\n".join(parts)
    nsql, last = noise_ctes("sent", "tgt", "src", apply=f"{H('k', 'neg')} % 5 <> 0")
    parts.append(nsql)
    parts.append(f"pairs AS (SELECT * FROM {last})")
    if level == "pairs":
        return "WITH " + ",\n".join(parts)
    parts.append(f"""triples AS (
  SELECT *, CASE WHEN {H('k', 'pred')} % 4 < 2 THEN tgt
                 WHEN {H('k', 'pred')} % 4 = 2 THEN src
                 WHEN length(tgt) = 0 THEN tgt
                 ELSE substr(tgt, 1, length(tgt) - 1) || '#' END AS pred
  FROM pairs)""")
    return "WITH " + ",\n".join(parts)


def with_base(level: str, body: str, extra: str = "") -> str:
    """``WITH <base>, <extra> <body>``."""
    head = base_ctes(level)
    if extra:
        head += ",\n" + extra
    return head + "\n" + body
