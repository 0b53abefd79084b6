"""Scalar string/array functions over Columns (all JVM-side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
# Punctuation ignored by the punctuation-blind equality, short and long lists.
PUNCT_SHORT = [".", "。", ",", "，", "?", "？", ":", "："]
PUNCT_LONG = [".", "。", ",", "，", "?", "？", ":", "：", "!", "！"]
# Han block used by the character predicate, inclusive.
HAN_CLASS = "[\\x{4e00}-\\x{9fff}]"
# ---------------------------------------------------------------------------

# Python's str.split()/strip() whitespace: Unicode White_Space plus U+001C..U+001F.
_PY_WS = "(?U)[\\s\\x{1c}-\\x{1f}]+"
PY_SPACES = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                              0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))

def empty_str_array() -> Column:
    return F.array().cast("array<string>")


def _c(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def chars(s: str | Column) -> Column:
    """Split into code points; ``''`` gives ``[]`` (Spark's split gives ``['']``)."""
    s = _c(s)
    return F.when(s.isNull(), F.lit(None).cast("array<string>")).when(
        F.length(s) == 0, empty_str_array()).otherwise(F.split(s, ""))


def py_strip(s: str | Column) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends."""
    return F.regexp_replace(_c(s), "^" + _PY_WS + "|" + _PY_WS + "$", "")


def py_trim(s: str | Column) -> Column:
    """``py_strip`` without a regex: only the ends of the text are looked at."""
    return F.trim(_c(s), F.lit(PY_SPACES))


def ws_tokens(s: str | Column) -> Column:
    """Python ``str.split()`` (no empties, Unicode whitespace)."""
    return F.array_remove(F.split(_c(s), _PY_WS), "")


def spaced_or_chars(s: str | Column) -> Column:
    """A02 side rule: whitespace split if the text holds a space, else one token per char."""
    s = _c(s)
    return F.when(F.instr(s, " ") > 0, ws_tokens(s)).otherwise(chars(s))


def is_class(ch: str | Column, char_class: str = HAN_CLASS) -> Column:
    """Single-character predicate (default: Han U+4E00..U+9FFF)."""
    return _c(ch).rlike("^" + char_class + "$")


def annotate(a: str | Column, b: str | Column) -> Column:
    """``(x->y)`` at differing positions of two token arrays.

    The zip stops at the shorter array; the rest of ``a`` is kept unchanged.
    """
    # arrays_zip evaluates both arrays once; it pads the shorter with NULLs, so entries
    # past the end of ``a`` are dropped and entries past the end of ``b`` keep ``a``.
    z = F.filter(F.arrays_zip(_c(a).alias("x"), _c(b).alias("y")), lambda e: e["x"].isNotNull())
    return F.array_join(
        F.transform(z, lambda e: F.when(
            e["y"].isNotNull() & (e["x"] != e["y"]),
            F.concat(F.lit("("), e["x"], F.lit("->"), e["y"], F.lit(")"))).otherwise(e["x"])),
        "")


def annotate_text(a: str | Column, b: str | Column) -> Column:
    """G03 on character strings."""
    return annotate(chars(a), chars(b))


def simple_difference(src: str | Column, trg: str | Column, note: Column | None = None,
                      style: str = "lines") -> Column:
    """``src->\\ntrg\\n`` (+ note) or ``src->trg``."""
    if style == "arrow":
        return F.concat(_c(src), F.lit("->"), _c(trg))
    parts = [_c(src), F.lit("->\n"), _c(trg), F.lit("\n")]
    if note is not None:
        parts.append(note)
    return F.concat(*parts)


def punct_equal(a: str | Column, b: str | Column, marks: list[str] = PUNCT_LONG) -> Column:
    """Equal length and equal at every position unless ``a``'s char is a mark.

    Not symmetric: only the first argument's characters are tested against the list.
    Arguments are token arrays.
    """
    a, b = _c(a), _c(b)
    mark_arr = F.array(*[F.lit(m) for m in marks])
    return (F.size(a) == F.size(b)) & F.forall(
        F.zip_with(a, b, lambda x, y: F.array_contains(mark_arr, x) | (x == y)),
        lambda v: v)


def punct_equal_text(a: str | Column, b: str | Column, marks: list[str] = PUNCT_LONG) -> Column:
    """G05 on strings. Codegen'd fast paths decide almost every row (identical strings,
    different lengths, first string without any mark); the per-character lambda only runs
    for equal-length, different strings whose first argument holds a mark."""
    a, b = _c(a), _c(b)
    mark_class = "[" + "".join("\\" + m if m in "\\^]-[" else m for m in marks) + "]"
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean"))
            .when(a == b, F.lit(True))
            .when(F.length(a) != F.length(b), F.lit(False))
            .when(~a.rlike(mark_class), F.lit(False))
            .otherwise(F.regexp(b, punct_pattern(a, marks))))


_PMARK = "\u0001"  # reserved: must not occur in compared texts


def punct_pattern(a: Column, marks: list[str]) -> Column:
    """Regex matching exactly the strings punctuation-blind equal to ``a``: ``a`` quoted
    literally, each of its mark characters replaced by ``.`` (any character)."""
    marked = F.translate(a, "".join(marks), _PMARK * len(marks))
    quoted = F.replace(marked, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    body = F.replace(quoted, F.lit(_PMARK), F.lit("\\E.\\Q"))
    return F.concat(F.lit("(?s)^\\Q"), body, F.lit("\\E$"))


def extract_response(generated: str | Column) -> Column:
    """struct(input, label, prediction) from a generated block.

    input = second to last paragraph's last line; label/prediction = last line.
    """
    g = _c(generated)
    paragraph = F.try_element_at(F.split(g, "\n\n"), F.lit(-2))
    return F.struct(
        F.try_element_at(F.split(paragraph, "\n"), F.lit(-1)).alias("input"),
        F.try_element_at(F.split(g, "\n"), F.lit(-1)).alias("last_line"),
    )


def strip_prefix(prediction: str | Column, prefix: str | Column) -> Column:
    """``prediction[len(input):]`` on strings."""
    return _substr_from(_c(prediction), F.length(_c(prefix)) + 1)


def _substr_from(s: Column, start: Column) -> Column:
    return F.when(start > F.length(s), F.lit("")).otherwise(s.substr(start, F.length(s)))


def arrow_interleave(src: str | Column, trg: str | Column) -> Column:
    """``[s1,'>',t1, s2,'>',t2, ...]``."""
    return F.flatten(F.zip_with(_c(src), _c(trg), lambda a, b: F.array(a, F.lit(">"), b)))


def arrow_recover(tokens: str | Column) -> Column:
    """Every third element (0-based index 2, 5, ...); NULL unless length % 3 == 0."""
    t = _c(tokens)
    return F.when(F.size(t) % 3 == 0, F.filter(t, lambda v, i: i % 3 == 2))


def strip_specials(tokens: str | Column, specials: list[str]) -> Column:
    """Drop special tokens (including UNK) from a decoded token list."""
    return F.filter(_c(tokens), lambda x: ~x.isin(*specials))


def first_diff(a: str | Column, b: str | Column) -> Column:
    """0-based first differing position of two token arrays; -1 when none."""
    # past the end of either array the comparison is null and so never found
    return F.array_position(F.zip_with(_c(a), _c(b), lambda x, y: x != y), True) - 1
