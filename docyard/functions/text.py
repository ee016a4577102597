"""Native text functions with Python ``str`` semantics.

Java's ``\\s`` is ASCII-only and Spark's ``trim`` removes only spaces, so the
whitespace and line-break classes that Python's ``str.isspace``/``re`` ``\\s``
and ``str.splitlines`` use are spelled out here. The ``\\x{...}`` escapes are
read the same way by Java regexes (Spark) and RE2 (the DuckDB oracle).

Everything except NFKC is a JVM expression and stays inside whole-stage
codegen; NFKC has no Spark builtin and runs as one Arrow-batched UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters Python treats as white space, and as line breaks.
PY_WS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}]")
PY_WS_BODY = PY_WS[1:-1]
#: The same characters as a string, for ``trim``: only the ends of a text are looked at, where a regex tries every place.
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
               + "\u2028\u2029\u202f\u205f\u3000")
# one class, then the LF of a CR LF: an alternation would be tried branch by branch at every character
LINE_SEP = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}](?:(?<=\r)\n)?"

# Typography mapped to ASCII after NFKC, in the reference's order:
# left/right single quote, left/right double quote, en dash, em dash, no-break space.
TYPOGRAPHY_FROM = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0"
TYPOGRAPHY_TO = "''\"\"-- "

# Default boilerplate line patterns (Python regex syntax).
DEFAULT_BOILERPLATE_PATTERNS = (
    r"page\s+\d+\s+of\s+\d+",
    r"©\s*\d{4}",
    r"all rights reserved",
    r"^\s*[-–—]{3,}\s*$",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def portable_regex(pattern: str) -> str:
    """Rewrite a Python ``re`` pattern so Java and RE2 read it the same way.

    Only the escapes whose meaning differs are rewritten: ``\\s`` becomes the
    Python white-space class and ``\\d`` becomes ``\\p{Nd}`` (Python's ``\\d`` is
    any decimal digit). Inside a bracket class ``\\s`` expands to the class body.
    """
    out: list[str] = []
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(PY_WS_BODY if in_class else PY_WS)
            elif nxt == "d":
                out.append(r"\p{Nd}")
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            # a leading ']' or '^]' is literal inside a class
            if pattern[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1:i + 2] == "]":
                out.append("]")
                i += 1
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def py_strip(col: Column | str) -> Column:
    """``str.strip()``: remove leading and trailing Python white space."""
    return F.trim(_c(col), F.lit(PY_WS_CHARS))


def split_lines(col: Column | str) -> Column:
    """``str.splitlines()`` as an array (a final line break adds no empty line)."""
    def without_last(lines: Column) -> Column:
        n = F.size(lines)
        return F.when((n > 1) & (F.get(lines, n - 1) == F.lit("")), F.slice(lines, 1, n - 1)).otherwise(lines)

    return F.get(F.transform(F.array(F.split(_c(col), LINE_SEP)), without_last), 0)


def normalize_whitespace(col: Column | str) -> Column:
    """Split on 2+ LF, squeeze spaces/tabs, strip, drop empty, join by a blank line."""
    paragraphs = F.split(_c(col), r"\n{2,}")
    cleaned = F.transform(paragraphs, lambda p: py_strip(F.regexp_replace(p, r"[ \t]+", " ")))
    return F.array_join(F.filter(cleaned, lambda p: p != F.lit("")), "\n\n")


def boilerplate_regex(patterns: tuple[str, ...] | list[str] | None = None) -> str | None:
    """One case-insensitive Java regex for a pattern list (None: the defaults)."""
    active = DEFAULT_BOILERPLATE_PATTERNS if patterns is None else tuple(patterns)
    if not active:
        return None
    return "(?iu)" + "|".join(f"(?:{portable_regex(p)})" for p in active)


def strip_boilerplate(col: Column | str, patterns: tuple[str, ...] | list[str] | None = None) -> Column:
    """Drop every line in which any pattern is found (case-insensitive), join by LF.

    Given patterns replace the defaults; an empty list keeps every line (an
    empty alternation would match every line, so the filter is skipped).
    """
    lines = split_lines(col)
    rx = boilerplate_regex(patterns)
    if rx is not None:
        lines = F.filter(lines, lambda line: ~line.rlike(rx))
    return F.array_join(lines, "\n")


def _nfkc_one(x: str | None) -> str | None:
    if x is None or x.isascii() or unicodedata.is_normalized("NFKC", x):
        return x
    return unicodedata.normalize("NFKC", x)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC (no Spark builtin); ASCII and already-normal rows pass as is."""
    return s.map(_nfkc_one)


def is_ascii(col: Column | str) -> Column:
    """Whether every character is one byte."""
    return F.octet_length(_c(col)) == F.length(_c(col))


def nfkc_column(col: Column | str) -> Column:
    """NFKC of a column; only rows holding a non-ASCII character are sent to Python.

    NFKC leaves ASCII text unchanged, so the UDF gets NULL for pure-ASCII rows
    (their bytes are counted) and the original value is kept for them.
    """
    c = _c(col)
    return F.coalesce(nfkc(F.when(~is_ascii(c), c)), c)


def normalize_unicode(col: Column | str) -> Column:
    """NFKC, then typographic quotes/dashes and NBSP to ASCII."""
    c = _c(col)
    return F.when(is_ascii(c), c).otherwise(F.translate(nfkc_column(c), TYPOGRAPHY_FROM, TYPOGRAPHY_TO))


def normalize_query(col: Column | str) -> Column:
    """NFKC, lower case, white-space runs to one space, strip."""
    return py_strip(F.regexp_replace(F.lower(nfkc_column(col)), f"{PY_WS}+", " "))


def is_empty_query(col: Column | str) -> Column:
    return F.length(normalize_query(col)) == 0


def default_cleaning_steps(patterns: tuple[str, ...] | list[str] | None = None):
    """The ordered cleaning steps: unicode, boilerplate, white space."""
    return [
        normalize_unicode,
        lambda c: strip_boilerplate(c, patterns),
        normalize_whitespace,
    ]


def apply_steps(col: Column | str, steps) -> Column:
    out = _c(col)
    for step in steps:
        out = step(out)
    return out


def with_column_where(df, name: str, value: Column, predicate) -> "DataFrame":  # noqa: F821
    """Set column ``name`` to ``value`` and keep the rows where ``predicate(value)`` holds.

    ``value`` is evaluated once per row: it is bound inside a one-element
    array, filtered there, and exploded. A plain ``withColumn(...).filter(...)``
    lets the optimizer copy the (costly) expression into the filter and push
    that below earlier operators, evaluating it twice.
    """
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.filter(F.array(value), predicate)).alias(name))


def bind_column(df, name: str, value: Column) -> "DataFrame":  # noqa: F821
    """Add column ``name`` computed exactly once per row, even when it has many consumers.

    A column defined by ``withColumn`` may be inlined by the optimizer into
    each expression that uses it (and into Python UDF inputs), repeating the
    work; the output of a one-element ``explode`` is a fresh attribute that
    every consumer reads.
    """
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(value)).alias(name))
