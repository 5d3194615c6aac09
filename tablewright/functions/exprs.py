"""Column expressions that all operators share; each has a DuckDB twin in ``sql_*``.

Cells are text.  ``""`` is the blank cell and NULL a cell that the row lacks.  Numbers
are plain decimals with an optional exponent: ``1_000``, ``NaN``, ``Infinity`` and ``1d``
are text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARKERS = ("missing", "nil", "none", "null", "n/a", "na")
TRUE_WORDS, FALSE_WORDS = ("t", "true", "y", "yes"), ("f", "false", "n", "no")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BARE = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
BARE_INTEGER = r"\A[+-]?\d+\z"
INTEGER = r"^[+-]?\d+$"
DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def strip(v: Column) -> Column:
    """Without white space at either end, of Unicode and the ASCII separators 28 to 31."""
    return F.regexp_replace(v, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def folded(v: Column) -> Column:
    return F.lower(strip(v))


def collapsed(v: Column) -> Column:
    """Folded, with one space for each run of white space."""
    return F.lower(F.regexp_replace(strip(v), r"(?U)\s+", " "))


def _number(v: Column, kind: str) -> Column:
    """Most cells are bare numbers or blank, and are told so by one match."""
    s = F.replace(strip(v), F.lit("−"), F.lit("-"))
    return F.when(v == "", F.lit(None).cast(kind)).when(v.rlike(BARE), v.try_cast(kind)).when(s.rlike(NUMBER), s.try_cast(kind))


def to_num(v: Column) -> Column:
    """Double of a plain number, else NULL.  U+2212 is a minus sign."""
    return _number(v, "double")


def to_dec(v: Column) -> Column:
    """Exact ``decimal(18,6)`` of a plain number, else NULL."""
    return _number(v, "decimal(18,6)")


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def number_of(df: DataFrame, name: str) -> Column:
    """``to_num`` of a column's text; a column of integers needs no text for it."""
    c = F.col(f"`{name}`")
    return c.cast("double") if dict(df.dtypes)[name] in _WHOLE else to_num(c.cast("string"))


def decimal_of(df: DataFrame, name: str) -> Column:
    """``to_dec`` of a column's text; a column of integers needs no text for it."""
    c = F.col(f"`{name}`")
    return c.try_cast("decimal(18,6)") if dict(df.dtypes)[name] in _WHOLE else to_dec(c.cast("string"))


def fmt_num(v: Column) -> Column:
    """A decimal's digits without trailing zeros, exponent or a negative zero."""
    s = F.regexp_replace(F.regexp_replace(v.cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(s == "-0", "0").otherwise(s)


def is_close(a: Column, b: Column, abs_tol: float = 1e-6, rel_tol: float = 1e-6) -> Column:
    return F.abs(a - b) <= abs_tol + rel_tol * F.greatest(F.abs(b), F.lit(1.0))


def is_marker(v: Column) -> Column:
    return folded(v).isin(*NULL_MARKERS)


def boolean_word(v: Column) -> Column:
    """``true`` or ``false`` for a word of either list, else NULL."""
    w = folded(v)
    return F.when(w.isin(*TRUE_WORDS), "true").when(w.isin(*FALSE_WORDS), "false")


def value_type(v: Column) -> Column:
    """``empty, bool, int, float, date`` or ``string``."""
    s = strip(v)
    day = F.when(s.rlike(DATE), F.replace(s, F.lit("/"), F.lit("-")).try_cast("date"))
    return F.when(s == "", "empty").when(boolean_word(v).isNotNull(), "bool").when(s.rlike(INTEGER), "int").when(s.rlike(NUMBER), "float").when(day.isNotNull(), "date").otherwise("string")


def to_ts(v: Column) -> Column:
    """Timestamp of ISO 8601 text, else NULL."""
    s = strip(v)
    return F.when(s.rlike(ISO), F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00")))


def locale_number(v: Column, style: str) -> Column:
    """Number of a cell written ``plain`` (1234.5), ``us`` (1,234.5) or ``eu`` (1.234,5).

    The last two must group by thousands; no-break spaces count as spaces."""
    s = F.translate(strip(v), "  −", "  -")
    if style == "plain":
        return F.when(s.rlike(r"^[+-]?\d+(\.\d+)?$"), s.try_cast("double"))
    group, point = (",", r"\.") if style == "us" else (r"[. ]", ",")
    shaped = s.rlike(rf"^[+-]?\d{{1,3}}({group}\d{{3}})+({point}\d+)?$") if style == "us" else s.rlike(rf"^[+-]?(\d{{1,3}}({group}\d{{3}})+(,\d+)?|\d+,\d+)$")
    bare = F.regexp_replace(s, group, "")
    return F.when(shaped, (bare if style == "us" else F.replace(bare, F.lit(","), F.lit("."))).try_cast("double"))


def canonical(v: Column) -> Column:
    """``#n:`` number, ``#t:`` time or ``#s:`` text, equal for cells that mean the same."""
    n, t = to_dec(v), to_ts(v)
    return F.when(n.isNotNull(), F.concat(F.lit("#n:"), fmt_num(n))).when(t.isNotNull(), F.concat(F.lit("#t:"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))).otherwise(F.concat(F.lit("#s:"), collapsed(v)))


def canon_token(v: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(v), r"(?U)[^\w]+|_", "")


def acronym(v: Column) -> Column:
    words = F.filter(F.split(F.lower(strip(v)), r"(?U)[^\w]+"), lambda x: x != "")
    return F.when(F.size(words) > 1, F.array_join(F.transform(words, lambda x: F.substring(x, 1, 1)), ""))


#: Equations by name: how many sources, the value, and each missing source from the target.
EQUATIONS = {
    "sum": lambda a, b: a + b,
    "difference": lambda a, b: a - b,
    "product": lambda a, b: a * b,
    "ratio": lambda a, b: F.try_divide(a, b),
    "sum3": lambda a, b, c: a + b + c,
    "sum_minus": lambda a, b, c: a + b - c,
    "product_plus": lambda a, b, c: a * b + c,
    "product_minus": lambda a, b, c: a * b - c,
}


def evaluate(kind: str, sources: list[Column]) -> Column:
    """Value of an equation; NULL where a source is missing or a divisor is zero."""
    if kind in ("sum", "product") and len(sources) > 2:
        return reduce(lambda a, b: a + b if kind == "sum" else a * b, sources)
    return EQUATIONS[kind](*sources)


def solve(kind: str, sources: list[Column], target: Column, missing: int) -> Column:
    """The one missing source from the others and the target; NULL if there's none."""
    y, s = target, sources
    div = F.try_divide
    if kind in ("sum", "sum3"):
        return reduce(lambda a, b: a - b, [x for i, x in enumerate(s) if i != missing], y)
    if kind == "difference":
        return y + s[1] if missing == 0 else s[0] - y
    if kind == "product":
        return div(y, s[1 - missing])
    if kind == "ratio":
        return y * s[1] if missing == 0 else F.when(y != 0, div(s[0], y))
    if kind == "sum_minus":
        return s[0] + s[1] - y if missing == 2 else y + s[2] - s[1 - missing]
    sign = 1 if kind == "product_plus" else -1
    return (y - s[0] * s[1]) * sign if missing == 2 else div(y - s[2] * sign, s[1 - missing])
