"""Small Column helpers shared by the function families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of Unicode's White_Space property (Java's ``(?U)\\s``).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends (Spark's
    ``trim`` only removes spaces).  The ends alone are looked at; a regex
    stops at every blank of the text."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_chars(c: Column, chars: str) -> Column:
    """Python ``str.strip(chars)``: every listed char at both ends."""
    cls = "".join("\\" + ch if ch in "\\^-]" else ch for ch in chars)
    return F.regexp_replace(c, f"^[{cls}]+|[{cls}]+$", "")


def count_sub(c: Column, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    gone = F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))
    return gone if len(sub) == 1 else (gone / len(sub)).cast("int")


def _quote(s: str) -> str:
    """Java regex literal quoting."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quote_regex(s: str) -> str:
    return _quote(s)


def starts(c: Column, prefix: str) -> Column:
    return F.startswith(c, F.lit(prefix))


def ends(c: Column, suffix: str) -> Column:
    return F.endswith(c, F.lit(suffix))


def has(c: Column, sub: str) -> Column:
    return F.contains(c, F.lit(sub))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Inside higher-order functions an outer expression is re-evaluated at
    every reference; binding it through a one-element ``transform`` makes
    later references plain variable reads.
    """
    return F.transform(F.array(value), body)[0]


def kept_apart(array: Column) -> Column:
    """The same array, for a generator over a column that was costly to make.
    From a generator over a bare column Spark infers a filter on that column's
    size, pushes it below the projection that makes it and so makes it three
    times; an expression is left where it is."""
    return F.transform(array, lambda x: x)
