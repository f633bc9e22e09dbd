"""String helpers with one definition of white space, blank and truth for the whole engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# White space at the ends of a value, Unicode property plus U+001C to U+001F.
_WS = r"[\s\x1c-\x1f]"


def py_strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends (``trim`` takes spaces only). Null stays null.

    The pattern only runs over values that begin or end with white space.
    """
    c = _col(c)
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(rf"(?U){_WS}"), F.regexp_replace(c, rf"(?U)^{_WS}+|{_WS}+$", "")).otherwise(c)


def strip_lower(c: Column | str) -> Column:
    return F.lower(py_strip(c))


def blank_to_null(c: Column | str) -> Column:
    """The trimmed value, or null when nothing but white space is left."""
    return F.nullif(py_strip(c), F.lit(""))


def truthy_or(*cols: Column | str) -> Column:
    """First value that is neither null nor the empty string (white space counts as a value)."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def title_case(c: Column | str) -> Column:
    """Capital after every non-letter, unlike ``initcap``: ``risso's`` gives ``Risso'S``."""
    pieces = F.regexp_extract_all(_col(c), F.lit(r"(\p{L}+|\P{L}+)"), 0)
    return F.array_join(F.transform(pieces, lambda x: F.initcap(x)), "")


def round4(c: Column | str) -> Column:
    """Scores to four places, half to even."""
    return F.bround(_col(c), 4)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
