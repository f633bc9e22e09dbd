"""Entity keys, versions and file-path keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col, blank_to_null, py_strip, strip_lower


def entity_key(doi: Column | str = "doi", id_: Column | str = "id") -> Column:
    """DOI first: trimmed lower-case DOI, else trimmed id, else null."""
    return F.coalesce(F.nullif(strip_lower(doi), F.lit("")), blank_to_null(id_))


def work_id(id_: Column | str = "id", doi: Column | str = "doi", fallback_id: Column | str | None = None) -> Column:
    """Id first: the first ``W<digits>`` in the id, else ``doi:`` and the bare lower-case DOI, else null."""
    source = F.nullif(_col(id_), F.lit(""))
    if fallback_id is not None:
        source = F.coalesce(source, F.nullif(_col(fallback_id), F.lit("")))
    number = F.nullif(F.regexp_extract(source, r"(W\d+)", 1), F.lit(""))
    bare = F.nullif(F.regexp_replace(strip_lower(doi), r"https?://doi\.org/", ""), F.lit(""))
    return F.coalesce(number, F.concat(F.lit("doi:"), bare))


def version_text(c: Column | str = "updated_date") -> Column:
    """Versions are compared as text; a missing one is the empty string."""
    return F.coalesce(_col(c), F.lit(""))


def manifest_key(path: Column | str) -> Column:
    """Last two components of a path."""
    return F.regexp_extract(_col(path), r"([^/]+/[^/]+)$", 1)


def partition_date(path: Column | str) -> Column:
    """Date in an ``updated_date=YYYY-MM-DD`` component, null without one."""
    return F.nullif(F.regexp_extract(_col(path), r"updated_date=(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def bucket_id(c: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(py_strip(c)), F.lit(n)).cast("int")
