"""Text features of bibliographic records, from typed columns and from VARIANT where shapes differ."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col, py_strip, truthy_or


def reconstruct_abstract(index: Column | str) -> Column:
    """Text of an inverted index ``map<string, array<int>>``: words by position, ties by word; null gives ''."""
    places = F.transform(F.map_entries(_col(index)), lambda e: F.transform(F.filter(e["value"], lambda p: p.isNotNull()), lambda p: F.struct(p.alias("at"), e["key"].alias("word"))))
    words = F.transform(F.array_sort(F.flatten(F.filter(places, lambda x: x.isNotNull()))), lambda x: x["word"])
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def string_of(v: Column, path: str = "$") -> Column:
    """The string at a path of a VARIANT; null for numbers and everything else that is no string."""
    at = F.try_variant_get(v, path, "variant") if path != "$" else v
    return F.when(is_string(at), F.try_variant_get(at, "$", "string"))


def name_of(v: Column | str) -> Column:
    """A name from a polymorphic field: a string itself, an object's first naming member, a list's strings; else ''."""
    v = _col(v)
    strings = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: string_of(x)), lambda x: x.isNotNull())
    listed = F.when(F.size(strings) > 0, F.array_join(strings, "; "))
    return F.coalesce(string_of(v), *[string_of(v, f"$.{k}") for k in ("display_name", "name", "label", "title")], listed, F.lit(""))


def topic_field(v: Column | str) -> Column:
    """Field of a primary topic: of an object its ``field``, else ``subfield``; a string itself; trimmed."""
    v = _col(v)
    part = lambda k: F.nullif(name_of(F.try_variant_get(v, f"$.{k}", "variant")), F.lit(""))
    return py_strip(F.coalesce(part("field"), part("subfield"), string_of(v), F.lit("")))


def names_list(v: Column | str, most: int = 8) -> Column:
    """Trimmed non-blank names of the first ``most`` members of a VARIANT list; nulls are skipped."""
    items = F.slice(F.coalesce(F.try_variant_get(_col(v), "$", "array<variant>"), F.array().cast("array<variant>")), F.lit(1), F.lit(most))
    return F.filter(F.transform(items, lambda x: py_strip(name_of(x))), lambda s: s.isNotNull() & (s != ""))


def strings_list(c: Column | str, most: int = 8) -> Column:
    """As ``names_list`` for ``array<string>``."""
    items = F.slice(F.coalesce(_col(c), F.array().cast("array<string>")), F.lit(1), F.lit(most))
    return F.filter(F.transform(items, lambda x: py_strip(x)), lambda s: s.isNotNull() & (s != ""))


def build_text(title: Column, venue: Column | None = None, field: Column | None = None, keywords: Column | None = None, abstract: Column | None = None) -> Column:
    """Tagged parts in a fixed order, one blank between; parts that are null or blank are left out.

    ``keywords`` is a list of clean names.
    """
    said = [("TITLE", title), ("VENUE", venue), ("FIELD", field), ("KEYWORDS", None if keywords is None else F.array_join(keywords, "; ")), ("ABSTRACT", abstract)]
    parts = []
    for tag, c in said:
        if c is not None:
            s = py_strip(c)
            parts.append(F.when(s != "", F.concat(F.lit(f"[{tag}] "), s)))
    return F.concat_ws(" ", *parts)


def text_or_fallback(text: Column, display_name: Column | str, title: Column | str) -> Column:
    return F.coalesce(truthy_or(text, display_name, title), F.lit("unknown"))


def title_of(title: Column | str = "title", display_name: Column | str = "display_name") -> Column:
    return F.coalesce(py_strip(truthy_or(title, display_name)), F.lit(""))


def abstract_of(index: Column | str, abstract: Column | str | None = None) -> Column:
    """The plain abstract if it is not blank, else the one of the inverted index."""
    built = reconstruct_abstract(index)
    return built if abstract is None else F.coalesce(F.nullif(py_strip(abstract), F.lit("")), built)
