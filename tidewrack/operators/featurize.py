"""Slim records and text features of whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import records as R, vocab
from ..functions.text import py_strip


@dataclass(frozen=True)
class TextFields:
    """Which parts go into the text; a part whose column is absent is left out."""

    use_title: bool = True
    use_venue: bool = True
    use_primary_topic_field: bool = True
    use_keywords: bool = True
    use_abstract: bool = True
    max_keywords: int = 8


def slim(df: DataFrame) -> DataFrame:
    """The whitelisted fields that the table has, in their fixed order."""
    return df.select(*[f for f in vocab.SLIM_FIELDS if f in df.columns])


def index_payload(df: DataFrame, key: str, version: str = "updated_date") -> DataFrame:
    """``(key, updated_date, payload)``: the slim record as compact JSON, nulls left out."""
    fields = [c for c in slim(df).columns]
    return df.select(F.col(key).alias("key"), F.col(version).alias("updated_date"), F.to_json(F.struct(*fields)).alias("payload"))


def with_text(df: DataFrame, fields: TextFields = TextFields(), name: str = "text") -> DataFrame:
    """The classifier's text, with fall-backs; works on typed columns and on VARIANT ones."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}

    def keywords():
        c = R.names_list("keywords", fields.max_keywords) if have["keywords"] == "variant" else R.strings_list("keywords", fields.max_keywords)
        return c

    def topic():
        kind = have["primary_topic"]
        if kind == "variant":
            return R.topic_field("primary_topic")
        return F.col("primary_topic.field") if kind.startswith("struct") else F.col("primary_topic")

    abstract = R.abstract_of("abstract_inverted_index", "abstract" if "abstract" in have else None) if "abstract_inverted_index" in have else None
    text = R.build_text(
        R.title_of() if fields.use_title else F.lit(None).cast("string"),
        F.col("venue") if fields.use_venue and "venue" in have else None,
        topic() if fields.use_primary_topic_field and "primary_topic" in have else None,
        keywords() if fields.use_keywords and "keywords" in have else None,
        abstract if fields.use_abstract else None,
    )
    return df.withColumn(name, R.text_or_fallback(text, "display_name", "title"))


def paper_text(df: DataFrame, max_chars: int = 2000, most: int = 8) -> DataFrame:
    """What a prompt is made of: title, abstract cut to length, clean topic, concept and keyword lists, topic field."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}

    def names(c: str):
        if c not in have:
            return F.array().cast("array<string>")
        return R.names_list(c, most) if have[c] == "variant" else R.strings_list(c, most)

    kind = have.get("primary_topic", "")
    field = R.topic_field("primary_topic") if kind == "variant" else F.coalesce(py_strip("primary_topic.field"), F.lit("")) if kind.startswith("struct") else F.lit("")
    return df.select(
        *[c for c in df.columns if c not in ("topics", "concepts", "keywords", "title", "abstract", "topic_field")],
        R.title_of().alias("title"),
        F.substring(R.abstract_of("abstract_inverted_index", "abstract" if "abstract" in have else None), 1, max_chars).alias("abstract"),
        *[names(c).alias(c) for c in ("topics", "concepts", "keywords")],
        field.alias("topic_field"),
    )


def flatten_release(df: DataFrame) -> DataFrame:
    """Release columns of annotated records: names of species, domains and institutions, year and venue."""
    return df.select(
        F.col("publication_year").alias("year"),
        "research_tradition",
        F.col("venue"),
        F.transform("species", lambda s: s["name"]).alias("species"),
        F.transform("domains", lambda s: s["name"]).alias("domains"),
        *(["institutions"] if "institutions" in df.columns else []),
    )
