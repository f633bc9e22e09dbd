"""Ordered structural filter with the first reason for rejection, and the predicates around it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab
from ..functions.text import _col, blank_to_null, py_strip, strip_lower, truthy_or


@dataclass(frozen=True)
class StructuralFilter:
    """Knobs of the filter; column names are parameters, a null name switches its test off."""

    year_min: int = 1950
    year_max: int = 2026
    languages: tuple[str, ...] = ("en",)
    types: tuple[str, ...] = tuple(vocab.RECORD_TYPES)
    year: str | None = "publication_year"
    flags: tuple[str, ...] = ("is_retracted", "is_paratext")
    language: str | None = "language"
    type: str | None = "type"
    locations: str | None = "locations"
    primary: str | None = "primary_location"
    titles: tuple[str, ...] = ("display_name", "title")
    variant_year: bool = field(default=False)

    def tests(self) -> list[tuple[str, Column]]:
        """Reason and rejecting condition, in the order in which they are tried. Missing values pass all but the title test."""
        out: list[tuple[str, Column]] = []
        if self.year:
            y = F.col(self.year)
            if self.variant_year:  # only whole JSON numbers are tested
                number = F.when(F.schema_of_variant(y) == "BIGINT", F.try_variant_get(y, "$", "bigint"))
            else:
                number = y
            out.append(("year", ~number.between(self.year_min, self.year_max)))
        if self.flags:
            bad = F.lit(False)
            for f in self.flags:
                bad = bad | F.coalesce(F.col(f), F.lit(False))
            out.append(("retracted", bad))
        if self.language:
            out.append(("language", ~F.nullif(strip_lower(self.language), F.lit("")).isin(*self.languages)))
        if self.type:
            out.append(("type", ~F.nullif(strip_lower(self.type), F.lit("")).isin(*self.types)))
        if self.locations:
            out.append(("status", ~published(self.locations, self.primary)))
        if self.titles:
            out.append(("title", F.coalesce(py_strip(truthy_or(*self.titles)), F.lit("")) == ""))
        return out

    def reason(self) -> Column:
        """First reason for rejection, null for rows that pass."""
        c = F.lit(None).cast("string")
        for name, test in reversed(self.tests()):
            c = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(c)
        return c


def published(locations: str, primary: str | None) -> Column:
    """No location at all passes; else any location or the primary one must be published or accepted."""
    ok = lambda x: F.coalesce(x["is_published"], F.lit(False)) | F.coalesce(x["is_accepted"], F.lit(False))
    some = F.coalesce(F.exists(F.col(locations), ok), F.lit(False))
    if primary:
        some = some | ok(F.col(primary))
    return F.coalesce(F.size(locations), F.lit(0)).isin(0, -1) | some


def with_reason(df: DataFrame, spec: StructuralFilter = StructuralFilter(), name: str = "reject_reason") -> DataFrame:
    return df.withColumn(name, spec.reason())


def passing(df: DataFrame, spec: StructuralFilter = StructuralFilter()) -> DataFrame:
    return df.filter(spec.reason().isNull())


def reason_counts(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """``(reason, n)`` with ``kept`` for rows that pass: the counts add up to the rows checked."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def progress_counters(df: DataFrame, reason: str = "reject_reason", deduped: str | None = None) -> DataFrame:
    """One row: checked, kept, type, status, deduped and the rest, never below 0. ``deduped`` is a boolean column."""
    dup = F.coalesce(F.col(deduped), F.lit(False)) if deduped else F.lit(False)
    n = lambda cond: F.count_if(cond)
    passed = F.col(reason).isNull()
    t = df.agg(
        F.count(F.lit(1)).alias("checked"),
        n(passed & ~dup).alias("kept"),
        n(F.coalesce(F.col(reason) == "type", F.lit(False))).alias("type"),
        n(F.coalesce(F.col(reason) == "status", F.lit(False))).alias("status"),
        n(passed & dup).alias("deduped"),
    )
    return t.withColumn("other", F.greatest(F.lit(0), F.expr("checked - kept - `type` - `status` - deduped")))


def silent_failures(df: DataFrame, relevant: str = "is_relevant", score: str = "relevance_score", summary: str = "summary") -> DataFrame:
    """Rejected verdicts that are no judgement: score 0 and a marker or nothing for a summary."""
    low = strip_lower(F.coalesce(F.col(summary), F.lit("")))
    return df.filter((F.col(relevant) == 0) & (F.col(score) == 0) & low.isin(vocab.FAILURE_MARKERS))


def all_rejected(df: DataFrame, relevant: str = "is_relevant") -> DataFrame:
    return df.filter(F.col(relevant) == 0)


def relevant_only(df: DataFrame, relevant: str = "is_relevant") -> DataFrame:
    return df.filter(F.col(relevant) == 1)


def year_range(df: DataFrame, year: str, first: int, last: int) -> DataFrame:
    return df.filter(F.col(year).between(first, last))


def known_values(df: DataFrame, c: str, allowed: list[str]) -> DataFrame:
    return df.filter(F.col(c).isin(allowed))


def drop_labels(df: DataFrame, c: str, labels: list[str]) -> DataFrame:
    """Without blank labels and without those listed; labels come out trimmed."""
    out = df.withColumn(c, blank_to_null(_col(c))).filter(F.col(c).isNotNull())
    return out.filter(~F.col(c).isin(labels)) if labels else out


def with_key(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Rows that have a key."""
    return df.withColumn(name, key).filter(F.col(name).isNotNull())
