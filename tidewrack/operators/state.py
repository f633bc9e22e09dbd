"""Verdicts: keyed state with upserts, staleness and reprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import work_id
from . import dedup, filters

VERDICTS = "oa_id string, is_relevant int, relevance_score int, paper_type string, summary string, processed_at string, source_updated_date string"
STATE = "key string, year int, updated_date string"


def reprocess_ids(verdicts: DataFrame, mode: str) -> DataFrame:
    """Ids to judge again: none for "normal", silent failures, or all rejected ones, which contain them."""
    if mode == "normal":
        return verdicts.select("oa_id").limit(0)
    if mode == "silent_failures":
        return filters.silent_failures(verdicts).select("oa_id")
    if mode == "all_rejected":
        return filters.all_rejected(verdicts).select("oa_id")
    raise ValueError(f"unknown mode: {mode}")


def with_work_id(records: DataFrame) -> DataFrame:
    return records.withColumn("oa_id", work_id("id", "doi"))


def pending_records(records: DataFrame, verdicts: DataFrame, mode: str = "normal") -> DataFrame:
    """Records (with ``oa_id``) that a run has to judge."""
    again = None if mode == "normal" else reprocess_ids(verdicts, mode)
    return dedup.to_judge(records, verdicts, again=again)


def verdict_rows(annotated: DataFrame, processed_at: str) -> DataFrame:
    """Verdicts of annotated records that have an id."""
    m = F.col("ai_metadata")
    return annotated.filter("oa_id IS NOT NULL").select(
        "oa_id",
        m["is_relevant"].cast("int").alias("is_relevant"),
        m["relevance_score"].alias("relevance_score"),
        m["paper_type"].alias("paper_type"),
        m["summary"].alias("summary"),
        F.lit(processed_at).alias("processed_at"),
        F.coalesce("updated_date", F.lit("")).alias("source_updated_date"),
    )


def upsert_verdicts(old: DataFrame, new: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """Verdicts with the new ones: they replace those that are stale or in ``again``, else what is there stays.

    A stored verdict is stale if the new one judged a later version. Of several new verdicts of an id the
    first stays where none was stored.
    """
    first = dedup.upsert(new.limit(0), new, "oa_id", "source_updated_date")
    seen = old.select(F.col("oa_id").alias("_id"), F.coalesce("source_updated_date", F.lit("")).alias("_judged"))
    j = first.join(seen, first["oa_id"] == seen["_id"], "left")
    replace = F.col("_id").isNull() | (F.coalesce("source_updated_date", F.lit("")) > F.col("_judged"))
    if again is not None:
        a = again.select(F.col("oa_id").alias("_again")).distinct()
        j = j.join(a, j["oa_id"] == a["_again"], "left")
        replace = replace | F.col("_again").isNotNull()
    fresh = j.filter(replace).select(*[first[c] for c in first.columns])
    return dedup.upsert(old, fresh, "oa_id")


def seed_verdicts(old: DataFrame, legacy: list[DataFrame]) -> DataFrame:
    """Stored verdicts plus those of older outputs that they lack; earlier sources win.

    Older outputs have ``oa_id`` and may have the other columns; a missing version stays blank, so dated
    input will be judged again.
    """
    out = old
    for df in legacy:
        have = df.columns
        rows = df.filter("oa_id IS NOT NULL").select(
            "oa_id",
            (F.coalesce(F.col("is_relevant").cast("int"), F.lit(1)) if "is_relevant" in have else F.lit(1)).alias("is_relevant"),
            (F.col("relevance_score") if "relevance_score" in have else F.lit(5)).cast("int").alias("relevance_score"),
            (F.col("paper_type") if "paper_type" in have else F.lit(None).cast("string")).alias("paper_type"),
            (F.col("summary") if "summary" in have else F.lit("")).alias("summary"),
            F.lit(None).cast("string").alias("processed_at"),
            (F.coalesce("source_updated_date", F.lit("")) if "source_updated_date" in have else F.lit("")).alias("source_updated_date"),
        )
        out = dedup.upsert(out, rows.dropDuplicates(["oa_id"]), "oa_id", replace=False)
    return out
