"""Latest versions, watermark joins and reconciliation. All of them shuffle on one key only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.keys import manifest_key, version_text


def latest_per_key(df: DataFrame, key: str, version: str, *ties: str) -> DataFrame:
    """One row per key: greatest version as text (null as ''), then the greatest tie-breaks in turn.

    The limit on the window is pushed below the exchange, so each task sends at most one row per key.
    Give tie-breaks that make the order total; null keys form one group.
    """
    order = [F.desc(version_text(version)), *(F.col(t).desc_nulls_last() for t in ties)]
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def latest_or_keyless(df: DataFrame, key: str, version: str, *ties: str) -> DataFrame:
    """``latest_per_key`` for rows with a key, beside every row without one: what has no key is nobody's older version."""
    return latest_per_key(df.filter(F.col(key).isNotNull()), key, version, *ties).unionByName(df.filter(F.col(key).isNull()))


def latest_by_struct(df: DataFrame, key: str, version: str, *carry: str) -> DataFrame:
    """As ``latest_per_key`` for a few narrow columns: a hash aggregation with map-side partials, which also takes hot keys."""
    best = F.max(F.struct(version_text(version).alias("_v"), *[F.col(c) for c in carry]))
    return df.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b._v").alias(version), *[F.col(f"_b.{c}").alias(c) for c in carry])


def merge_states(shards: list[DataFrame]) -> DataFrame:
    """Union of state shards ``(key, year, updated_date)`` with the greatest date per key, then the greatest year."""
    every = shards[0]
    for s in shards[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    return latest_by_struct(every.filter("key IS NOT NULL"), "key", "updated_date", "year").select("key", "year", "updated_date")


def still_needed(winners: DataFrame, state: DataFrame, key: str = "key", version: str = "updated_date") -> DataFrame:
    """Winners newer than the state, strictly; a blank version is never newer. Column order is kept.

    The state is reduced to its greatest version per key first and always joined on the key: at 100 million
    keys it is no broadcast.
    """
    seen = state.groupBy(F.col(key).alias("_k")).agg(F.max(version_text(version)).alias("_seen"))
    joined = winners.join(seen, winners[key] == seen["_k"], "left")
    return joined.filter(version_text(winners[version]) > F.coalesce("_seen", F.lit(""))).select(*[winners[c] for c in winners.columns])


def candidate_rows(records: DataFrame, needed: DataFrame, key: str = "key", version: str = "updated_date") -> DataFrame:
    """Records that are the needed version of a needed key."""
    return records.join(needed.select(key, version).distinct(), [key, version], "left_semi")


def dedup_output(df: DataFrame, key: Column, version: str, *ties: str) -> DataFrame:
    """Latest row per key, rows without a key left out."""
    return latest_per_key(df.withColumn("_key", key).filter("_key IS NOT NULL"), "_key", version, *ties).drop("_key")


def dedup_counts(df: DataFrame, key: Column) -> DataFrame:
    """One row ``(before, after)``: rows, and rows that one per key leaves."""
    return df.select(key.alias("k")).agg(F.count(F.lit(1)).alias("before"), F.count_distinct("k").alias("after"))


def last_line_per_id(df: DataFrame, id_: str, *sequence: str) -> DataFrame:
    """Last line of each id in the order of the sequence columns."""
    n = F.row_number().over(W.partitionBy(id_).orderBy(*[F.col(s).desc_nulls_last() for s in sequence]))
    return df.filter(F.col(id_).isNotNull()).withColumn("_n", n).filter("_n = 1").drop("_n")


def pending_files(files: DataFrame, manifest: DataFrame, path: str = "path", done: str = "path") -> DataFrame:
    """Files whose last two path components no manifest line has."""
    m = manifest.select(manifest_key(done).alias("_done")).distinct()
    return files.join(m, manifest_key(files[path]) == m["_done"], "left_anti")


def complete_files(listing: DataFrame, local: DataFrame) -> DataFrame:
    """Listed ``(path, size)`` with ``complete``: a local file of the same path and size exists."""
    have = local.select("path", "size").distinct().withColumn("_have", F.lit(True))
    return listing.join(have, ["path", "size"], "left").withColumn("complete", F.coalesce("_have", F.lit(False))).drop("_have")


def byte_totals(files: DataFrame, group: str = "complete") -> DataFrame:
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def to_judge(records: DataFrame, verdicts: DataFrame, id_: str = "oa_id", version: str = "updated_date", judged: str = "source_updated_date", again: DataFrame | None = None) -> DataFrame:
    """Records that need a verdict: without an id, never judged, changed since, or in ``again``.

    A record has changed if its version is not blank and greater than the one judged.
    """
    seen = verdicts.groupBy(F.col(id_).alias("_id")).agg(F.max(version_text(judged)).alias("_judged"))
    # Records without an id meet no verdict; kept out of the joins they don't crowd into one task.
    keyed, keyless = records.filter(F.col(id_).isNotNull()), records.filter(F.col(id_).isNull())
    j = keyed.join(seen, keyed[id_] == seen["_id"], "left")
    run = F.col("_id").isNull() | (version_text(keyed[version]) > F.col("_judged"))
    if again is not None:
        a = again.select(F.col(id_).alias("_again")).filter("_again IS NOT NULL").distinct()
        j = j.join(a, keyed[id_] == a["_again"], "left")
        run = run | F.col("_again").isNotNull()
    return j.filter(run).select(*[keyed[c] for c in records.columns]).unionByName(keyless)


def reconcile(lines: DataFrame, verdicts: DataFrame, id_: str = "oa_id", relevant: str = "is_relevant") -> DataFrame:
    """Output lines whose id has a relevant verdict."""
    good = verdicts.filter(F.col(relevant) == 1).select(id_)
    return lines.join(good, id_, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, *sequence: str, replace: bool = True) -> DataFrame:
    """Old and new rows with one per key: the new row with ``replace``, else the old; among equals the last in sequence."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    side = F.col("_side").desc() if replace else F.col("_side").asc()
    last = [F.col(s).desc_nulls_last() if replace else F.col(s).asc_nulls_first() for s in sequence]
    n = F.row_number().over(W.partitionBy(key).orderBy(side, *last))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n", "_side")
