"""Counts, ranks and shares behind the reports. Equal counts are ordered by label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import labels as L
from .filters import drop_labels, known_values, year_range

Label = Callable[[Column], Column]


def load_release(df: DataFrame, year: str = "year", trad: str = "research_tradition", year_min: int = 1950, year_max: int = 2026) -> DataFrame:
    """Rows with a year in range and a known tradition; adds ``trad3`` and ``group2``. Years may be of any type."""
    missing = [c for c in (year, trad) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    y = F.col(year).cast("string").try_cast("double").cast("int")
    out = year_range(df.withColumn(year, y), year, year_min, year_max)
    return known_values(out.withColumn("trad3", L.tradition(trad)).withColumn("group2", L.tradition_group(trad)), "group2", ["biological", "comp_or_hybrid"])


def value_counts(df: DataFrame, c: str, label: Label | None = None, drop: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """``(by..., label, n)`` of a scalar column: nulls and blanks left out, labels normalised and trimmed.

    Raw values are counted first, so ``label``, which maps a Column to a Column, runs once per distinct value.
    """
    keys = by or []
    raw = df.filter(F.col(c).isNotNull()).groupBy(*keys, F.col(c).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    named = raw.withColumn("label", label(F.col("label"))) if label else raw
    return drop_labels(named, "label", drop or []).groupBy(*keys, "label").agg(F.sum("_n").alias("n"))


def value_counts_list(df: DataFrame, c: str, label: Label | None = None, drop: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """As ``value_counts`` for a list column: counts mentions."""
    return value_counts(df.select(*(by or []), F.explode(L.string_list(c)).alias("_x")), "_x", label, drop, by)


def ranked(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ``rank``, the place from 0 in the descending list; labels with equal counts have different ranks."""
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*(by or [])).orderBy(F.desc("n"), F.asc("label"))) - 1)


def top_k(counts: DataFrame, k: int) -> DataFrame:
    """The k largest; a partial top-k in each task, no total sort."""
    return counts.orderBy(F.desc("n"), F.asc("label")).limit(k)


def rank_status(counts: DataFrame, group: str, focal: str, other: str, k: int | None = None) -> DataFrame:
    """Labels of the focal group with ``status`` against the other: new, same, up or down by rank."""
    r = ranked(counts, [group])
    f = r.filter(F.col(group) == focal)
    if k is not None:
        f = f.filter(F.col("rank") < k)
    o = r.filter(F.col(group) == other).select(F.col("label").alias("_l"), F.col("rank").alias("_r"))
    j = f.join(o, f["label"] == o["_l"], "left")
    status = F.when(F.col("_r").isNull(), "new").when(F.col("rank") == F.col("_r"), "same").when(F.col("rank") < F.col("_r"), "up").otherwise("down")
    return j.select(group, "label", "n", "rank", status.alias("status"))


def dual_align(counts: DataFrame, group: str, left: str, right: str, k: int) -> DataFrame:
    """Union of both groups' top labels with both counts, 0 where a group lacks the label."""
    r = ranked(counts, [group]).filter(F.col(group).isin(left, right))
    wanted = r.filter(F.col("rank") < k).select("label").distinct()
    each = r.join(wanted, "label", "left_semi")
    side = lambda g: F.coalesce(F.sum(F.when(F.col(group) == g, F.col("n"))), F.lit(0))
    return each.groupBy("label").agg(side(left).alias("n_left"), side(right).alias("n_right"))


def bucket_histogram(df: DataFrame, year: str, group: str, groups: list[str], year_min: int, year_max: int) -> DataFrame:
    """``(bucket, label, <groups>)`` over the periods, zero where there is nothing."""
    got = df.select(L.period_index(year, year_min, year_max).alias("bucket"), F.col(group).alias("_g")).filter("bucket IS NOT NULL").groupBy("bucket").agg(*[F.count_if(F.col("_g") == g).alias(g) for g in groups])
    dim = L.period_table(df.sparkSession, year_min, year_max)
    return dim.join(got, "bucket", "left").select("bucket", "label", *[F.coalesce(g, F.lit(0)).alias(g) for g in groups])


def share_of_total(counts: DataFrame) -> DataFrame:
    """Adds ``total``, a scalar subquery, and ``share``."""
    return counts.withColumn("total", counts.agg(F.sum("n")).scalar()).withColumn("share", F.round(F.col("n") / F.col("total"), 6))


def bucket_small(counts: DataFrame, min_pct: float = 1.0, other: str = "Other") -> DataFrame:
    """Labels below ``min_pct`` percent of the total folded into ``other``, together with one that is there."""
    kept = counts.withColumn("_t", counts.agg(F.sum("n")).scalar()).withColumn("label", F.when(F.col("n") * 100.0 >= F.col("_t") * min_pct, F.col("label")).otherwise(other))
    return kept.groupBy("label").agg(F.sum("n").alias("n"))


def top_n_plus_other(counts: DataFrame, k: int, min_pct: float = 1.0, other: str = "Other") -> DataFrame:
    """``(place, label, n, pct)``: the k largest, the rest and small slices in ``other``, which comes last; percent of what is shown.

    Labels with equal counts at the border are decided by name.
    """
    top = top_k(counts.filter("n > 0"), k).select(F.col("label").alias("_top"))
    folded = counts.filter("n > 0").join(top, F.col("label") == F.col("_top"), "left").withColumn("label", F.coalesce("_top", F.lit(other))).groupBy("label").agg(F.sum("n").alias("n"))
    shown = bucket_small(folded, min_pct, other)
    place = F.row_number().over(W.orderBy((F.col("label") == other).cast("int"), F.desc("n"), F.asc("label"))) - 1
    # At most k + 1 rows reach this window.
    return shown.withColumn("place", place).withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 1)).select("place", "label", "n", "pct")


def slice_text(shares: DataFrame) -> DataFrame:
    """Adds ``text``, the label with its percentage, to the result of ``top_n_plus_other``."""
    return shares.withColumn("text", F.format_string("%s  (%.1f%%)", "label", "pct"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def verdict_stats(verdicts: DataFrame) -> DataFrame:
    """Relevant verdicts and their mean score."""
    return verdicts.filter("is_relevant = 1").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("relevance_score"), 6).alias("mean_score"))


def early_late(df: DataFrame, year: str) -> DataFrame:
    """Rows with ``half``: the first half of the distinct years is early, the rest late. Years that are no number drop out.

    The distinct years are few and numbered apart from the rows.
    """
    y = F.col(year).cast("string").try_cast("double").cast("int")
    years = df.select(y.alias("_y")).filter("_y IS NOT NULL").distinct()
    numbered = years.withColumn("_i", F.row_number().over(W.orderBy("_y")) - 1).withColumn("_half", F.count(F.lit(1)).over(W.partitionBy()) / 2)
    parts = numbered.select("_y", F.when(F.col("_i") < F.floor("_half"), "early").otherwise("late").alias("half"))
    return df.withColumn("_year", y).join(parts, F.col("_year") == F.col("_y")).drop("_y", "_year")


def trends(release: DataFrame, year_min: int = 1950, year_max: int = 2026) -> DataFrame:
    return bucket_histogram(load_release(release, year_min=year_min, year_max=year_max), "year", "group2", ["biological", "comp_or_hybrid"], year_min, year_max)


def trend_totals(release: DataFrame, year_min: int = 1950, year_max: int = 2026) -> DataFrame:
    """One row: papers by group, hybrid ones among them, and their share of all."""
    r = load_release(release, year_min=year_min, year_max=year_max)
    t = r.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("group2") == "biological").alias("biological"), F.count_if(F.col("group2") == "comp_or_hybrid").alias("comp_or_hybrid"), F.count_if(F.col("trad3") == "hybrid").alias("hybrid"))
    return t.withColumn("hybrid_share", F.round(F.col("hybrid") / F.col("total"), 6))


def dual_report(counts: DataFrame, k: int) -> DataFrame:
    """Top labels of both groups, each with its status against the other group."""
    a, b = "biological", "comp_or_hybrid"
    return rank_status(counts, "group2", a, b, k).unionByName(rank_status(counts, "group2", b, a, k))


def species_report(release: DataFrame, k: int = 15) -> DataFrame:
    r = load_release(release)
    return dual_report(value_counts_list(r, "species", L.taxon_group, ["Other", "Others", "other species"], ["group2"]), k)


def venue_report(release: DataFrame, k: int = 15) -> DataFrame:
    r = load_release(release)
    return dual_report(value_counts(r, "venue", L.venue_label, [], ["group2"]), k)


def institution_report(release: DataFrame, k: int = 15) -> DataFrame:
    r = load_release(release)
    return dual_report(value_counts_list(r, "institutions", None, [], ["group2"]), k)


def domain_report(release: DataFrame, k: int = 10) -> DataFrame:
    r = load_release(release)
    return top_n_plus_other(value_counts_list(r, "domains", L.plain_label), k)


