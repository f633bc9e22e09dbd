"""Report queries over the release table, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import labels as L, vocab
from ..operators import reports
from ..session import table
from .changes import sql_strip
from .curation import _in

TOP = 15


def _release(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "final_relevant")


def species_labels(spark, d):
    each = _release(spark, d).select(F.explode("species").alias("value")).distinct()
    return each.select("value", L.species_label("value").alias("label"), L.taxon_group("value").alias("taxon"))


def venue_labels(spark, d):
    return _release(spark, d).select("venue").distinct().select("venue", L.venue_label("venue").alias("label"))


def traditions(spark, d):
    return _release(spark, d).select("rec_no", L.tradition("research_tradition").alias("trad3"), L.tradition_group("research_tradition").alias("group2"))


def plain_labels(spark, d):
    each = _release(spark, d).select(F.explode("domains").alias("value")).distinct()
    return each.select("value", L.plain_label("value").alias("label"))


def token_counts(spark, d):
    """Words of the titles in their canonical form."""
    words = table(spark, d, "works").select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]+)"), 1)).alias("w"))
    return words.groupBy(L.token_form("w").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def release_rows(spark, d):
    return reports.load_release(_release(spark, d)).select("rec_no", "year", "trad3", "group2")


def venue_counts(spark, d):
    return reports.value_counts(_release(spark, d), "venue", L.venue_label)


def institution_counts(spark, d):
    return reports.value_counts_list(_release(spark, d), "institutions")


def species_counts(spark, d):
    return reports.value_counts_list(_release(spark, d), "species", L.species_label, ["Other"])


def domain_shares(spark, d):
    return reports.share_of_total(reports.value_counts_list(_release(spark, d), "domains", L.plain_label))


def institutions_folded(spark, d):
    return reports.bucket_small(institution_counts(spark, d), 1.0)


def ranked_venues(spark, d):
    return reports.ranked(venue_counts(spark, d))


def top_institutions(spark, d):
    return reports.top_k(institution_counts(spark, d), TOP)


def dual_institutions(spark, d):
    counts = reports.value_counts_list(reports.load_release(_release(spark, d)), "institutions", by=["group2"])
    return reports.dual_align(counts, "group2", "biological", "comp_or_hybrid", TOP)


def early_late_counts(spark, d):
    return reports.group_sizes(reports.early_late(_release(spark, d), "year"), "half")


def group_sizes(spark, d):
    return reports.group_sizes(reports.load_release(_release(spark, d)), "group2")


def verdict_stats(spark, d):
    return reports.verdict_stats(table(spark, d, "processed_s2"))


def report_trends(spark, d):
    return reports.trends(_release(spark, d))


def report_trend_totals(spark, d):
    return reports.trend_totals(_release(spark, d))


def report_species(spark, d):
    return reports.species_report(_release(spark, d), TOP)


def report_venues(spark, d):
    return reports.venue_report(_release(spark, d), TOP)


def report_institutions(spark, d):
    return reports.institution_report(_release(spark, d), TOP)


def report_domains(spark, d):
    return reports.domain_report(_release(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        species_labels, venue_labels, traditions, plain_labels, token_counts, release_rows, venue_counts, institution_counts,
        species_counts, domain_shares, institutions_folded, ranked_venues, top_institutions, dual_institutions,
        early_late_counts, group_sizes, verdict_stats, report_trends, report_trend_totals, report_species, report_venues,
        report_institutions, report_domains,
    )
}


def _map(table_: dict[str, str]) -> str:
    pairs = ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in table_.items())
    return "MAP {" + pairs + "}"


def sql_species(v: str) -> str:
    """Species label as one expression over ``v``; the words before the last keep their spacing closed up."""
    s = sql_strip(v)
    bare = sql_strip(f"regexp_replace({s}, '\\s*\\([^)]*\\d{{4}}[^)]*\\)\\s*$', '')")
    bare = sql_strip(f"regexp_replace({bare}, ',?\\s*\\d{{4}}\\s*$', '')")
    words = f"list_filter(regexp_split_to_array(lower({bare}), '[\\s\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: w <> '')"
    one = f"""(SELECT CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(list_concat(w[1:-2], [CASE
        WHEN w[-1] IN ('species', 'series', 'lens') OR regexp_matches(w[-1], '(idae|inae)$') THEN w[-1]
        WHEN ends_with(w[-1], 'ves') THEN w[-1][1:-4] || 'f' WHEN ends_with(w[-1], 'ies') THEN w[-1][1:-4] || 'y' WHEN ends_with(w[-1], 'ses') THEN w[-1][1:-4] || 's'
        WHEN ends_with(w[-1], 'ss') THEN w[-1] WHEN ends_with(w[-1], 's') THEN w[-1][1:-2] ELSE w[-1] END]), ' ') END FROM (SELECT {words} AS w))"""
    title = f"array_to_string(list_transform(regexp_extract_all({one}, '(\\p{{L}}+|\\P{{L}}+)'), lambda p: upper(left(p, 1)) || lower(p[2:])), '')"
    table_ = _map(vocab.SPECIES_SYNONYMS)
    return f"""CASE WHEN {v} IS NULL OR {s} = '' OR lower({s}) IN {_in(vocab.SPECIES_NULLISH)} OR starts_with(lower({s}), 'other ') THEN 'Other'
        ELSE coalesce({table_}[lower({bare})], {table_}[{one}], {title}) END"""


def sql_taxon(label: str) -> str:
    cases = " ".join(f"WHEN contains(lower({label}), '{w}') THEN '{g}'" for w, g in vocab.TAXON_GROUPS.items())
    return f"CASE WHEN {label} = 'Other' THEN {label} {cases} ELSE {label} END"


def sql_venue(v: str) -> str:
    s = f"coalesce({sql_strip(f"regexp_replace({sql_strip(v)}, '\\s*\\([^)]*\\)\\s*$', '')")}, '')"
    return f"coalesce({_map(vocab.VENUE_SHORT)}[lower({s})], {s})"


def sql_plain(v: str) -> str:
    s = sql_strip(v)
    return f"CASE WHEN {v} IS NULL OR lower({s}) IN {_in([*vocab.NULLISH, 'other', 'misc', 'miscellaneous', ''])} OR starts_with(lower({s}), 'other ') THEN 'Other' ELSE {s} END"


_TRAD = f"coalesce({_map(vocab.TRADITION_ALIASES)}[lower({sql_strip('research_tradition')})], 'unknown')"
_LOAD = f"""r AS (SELECT * EXCLUDE (year), CAST(year AS INT) AS year, {_TRAD} AS trad3 FROM final_relevant WHERE year BETWEEN 1950 AND 2026),
    g AS (SELECT *, CASE WHEN trad3 = 'biological' THEN 'biological' ELSE 'comp_or_hybrid' END AS group2 FROM r WHERE trad3 <> 'unknown')"""
_LIST = lambda c, src: f"SELECT {'group2, ' if src == 'g' else ''}{sql_strip('x')} AS x FROM (SELECT * EXCLUDE ({c}), unnest({c}) AS x FROM {src}) WHERE {sql_strip('x')} <> ''"


def _dual(counts: str) -> str:
    """Both groups' top labels with their status; ``counts`` is a select of (group2, label, n)."""
    return f"""WITH {_LOAD}, c AS ({counts}), k AS (SELECT *, row_number() OVER (PARTITION BY group2 ORDER BY n DESC, encode(label)) - 1 AS rank FROM c)
        SELECT a.group2, a.label, a.n, a.rank, CASE WHEN b.rank IS NULL THEN 'new' WHEN a.rank = b.rank THEN 'same' WHEN a.rank < b.rank THEN 'up' ELSE 'down' END AS status
        FROM k a LEFT JOIN k b ON a.label = b.label AND a.group2 <> b.group2 WHERE a.rank < {TOP}"""


_BUCKETS = "(0, 1950, 1980, '≤1979'), (1, 1980, 1990, '1980s'), (2, 1990, 2000, '1990s'), (3, 2000, 2010, '2000s'), (4, 2010, 2020, '2010s'), (5, 2020, 2027, '2020–26*')"
_INST = f"SELECT x AS label, count(*) AS n FROM ({_LIST('institutions', 'final_relevant')}) GROUP BY 1"

ORACLES = {
    "species_labels": f"SELECT value, l AS label, {sql_taxon('l')} AS taxon FROM (SELECT value, {sql_species('value')} AS l FROM (SELECT DISTINCT unnest(species) AS value FROM final_relevant))",
    "venue_labels": f"SELECT DISTINCT venue, {sql_venue('venue')} AS label FROM final_relevant",
    "traditions": f"SELECT rec_no, t AS trad3, CASE WHEN t = 'biological' THEN t WHEN t IN ('computational', 'hybrid') THEN 'comp_or_hybrid' END AS group2 FROM (SELECT rec_no, {_TRAD} AS t FROM final_relevant)",
    "plain_labels": f"SELECT value, {sql_plain('value')} AS label FROM (SELECT DISTINCT unnest(domains) AS value FROM final_relevant)",
    "token_counts": f"SELECT coalesce({_map(vocab.TOKEN_FORMS)}[w], w) AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(title), '[a-z]+')) AS w FROM works) GROUP BY 1",
    "release_rows": f"WITH {_LOAD} SELECT rec_no, year, trad3, group2 FROM g",
    "venue_counts": f"SELECT label, count(*) AS n FROM (SELECT {sql_venue('venue')} AS label FROM final_relevant) WHERE label <> '' GROUP BY 1",
    "institution_counts": _INST,
    "species_counts": f"SELECT label, count(*) AS n FROM (SELECT {sql_species('x')} AS label FROM ({_LIST('species', 'final_relevant')})) WHERE label NOT IN ('', 'Other') GROUP BY 1",
    "domain_shares": f"""WITH c AS (SELECT {sql_plain('x')} AS label, count(*) AS n FROM ({_LIST('domains', 'final_relevant')}) GROUP BY 1)
        SELECT label, n, CAST(sum(n) OVER () AS BIGINT) AS total, round(n / sum(n) OVER (), 6) AS share FROM c""",
    "institutions_folded": f"""WITH c AS ({_INST}), t AS (SELECT *, sum(n) OVER () AS t FROM c)
        SELECT CASE WHEN n * 100 >= t THEN label ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1""",
    "ranked_venues": f"SELECT label, n, row_number() OVER (ORDER BY n DESC, encode(label)) - 1 AS rank FROM (SELECT label, count(*) AS n FROM (SELECT {sql_venue('venue')} AS label FROM final_relevant) WHERE label <> '' GROUP BY 1)",
    "top_institutions": f"SELECT label, n FROM ({_INST}) ORDER BY n DESC, encode(label) LIMIT {TOP}",
    "dual_institutions": f"""WITH {_LOAD}, c AS (SELECT group2, x AS label, count(*) AS n FROM ({_LIST('institutions', 'g')}) GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY group2 ORDER BY n DESC, encode(label)) AS r FROM c)
        SELECT label, CAST(coalesce(sum(n) FILTER (group2 = 'biological'), 0) AS BIGINT) AS n_left, CAST(coalesce(sum(n) FILTER (group2 = 'comp_or_hybrid'), 0) AS BIGINT) AS n_right
        FROM k WHERE label IN (SELECT label FROM k WHERE r <= {TOP}) GROUP BY label""",
    "early_late_counts": """WITH y AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT year FROM final_relevant WHERE year IS NOT NULL))
        SELECT CASE WHEN i < k // 2 THEN 'early' ELSE 'late' END AS half, count(*) AS n FROM final_relevant JOIN y USING (year) GROUP BY 1""",
    "group_sizes": f"WITH {_LOAD} SELECT group2, count(*) AS n FROM g GROUP BY 1",
    "verdict_stats": "SELECT count(*) AS n, round(avg(relevance_score), 6) AS mean_score FROM processed_s2 WHERE is_relevant = 1",
    "report_trends": f"""WITH {_LOAD}, b(bucket, lo, hi, label) AS (VALUES {_BUCKETS})
        SELECT bucket, label, count(*) FILTER (group2 = 'biological') AS biological, count(*) FILTER (group2 = 'comp_or_hybrid') AS comp_or_hybrid
        FROM b LEFT JOIN g ON year >= lo AND year < hi GROUP BY 1, 2""",
    "report_trend_totals": f"""WITH {_LOAD} SELECT count(*) AS total, count(*) FILTER (group2 = 'biological') AS biological, count(*) FILTER (group2 = 'comp_or_hybrid') AS comp_or_hybrid,
        count(*) FILTER (trad3 = 'hybrid') AS hybrid, round(count(*) FILTER (trad3 = 'hybrid') / count(*), 6) AS hybrid_share FROM g""",
    "report_species": _dual(f"SELECT group2, label, count(*) AS n FROM (SELECT group2, {sql_taxon('l')} AS label FROM (SELECT group2, {sql_species('x')} AS l FROM ({_LIST('species', 'g')}))) WHERE label NOT IN ('', 'Other', 'Others', 'other species') GROUP BY ALL"),
    "report_venues": _dual(f"SELECT group2, label, count(*) AS n FROM (SELECT group2, {sql_venue('venue')} AS label FROM g WHERE venue IS NOT NULL) WHERE label <> '' GROUP BY ALL"),
    "report_institutions": _dual(f"SELECT group2, x AS label, count(*) AS n FROM ({_LIST('institutions', 'g')}) GROUP BY ALL"),
    "report_domains": f"""WITH {_LOAD}, c AS (SELECT label, count(*) AS n FROM (SELECT {sql_plain('x')} AS label FROM ({_LIST('domains', 'g')})) GROUP BY 1),
        k AS (SELECT *, row_number() OVER (ORDER BY n DESC, encode(label)) AS r FROM c),
        f AS (SELECT CASE WHEN r <= 10 THEN label ELSE 'Other' END AS label, sum(n) AS n FROM k GROUP BY 1),
        s AS (SELECT CASE WHEN n * 100 >= (SELECT sum(n) FROM f) THEN label ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1)
        SELECT row_number() OVER (ORDER BY CAST(label = 'Other' AS INT), n DESC, encode(label)) - 1 AS place, label, n, round(100 * n / sum(n) OVER (), 1) AS pct FROM s""",
}
