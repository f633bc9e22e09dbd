"""Queries over change-log, state and verdicts, each with its SQL oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import model_json as M, records as R, vocab
from ..functions.keys import entity_key, manifest_key, partition_date, work_id
from ..operators import dedup, featurize, filters, scoring, state
from ..session import ensure_checkpoint_dir, table
from ..sources import readers
from ..streaming.watermark import WatermarkStream
from . import pipeline
from .changes import SQL_KEY, sql_strip

SPEC = filters.StructuralFilter()


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


SQL_REASON = f"""CASE
    WHEN publication_year NOT BETWEEN {SPEC.year_min} AND {SPEC.year_max} THEN 'year'
    WHEN coalesce(is_retracted, false) OR coalesce(is_paratext, false) THEN 'retracted'
    WHEN nullif(lower({sql_strip('language')}), '') <> 'en' THEN 'language'
    WHEN nullif(lower({sql_strip('type')}), '') NOT IN {_in(vocab.RECORD_TYPES)} THEN 'type'
    WHEN len(coalesce(locations, [])) > 0
        AND len(list_filter(locations, lambda l: coalesce(l.is_published, false) OR coalesce(l.is_accepted, false))) = 0
        AND NOT (coalesce(primary_location.is_published, false) OR coalesce(primary_location.is_accepted, false)) THEN 'status'
    WHEN coalesce({sql_strip("coalesce(nullif(display_name, ''), nullif(title, ''))")}, '') = '' THEN 'title'
    END"""
SQL_OA = f"""coalesce(nullif(regexp_extract(id, 'W[0-9]+'), ''),
    'doi:' || nullif(regexp_replace(lower({sql_strip('doi')}), 'https?://doi\\.org/', '', 'g'), ''))"""
SQL_ABSTRACT = """coalesce((SELECT string_agg(w, ' ' ORDER BY p, encode(w)) FROM (
        SELECT e.key AS w, unnest(e.value) AS p FROM (SELECT unnest(map_entries(abstract_inverted_index)) AS e)) WHERE p IS NOT NULL), '')"""
SQL_TITLE = sql_strip("coalesce(nullif(title, ''), nullif(display_name, ''))")


def _works(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    w = table(spark, d, "works")
    return w.select(*cols) if cols else w


def _winners(spark: SparkSession, d: str) -> DataFrame:
    keyed = filters.with_key(_works(spark, d, "row_no", "doi", "id", "updated_date", "publication_year"), entity_key())
    return dedup.latest_per_key(keyed, "key", "updated_date", "row_no")


SQL_WINNERS = f"""w AS (SELECT *, {SQL_KEY} AS key FROM works),
    best AS (SELECT key, row_no, updated_date, publication_year FROM w WHERE key IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(updated_date, '') DESC, row_no DESC) = 1),
    seen AS (SELECT key, max(coalesce(updated_date, '')) AS v FROM dedup_state WHERE key IS NOT NULL GROUP BY key)"""


def scan_raw(spark, d):
    lines = table(spark, d, "raw_works").select("line_no", F.col("line").alias("value"))
    return readers.parse_lines(lines, "id string, doi string, language string").select("line_no", "id", "doi", "language")


def reject_reasons(spark, d):
    return filters.with_reason(_works(spark, d)).select("row_no", "reject_reason")


def reject_counts(spark, d):
    return filters.reason_counts(filters.with_reason(_works(spark, d)))


def progress_counters(spark, d):
    return filters.progress_counters(filters.with_reason(_works(spark, d)))


def entity_keys(spark, d):
    return _works(spark, d, "row_no", entity_key().alias("key"))


def work_ids(spark, d):
    return _works(spark, d, "row_no", work_id().alias("oa_id"))


def latest_versions(spark, d):
    return _winners(spark, d).select("key", "row_no")


def still_needed(spark, d):
    return dedup.still_needed(_winners(spark, d), table(spark, d, "dedup_state")).select("key", "row_no", "updated_date")


def candidate_rows(spark, d):
    keyed = filters.with_key(_works(spark, d, "row_no", "doi", "id", "updated_date"), entity_key())
    needed = dedup.still_needed(_winners(spark, d), table(spark, d, "dedup_state"))
    return dedup.candidate_rows(keyed, needed).select("row_no")


def state_merge(spark, d):
    won = _winners(spark, d).select("key", F.col("publication_year").alias("year"), "updated_date")
    return dedup.merge_states([table(spark, d, "dedup_state").select("key", "year", "updated_date"), won])


def dedup_counts(spark, d):
    return dedup.dedup_counts(filters.with_key(_works(spark, d, "doi", "id"), entity_key()), F.col("key"))


def index_stage(spark, d):
    return pipeline.index_stage(_works(spark, d), table(spark, d, "dedup_state"), pipeline.PipelineConfig(ties=("row_no",))).select("key", "row_no")


def abstracts(spark, d):
    return _works(spark, d, "row_no", R.reconstruct_abstract("abstract_inverted_index").alias("abstract"))


def classifier_text(spark, d):
    return featurize.with_text(_works(spark, d)).select("row_no", "text")


def prompt_text(spark, d):
    t = featurize.paper_text(_works(spark, d))
    return t.select("row_no", "title", "abstract", "topic_field", F.array_join("keywords", "|").alias("keywords"))


def index_payload(spark, d):
    """Slim records as JSON beside their key; also read back as an index is."""
    keyed = filters.with_key(_works(spark, d), entity_key())
    chunk = featurize.index_payload(keyed.withColumn("updated_date", F.coalesce("updated_date", F.lit(""))), "key")
    back = readers.parse_lines(chunk.select("key", F.col("payload").alias("value")), "id string, updated_date string, publication_year int", strict=False)
    return back.select("key", "id", "updated_date", "publication_year")


def threshold_labels(spark, d):
    v = table(spark, d, "processed_s2").withColumn("raw", F.col("relevance_score") / 10)
    return scoring.labelled(v, "raw").select("oa_id", "bert_score", "bert_label")


def silent_failures(spark, d):
    return filters.silent_failures(table(spark, d, "processed_s2")).select("oa_id")


def all_rejected(spark, d):
    return filters.all_rejected(table(spark, d, "processed_s2")).select("oa_id")


def relevant_only(spark, d):
    return filters.relevant_only(table(spark, d, "processed_s2")).select("oa_id", "relevance_score")


def model_replies(spark, d):
    """Replies written from the verdicts with prose around them, found, parsed and repaired."""
    v = table(spark, d, "processed_s2")
    said = F.concat(F.lit("Reply: "), F.to_json(F.struct((F.col("is_relevant") == 1).alias("is_relevant"), "relevance_score", "paper_type", "summary")), F.lit(" Done."))
    m = scoring.parse_replies(v.select("oa_id", said.alias("said")), "said", None, "m")
    return m.select("oa_id", "m.is_relevant", "m.relevance_score", "m.paper_type", "m.summary", F.size("m.modalities").alias("n_modalities"))


def vocabulary_flags(spark, d):
    """Domains of replies written from the release, checked against their vocabulary; blank names are left out."""
    items = F.transform("domains", lambda x: F.struct(x.alias("domain")))
    reply = M.extract_json(F.to_json(F.struct(items.alias("domains"))))
    each = table(spark, d, "final_relevant").select("rec_no", F.posexplode(M.facet(reply, "domains", *M.FACETS["domains"])).alias("pos", "x"))
    return each.select("rec_no", "pos", "x.name", "x.out_of_schema")


def to_judge(spark, d):
    """Newest record of each id and every record without one, as far as they need a verdict."""
    best = dedup.latest_or_keyless(state.with_work_id(_works(spark, d, "row_no", "id", "doi", "updated_date")), "oa_id", "updated_date", "row_no")
    return state.pending_records(best, table(spark, d, "processed_s2"), "silent_failures").select("row_no", "oa_id")


def verdict_upsert(spark, d):
    """All papers judged anew by their newest version: stale verdicts are replaced, missing ones added."""
    old = table(spark, d, "processed_s2").select("oa_id", "is_relevant", "relevance_score", "paper_type", "summary", "processed_at", "source_updated_date")
    best = dedup.latest_per_key(state.with_work_id(_works(spark, d, "row_no", "id", "doi", "updated_date")).filter("oa_id IS NOT NULL"), "oa_id", "updated_date", "row_no")
    new = best.select("oa_id", F.lit(1).alias("is_relevant"), F.lit(7).alias("relevance_score"), F.lit("method").alias("paper_type"), F.lit("judged anew").alias("summary"), F.lit("now").alias("processed_at"), F.coalesce("updated_date", F.lit("")).alias("source_updated_date"))
    return state.upsert_verdicts(old, new).select("oa_id", "relevance_score", "source_updated_date")


def reconcile(spark, d):
    return dedup.reconcile(table(spark, d, "final_relevant"), table(spark, d, "processed_s2")).select("rec_no")


def last_lines(spark, d):
    return dedup.last_line_per_id(table(spark, d, "final_relevant").select("oa_id", "rec_no"), "oa_id", "rec_no")


def pending_files(spark, d):
    files = _works(spark, d, F.col("file_path").alias("path")).distinct()
    return dedup.pending_files(files, table(spark, d, "raw_works").select(F.col("file_path").alias("path")))


def complete_files(spark, d):
    size = lambda t: table(spark, d, t).groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("size"))
    return dedup.complete_files(size("works"), size("raw_works"))


def file_totals(spark, d):
    return dedup.byte_totals(complete_files(spark, d))


def pruned_partitions(spark, d):
    files = _works(spark, d, F.col("file_path").alias("path")).distinct()
    return readers.after_date(files, "2025-06-01").select("path", partition_date("path").alias("date"), manifest_key("path").alias("manifest_key"))


def state_lines(spark, d):
    """The state written as tab-separated lines, old and new layout, and read again."""
    s = table(spark, d, "dedup_state").filter("key IS NOT NULL")
    year = F.coalesce(F.col("year").cast("string"), F.lit("x"))
    line = F.when(F.coalesce("updated_date", F.lit("")) == "", F.concat_ws("\t", "key", year)).otherwise(F.concat_ws("\t", "key", year, "updated_date"))
    return readers.parse_state_lines(s.select(line.alias("value")))


def stream_latest(spark, d):
    """The change-log as a file stream through key state, and the latest row of each key."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "works").schema
    stream = WatermarkStream(spark, f"{d}/works.parquet", schema, f"{base}/out", f"{base}/checkpoint", entity_key(), "updated_date", "publication_year", files_per_batch=4, ties=("row_no",))
    stream.run()
    return stream.latest().select("key", "updated_date")


QUERIES = {
    f.__name__: f
    for f in (
        scan_raw, reject_reasons, reject_counts, progress_counters, entity_keys, work_ids, latest_versions, still_needed,
        candidate_rows, state_merge, dedup_counts, index_stage, abstracts, classifier_text, prompt_text, index_payload,
        threshold_labels, silent_failures, all_rejected, relevant_only, model_replies,
        vocabulary_flags, to_judge, verdict_upsert, reconcile, last_lines, pending_files, complete_files, file_totals,
        pruned_partitions, state_lines, stream_latest,
    )
}

_FAILURE = f"is_relevant = 0 AND relevance_score = 0 AND lower({sql_strip("coalesce(summary, '')")}) IN {_in(vocab.FAILURE_MARKERS)}"
_NEWEST_OA = f"""p AS (SELECT row_no, {SQL_OA} AS oa_id, coalesce(updated_date, '') AS v FROM works),
    b AS (SELECT * FROM p WHERE oa_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY oa_id ORDER BY v DESC, row_no DESC) = 1 UNION ALL SELECT * FROM p WHERE oa_id IS NULL)"""
_KEYWORDS = f"list_filter(list_transform(coalesce(keywords, [])[1:8], lambda k: {sql_strip('k')}), lambda k: k IS NOT NULL AND k <> '')"
_PART = lambda tag, s: f"CASE WHEN {s} <> '' THEN '[{tag}] ' || {s} END"

ORACLES = {
    "scan_raw": """SELECT line_no, j->>'id' AS id, j->>'doi' AS doi, j->>'language' AS language FROM (
        SELECT line_no, CASE WHEN json_valid(trim(line)) THEN trim(line)::JSON END AS j FROM raw_works) WHERE json_type(j) = 'OBJECT'""",
    "reject_reasons": f"SELECT row_no, {SQL_REASON} AS reject_reason FROM works",
    "reject_counts": f"SELECT coalesce({SQL_REASON}, 'kept') AS reason, count(*) AS n FROM works GROUP BY 1",
    "progress_counters": f"""WITH r AS (SELECT {SQL_REASON} AS r FROM works)
        SELECT count(*) AS checked, count(*) FILTER (r IS NULL) AS kept, count(*) FILTER (r = 'type') AS type, count(*) FILTER (r = 'status') AS status,
            0 AS deduped, count(*) FILTER (r NOT IN ('type', 'status')) AS other FROM r""",
    "entity_keys": f"SELECT row_no, {SQL_KEY} AS key FROM works",
    "work_ids": f"SELECT row_no, {SQL_OA} AS oa_id FROM works",
    "latest_versions": f"WITH {SQL_WINNERS} SELECT key, row_no FROM best",
    "still_needed": f"WITH {SQL_WINNERS} SELECT key, row_no, updated_date FROM best LEFT JOIN seen USING (key) WHERE coalesce(updated_date, '') > coalesce(v, '')",
    "candidate_rows": f"""WITH {SQL_WINNERS}, need AS (SELECT key, updated_date FROM best LEFT JOIN seen USING (key) WHERE coalesce(updated_date, '') > coalesce(v, ''))
        SELECT row_no FROM w SEMI JOIN need USING (key, updated_date)""",
    "state_merge": f"""WITH {SQL_WINNERS}, u AS (SELECT key, year, coalesce(updated_date, '') AS v FROM dedup_state WHERE key IS NOT NULL
            UNION ALL SELECT key, publication_year, coalesce(updated_date, '') FROM best)
        SELECT key, year, v AS updated_date FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY v DESC, year DESC NULLS LAST) = 1""",
    "dedup_counts": f"SELECT count(*) AS before, count(DISTINCT k) AS after FROM (SELECT {SQL_KEY} AS k FROM works) WHERE k IS NOT NULL",
    "index_stage": f"""WITH w AS (SELECT *, {SQL_KEY} AS key FROM works WHERE {SQL_REASON} IS NULL),
        best AS (SELECT key, row_no, coalesce(updated_date, '') AS v FROM w WHERE key IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(updated_date, '') DESC, row_no DESC) = 1),
        seen AS (SELECT key, max(coalesce(updated_date, '')) AS s FROM dedup_state WHERE key IS NOT NULL GROUP BY key)
        SELECT key, row_no FROM best LEFT JOIN seen USING (key) WHERE v > coalesce(s, '')""",
    "abstracts": f"SELECT row_no, {SQL_ABSTRACT} AS abstract FROM works",
    "classifier_text": f"""WITH t AS (SELECT row_no, display_name, title, {SQL_TITLE} AS t, {sql_strip('venue')} AS v, {sql_strip('primary_topic.field')} AS f,
            array_to_string({_KEYWORDS}, '; ') AS k, {sql_strip(SQL_ABSTRACT)} AS a FROM works)
        SELECT row_no, coalesce(nullif(concat_ws(' ', {_PART('TITLE', 't')}, {_PART('VENUE', 'v')}, {_PART('FIELD', 'f')}, {_PART('KEYWORDS', 'k')}, {_PART('ABSTRACT', 'a')}), ''),
            nullif(display_name, ''), nullif(title, ''), 'unknown') AS text FROM t""",
    "prompt_text": f"""SELECT row_no, coalesce({SQL_TITLE}, '') AS title, left({SQL_ABSTRACT}, 2000) AS abstract, coalesce({sql_strip('primary_topic.field')}, '') AS topic_field,
        array_to_string({_KEYWORDS}, '|') AS keywords FROM works""",
    "index_payload": f"SELECT * FROM (SELECT {SQL_KEY} AS key, id, coalesce(updated_date, '') AS updated_date, publication_year FROM works) WHERE key IS NOT NULL",
    "threshold_labels": "SELECT oa_id, round(relevance_score / 10, 4) AS bert_score, CAST(round(relevance_score / 10, 4) >= 0.45 AS INT) AS bert_label FROM processed_s2",
    "silent_failures": f"SELECT oa_id FROM processed_s2 WHERE {_FAILURE}",
    "all_rejected": "SELECT oa_id FROM processed_s2 WHERE is_relevant = 0",
    "relevant_only": "SELECT oa_id, relevance_score FROM processed_s2 WHERE is_relevant = 1",
    "model_replies": f"""WITH v AS (SELECT *, coalesce(is_relevant = 1, false) AS yes, lower({sql_strip("coalesce(summary, '')")}) AS low FROM processed_s2)
        SELECT oa_id, CASE WHEN is_relevant IS NULL THEN coalesce(relevance_score > 0, false) ELSE yes END AS is_relevant,
            CASE WHEN CASE WHEN is_relevant IS NULL THEN coalesce(relevance_score > 0, false) ELSE yes END THEN greatest(1, least(10, coalesce(relevance_score, 5))) ELSE 0 END AS relevance_score,
            CASE WHEN NOT CASE WHEN is_relevant IS NULL THEN coalesce(relevance_score > 0, false) ELSE yes END THEN 'irrelevant' WHEN paper_type IN {_in(vocab.PAPER_TYPES)} THEN paper_type ELSE 'empirical' END AS paper_type,
            CASE WHEN CASE WHEN is_relevant IS NULL THEN coalesce(relevance_score > 0, false) ELSE yes END THEN coalesce(summary, '') WHEN summary IS NULL THEN 'rejected'
                WHEN low IN {_in(vocab.COPIED_SUMMARIES)} OR (contains(low, '<') AND contains(low, '>')) THEN 'template_leak' ELSE summary END AS summary,
            CASE WHEN CASE WHEN is_relevant IS NULL THEN coalesce(relevance_score > 0, false) ELSE yes END THEN 1 ELSE 0 END AS n_modalities FROM v""",
    "vocabulary_flags": f"""SELECT rec_no, pos - 1 AS pos, name, name NOT IN {_in(vocab.DOMAINS)} AS out_of_schema FROM (
        SELECT rec_no, unnest(m) AS name, generate_subscripts(m, 1) AS pos FROM (SELECT rec_no, list_filter(domains, lambda x: coalesce({sql_strip('x')}, '') <> '') AS m FROM final_relevant))""",
    "to_judge": f"""WITH {_NEWEST_OA}, s AS (SELECT oa_id, max(coalesce(source_updated_date, '')) AS j, bool_or({_FAILURE}) AS again FROM processed_s2 GROUP BY oa_id)
        SELECT row_no, b.oa_id FROM b LEFT JOIN s ON b.oa_id = s.oa_id WHERE s.oa_id IS NULL OR v > j OR coalesce(again, false)""",
    "verdict_upsert": f"""WITH {_NEWEST_OA}, n AS (SELECT oa_id, v FROM b WHERE oa_id IS NOT NULL)
        SELECT oa_id, CASE WHEN s.oa IS NULL OR v > j THEN 7 ELSE score END AS relevance_score, CASE WHEN s.oa IS NULL OR v > j THEN v ELSE raw END AS source_updated_date
        FROM n FULL JOIN (SELECT oa_id AS oa, relevance_score AS score, source_updated_date AS raw, coalesce(source_updated_date, '') AS j FROM processed_s2) s ON n.oa_id = s.oa
        WHERE n.oa_id IS NOT NULL UNION ALL
        SELECT oa_id, relevance_score, source_updated_date FROM processed_s2 ANTI JOIN n USING (oa_id)""",
    "reconcile": "SELECT rec_no FROM final_relevant SEMI JOIN (SELECT oa_id FROM processed_s2 WHERE is_relevant = 1) USING (oa_id)",
    "last_lines": "SELECT oa_id, max(rec_no) AS rec_no FROM final_relevant WHERE oa_id IS NOT NULL GROUP BY oa_id",
    "pending_files": "SELECT DISTINCT file_path AS path FROM works WHERE regexp_extract(file_path, '([^/]+/[^/]+)$', 1) NOT IN (SELECT regexp_extract(file_path, '([^/]+/[^/]+)$', 1) FROM raw_works WHERE file_path IS NOT NULL)",
    "complete_files": """WITH a AS (SELECT file_path AS path, count(*) AS size FROM works GROUP BY 1), b AS (SELECT file_path AS path, count(*) AS size FROM raw_works GROUP BY 1)
        SELECT a.path, a.size, b.path IS NOT NULL AS complete FROM a LEFT JOIN b ON a.path = b.path AND a.size = b.size""",
    "file_totals": """WITH a AS (SELECT file_path AS path, count(*) AS size FROM works GROUP BY 1), b AS (SELECT file_path AS path, count(*) AS size FROM raw_works GROUP BY 1)
        SELECT b.path IS NOT NULL AS complete, count(*) AS files, CAST(sum(a.size) AS BIGINT) AS bytes FROM a LEFT JOIN b ON a.path = b.path AND a.size = b.size GROUP BY 1""",
    "pruned_partitions": """SELECT DISTINCT file_path AS path, regexp_extract(file_path, 'updated_date=(\\d{4}-\\d{2}-\\d{2})', 1) AS date, regexp_extract(file_path, '([^/]+/[^/]+)$', 1) AS manifest_key
        FROM works WHERE regexp_extract(file_path, 'updated_date=(\\d{4}-\\d{2}-\\d{2})', 1) >= '2025-06-01'""",
    "state_lines": """SELECT key, year, updated_date FROM (SELECT key, year, coalesce(updated_date, '') AS updated_date FROM dedup_state WHERE key IS NOT NULL AND year IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_date DESC, year DESC) = 1""",
    "stream_latest": f"WITH {SQL_WINNERS} SELECT key, updated_date FROM best WHERE coalesce(updated_date, '') > ''",
}
