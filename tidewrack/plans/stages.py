"""Queries over model stages, ragged records, sources and sinks, each with its SQL oracle.

What a sink writes goes into the checkpoint folder, one folder a call, and is read back by the reader under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import keys, model_json as M, records as R, vocab
from ..operators import dedup, featurize, filters, reports, scoring, shred, state
from ..session import ensure_checkpoint_dir, table
from ..sources import readers, sinks
from . import pipeline
from .changes import SQL_KEY, SQL_SPACE, _each, sql_strip
from .curation import _KEYWORDS, _NEWEST_OA, ORACLES as CURATION, SQL_ABSTRACT, SQL_OA, SQL_TITLE, _in
from .release import ORACLES as RELEASE

CONFIG = pipeline.PipelineConfig(ties=("row_no",))
#: Words that a fitted prompt may have.
BUDGET = 60


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.classify_stage(pipeline.index_stage(table(spark, d, "works"), table(spark, d, "dedup_state"), CONFIG), config=CONFIG)


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.annotate_stage(scoring.positives(_scored(spark, d)), table(spark, d, "processed_s2"), config=CONFIG)


def classify(spark, d):
    """Scores of the index stage's candidates by the deterministic stand-in model."""
    return _scored(spark, d).select("row_no", "bert_score", "bert_label", "bert_threshold")


def positives(spark, d):
    return scoring.positives(_scored(spark, d)).select("row_no", "bert_score")


def annotate(spark, d):
    """Annotations of the positives that need a verdict by the deterministic stand-in model."""
    return _annotated(spark, d).select("row_no", "oa_id", "ai_metadata.is_relevant", "ai_metadata.relevance_score", "ai_metadata.summary", "classification.confidence")


def attached_meta(spark, d):
    """The members of the annotations as columns of the record."""
    return scoring.attach_meta(_annotated(spark, d)).select("row_no", "is_relevant", "relevance_score", "paper_type", "research_tradition", "ai_summary", F.size("domains").alias("n_domains"))


def flat_release(spark, d):
    """Annotated records as release rows."""
    flat = featurize.flatten_release(scoring.attach_meta(_annotated(spark, d)))
    return flat.select("year", "research_tradition", "venue", F.array_join("domains", "|").alias("domains"), F.size("species").alias("n_species"))


def fitted_prompts(spark, d):
    works = table(spark, d, "works")
    return scoring.fit_prompts(scoring.prompts(featurize.paper_text(works)), BUDGET).select("row_no", "prompt")


def prompts_with_system(spark, d):
    """Prompts as a chat template sees them, the instructions before each."""
    works = table(spark, d, "works")
    return scoring.prompts(featurize.paper_text(works), system="Judge the paper.").select("row_no", F.md5("prompt").alias("digest"), F.length("prompt").alias("n"))


def bat_categories(spark, d):
    """Species of replies written from the release, their category mended where the name sounds like a bat's."""
    items = F.transform(F.coalesce("species", F.array().cast("array<string>")), lambda s: F.struct(s.alias("name"), F.lit("Other").alias("category")))
    reply = M.extract_json(F.to_json(F.struct(items.alias("species"))))
    each = table(spark, d, "final_relevant").select("rec_no", F.posexplode(M.species_items(reply)).alias("pos", "s"))
    return each.select("rec_no", "pos", F.col("s.name").alias("name"), F.col("s.category").alias("category"))


def raw_features(spark, d):
    """Topic field, keywords and year test of ragged records, from VARIANT."""
    lines = table(spark, d, "raw_works").select("line_no", F.col("line").alias("value"))
    raw = readers.parse_lines(lines, "primary_topic variant, keywords variant, publication_year variant")
    kept = filters.with_reason(raw, filters.StructuralFilter(flags=(), language=None, type=None, locations=None, primary=None, titles=(), variant_year=True))
    return kept.select("line_no", R.topic_field("primary_topic").alias("field"), R.name_of("primary_topic").alias("topic"), F.array_join(R.names_list("keywords"), "|").alias("keywords"), F.col("reject_reason").isNotNull().alias("out_of_years"))


def institution_rows(spark, d):
    """The flat table of institutions with all their members, tied to line and author."""
    rows = shred.related_rows(table(spark, d, "raw_works"))
    t = shred.related_table(rows, "authorships.institutions")
    return t.select("line_no", F.col("`authorships_place`").alias("author"), F.col("`authorships.institutions_place`").alias("place"), "id", "display_name", "name")


def gz_scan(spark, d):
    """Lines written as compressed files, found by listing, the files in a seeded order, and scanned."""
    at = _folder(spark, "gz")
    table(spark, d, "raw_works").select("line").repartition(3).write.option("compression", "gzip").text(at)
    files = readers.seeded_order(readers.list_files(spark, at, "*.gz"), 7, 2)
    paths = [r.path for r in files.collect()]
    return readers.read_gz_jsonl(spark, paths, schema="id string, doi string, language string").select("id", "doi", "language")


def jsonl_round_trip(spark, d):
    """The release appended as JSON lines in two halves and read again."""
    at = _folder(spark, "jsonl")
    rows = table(spark, d, "final_relevant").select("rec_no", "oa_id", "year", "venue", "species")
    for half in (0, 1):
        sinks.append_jsonl(rows.filter(F.pmod("rec_no", F.lit(2)) == half), at)
    return readers.read_jsonl(spark, at, "rec_no bigint, oa_id string, year int, venue string, species array<string>").select("rec_no", "oa_id", "year", "venue", F.array_join("species", "|").alias("species"))


def index_round_trip(spark, d):
    """Index chunks of slim records written in files of bounded length and scanned."""
    at = _folder(spark, "index")
    keyed = filters.with_key(table(spark, d, "works"), keys.entity_key())
    sinks.rolling_parquet(featurize.index_payload(keyed, "key"), at, 500)
    back = readers.read_index(spark, at, "id string, doi string, title string, publication_year int")
    return back.select("id", "doi", "title", "publication_year")


def dual_rows(spark, d):
    """Two runs through the dual sink: all rows, and the positives of both."""
    at = _folder(spark, "dual")
    rows = scoring.labelled(table(spark, d, "processed_s2").withColumn("raw", F.col("relevance_score") / 10), "raw").select("oa_id", "bert_score")
    for half in (0, 1):
        sinks.dual_sink(rows.filter(F.pmod(F.crc32(F.col("oa_id").cast("binary")), F.lit(2)) == half), f"{at}/all", f"{at}/positives", 0.45)
    read = lambda name: sinks.read_runs(spark, f"{at}/{name}").select("oa_id", F.lit(name).alias("sink"))
    return read("all").unionAll(read("positives"))


def release_table(spark, d):
    """Release columns and their list columns checked when read."""
    df = readers.read_release(spark, f"{d}/final_relevant.parquet", ["rec_no", "year", "research_tradition", "species", "domains", "institutions"])
    for c in ("species", "domains", "institutions"):
        readers.assert_list_like(df, c)
    return reports.load_release(df).select("rec_no", "year", "trad3", "group2")


def last_state_lines(spark, d):
    """State lines where the last line of a key wins, whatever its date."""
    s = table(spark, d, "dedup_state").filter("key IS NOT NULL AND year IS NOT NULL")
    line = F.concat_ws("\t", "key", F.col("year").cast("string"), F.coalesce("updated_date", F.lit("")))
    # The table has no order: lines are numbered by their text.
    return readers.parse_state_lines(s.select(line.alias("value")).withColumn("at", F.col("value")), order="at")


def rejected_again(spark, d):
    """What a run takes that judges all rejected papers again."""
    best = dedup.latest_or_keyless(state.with_work_id(table(spark, d, "works").select("row_no", "id", "doi", "updated_date")), "oa_id", "updated_date", "row_no")
    return state.pending_records(best, table(spark, d, "processed_s2"), "all_rejected").select("row_no", "oa_id")


def seeded_verdicts(spark, d):
    """Stored verdicts and what two older outputs add to them."""
    old = table(spark, d, "processed_s2").filter("relevance_score >= 5")
    old = old.select("oa_id", "is_relevant", "relevance_score", "paper_type", "summary", "processed_at", "source_updated_date")
    legacy = [table(spark, d, "final_relevant").select("oa_id"), table(spark, d, "processed_s2").select("oa_id", "is_relevant", "relevance_score")]
    return state.seed_verdicts(old, legacy).select("oa_id", "is_relevant", "relevance_score")


def deduped_output(spark, d):
    return dedup.dedup_output(table(spark, d, "works").select("row_no", "doi", "id", "updated_date"), keys.entity_key(), "updated_date", "row_no").select("row_no")


QUERIES = {
    f.__name__: f
    for f in (
        classify, positives, annotate, attached_meta, flat_release, fitted_prompts, prompts_with_system, bat_categories, raw_features, institution_rows, gz_scan, jsonl_round_trip,
        index_round_trip, dual_rows, release_table, last_state_lines, rejected_again, seeded_verdicts, deduped_output,
    )
}

_WORDS = lambda c: f"regexp_extract_all({c}, '{SQL_SPACE.replace('[', '[^', 1)}+')"
_PIECES = lambda c: f"regexp_extract_all({c}, '{SQL_SPACE}*{SQL_SPACE.replace('[', '[^', 1)}+|{SQL_SPACE}+$')"
_HEX = lambda c: f"('0x' || substr(md5({c}), 1, 7))::BIGINT"

_SCORED = f"""x AS ({CURATION['index_stage']}), t AS ({CURATION['classifier_text']}),
    w AS (SELECT row_no, array_to_string({_WORDS('text')}[1:512], ' ') AS w FROM t SEMI JOIN x USING (row_no)),
    s AS (SELECT row_no, round_even(CASE WHEN w = '' THEN 0.5 ELSE {_HEX('w')} / CAST(268435455 AS DOUBLE) END, 4) AS bert_score FROM w)"""
_BODY = f"""'TITLE: ' || coalesce({SQL_TITLE}, '') || chr(10) || chr(10) || 'ABSTRACT: ' || left({SQL_ABSTRACT}, 2000) || chr(10) || chr(10) || 'TOPICS: ' || chr(10) || 'CONCEPTS: ' || chr(10) || 'KEYWORDS: ' || array_to_string({_KEYWORDS}, ', ')"""
_ANNOTATED = f"""{_SCORED},
    o AS (SELECT row_no, {SQL_OA} AS oa_id, coalesce(updated_date, '') AS v, split_part(coalesce({SQL_TITLE}, ''), chr(10), 1) AS title, {_BODY} AS p FROM works SEMI JOIN (SELECT row_no FROM s WHERE bert_score >= 0.45) USING (row_no)),
    seen AS (SELECT oa_id, max(coalesce(source_updated_date, '')) AS j FROM processed_s2 GROUP BY oa_id),
    h AS (SELECT row_no, o.oa_id, title, {_HEX('p')} AS h FROM o LEFT JOIN seen ON o.oa_id = seen.oa_id WHERE seen.oa_id IS NULL OR v > j),
    k AS (SELECT *, h % 11 <> 0 AND h % 3 <> 0 AS yes, 'Not relevant: ' || left(title, 60) AS no FROM h),
    a AS (SELECT *, CASE WHEN yes THEN greatest(1, least(10, h % 12)) ELSE 0 END AS score,
        CASE WHEN yes THEN left(title, 80) WHEN h % 11 = 0 THEN 'silent_failure' WHEN lower({sql_strip('no')}) IN {_in(vocab.COPIED_SUMMARIES)} OR (contains(no, '<') AND contains(no, '>')) THEN 'template_leak' ELSE no END AS said FROM k)"""

_NAME = lambda x: f"""CASE json_type({x}) WHEN 'VARCHAR' THEN ({x}->>'$') WHEN 'OBJECT' THEN coalesce({", ".join(f"CASE WHEN json_type({x}->'{k}') = 'VARCHAR' THEN ({x}->>'{k}') END" for k in ('display_name', 'name', 'label', 'title'))}, '')
    WHEN 'ARRAY' THEN coalesce(array_to_string(list_transform(list_filter(CAST({x} AS JSON[]), lambda m: json_type(m) = 'VARCHAR'), lambda m: (m->>'$')), '; '), '') ELSE '' END"""  # noqa: E731
_TEXT = lambda k: f"CASE WHEN json_type(x) = 'OBJECT' AND json_type(x->'{k}') IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN (x->>'{k}') END"
_NAMED = _NAME("(k)").replace("\n", " ")

ORACLES = {
    "classify": f"WITH {_SCORED} SELECT row_no, bert_score, CAST(bert_score >= 0.45 AS INT) AS bert_label, CAST(0.45 AS DOUBLE) AS bert_threshold FROM s",
    "positives": f"WITH {_SCORED} SELECT row_no, bert_score FROM s WHERE bert_score >= 0.45",
    "annotate": f"WITH {_ANNOTATED} SELECT row_no, oa_id, yes AS is_relevant, CAST(score AS INT) AS relevance_score, said AS summary, CAST(yes AS DOUBLE) AS confidence FROM a",
    "attached_meta": f"""WITH {_ANNOTATED} SELECT row_no, yes AS is_relevant, CAST(score AS INT) AS relevance_score, CASE WHEN yes THEN 'empirical' ELSE 'irrelevant' END AS paper_type,
        'biological' AS research_tradition, said AS ai_summary, CAST(yes AS INT) AS n_domains FROM a""",
    "flat_release": f"""WITH {_ANNOTATED} SELECT publication_year AS year, 'biological' AS research_tradition, venue, CASE WHEN yes THEN 'Neuroscience' ELSE '' END AS domains, 0 AS n_species
        FROM a JOIN works USING (row_no)""",
    "fitted_prompts": f"""WITH p AS (SELECT row_no, {_BODY} AS p, left({SQL_ABSTRACT}, 2000) AS a FROM works), n AS (SELECT *, len({_PIECES('p')}) - {BUDGET} AS over, {_PIECES('a')} AS w FROM p)
        SELECT row_no, CASE WHEN over > 0 AND a <> '' THEN replace(p, 'ABSTRACT: ' || a, 'ABSTRACT: ' || array_to_string(w[1:greatest(0, len(w) - over)], '')) ELSE p END AS prompt FROM n""",
    "prompts_with_system": f"SELECT row_no, md5(p) AS digest, CAST(length(p) AS INT) AS n FROM (SELECT row_no, 'Judge the paper.' || chr(10) || chr(10) || {_BODY} AS p FROM works)",
    "bat_categories": f"""SELECT rec_no, CAST(pos - 1 AS INT) AS pos, name, CASE WHEN regexp_matches(lower(coalesce(name, '')), '{"|".join(vocab.BAT_WORDS)}') THEN 'Bat' ELSE 'Other' END AS category
        FROM (SELECT rec_no, unnest(species) AS name, generate_subscripts(species, 1) AS pos FROM final_relevant)""",
    "raw_features": f"""WITH l AS (SELECT line_no, CASE WHEN json_valid(trim(line)) THEN trim(line)::JSON END AS j FROM raw_works),
        f AS (SELECT line_no, (j->'primary_topic') AS t, (j->'primary_topic'->'field') AS tf, (j->'primary_topic'->'subfield') AS ts, (j->'keywords') AS k, (j->'publication_year') AS y FROM l WHERE json_type(j) = 'OBJECT')
        SELECT line_no, {sql_strip(f"coalesce(nullif({_NAME('tf')}, ''), nullif({_NAME('ts')}, ''), CASE WHEN json_type(t) = 'VARCHAR' THEN (t->>'$') END, '')")} AS field, {_NAME('t')} AS topic,
            CASE WHEN json_type(k) = 'ARRAY' THEN array_to_string(list_filter(list_transform((CAST(k AS JSON[]))[1:8], lambda k: {sql_strip(_NAMED)}), lambda s: s IS NOT NULL AND s <> ''), '|') ELSE '' END AS keywords,
            coalesce(json_type(y) IN ('BIGINT', 'UBIGINT') AND CAST(y AS BIGINT) NOT BETWEEN 1950 AND 2026, false) AS out_of_years FROM f""",
    "institution_rows": f"""WITH v AS (SELECT line_no, {sql_strip('line')} AS t FROM raw_works), l AS (SELECT line_no, t::JSON AS j FROM v WHERE json_valid(t) AND json_type(t) = 'OBJECT'),
        a AS ({_each('l', "(j->'authorships')", 'line_no')}),
        i AS ({_each("(SELECT line_no, o AS ao, x AS a FROM a WHERE json_type(x) = 'OBJECT')", "(a->'institutions')", 'line_no', 'ao')})
        SELECT line_no, CAST(ao AS INT) AS author, CAST(o AS INT) AS place, {_TEXT('id')} AS id, {_TEXT('display_name')} AS display_name, CASE WHEN json_type(x) = 'VARCHAR' THEN (x->>'$') END AS name FROM i""",
    "gz_scan": f"SELECT id, doi, language FROM ({CURATION['scan_raw']})",
    "jsonl_round_trip": "SELECT rec_no, oa_id, year, venue, CASE WHEN species IS NOT NULL THEN coalesce(array_to_string(species, '|'), '') END AS species FROM final_relevant",
    "index_round_trip": f"SELECT id, doi, title, publication_year FROM works WHERE {SQL_KEY} IS NOT NULL",
    "dual_rows": "SELECT oa_id, 'all' AS sink FROM processed_s2 UNION ALL SELECT oa_id, 'positives' FROM processed_s2 WHERE relevance_score / 10 >= 0.45",
    "release_table": RELEASE["release_rows"],
    "last_state_lines": r"""WITH s AS (SELECT key, year, coalesce(updated_date, '') AS updated_date FROM dedup_state WHERE key IS NOT NULL AND year IS NOT NULL)
        SELECT key, year, updated_date FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY encode(key || chr(9) || year || chr(9) || updated_date) DESC) = 1""",
    "rejected_again": f"""WITH {_NEWEST_OA}, s AS (SELECT oa_id, max(coalesce(source_updated_date, '')) AS j, bool_or(coalesce(is_relevant = 0, false)) AS again FROM processed_s2 GROUP BY oa_id)
        SELECT row_no, b.oa_id FROM b LEFT JOIN s ON b.oa_id = s.oa_id WHERE s.oa_id IS NULL OR v > j OR again""",
    "seeded_verdicts": """WITH old AS (SELECT oa_id, is_relevant, relevance_score FROM processed_s2 WHERE relevance_score >= 5),
        f AS (SELECT DISTINCT oa_id, 1 AS is_relevant, 5 AS relevance_score FROM final_relevant WHERE oa_id IS NOT NULL AND oa_id NOT IN (SELECT oa_id FROM old)),
        o AS (SELECT * FROM old UNION ALL SELECT * FROM f)
        SELECT * FROM o UNION ALL SELECT oa_id, coalesce(is_relevant, 1), relevance_score FROM processed_s2 WHERE oa_id IS NOT NULL AND oa_id NOT IN (SELECT oa_id FROM o)""",
    "deduped_output": f"SELECT row_no FROM (SELECT row_no, updated_date, {SQL_KEY} AS key FROM works) WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(updated_date, '') DESC, row_no DESC) = 1",
}
