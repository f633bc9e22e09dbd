import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.functions.keys import entity_key
from tidewrack.operators import dedup, featurize, filters, reports, scoring, state
from tidewrack.plans import pipeline

WORK = "row_no bigint, id string, doi string, display_name string, title string, type string, language string, updated_date string, publication_year int, is_retracted boolean, is_paratext boolean, locations array<struct<is_published:boolean,is_accepted:boolean>>, primary_location struct<is_published:boolean,is_accepted:boolean>, abstract_inverted_index map<string,array<int>>, venue string, keywords array<string>, primary_topic struct<field:string>"


def works(spark, *rows):
    base = dict(row_no=0, id="W1", doi=None, display_name="N", title=None, type="article", language="en", updated_date="2024", publication_year=2000, is_retracted=False, is_paratext=None, locations=None, primary_location=None, abstract_inverted_index=None, venue=None, keywords=None, primary_topic=None)
    return spark.createDataFrame([tuple((base | {"row_no": i} | r).values()) for i, r in enumerate(rows)], WORK)


def reasons(df, spec=filters.StructuralFilter()):
    return [r.reject_reason for r in filters.with_reason(df, spec).orderBy("row_no").collect()]


def test_reasons_one_by_one(spark):
    no, yes = (False, False), (True, False)
    df = works(
        spark, {}, {"publication_year": 1949}, {"publication_year": 2026}, {"publication_year": None}, {"publication_year": 1900, "is_retracted": True, "language": "fr"},
        {"is_paratext": True}, {"language": " EN "}, {"language": ""}, {"language": "fr"}, {"type": "Zine"}, {"type": None},
        {"locations": [], "primary_location": no}, {"locations": [no], "primary_location": yes}, {"locations": [no]}, {"display_name": "  ", "title": "Good"}, {"display_name": "", "title": "Good"},
    )
    assert reasons(df) == [None, "year", None, None, "year", "retracted", None, None, "language", "type", None, None, None, "status", "title", None]
    c = filters.progress_counters(filters.with_reason(df)).first()
    assert c.checked == c.kept + c.type + c.status + c.deduped + c.other == df.count()


def test_variant_years(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["1949", '"1900"', "1900.0", "null", "2027", "1950"])], "row_no int, j string").select("row_no", F.parse_json("j").alias("publication_year"))
    spec = filters.StructuralFilter(flags=(), language=None, type=None, locations=None, titles=(), variant_year=True)
    assert reasons(df, spec) == ["year", None, None, None, "year", None]


def test_latest_and_ties_do_not_depend_on_order(spark):
    rows = [("k", "2024-01-01", 1), ("k", "2024-03-01", 2), ("k", "2024-03-01", 3), ("k", None, 9), ("j", None, 1)]
    want = {("k", 3), ("j", 1)}
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "key string, updated_date string, n int").repartition(3)
        once = dedup.latest_per_key(df, "key", "updated_date", "n")
        assert {(x.key, x.n) for x in once.collect()} == want
        assert {(x.key, x.n) for x in dedup.latest_per_key(once, "key", "updated_date", "n").collect()} == want
        assert {(x.key, x.n) for x in dedup.latest_by_struct(df, "key", "updated_date", "n").collect()} == want


def test_still_needed_is_strict(spark):
    w = spark.createDataFrame([("same", "2"), ("older", "1"), ("newer", "3"), ("absent", "1"), ("blank", "")], "key string, updated_date string")
    s = spark.createDataFrame([("same", "2"), ("older", "2"), ("newer", "2"), ("newer", None)], "key string, updated_date string")
    assert {r.key for r in dedup.still_needed(w, s).collect()} == {"newer", "absent"}


def test_merge_states_is_monotone(spark):
    a = spark.createDataFrame([("x", 1, "2"), ("y", 1, None)], state.STATE)
    b = spark.createDataFrame([("x", 9, "1"), ("z", None, "1")], state.STATE)
    got = {(r.key, r.year, r.updated_date) for r in dedup.merge_states([a, b]).collect()}
    assert got == {("x", 1, "2"), ("y", 1, ""), ("z", None, "1")}
    assert {tuple(r) for r in dedup.merge_states([b, a, a]).collect()} == got


VERDICT = [("new", "2025"), ("same", "2024"), ("old", "2023"), (None, "1"), ("fail", "2020")]


def test_to_judge(spark):
    recs = spark.createDataFrame(VERDICT, "oa_id string, updated_date string")
    seen = spark.createDataFrame([("new", 1, 5, "x", "s", "t", "2024"), ("same", 1, 5, "x", "s", "t", "2024"), ("old", 1, 5, "x", "s", "t", "2024"), ("fail", 0, 0, "x", " Rejected ", "t", "2024")], state.VERDICTS)
    assert {r.oa_id for r in state.pending_records(recs, seen).collect()} == {"new", None}
    assert {r.oa_id for r in state.pending_records(recs, seen, "silent_failures").collect()} == {"new", None, "fail"}
    assert {r.oa_id for r in state.reprocess_ids(seen, "all_rejected").collect()} == {"fail"}
    with pytest.raises(ValueError):
        state.reprocess_ids(seen, "x")


def test_upsert_verdicts(spark):
    v = lambda *rows: spark.createDataFrame([(i, 1, n, "empirical", "s", "t", d) for i, n, d in rows], state.VERDICTS)
    old = v(("a", 1, "2024"), ("b", 1, "2024"))
    got = state.upsert_verdicts(old, v(("a", 2, "2025"), ("b", 2, "2024"), ("c", 2, "")))
    assert {(r.oa_id, r.relevance_score) for r in got.collect()} == {("a", 2), ("b", 1), ("c", 2)}
    again = state.upsert_verdicts(old, v(("b", 3, "2024")), spark.createDataFrame([("b",)], "oa_id string"))
    assert {(r.oa_id, r.relevance_score) for r in again.collect()} == {("a", 1), ("b", 3)}
    seeded = state.seed_verdicts(old, [spark.createDataFrame([("a",), ("z",)], "oa_id string")])
    assert {(r.oa_id, r.relevance_score, r.source_updated_date) for r in seeded.collect()} == {("a", 1, "2024"), ("b", 1, "2024"), ("z", 5, "")}


def test_last_line_and_reconcile(spark):
    lines = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "oa_id string, n int")
    seen = spark.createDataFrame([("a", 1), ("b", 0)], "oa_id string, is_relevant int")
    assert [(r.oa_id, r.n) for r in dedup.last_line_per_id(dedup.reconcile(lines, seen), "oa_id", "n").collect()] == [("a", 2)]


def test_files(spark):
    f = spark.createDataFrame([("x/d=1/a.gz", 5), ("x/d=1/b.gz", 6)], "path string, size int")
    assert [r.path for r in dedup.pending_files(f, spark.createDataFrame([("y/d=1/a.gz",)], "path string")).collect()] == ["x/d=1/b.gz"]
    done = dedup.complete_files(f, spark.createDataFrame([("x/d=1/a.gz", 5), ("x/d=1/b.gz", 1)], "path string, size int"))
    assert {r.path: r.complete for r in done.collect()} == {"x/d=1/a.gz": True, "x/d=1/b.gz": False}


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"word{i} calls {i % 3}") for i in range(40)] + [(99, None)], "row_no int, text string")
    a = {r.row_no: r.bert_score for r in scoring.score(df.repartition(1), scoring.HashScorer()).collect()}
    b = {r.row_no: r.bert_score for r in scoring.score(df.repartition(7), scoring.HashScorer(), batch=3).collect()}
    assert a == b and a[99] == 0.5 and all(0 <= x <= 1 for x in a.values())
    with pytest.raises(ValueError):
        scoring.score(df, scoring.HashScorer(), threshold=2)
    assert np.isclose(scoring.HashScorer().score([""])[0], 0.5)


def test_annotation_is_parsed_outside_the_model(spark):
    df = works(spark, *({"id": f"W{i}", "title": f"Title {i}"} for i in range(12)))
    out = scoring.annotate(scoring.prompts(featurize.paper_text(state.with_work_id(df))), scoring.EchoAnnotator())
    flat = scoring.attach_meta(out)
    rows = flat.collect()
    assert len(rows) == 12
    assert all((r.classification.confidence == 1.0) == r.is_relevant for r in rows)
    assert {r.oa_id for r in state.verdict_rows(out, "now").collect()} == {f"W{i}" for i in range(12)}


def test_prompts_fit_the_budget(spark):
    df = works(spark, {"title": "T", "abstract_inverted_index": {f"w{i}": [i] for i in range(50)}, "keywords": ["k"]}, {"title": "short"})
    full = scoring.prompts(featurize.paper_text(df))
    words = lambda r: len(r.prompt.split())
    before = {r.row_no: words(r) for r in full.collect()}
    after = {r.row_no: r for r in scoring.fit_prompts(full, 30).collect()}
    assert before[0] > 30 and words(after[0]) == 30 and "w0 w1" in after[0].prompt and after[0].prompt.endswith("KEYWORDS: k")
    assert words(after[1]) == before[1]
    assert words(scoring.fit_prompts(full, 1).filter("row_no = 0").first()) == before[0] - 50


def test_stages_and_state(spark):
    df = works(spark, {"id": "W1", "updated_date": "1"}, {"id": "W1", "updated_date": "2"}, {"id": "W2", "language": "fr"}, {"id": "W3", "updated_date": ""})
    seen = spark.createDataFrame([], state.STATE)
    index = pipeline.index_stage(df, seen)
    assert [(r.key, r.updated_date) for r in index.collect()] == [("W1", "2")]
    after = pipeline.new_state(index, seen)
    assert pipeline.index_stage(df, after).count() == 0
    run = pipeline.Pipeline([("a", lambda d: 1), ("b", lambda d: d.get("a", 0) + 1)])
    assert run.run() == {"a": 1, "b": 2} and run.run("b") == {"b": 1}
    with pytest.raises(ValueError):
        run.run("c")
    assert [pipeline.format_duration(s) for s in (45, 125, 4020)] == ["45s", "2m05s", "1h07m"]


def counts(spark, *rows):
    return spark.createDataFrame(rows, "label string, n bigint")


def test_ranks(spark):
    c = spark.createDataFrame([("f", "a", 5), ("f", "b", 4), ("f", "c", 3), ("o", "b", 9), ("o", "a", 1)], "g string, label string, n bigint")
    assert {r.label: r.status for r in reports.rank_status(c, "g", "f", "o").collect()} == {"a": "up", "b": "down", "c": "new"}
    assert {(r.label, r.n_left, r.n_right) for r in reports.dual_align(c, "g", "f", "o", 1).collect()} == {("a", 5, 1), ("b", 4, 9)}
    assert [r.label for r in reports.top_k(counts(spark, ("b", 1), ("a", 1), ("c", 2)), 2).collect()] == ["c", "a"]


def test_folding(spark):
    got = {r.label: r.n for r in reports.bucket_small(counts(spark, ("x", 98), ("y", 1), ("z", 1)), 1.5).collect()}
    assert got == {"x": 98, "Other": 2}
    assert {r.label: r.n for r in reports.bucket_small(counts(spark, ("x", 98), ("y", 1), ("Other", 1)), 1.5).collect()} == {"x": 98, "Other": 2}
    top = reports.top_n_plus_other(counts(spark, ("a", 50), ("b", 30), ("c", 20), ("d", 0)), 2).orderBy("place").collect()
    assert reports.slice_text(reports.top_n_plus_other(counts(spark, ("a", 1)), 2)).first().text == "a  (100.0%)"
    assert [(r.label, r.n, r.pct) for r in top] == [("a", 50, 50.0), ("b", 30, 30.0), ("Other", 20, 20.0)]


def test_early_late(spark):
    df = spark.createDataFrame([("2001",), ("2002",), ("2003",), ("x",), (None,)], "year string")
    assert sorted((int(r.year), r.half) for r in reports.early_late(df, "year").collect()) == [(2001, "early"), (2002, "late"), (2003, "late")]


def test_reports_on_empty_and_null_tables(spark):
    kind = "year int, research_tradition string, venue string, institutions array<string>, species array<string>, domains array<string>"
    for rows in ([], [(None, None, None, None, None, None)], [(2000, "bio", None, [], [None, " "], None)]):
        df = spark.createDataFrame(rows, kind)
        for f in (reports.species_report, reports.venue_report, reports.institution_report, reports.domain_report):
            assert f(df).count() == 0
        assert reports.trends(df).count() == 6
    with pytest.raises(ValueError):
        reports.load_release(spark.range(1))


def test_slim_and_payload(spark):
    df = works(spark, {"doi": "D"}).withColumn("extra", F.lit(1))
    assert "extra" not in featurize.slim(df).columns and "row_no" not in featurize.slim(df).columns
    p = featurize.index_payload(df.withColumn("key", entity_key()), "key").first()
    assert p.key == "d" and '"doi":"D"' in p.payload and "venue" not in p.payload
