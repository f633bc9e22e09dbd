"""Cases with a known answer, made from the clean part of a table: restored texts, joined titles, hidden dates."""

import pytest
from pyspark.sql import functions as F

from tidewrack.llm import encoding as E, language as L, queries as Q, records as R
from tidewrack.session import table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def works(spark):
    return table(spark, FOLDER, "works").select("row_no", "title", "language", "abstract_inverted_index")


def test_wrongly_decoded_titles_are_restored(spark, works):
    damaged = {r.row_no for r in Q.p1_found(spark, FOLDER).filter("field_name = 'title'").collect()}
    clean = sorted({r.title for r in works.filter(F.col("title").rlike(r"[^\x00-\x7f]")).collect() if r.row_no not in damaged})
    planted = []
    for i, t in enumerate(clean[::2]):
        wrong = ["cp1252", "latin-1"][i % 2]
        got = E.misread(t, "utf-8", wrong)
        if got and got != t and not any("\x80" <= c <= "\x9f" for c in got):
            planted.append((10**6 + i, got, t))
    assert len(planted) >= 40
    extra = spark.createDataFrame([(n, g, None, None) for n, g, _ in planted], works.schema)
    every = works.unionByName(extra)
    model = Q._damage_model(every)
    found = E.find_damage(every, "row_no", {"title": E.strange_text("title")}, model).filter("row_no >= 1000000").collect()
    back = {r.row_no: r.restored[0] for r in found}
    assert len(back) >= 0.97 * len(planted)
    assert sum(back.get(n) == t for n, _, t in planted) >= 0.95 * len(planted)


def test_segments_of_joined_titles(spark, works):
    model = L.train(works, "title", "language")
    by = {}
    for r in works.select("title", L.label_code("language").alias("code")).filter("title IS NOT NULL AND code IS NOT NULL").distinct().collect():
        if L.plain(r.title) in set(model.get(r.code, ())) and not L._SPLIT.search(r.title) and L.enough(r.title):
            by.setdefault(r.code, []).append(r.title.strip())
    langs = sorted(k for k, v in by.items() if len(v) >= 3)
    joined = {}
    for i, a in enumerate(langs):
        for b in langs[i + 1 :]:
            for left, right in zip(sorted(by[a])[:3], sorted(by[b])[:3]):
                joined[f"{left} | {right}"] = [(0, len(left), a), (len(left) + 3, len(left) + 3 + len(right), b)]
    df = spark.createDataFrame([(t,) for t in joined], "title string")
    got = {r.text: [(p.start, p.end, p.lang) for p in r.parts] for r in L.judge_texts(df, "title", model).collect()}
    assert len(joined) >= 100 and sum(got[t] == want for t, want in joined.items()) >= 0.93 * len(joined)


def test_hidden_dates(spark):
    """Of a quarter of the rows the date is hidden; currency picks the true value at least as often as blank dates do."""
    works = table(spark, FOLDER, "works").select("row_no", "id", "updated_date", *Q.FIELDS)
    groups = Q._paper_groups(works)
    values = works.select("row_no", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), R._value(works, f).alias("v")) for f in Q.FIELDS])).alias("x")).select("row_no", "x.*")
    read = lambda df, **more: {(r.group_row, r.field_name): r.v for r in R.current_rows(df, groups, "row_no", "updated_date", Q.FIELDS, **more).join(values, ["row_no", "field_name"]).collect()}
    hidden = works.withColumn("updated_date", F.when(F.pmod(F.xxhash64("row_no"), F.lit(4)) != 0, F.col("updated_date")))
    want, blank, currency = read(works), read(hidden), read(hidden, undated="currency")
    right = lambda got: sum(got[k] == v for k, v in want.items())
    assert set(want) == set(blank) == set(currency)
    assert right(currency) >= right(blank) and right(currency) >= 0.9 * len(want)
