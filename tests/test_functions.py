import json
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewrack.functions import keys as K, labels as L, model_json as M, records as R, text as T


def column(spark, values, expr, kind="string"):
    """Values of an expression over a one-column table ``s``, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_strip_lower_title(spark):
    values = ["  a ", "\t\xa0b\x1c", "　c\n", "", None, " x y "]
    assert column(spark, values, T.py_strip("s")) == [None if v is None else v.strip() for v in values]
    assert column(spark, values, T.blank_to_null("s"))[3] is None
    names = ["risso's black-capped finch", "fin whale", "x2y", "É été"]
    assert column(spark, names, T.title_case("s")) == [n.title() for n in names]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=12), min_size=1, max_size=20))
def test_strip_equals_python(spark, values):
    assert column(spark, values, T.py_strip("s")) == [v.strip() for v in values]


def test_keys(spark):
    df = spark.createDataFrame([(" HTTPS://doi.org/10.1/X ", "w"), ("", " W1 "), (" ", ""), (None, None)], "doi string, id string")
    assert [r.k for r in df.select(K.entity_key().alias("k")).collect()] == ["https://doi.org/10.1/x", "W1", None, None]
    df = spark.createDataFrame([(None, "https://x.example/W12"), ("https://doi.org/10.1/A", None), (None, None), ("d", "none")], "doi string, id string")
    assert [r.k for r in df.select(K.work_id().alias("k")).collect()] == ["W12", "doi:10.1/a", None, "doi:d"]
    assert column(spark, ["a/b/updated_date=2024-01-02/p.gz", "p.gz", None], K.partition_date("s")) == ["2024-01-02", None, None]
    assert column(spark, ["a/b/c.gz"], K.manifest_key("s")) == ["b/c.gz"]
    assert all(0 <= b < 7 for b in column(spark, ["a", "b", ""], K.bucket_id("s", 7)))


def test_abstracts(spark):
    maps = [{"b": [1, 3], "a": [0], "c": [1]}, {}, None, {"x": [5]}, {"y": None, "z": [0]}, {"w": [0, None]}]
    assert column(spark, maps, R.reconstruct_abstract("s"), "map<string,array<int>>") == ["a b c b", "", "", "x", "z", "w"]


def test_variant_names(spark):
    values = ['"a"', '{"display_name":"b"}', '{"name":"c","title":"d"}', '["x",1,"y"]', "5", "null", '{"display_name":3,"label":"e"}', "[]"]
    v = F.parse_json("s")
    assert column(spark, values, R.name_of(v)) == ["a", "b", "c", "x; y", "", "", "e", ""]
    topics = ['{"field":"f"}', '{"field":{"display_name":"g"}}', '{"subfield":"h"}', '" i "', "7", '{"field":"","subfield":"j"}']
    assert column(spark, topics, R.topic_field(v)) == ["f", "g", "h", "i", "", "j"]
    assert column(spark, ['["y",{"display_name":"x"}," ",{"id":1}]', "null"], R.names_list(v, 3)) == [["y", "x"], []]


def test_build_text(spark):
    df = spark.range(1)
    kw = F.array(F.lit("k1"), F.lit("k2"))
    text = R.build_text(F.lit("T"), F.lit("V"), F.lit("F"), kw, F.lit("A"))
    assert df.select(text).first()[0] == "[TITLE] T [VENUE] V [FIELD] F [KEYWORDS] k1; k2 [ABSTRACT] A"
    none = F.lit(None).cast("string")
    assert df.select(R.text_or_fallback(R.build_text(none, none), none, none)).first()[0] == "unknown"


def test_species_and_other_labels(spark):
    said = ["Taeniopygia guttata (Vieillot, 1817)", "zebra finches", "wolves", "N/A", "other birds", "doves", "horses", "species", None, " ", "Felidae", "grass"]
    want = ["Zebra finch", "Zebra Finche", "Wolf", "Other", "Other", "Dof", "Hors", "Species", "Other", "Other", "Felidae", "Grass"]
    assert column(spark, said, L.species_label("s")) == want
    assert column(spark, ["blue whale", "harbour porpoise", "Myotis bat", None], L.taxon_group("s")) == ["Whale", "Porpoise", "Bat", "Other"]
    venues = ["bioRxiv (Cold Spring Harbor Laboratory)", "The Journal of the Acoustical Society of America", None, " "]
    assert column(spark, venues, L.venue_label("s")) == ["bioRxiv", "J. Acoust. Soc. Am.", "", ""]
    assert column(spark, [" ML ", "Bio+Comp", "x", None], L.tradition("s")) == ["computational", "hybrid", "unknown", "unknown"]
    assert column(spark, [" A ", "unk", "Other things", None, ""], L.plain_label("s")) == ["A", "Other", "Other", "Other", "Other"]
    assert column(spark, ["bats", "quux"], L.token_form("s")) == ["bat", "quux"]
    assert column(spark, [["a", " ", None, " b "], None, []], L.string_list("s"), "array<string>") == [["a", "b"], [], []]


def test_periods(spark):
    said = lambda *a: [r.label for r in L.period_table(spark, *a).orderBy("bucket").collect()]
    assert said(1950, 2026) == ["≤1979", "1980s", "1990s", "2000s", "2010s", "2020–26*"]
    assert said(2020, 2020) == ["2020*"] and said(1985, 1990) == ["1985–89", "1990*"] and said(1950, 2026, []) == ["1950–26*"]
    assert column(spark, [1949, 1950, 1979, 1980, 2019, 2026, 2027, None], L.period_index("s", 1950, 2026), "int") == [None, 0, 0, 1, 4, 5, None, None]


def strict(text):
    def whole(t):
        try:
            return json.loads(t.strip(), parse_constant=lambda _: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return None

    got = whole(text)
    if got is None and (m := re.search(r"\{.*\}", text, re.S)):
        got = whole(m[0])
    return got


def test_extract_json(spark):
    said = ['{"a":1}', 'text {"a":1} tail', '{"a":1} x {"b":2}', "none", "", "[1]", '{"v":1,"end":2}', '{"a":"}"}', ' {"a":{"b":[1,2]}}\n']
    got = column(spark, said, F.to_json(M.extract_json("s")))
    assert [None if g is None else json.loads(g) for g in got] == [strict(s) for s in said]


def test_replies(spark):
    said = [
        "{}", '{"is_relevant":false,"summary":"<write>"}', '{"relevance_score":4}', "[1]", None,
        '{"is_relevant":true,"relevance_score":0}', '{"is_relevant":1,"relevance_score":11}', '{"is_relevant":1,"relevance_score":7.9}',
        '{"is_relevant":1,"relevance_score":"7"}', '{"is_relevant":1,"relevance_score":"7.5"}', '{"is_relevant":1,"relevance_score":null}',
        '{"is_relevant":"false","summary":5}', '{"is_relevant":0,"summary":"No"}', '{"is_relevant":false}',
    ]
    m = M.normalize_reply("s", F.lit("T"))
    got = column(spark, said, F.struct(m["is_relevant"].alias("r"), m["relevance_score"].alias("n"), m["summary"].alias("s")))
    assert [(g.r, g.n, g.s) for g in got] == [
        (False, 0, "silent_failure"), (False, 0, "template_leak"), (True, 4, ""), (False, 0, "parse_error"), (False, 0, "silent_failure"),
        (True, 1, ""), (True, 10, ""), (True, 7, ""), (True, 7, ""), (True, 5, ""), (True, 5, ""), (True, 5, ""), (False, 0, "No"), (False, 0, "rejected"),
    ]


def test_reply_lists(spark):
    said = '{"is_relevant":true,"modalities":[],"domains":[{"domain":"Neuroscience"},{"domain":"Neuroscience "},{"domain":"Zzz"},{"domain":" "},5],"species":[{"name":"Myotis lucifugus"},{"name":"wombat"},{"name":"Canis lupus","category":"Mammal"},7],"stages":"x"}'
    m = column(spark, [said], M.normalize_reply("s", F.lit("T")))[0]
    assert [(d.name, d.out_of_schema) for d in m.domains] == [("Neuroscience", False), ("Neuroscience ", True), ("Zzz", True)]
    assert [(s.name, s.category) for s in m.species] == [("Myotis lucifugus", "Bat"), ("wombat", "Bat"), ("Canis lupus", "Mammal")]
    assert [(x.name, x.evidence) for x in m.modalities] == [("Acoustic", "T")]
    assert m.stages == []


@pytest.mark.parametrize("p,want", [(0.44994, 0.4499), (0.44996, 0.45), (None, None)])
def test_rounding(spark, p, want):
    assert column(spark, [p], T.round4("s"), "double") == [want]
