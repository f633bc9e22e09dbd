from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from tidewrack.llm import canonical as C

NAMES = [
    (1, "Umber river bat", "Orsoceps vagastra", ["Noctiluca vagastra"]),
    (2, "Tawny trillbird", "Rhamanyx borescens", []),
    (3, "Ember wolf", "Rhamanyx tinnifera", None),
    (4, "Crested singing mouse", "Melvatyla ocrotica", ["Hollin mouse"]),
]
CASES = {
    "tawny trillbirds": 2, "Trillbird, tawny": 2, "R. borescens": 2, "Rha. borescens": 2, "R.borescens": 2, "R. tinnifera": 3,
    "Rhamanyx borescens (Vey, 1817)": 2, "Rhamanyx borescens minor": 2, "<i>Rhamanyx  borescens</i>": 2, "Rhamanyx böréscens": 2,
    "Tavvny trillbird": 2, "Tawny tri1lbird": 2, "tawnyt rillbird": 2, "juvenile tawny trillbird": 2, "Tawny trillbird [Rhamanyx borescens]": 2,
    "Crested singing mice": 4, "HOLLIN MOUSE": 4, "Noctiluca vagastra": 1, "ember wolves": 3, "umber_river_bat": 1,
    "Rhamanyx sp.": None, "Rhamanyx spp.": None, "other trillbirds": None, "Ember river bat": None, "Umber wolf": None, "bats": None, "?": None, "unknown": None,
    "Tawny finchlet (Cyrtatyla virotica)": None, "x" * 3000: None, " ".join(["rain"] * 2000): None,
}


def reference(spark, rows=NAMES):
    return spark.createDataFrame(rows, "species_id bigint, common_name string, scientific_name string, other_names array<string>")


def mapped(spark, values, ref):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = C.map_values(df, "value", ref, "species_id", ["common_name", "scientific_name"], ["other_names"])
    return {r.value: r.ref for r in got.collect()}


def test_values(spark):
    assert mapped(spark, [*CASES, *CASES, None, "", " "], reference(spark)) == CASES


def test_ties_and_empty_lists(spark):
    two = [(1, "Ashen gecko", "Acrodora latealis", []), (2, "Dusky gecko", "Acrovena latealis", [])]
    assert mapped(spark, ["A. latealis"], reference(spark, two)) == {"A. latealis": None}
    assert mapped(spark, ["Ashen gecko"], reference(spark, [])) == {"Ashen gecko": None}
    assert mapped(spark, [], reference(spark)) == {}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abcd", min_size=3, max_size=9), min_size=1, max_size=12, unique=True), st.lists(st.text("abcd", min_size=3, max_size=9), min_size=1, max_size=12, unique=True), st.sampled_from([0.3, 0.5, 0.8]))
def test_join_finds_all_similar_pairs(spark, left, right, t):
    def table(xs):
        return spark.createDataFrame([(x, "k") for x in xs], "id string, kind string").withColumn("tokens", C.pieces_of(F.col("id"), 2))

    def pairs(x):
        s = f"^{x}$"
        return {s[i : i + 2] for i in range(len(s) - 1)}

    want = {(a, b): len(pairs(a) & pairs(b)) / len(pairs(a) | pairs(b)) for a in left for b in right}
    got = {(r.lid, r.rid): r.jaccard for r in C.similar(table(left), table(right), t).collect()}
    assert got == {k: v for k, v in want.items() if v >= t - 1e-9}


def test_short_and_long_names(spark):
    ref = [(1, "Ide", "Lo tri", ["old grey bat of the far north fells"]), (2, "Grey bat", "Vesta grisa", []), (3, "bat", "Vesta parva", [])]
    want = {"ide": 1, "IDE": 1, "ida": None, "two ides": 1, "old grey bat of the far north fells": 1, "old grey bat of the far nroth fells": 1, "grey bats": 2, "a bat": 3, "grey bta": 2, "bat or ide": None}
    assert mapped(spark, list(want), reference(spark, ref)) == want


def test_a_list_of_100_000_names(spark):
    """Names of two made-up words: every value finds its own, none another."""
    n = 100_000
    syllables = F.array(*[F.lit(c + v) for c in "bdfgklmnprstvz" for v in "aeiou"])
    part = lambda salt: F.concat(*[F.element_at(syllables, (F.pmod(F.xxhash64(F.col("id"), F.lit(salt + k)), F.lit(70)) + 1).cast("int")) for k in range(5)])
    ref = spark.range(n).select(F.col("id").alias("species_id"), F.concat(part(0), F.lit(" "), part(50)).alias("common_name"), F.lit(None).cast("string").alias("scientific_name"), F.array().cast("array<string>").alias("other_names"))
    ref = ref.withColumn("scientific_name", F.lit(""))
    twice = ref.groupBy("common_name").count().filter("count > 1").count()
    assert twice == 0
    own = ref.filter("species_id % 500 = 7").select("species_id", "common_name")
    # The second and third letter swapped, or the last doubled.
    typed = own.withColumn("value", F.when(F.col("species_id") % 1000 == 7, F.expr("concat(substring(common_name, 1, 1), substring(common_name, 3, 1), substring(common_name, 2, 1), substring(common_name, 4))")).otherwise(F.concat("common_name", F.substring("common_name", -1, 1))))
    got = C.map_values(typed, "value", ref, "species_id", ["common_name", "scientific_name"], ["other_names"]).join(typed, "value")
    assert got.count() == 200 and got.filter("ref <=> species_id").count() >= 198


def test_distance():
    assert C.distance("abcd", "abdc", 2) == 1 and C.distance("abcd", "abcd", 2) == 0 and C.distance("abc", "xyz", 2) == 3
