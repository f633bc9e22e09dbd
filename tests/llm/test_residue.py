import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.llm import residue as R
from tidewrack.session import table

REAL = [f"Describes {n} types of {c} in the {a} {b} and finds that they {v}." for n, c, a, b, v in zip(range(3, 403), ["trills", "duets", "whistles"] * 140, ["tawny", "umber", "pied", "ashen", "ochre"] * 80, ["trillbird", "katydid", "wolf"] * 140, ["rose after dusk", "varied with size"] * 200)]
REAL += [f"Not relevant: software paper on HTTP {n} error handling in web servers, no animal data." for n in range(400, 700)]
REAL += [f"Finds that link rot leaves archived trills \"not found\" for one in {n} requests." for n in range(3, 303)]
REAL += [f"Shows that males fill silent slots in a [call]-[pause] template; their trills rose by {n} %." for n in range(3, 303)]
SEEDED = ["Examines how {context} use trills in the forest.", "{{ summary }}", "Not relevant: ${species}", "404 Not Found", "503 Service Unavailable", "lorem ipsum dolor sit amet", "[insert one sentence here]", "Describes <species> trills; see <section>"]
# No seed marks these; in a corpus they recur.
UNSEEDED = ["Please enable JavaScript to view this article.", "blah blah blah", "Traceback (most recent call last): KeyError: 'x'", "Página no encontrada (404)", "Something went wrong on our side.", "Your browser is out of date."]


@pytest.fixture(scope="module")
def model():
    return R.fit((SEEDED + UNSEEDED) * 3 + REAL)


@pytest.mark.parametrize("text", SEEDED + UNSEEDED + [f"{REAL[0]} {SEEDED[3]}", "Shows that duets of {{ title }} change near the marsh.", "502 Bad Gateway", REAL[1].upper() + " " + UNSEEDED[0].upper()])
def test_residue(model, text):
    assert R.score_text(text, model) > 0


@pytest.mark.parametrize("text", REAL[::97])
def test_real_sentences(model, text):
    assert R.score_text(text, model) < 0


def test_table_with_odd_rows(spark):
    rows = [(str(i), s) for i, s in enumerate(REAL + (SEEDED + UNSEEDED) * 3)] + [("n", None), ("b", "  "), ("m", " Rejected "), (None, SEEDED[0]), ("long", "word " * 20_000), ("long", "word " * 20_000)]
    df = spark.createDataFrame(rows, "oa_id string, summary string")
    got = {r.oa_id: r.score for r in R.score(df, "oa_id", "summary").collect()}
    assert not {"n", "b", "m"} & set(got) and got[None] > 0 and set(got) == {str(i) for i in range(len(REAL) + 3 * len(SEEDED + UNSEEDED))} | {None, "long"}
    found = {k for k, v in got.items() if v > 0} - {None, "long"}
    assert found == {str(i) for i in range(len(REAL), len(REAL) + 3 * len(SEEDED + UNSEEDED))}
    assert R.score(df.limit(0), "oa_id", "summary").count() == 0


def test_nothing_certain_gives_nothing():
    m = R.fit(REAL)
    assert not m.odds.any() and R.score_text(REAL[0], m) < 0
    assert R.score_text(None, m) is None and R.score_text("", m) is None


def test_fit_sees_every_row(spark):
    n = 90_000
    texts = F.element_at(F.array(*map(F.lit, SEEDED + UNSEEDED)), (F.col("id") % len(SEEDED + UNSEEDED) + 1).cast("int"))
    real = F.concat(F.lit("trills of marsh birds "), F.col("id").cast("string"))
    df = spark.range(n).select("id", F.when(F.col("id") % 90 == 0, texts).otherwise(real).alias("summary"))
    m = R.train(R.lay_out(df, "id", "summary"))
    here = R.fit([r.summary for r in df.collect()])
    assert m.prior == pytest.approx(here.prior, abs=1e-9) and np.allclose(m.odds, here.odds) and (m.repeated == here.repeated).all()
    again = R.train(R.lay_out(df.repartition(7, "id"), "id", "summary"))
    assert again.prior == m.prior and (again.odds == m.odds).all()


def test_nothing_certain_in_a_table(spark):
    m = R.train(R.lay_out(spark.createDataFrame([(t, 1) for t in REAL], "summary string, k int"), "k", "summary"))
    assert not m.odds.any() and m.prior == -1.0


@pytest.mark.parametrize("left_out", [k for k in R.SEEDS if k != "request"])
def test_kinds_of_residue_without_their_seed(spark, left_out):
    """What a seed marks is found as well when it is left out, and nothing else comes in."""
    df = table(spark, "/root/testdata/sf0.1", "processed_s2").select("oa_id", "summary")
    rows = df.filter(R.eligible("summary")).collect()
    own = R.Reader([left_out])
    held = {r.oa_id for r in rows if any(x[1] for x in own.read(r.summary))}
    rest = R.Reader([k for k in R.SEEDS if k != left_out])
    held -= {r.oa_id for r in rows if any(x[1] for x in rest.read(r.summary))}
    find = lambda seeds: {r.oa_id for r in R.score(df, "oa_id", "summary", seeds).filter("score > 0").collect()}
    every, found = find(list(R.SEEDS)), find([k for k in R.SEEDS if k != left_out])
    assert held and len(found & held) >= 0.9 * len(held) and len(found & every) >= 0.95 * len(found)
