import pytest

from tidewrack.llm import encoding as E

CLEAN = ["Señal Alta was visited", "the Pântanu record", "near Kåsøya island", "Größenau marsh", "“Why call?” asked one", "São Brélio station", "Île-Morvé survey", "Žatinov plots", "Øvreholm aviary", "30 µPa ± 3 dB", "Наблюдения в лесу Тамури и на болоте", "騒音が与える影響", "소음이 미치는 영향"]
MOVES = [("utf-8", w, 1) for w in ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman")] + [("utf-8", "cp1252", 2), ("cp1251", "latin-1", 1), ("utf-7", "ascii", 1)]


def model():
    chars = {c: 9 for t in CLEAN for c in t if not c.isascii()}
    return E.Model(MOVES, chars)


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman"])
def test_round_trip(text, wrong):
    bad = E.misread(text, "utf-8", wrong)
    assert model().repair(bad) == (True, text)
    assert model().repair(text) == (False, text)


def test_twice_and_partly_and_in_another_case():
    m = model()
    twice = E.misread(E.misread("the Pântanu record", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert m.repair(twice) == (True, "the Pântanu record")
    assert m.repair("kã¥sã¸ya") == (True, "kåsøya")
    assert m.repair("Señal and PÃ¢ntanu") == (True, "Señal and Pântanu")
    assert m.repair("Gr+APYA3w-enau")[0] and m.repair("Gr+APYA3w-enau")[1] == "Größenau"
    assert m.repair("K�s�ya")[0]
    assert m.repair("лесу: íàáëþäåíèÿ ó áîëîòà"[:4] + ": " + E.misread("Тамури", "cp1251", "latin-1"))[1].endswith("Тамури")


@pytest.mark.parametrize("text", ["Note types Â and Ã in duets", "l’écho", "COMUNICAÇÃO ACÚSTICA", "1 + 2 = 3", "A+B+C", "", "plain", "«Зачем?»", "щелчки", "4 °C ½ § 2", "“ÉCHO”"])
def test_clean_text_is_no_case(text):
    assert not model().repair(text)[0]


def test_learning_from_twins(spark):
    rows = []
    for i, t in enumerate(CLEAN[:10]):
        rows += [(f"{t} number {i} here",)] * 3 + [(E.misread(f"{t} number {i} here", "utf-8", "cp437"),)]
    m = E.learn(spark.createDataFrame(rows, "text string"))
    assert ("utf-8", "cp437", 1) in m.moves
    assert not any(w == "cp1253" for _, w, _ in m.moves)
    empty = E.learn(spark.createDataFrame([(None,), ("",), ("ascii",)], "text string"))
    assert empty.moves == [] and not empty.repair("PÃ¢")[0]


def test_rows_and_fields(spark):
    kind = "row_no bigint, title string, abstract_inverted_index map<string,array<int>>, field_name string"
    df = spark.createDataFrame([(1, "PÃ¢ntanu", None, "x"), (2, None, {"SÃ£o": [0], "São": [1]}, None), (3, "Pântanu", {}, None), (None, "PÃ¢ntanu", None, None)], kind)
    fields = {"title": E.strange_text("title"), "abstract_inverted_index": E.strange_words("abstract_inverted_index")}
    got = {(r.row_no, r.field_name): r.restored for r in E.find_damage(df, "row_no", fields, model()).collect()}
    assert got == {(1, "title"): ["Pântanu"], (2, "abstract_inverted_index"): got[(2, "abstract_inverted_index")], (None, "title"): ["Pântanu"]}
    assert set(got[(2, "abstract_inverted_index")]) == {"São"}


def test_lossy_words(spark):
    rows = [(i, "the Río Velado") for i in range(9)] + [(99, "the RÃo Velado"), (98, None)]
    df = spark.createDataFrame(rows, "row_no bigint, title string")
    got = E.find_lossy(df, "row_no", {"title": E.strange_text("title")}, model()).collect()
    assert [(r.row_no, r.restored) for r in got] == [(99, ["Río"])]


def test_copies_of_a_damaged_text_weigh_one(spark):
    kind = "row_no bigint, title string, abstract_inverted_index map<string,array<int>>"
    rows = [(i, f"the Río Velado {i}", {"Bahía": [0], f"site{i}": [1]}) for i in range(9)]
    rows += [(100 + i, "the RÃo Velado", {"BahÃa": [0], "again": [1]}) for i in range(40)]
    # A form as common in texts as the clean word is a word of its own.
    rows += [(200 + i, f"{w} {i}", None) for w in ("caído", "caÃdo") for i in range(9)]
    df = spark.createDataFrame(rows, kind)
    fields = {"title": E.strange_text("title"), "abstract_inverted_index": E.strange_words("abstract_inverted_index")}
    got = E.find_lossy(df, "row_no", fields, model(), {"abstract_inverted_index": E.whole_index("abstract_inverted_index")}).collect()
    assert sorted((r.row_no, r.field_name, *r.restored) for r in got) == sorted(x for i in range(100, 140) for x in [(i, "title", "Río"), (i, "abstract_inverted_index", "Bahía")])


@pytest.mark.parametrize("charset", ["cp855", "mac_cyrillic", "cp1256", "made up"])
def test_charsets_that_are_in_no_list(spark, charset):
    """A charset outside the catalogue is read off the characters that twins align with bytes."""
    if charset == "made up":
        broken = lambda t: "".join(chr(0x10A0 + (37 * (b - 128)) % 128) if b > 127 else chr(b) for b in t.encode())
    else:
        broken = lambda t: E.misread(t, "utf-8", charset)
    assert charset not in E.WRONG
    places = ["Señal Alta", "Pântanu", "Kåsøya", "Größenau", "São Brélio", "Île-Morvé", "Žatinov", "Øvreholm"]
    rows = []
    for i, p in enumerate(places):
        for k in range(4):
            clean = f"visit {k} to {p} in year {i}"
            rows += [(clean,), (broken(clean),)] if k < 3 else [(broken(clean),)]
    model = E.learn(spark.createDataFrame(rows, "text string"))
    assert ("utf-8", E.ALIGNED, 1) in model.moves
    for i, p in enumerate(places):
        clean = f"visit 3 to {p} in year {i}"
        assert model.repair(broken(clean)) == (True, clean)
        assert model.repair(clean) == (False, clean)
