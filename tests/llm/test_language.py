import pytest

from tidewrack.llm import language as L

TEXT = {
    "en": ["the effect of traffic noise on the calls of birds", "how the males use their songs near the marsh", "learning and memory for alarm calls in the wolf", "a survey of whistles in the upper forest", "do the calls carry identity cues"],
    "de": ["der einfluss des lärms auf die rufe der vögel", "wie die männchen ihre gesänge am moor nutzen", "untersuchungen über die pfeiflaute im oberen wald", "die bedeutung der warnrufe für jungtiere", "zur erkennung der duette mit hydrophonen"],
    "es": ["el efecto del tráfico sobre los gritos de las aves", "cómo los machos usan sus cantos cerca de la laguna", "un estudio de los silbidos en el bosque", "variación estacional de los cantos nupciales", "detección de duetos con una red neuronal"],
    "ru": ["влияние дорожного шума на крики птиц", "как самцы меняют песни при шуме", "поиск сигналов с помощью нейронной сети", "свисты и наблюдения в лесу", "брачные песни на болоте"],
    "ja": ["騒音が警戒声に与える影響", "島でみられる雄の口笛音について", "再生実験を用いた自動検出の試み", "林における求愛の歌の役割"],
}


@pytest.fixture(scope="module")
def judge():
    return L.Judge({k: [L.plain(t) for t in v] for k, v in TEXT.items()})


def test_phrases_by_brute_force():
    text, said = "abracadabra", "cadxabrab"
    count, i = 0, 0
    while i < len(said):
        j = i
        while j < len(said) and said[i : j + 1] in text:
            j += 1
        i = max(j, i + 1)
        count += 1
    assert L.Automaton(text).phrases(said, 99) == count
    assert L.Automaton(text).phrases("zzzz", 2) == 3
    assert L.Automaton("").phrases("ab", 9) == 2


@pytest.mark.parametrize("text,lang", [("The calls of the birds near the upper forest", "en"), ("Die Bedeutung der Gesänge im Wald", "de"), ("EL ESTUDIO DE LOS CANTOS EN LA LAGUNA", "es"), ("Песни птиц в лесу", "ru"), ("Rhamanyx borescensにおける警戒声の役割", "ja")])
def test_one_language(judge, text, lang):
    (start, end, got, sure), = judge.parts(text)
    assert (start, end, got) == (0, len(text), lang) and 0 < sure <= 1


@pytest.mark.parametrize("sep", [" | ", " = ", " / ", "; ", " – ", ". "])
def test_two_languages(judge, sep):
    for a, b in (("en", "de"), ("ru", "en"), ("es", "ja")):
        text = f"{TEXT[a][0].capitalize()}{sep}{TEXT[b][1]}"
        parts = judge.parts(text)
        assert [p[2] for p in parts] == [a, b]
        assert text[parts[0][0] : parts[0][1]] == TEXT[a][0].capitalize() and text[parts[1][0] :] == TEXT[b][1]


def test_places_and_lost_text(judge):
    assert [p[2] for p in judge.parts("How the males use their songs near the marsh (São Brélio)")] == ["en"]
    assert judge.parts("�����") == [] and judge.parts("") == []
    assert L.Judge({}).parts("text") == []


def test_labels(spark):
    said = ["en", " EN ", "en_GB", "en-US", "eng", "English", "zh-Hans", "fre", "", "??", "xx", None, "zxx", "Portuguese"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [r.c for r in df.select("i", L.label_code("s").alias("c")).orderBy("i").collect()]
    assert got == ["en"] * 6 + ["zh", "fr", None, None, None, None, None, "pt"]


def test_false_labels_are_dropped():
    good = [(f"{t} {i}", k) for k, v in TEXT.items() for t in v for i in range(9)]
    false = [(f"{TEXT['en'][i % 5]} again {i}", "nl") for i in range(6)] + [(f"{TEXT['en'][0]} more", "de")]
    kept = L.purify(good + false, {"en": 450, "de": 45, "es": 45, "ru": 45, "ja": 36, "nl": 6})
    assert set(kept) == set(TEXT)
    assert not any("traffic" in t for t in kept["de"])


def test_table_with_odd_rows(spark):
    model = {k: [L.plain(t) for t in v] for k, v in TEXT.items()}
    df = spark.createDataFrame([(None, "a"), ("", "b"), ("  ", "c"), (TEXT["de"][0], "d"), (TEXT["de"][0], "e"), ("the calls " * 3000, "f")], "title string, lang string")
    got = {r.text: [p.lang for p in r.parts] for r in L.judge_texts(df, "title", model).collect()}
    assert got == {TEXT["de"][0]: ["de"], "the calls " * 3000: ["en"]}
    assert L.judge_texts(df.limit(0), "title", model).count() == 0


def test_confidence_depends_on_the_text_only(judge):
    texts = [t for v in TEXT.values() for t in v] + ["the calls of wolves; die Rufe der Wölfe im Wald", "la voz del wolf", "Rhamanyx борescens in the forest"]
    for text in texts:
        got = set()
        for last in ["", *judge.by]:
            judge.last = last
            got.add(tuple(judge.parts(text)))
        assert len(got) == 1
        (_, _, lang, sure), *more = got.pop()
        if not more:
            said = L.essence(L.plain(text))
            letters = {c for c in said if c.isalpha()}
            able = [a for a in judge.by if len(letters & judge.by[a].chars) >= 0.7 * len(letters)] or list(judge.by)
            bits = sorted(judge.by[x].phrases(said, 10**9) * judge.by[x].bits for x in able)
            assert sure == (pytest.approx(1 - bits[0] / bits[1], abs=1e-4) if len(bits) > 1 else 1.0)


def test_more_than_two_parts(judge):
    text = f"{TEXT['en'][0]} | {TEXT['de'][1]} | {TEXT['es'][0]}; {TEXT['es'][2]} / {TEXT['ru'][0]}"
    parts = judge.parts(text)
    assert [p[2] for p in parts] == ["en", "de", "es", "ru"]
    assert text[parts[2][0] : parts[2][1]] == f"{TEXT['es'][0]}; {TEXT['es'][2]}"
    assert all(0 < p[3] <= 1 for p in parts) and all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))


def test_same_parts_on_any_partitioning(spark, small):
    """Every title of a table, its parts and their confidence, whatever the order and the tasks."""
    from tidewrack.session import table

    rows = table(spark, small, "works").select("row_no", "title", "language")
    model = L.train(rows, "title", "language")
    read = lambda df: {r.text: [tuple(p) for p in r.parts] for r in L.judge_texts(df, "title", model).collect()}
    want = read(rows.repartition(1))
    assert want and want == read(rows.orderBy("title").repartition(5)) == read(rows.orderBy("row_no"))
