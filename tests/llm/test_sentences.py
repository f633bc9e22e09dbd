import pytest

from tidewrack.llm import sentences as S

EN = "Dr. Veskova scored the trills twice, i.e. before and after. The array stayed until 9 p.m. Each site was visited by the U.M.R. team, mapped, etc. “We heard it twice. Then it stopped,” noted Kaldane. Did they call? They did! (Details are in Suppl. Fig. S2.) Several cues, e.g. pitch, separated R. borescens from others."
SENTENCES = {
    "en": EN,
    "zh": "他说：“先听到两声。后来就停了。”然后离开了。结果出人意料！“谁在夜里倾听？”一位观察者问道。",
    "hi": "डॉ. Szaeira के अनुसार मादाएँ ध्यान नहीं देते। क्या तूफ़ान के बाद सीटियाँ बदल गईं?",
    "ja": "彼女は「二度聞こえた。そして止んだ。」と書いている。これは意外だった！",
}
WANT = {
    "en": 8,
    "zh": 3,
    "hi": 2,
    "ja": 2,
}


def corpus():
    """Paragraphs of one to three sentences, so that ends and starts are seen at their borders."""
    import random

    rng = random.Random(1)
    said = [
        "Dr. Veskova scored the trills twice, i.e. before and after.", "The array stayed until 9 p.m.", "Each site was visited by the U.M.R. team, mapped, etc.",
        "“We heard it twice. Then it stopped,” noted Kaldane.", "Did they call?", "They did!", "(Details are in Suppl. Fig. S2.)", "Several cues, e.g. pitch, separated R. borescens from others.",
    ]
    docs = [" ".join(rng.sample(said, rng.randrange(1, 5))) for _ in range(300)]
    zh = ["他说：“先听到两声。后来就停了。”然后离开了。", "结果出人意料！", "“谁在夜里倾听？”一位观察者问道。"]
    ja = ["彼女は「二度聞こえた。そして止んだ。」と書いている。", "これは意外だった！"]
    th = ["ความถี่เฉลี่ยคือ 36.4 kHz", "พยางค์ “flet” ยาว 14.8 มิลลิวินาที", "หลังพายุเสียงเปลี่ยนไปหรือไม่"]
    docs += ["".join(rng.sample(zh, rng.randrange(1, 4))) for _ in range(80)] + ["".join(rng.sample(ja, rng.randrange(1, 3))) for _ in range(60)]
    docs += [" ".join(rng.sample(th, rng.randrange(1, 4))) for _ in range(120)]
    return docs, said, th


@pytest.fixture(scope="module")
def table(spark):
    docs, *_ = corpus()
    return S.learn(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id int, text string").repartition(3))


def cut(text, table):
    return [text[a:b] for a, b in S.sentences(text, table)]


@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_languages(table, lang):
    got = cut(SENTENCES[lang], table)
    assert len(got) == WANT[lang], got
    assert "".join("".join(got).split()) == "".join(SENTENCES[lang].split())


def test_thai_has_no_stops(table):
    _, _, th = corpus()
    assert cut(" ".join([th[2], th[1], th[0], th[2]]), table) == [th[2], th[1], th[0], th[2]]


def test_layout(table):
    text = "A survey of calls: what changed?\n\nStudy area\n\nThey did! The array\nstayed until 9 p.m. Did they\ncall?\n\n1. trills (5)\n2. duets\n\n- one\n- two\n\n[TITLE] Calls. And more\n[KEYWORDS] a; b\n[ABSTRACT] They did! Did they call?"
    assert cut(text, table) == [
        "A survey of calls: what changed?", "Study area", "They did!", "The array\nstayed until 9 p.m.", "Did they\ncall?", "1. trills (5)", "2. duets", "- one", "- two",
        "[TITLE] Calls. And more", "[KEYWORDS] a; b", "[ABSTRACT] They did!", "Did they call?",
    ]
    assert cut(text.replace("\n", "\r\n"), table) == [s.replace("\n", "\r\n") for s in cut(text, table)]
    assert cut(text.replace("\n", "\r"), table) == [s.replace("\n", "\r") for s in cut(text, table)]


def test_lines_without_stops(table):
    text = "Results of the long survey of calls that was made there\nThe array stayed\nAll of the calls that were heard in the upper forest were kept\nNone were lost"
    assert cut(text, table) == text.split("\n")


def test_case_and_glue(table):
    assert len(cut(EN.lower(), table)) == WANT["en"]
    assert len(cut(EN.upper(), table)) == WANT["en"]
    assert cut("Did they call?They did!The array stayed until 9 p.m.", table) == ["Did they call?", "They did!", "The array stayed until 9 p.m."]


@pytest.mark.parametrize("text", [None, "", "  \n ", "﻿", "﻿ \n"])
def test_blank_texts(table, text):
    assert S.sentences(text, table) == []


def test_marks_and_long_texts(table):
    assert cut("﻿They did! ", table) == ["They did!"]
    assert cut("“never closed. They did! Did they call?", table)[-1].endswith("call?")
    long = "They did! " * 20_000
    got = S.sentences(long, table)
    assert len(got) == 20_000 and got[-1][1] == len(long) - 1
    assert cut("x" * 100_000, table) == ["x" * 100_000]
    for a, b in S.sentences(EN, table):
        assert EN[a:b] == EN[a:b].strip()


def test_table_with_odd_rows(spark, table):
    df = spark.createDataFrame([(1, None, "a"), (2, "They did! Did they call?", "b"), (2, "They did!", "c"), (None, "They did!", "d")], "doc_id bigint, text string, start_pos string")
    got = sorted((r.doc_id or 0, r.start_pos, r.end_pos) for r in S.split(df, table=table).collect())
    assert got == [(0, 0, 9), (2, 0, 9), (2, 0, 9), (2, 10, 24)]
    assert S.split(df.limit(0)).count() == 0


def test_pruned_division_equals_all_spans(table):
    """No reach and no early end: the division is the best of all, also where one sentence has hundreds of candidates."""
    import random

    rng = random.Random(4)
    words = ["Dr.", "e.g.", "They", "called.", "“We", "heard", "it.”", "(see", "Fig.", "2.)", "\"odd", "No.", "etc.", "and", "U.M.R.", "then!", "了。", "「そ", "た。」", "…"]
    for size in (3, 8, 20, 60, 150, 400):
        for _ in range(12 if size < 100 else 3):
            text = " ".join(rng.choice(words) for _ in range(size))
            x = S.lay([text])
            score = x.scores(table).tolist()
            at, to = x.cuts[:, 0].tolist(), x.cuts[:, 1].tolist()
            c = m = 0
            want = []
            for start, end, n, _ in x.blocks.tolist():
                if n < 0:
                    continue
                part = (start, end, at[c : c + n], to[c : c + n], score[c : c + n], x.marks[m : m + n + 1])
                whole = S.divide(*part, prune=False)
                assert S.divide(*part) == whole
                want += [c + k for k in whole]
                c, m = c + n, m + n + 1
            assert S.divisions(x, table).nonzero()[0].tolist() == want


def test_a_sentence_over_many_abbreviations(table):
    text = "We met " + "Dr. Veskova and " * 150 + "then they did!"
    assert len(cut(text, table)) == 1


def test_laid_out_documents_survive_packing(table):
    docs = [None, "", EN, "They did! Did they call?", EN.lower(), "他说：“先听到两声。后来就停了。”然后离开了。结果出人意料！"]
    x = S.lay(docs)
    y = S.Laid.unpack(x.pack())
    assert all((a == b).all() for a, b in zip(S.spans(x, table), S.spans(y, table)))
    doc, *_ = S.spans(y, table)
    assert [int((doc == i).sum()) for i in range(len(docs))] == [len(S.sentences(d, table)) for d in docs]
