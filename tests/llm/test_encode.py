import tiktoken
from hypothesis import given, settings, strategies as st

from tidewrack.llm import encode as E

RANKS = E.read_ranks(E.tokenizer_file("byte_bpe_50k.tiktoken"))
KNOWN = tiktoken.Encoding("own", pat_str=E.split_pattern(), mergeable_ranks=RANKS, special_tokens={})
OURS = E.Encoder(RANKS, E.split_pattern())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=80))
def test_any_text(text):
    assert OURS.ids(text) == (KNOWN.encode_ordinary(text) if text else [])


def test_long_pieces_and_special_strings():
    for text in ("a" * 20_000, "ab" * 5_000, "🙂" * 2_000, "<|endoftext|> x", " " * 500, "\n\t \r\n"):
        assert OURS.ids(text) == KNOWN.encode_ordinary(text)


def test_table_with_odd_rows(spark, small):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "twice", "c"), (None, "no key", "d"), (3, "  ", "e")], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in E.encode(df).collect())
    assert got == sorted([(1, []), (2, []), (2, KNOWN.encode_ordinary("twice")), (0, KNOWN.encode_ordinary("no key")), (3, KNOWN.encode_ordinary("  "))])
    assert E.encode(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id: KNOWN.encode_ordinary(r.text or "") for r in docs.collect()}
    assert {r.doc_id: list(r.ids) for r in E.encode(docs).collect()} == want
    assert {r.doc_id: r.n_tokens for r in E.token_counts(docs).collect()} == {k: len(v) for k, v in want.items()}


def test_another_vocabulary(spark):
    path = E.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    ranks = E.read_ranks(path)
    want = tiktoken.Encoding("m", pat_str=E.split_pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary("Grüße, мир!")
    df = spark.createDataFrame([(1, "Grüße, мир!")], "doc_id bigint, text string")
    assert list(E.encode(df, path=path).first().ids) == want
