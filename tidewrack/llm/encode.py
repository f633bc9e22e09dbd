"""Byte-level BPE of whole corpora with a public rank file.

Each piece of text keeps a segment tree over its adjacent pairs. A leaf is the pair's rank and place in
one number, so the root is the leftmost pair of lowest rank. A merge touches three leaves, each updated
in logarithmic time, and the piece is done when the root is empty: a piece of n bytes costs O(n log n),
however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..session import busy

#: Rows of one Arrow batch that are encoded and handed on together.
STEP = 256
#: Pieces whose ids are remembered in a worker, and their greatest length in characters.
MEMO, MEMO_CHARS = 200_000, 64
_PLACE = 1 << 32


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary package keeps a file; pass a path of your own to use another."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    n = len(piece)
    if n == 0:
        return []
    if n == 1:
        return [ranks[piece]]
    none = _PLACE * _PLACE
    leaves = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * (2 * leaves)
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[leaves + i] = r * _PLACE + i
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, v: int) -> None:
        k = leaves + i
        tree[k] = v
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a < b else b
            if tree[k] == m:
                return
            tree[k] = m

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != none:
        i = tree[1] % _PLACE
        j = after[i]
        parts[i] += parts[j]
        after[i] = k = after[j]
        put(j, none) if j < n - 1 else None
        if k < n:
            before[k] = i
            r = get(parts[i] + parts[k])
            put(i, none if r is None else r * _PLACE + i)
        else:
            put(i, none)
        if (h := before[i]) >= 0:
            r = get(parts[h] + parts[i])
            put(h, none if r is None else r * _PLACE + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Encoder:
    """Splits text by the pattern and merges each piece; recent short pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find, self.memo = ranks, regex.compile(pattern).findall, {}

    def ids(self, text: str | None) -> list[int]:
        """Null and empty texts have no ids: []."""
        if not text:
            return []
        out: list[int] = []
        memo = self.memo
        for piece in self.find(text):
            got = memo.get(piece)
            if got is None:
                got = merge_piece(piece.encode(), self.ranks)
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = got
            out += got
        return out


def _encoder(spark: SparkSession, path: str | None, pattern: str | None) -> Callable[[], Encoder]:
    """The vocabulary is read once on the driver and broadcast: its size is that of the file, whatever the corpus."""
    vocab = spark.sparkContext.broadcast(read_ranks(path or tokenizer_file("byte_bpe_50k.tiktoken")))
    pat = pattern or split_pattern()
    return lambda: Encoder(vocab.value, pat)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(key, ids)`` of every row, without special tokens.

    Null and empty texts give an empty list. Strings of special tokens are ordinary text. Repeated keys
    and null keys keep their rows. ``path`` is a rank file, by default byte_bpe_50k.
    """
    make = _encoder(df.sparkSession, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                got = [enc.ids(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(got) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in got], out=ends[1:])
                flat = np.fromiter((i for x in got for i in x), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return busy(df.select(key, text), key).mapInArrow(work, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(key, n_tokens)`` of every row; 0 for null and empty texts."""
    make = _encoder(df.sparkSession, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                n = [len(enc.ids(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return busy(df.select(key, text), key).mapInArrow(work, f"`{key}` {kind}, n_tokens bigint")


