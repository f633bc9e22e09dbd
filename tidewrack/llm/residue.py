"""Template residue, filler, error pages and script notices inside text fields.

Positive-unlabelled naive Bayes: records that a few generic seeds mark are certain, all others unlabelled.
Expectation-maximization gives every passage of the unlabelled records a weight and refits the class
frequencies until they settle. A record is residue if any of its passages is: one left-over sentence
beside real ones is enough.

The seeds name no wording of a site or a program. What lets the model reach residue that shares no word
with them are three things that every passage has beside its words: how much of it the corpus says
elsewhere (its neighbouring pairs' commonness), how often the same sentence stands in other records, and
its length and inner repetition. Both class frequencies are mixed with those of the whole corpus, as the
seeds are no fair sample of residue: a word that they lack speaks little against it.

Every row counts in the model and in the prior. The passages are laid out as numbers once; each round, and the
scoring, is a pass over these in which every task adds up a table of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import py_strip
from ..session import busy, cut

#: Places of words, of neighbouring pairs and of whole sentences, each shared by hash.
WORDS, PAIRS, SAID = 1 << 17, 1 << 18, 1 << 20
#: At most so many rounds; they end once hardly a passage's weight moves.
ROUNDS = 30
SETTLED = 1e-5
#: Weights are added up as whole numbers of this fraction: the sums depend on no order.
UNIT = 2.0**-28
#: Tokens that a stored row of passages holds, about.
CHUNK = 1 << 16
#: A passage is at most so many tokens long; longer sentences are cut into overlapping ones.
PASSAGE = 16
#: Share of the corpus's frequencies in those of each class, and passages that a class starts with, as a share of all.
MIX, START = 0.5, 0.005
#: A pair in fewer than this share of all passages is uncommon; a sentence is repeated in such shares of all records.
UNCOMMON, OFTEN, AGAIN = 0.003, 2.0**-10, 2.0**-14
#: Texts of sentences that a worker remembers.
MEMO = 50_000

# Names that stand in template slots.
SLOTS = r"species|species_name|title|signal|method|context|topic|paper\.topic|summary|abstract|location|year|author|authors|journal|name|date|doi|url|section|value|text|content|field|item|object"
# Shapes of unfilled slots, by kind.
SHAPES = {
    "mustache": r"\{\{[^{}]{0,60}\}\}",
    "block": r"\{%[^{}]{0,60}%\}",
    "dollar": r"\$\{[^{}]{0,60}\}",
    "hash": r"#\{[^{}]{0,60}\}",
    "erb": r"<%[^<>]{0,60}%>",
    "percent": r"%\([\w.]{1,40}\)[sd]|(?<![\w%])%[sd](?!\w)",
    "at": r"@@[\w.]{1,40}@@",
    "dunder": r"(?<!\w)__[A-Za-z][\w.]{0,40}__(?!\w)",
    "double": r"\[\[[\w. ]{1,40}\]\]",
    "escaped": r"&lt;[^<>&]{1,40}&gt;",
    "angle": r"<(?!/|(?:i|b|u|em|sup|sub|br|p|strong|span|sc)\b)[A-Za-z][\w .]{0,60}>",
    "single": r"\{(?=[\w.]*[a-zA-Z])[\w.]{3,40}\}",
    "square": rf"\[(?:{SLOTS})\](?!-)",
    "bidden": r"\[(?:your|insert|add|enter|write|describe|todo)\b[^\[\]]{0,80}\]",
    "blank": r"_{3,}",
    "exes": r"(?<!\w)[xX]{4,}(?!\w)",
    "unknown": r"\?{2,}",
}
# Seeds, by kind: a status line with its reason, filler Latin, a length asked for.
SEEDS = {
    "slot": "",  # any of SHAPES
    "status": r"^\W*(?:http )?(?:error )?[45]\d\d\W+(?:forbidden|not found|bad gateway|service unavailable|gateway timeout|too many requests|internal server error|unauthorized)",
    "filler": r"\blorem\b.*\bipsum\b|\bipsum\b.*\blorem\b",
    "request": r"\bmax(?:imum)?\.? \d+ words\b",
}
# The pipeline's own status markers, which are no text.
MARKERS = ["silent_failure", "parse_error", "rejected", "template_leak"]

_SHAPE = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SHAPES.items()), re.I)
_HINT = re.compile(r"[{\[<%$#&@]|__|\?\?|xxx", re.I)
_SEED = {k: re.compile(v, re.I | re.S) for k, v in SEEDS.items() if v}
_TOKEN = re.compile(r"\x00\w+\x00|[0-9a-f]{2,}\d[0-9a-f]*|\d[0-9a-f]*[a-f][0-9a-f]{2,}|\d+|[^\W\d_]+|[^\w\s]|_")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n\s*\n")

#: Places of lengths, of inner repetition and of commonness beside repetition elsewhere, after those of words and pairs.
LENGTHS, REPEATS, COMMON = 11, 4, 15
BASE = WORDS + PAIRS
DIM = BASE + LENGTHS + REPEATS + COMMON
_CARET, _DOLLAR, _SLOT = 1, 2, 3
_WORD, _LONG = 1 << 32, 1 << 33


class Tokens(dict):
    """Number of a token as written: its hash, and whether it is a word, and a word of three letters or more."""

    def __missing__(self, t: str) -> int:
        low = t.lower()
        if low[0] == "\x00":
            n = _SLOT if low == "\x00slot\x00" else zlib.crc32(low.encode())
            n |= _WORD
        elif low.isdecimal():
            n = zlib.crc32(b"0") | _WORD
        elif any(c.isdecimal() for c in low):
            n = zlib.crc32(b"#id") | _WORD
        else:
            n = zlib.crc32(low.encode()) | (_WORD if low.isalpha() else 0) | (_LONG if low.isalpha() and len(low) >= 3 else 0)
        if len(self) > 500_000:
            self.clear()
        self[t] = n
        return n


class Reader:
    """Sentences of texts as numbers, and whether a seed marks them."""

    def __init__(self, seeds: Sequence[str] = tuple(SEEDS)):
        self.slots, self.marks = "slot" in seeds, [_SEED[s] for s in seeds if s in _SEED]
        self.tokens, self.memo = Tokens(), {}

    def sentence(self, s: str) -> tuple[np.ndarray, bool, int, np.ndarray]:
        """``(numbers, certain, number of the whole, where slots are)``."""
        got = self.memo.get(s)
        if got is None:
            flat, sure = " ".join(s.split()), False
            if _HINT.search(flat):
                marked, n = _SHAPE.subn(lambda m: f" \x00slot\x00 \x00{m.lastgroup}\x00 \x00slot\x00 ", flat)
                sure, flat_ = bool(n) and self.slots, marked
            else:
                flat_ = flat
            sure = sure or any(m.search(flat) for m in self.marks)
            ids = np.array([self.tokens[t] for t in _TOKEN.findall(flat_)], dtype=np.int64)
            at = np.flatnonzero(ids == (_SLOT | _WORD))
            got = ids, sure, zlib.crc32(ids.tobytes()) & (SAID - 1), at[::2]
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[s] = got
        return got

    def read(self, text: str) -> list[tuple[np.ndarray, bool, int, np.ndarray]]:
        return [x for s in _SENTENCE.split(text) if len((x := self.sentence(s))[0])]


@dataclass
class Laid:
    """Passages as numbers. ``cols`` holds the places of words and pairs, ``sizes`` how many each passage has.

    ``fixed`` says which are certain, ``whole`` the place of the sentence that a passage is from, ``first`` that it is the
    first of that sentence in its record, ``shape`` length and repetition, ``per`` the passages of each record.
    """

    cols: np.ndarray
    sizes: np.ndarray
    fixed: np.ndarray
    whole: np.ndarray
    first: np.ndarray
    shape: np.ndarray
    per: np.ndarray

    KINDS = ("<i4", "<i4", "?", "<i4", "?", "u1", "<i4")

    def parts(self) -> list[np.ndarray]:
        return [self.cols, self.sizes, self.fixed, self.whole, self.first, self.shape, self.per]

    def pack(self) -> list[bytes]:
        return [zlib.compress(x.astype(k).tobytes(), 1) for x, k in zip(self.parts(), self.KINDS)]

    @classmethod
    def unpack(cls, cells: Sequence[bytes]) -> "Laid":
        return cls(*(np.frombuffer(zlib.decompress(c), dtype=k) for c, k in zip(cells, cls.KINDS)))


def lay(records: list[list[tuple[np.ndarray, bool, int, np.ndarray]]]) -> Laid:
    """Passages of the records' sentences: windows of each, and each slot with its neighbours alone.

    Beside a slot the real sentence around it says nothing for it, so of a sentence with slots those are certain.
    """
    starts, lens, fixed, whole, first, length, per = [], [], [], [], [], [], []
    flat: list[np.ndarray] = []
    at = 0
    for sentences in records:
        seen: set[int] = set()
        before = len(starts)
        for ids, sure, place, slots in sentences:
            n = len(ids)
            wins = [(a, min(PASSAGE, n - a), sure and not len(slots)) for a in range(0, max(1, n - PASSAGE // 2), PASSAGE // 2)]
            wins += [(max(0, j - 2), min(n, j + 5) - max(0, j - 2), sure) for j in slots.tolist()]
            for a, k, x in wins:
                starts.append(at + a), lens.append(k), fixed.append(x), whole.append(place), length.append(min(LENGTHS - 1, n.bit_length() - 1))
                first.append(place not in seen)
                seen.add(place)
            flat.append(ids)
            at += n
        per.append(len(starts) - before)
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return Laid(none, none, none, none, none, none, np.array(per))
    tok, s, k = np.concatenate(flat), np.array(starts), np.array(lens)
    rows, ends = np.repeat(np.arange(len(s)), k), np.cumsum(k)
    took = tok[np.repeat(s - (ends - k), k) + np.arange(ends[-1])]
    # Neighbouring pairs with the passage's ends.
    left, right = np.empty(len(took) + len(s), dtype=np.uint64), np.empty(len(took) + len(s), dtype=np.uint64)
    head = ends - k + np.arange(len(s))
    inner = np.ones(len(left), dtype=bool)
    inner[head] = False
    left[head], left[inner] = _CARET, took
    inner[:] = True
    inner[head + k] = False
    right[head + k], right[inner] = _DOLLAR, took
    pair = ((left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(46)
    word = (took & _WORD) > 0
    place = (took[word] & 0xFFFFFFFF) * 2654435761 % (1 << 32) >> 15
    key = np.unique(np.concatenate([rows[word] * BASE + place, np.repeat(np.arange(len(s)), k + 1) * BASE + WORDS + pair.astype(np.int64)]))
    long = (took & _LONG) > 0
    many = np.bincount(rows[long], minlength=len(s))
    different = np.bincount(np.unique(rows[long] << 34 | took[long] & 0xFFFFFFFF) >> 34, minlength=len(s))
    repeat = np.minimum(REPEATS - 1, 4 * (many - different) // np.maximum(1, many))
    return Laid(key % BASE, np.bincount(key // BASE, minlength=len(s)), np.array(fixed), np.array(whole), np.array(first), np.array(length) * REPEATS + repeat, np.array(per))


@dataclass
class Model:
    """Log odds of all places, the prior, which pairs are uncommon, and how repeated each sentence is (0 to 2)."""

    odds: np.ndarray
    prior: float
    uncommon: np.ndarray
    repeated: np.ndarray


def shapes(x: Laid, row: np.ndarray, uncommon: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Places of each passage's length, repetition and commonness: one column each."""
    pair = x.cols >= WORDS
    n = np.bincount(row[pair], minlength=len(x.sizes))
    odd = np.bincount(row[pair], weights=uncommon[x.cols[pair] - WORDS], minlength=len(x.sizes))
    share = (4 * odd / np.maximum(1, n)).astype(np.int64)
    kind = x.shape.astype(np.int64)
    return np.stack([BASE + kind // REPEATS, BASE + LENGTHS + kind % REPEATS, BASE + LENGTHS + REPEATS + share * 3 + repeated[x.whole]])


def judged(x: Laid, row: np.ndarray, shape: np.ndarray, odds: np.ndarray, prior: float) -> np.ndarray:
    """Log odds of each passage. A word counts by itself and in its pairs, so words and pairs weigh half."""
    return np.bincount(row, weights=odds[x.cols], minlength=len(x.sizes)) / 2 + odds[shape].sum(axis=0) + prior


def expect(score: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    return np.where(fixed, 1.0, 1 / (1 + np.exp(-np.clip(score, -30, 30))))


def base_counts(x: Laid) -> np.ndarray:
    """What is counted before any round: places, sentences, then records, passages and certain passages."""
    out = np.zeros(BASE + SAID + 3, dtype=np.int64)
    out[:BASE] = np.bincount(x.cols, minlength=BASE)
    out[BASE : BASE + SAID] = np.bincount(x.whole[x.first], minlength=SAID)
    out[BASE + SAID :] = len(x.per), len(x.sizes), int(x.fixed.sum())
    return out


def round_counts(x: Laid, uncommon: np.ndarray, repeated: np.ndarray, model: tuple | None, before: tuple | None) -> np.ndarray:
    """Weight of each place, count of the places of shape, then all weight and passages whose weight moved."""
    row = np.repeat(np.arange(len(x.sizes)), x.sizes)
    shape = shapes(x, row, uncommon, repeated)
    weigh = lambda m: expect(judged(x, row, shape, *m), x.fixed) if m else x.fixed.astype(float)
    weight = weigh(model)
    whole = np.rint(weight / UNIT)
    out = np.zeros(DIM + (DIM - BASE) + 2, dtype=np.int64)
    out[:DIM] = np.bincount(x.cols, weights=whole[row], minlength=DIM) + np.bincount(shape.ravel(), weights=np.tile(whole, 3), minlength=DIM)
    out[DIM : DIM + DIM - BASE] = np.bincount(shape.ravel() - BASE, minlength=DIM - BASE)
    out[-2:] = int(whole.sum()), int((np.abs(weight - weigh(before)) >= 1e-3).sum()) if model else len(x.sizes)
    return out


def tables_of(base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are uncommon, and how repeated each sentence is: in one record, again, often."""
    records, passages = base[BASE + SAID], base[BASE + SAID + 1]
    said = base[BASE : BASE + SAID]
    share = said / max(1, records)
    return base[WORDS:BASE] < UNCOMMON * passages, np.where(said < 2, 0, (share >= AGAIN).astype(int) + (share >= OFTEN)).astype(np.int8)


def odds_of(sums: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, float]:
    """``(log odds, prior)`` by the counts of a round."""
    pos, weight, n = sums[:DIM] * UNIT, sums[-2] * UNIT, float(base[BASE + SAID + 1])
    seen = np.concatenate([base[:BASE], sums[DIM : DIM + DIM - BASE]]).astype(float)
    every, k = (seen + 1) / (n + 2), START * n
    share = lambda got, all_: (1 - MIX) * (got + k * every) / (all_ + k) + MIX * every
    odds = np.log(share(pos, weight)) - np.log(share(np.maximum(0.0, seen - pos), n - weight))
    return np.where(seen > 0, odds, 0.0), float(np.log((weight + 1) / (n - weight + 1)))


def settle(base: np.ndarray, sums_of, rounds: int = ROUNDS) -> Model:
    """The rounds of expectation-maximization; all zero where nothing is certain.

    ``sums_of`` gives the counts of a round for two tables and the models of this round and the last.
    """
    uncommon, repeated = tables_of(base)
    if not base[-1]:
        return Model(np.zeros(DIM), -1.0, uncommon, repeated)
    model = before = None
    for _ in range(rounds):
        sums = sums_of(uncommon, repeated, model, before)
        if sums[-1] <= SETTLED * base[BASE + SAID + 1]:
            break
        before, model = model, odds_of(sums, base)
    return Model(*model, uncommon, repeated)


def fit(texts: list[str], seeds: Sequence[str] = tuple(SEEDS), rounds: int = ROUNDS) -> Model:
    """``train`` on a list of texts, here."""
    reader = Reader(seeds)
    x = lay([reader.read(t) for t in texts])
    return settle(base_counts(x), lambda *m: round_counts(x, *m), rounds)


def score_text(text: str | None, model: Model) -> float | None:
    """Log odds of the record's most suspicious passage; null for null and blank texts."""
    x = lay([Reader().read(text or "")])
    return float(scores(x, model)[0]) if len(x.sizes) else None


def scores(x: Laid, m: Model) -> np.ndarray:
    """Greatest log odds of each record's passages; not a number for records without any."""
    row = np.repeat(np.arange(len(x.sizes)), x.sizes)
    got = judged(x, row, shapes(x, row, m.uncommon, m.repeated), m.odds, m.prior)
    out = np.full(len(x.per), -np.inf)
    np.maximum.at(out, np.repeat(np.arange(len(x.per)), x.per), got)
    return np.where(x.per > 0, out, np.nan)


def eligible(c: Column | str) -> Column:
    """Neither null, blank nor one of the pipeline's own markers."""
    s = F.lower(py_strip(c))
    return F.coalesce((s != "") & ~s.isin(MARKERS), F.lit(False))


def lay_out(df: DataFrame, key: str, text: str, seeds: Sequence[str] = tuple(SEEDS)) -> DataFrame:
    """The passages of all eligible rows as numbers, with their keys: rows of many records each, packed."""
    kind = df.schema[key].dataType.simpleString()
    seeds = tuple(seeds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seeds)
        keys: list = []
        held: list = []
        n = 0
        schema = None

        def packed() -> pa.RecordBatch:
            cells = [pa.array([c], pa.binary()) for c in lay(held).pack()]
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(schema)), *cells], names=["keys", *"abcdefg"])

        for b in batches:
            schema = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys.append(k)
                held.append(reader.read(t))
                n += sum(len(x[0]) for x in held[-1])
                if n >= CHUNK:
                    yield packed()
                    keys, held, n = [], [], 0
        if keys:
            yield packed()

    base = df.filter(eligible(text)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return cut(busy(base, "k").mapInArrow(work, f"keys array<{kind}>, " + ", ".join(f"{c} binary" for c in "abcdefg")))


def add_up(laid: DataFrame, size: int, counts) -> np.ndarray:
    """Sum over all rows of ``counts(Laid)``, arrays of ``size`` whole numbers: a table a task, then one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, dtype=np.int64)
        for b in batches:
            for cells in zip(*(c.to_pylist() for c in b.columns)):
                sums += counts(Laid.unpack(cells))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["at", "n"])

    got = laid.select(*"abcdefg").mapInArrow(work, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(size, dtype=np.int64)
    sums[got["at"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return sums


def train(laid: DataFrame, rounds: int = ROUNDS) -> Model:
    """Model of all passages that ``lay_out`` gave, those that seeds mark being the certain ones."""
    sc = laid.sparkSession.sparkContext
    base = add_up(laid, BASE + SAID + 3, base_counts)
    tables = None

    def sums_of(uncommon, repeated, model, before):
        nonlocal tables
        tables = tables or sc.broadcast((uncommon, repeated))
        shared = sc.broadcast((model, before))
        sums = add_up(laid, DIM + (DIM - BASE) + 2, lambda x: round_counts(x, *tables.value, *shared.value))
        shared.destroy()
        return sums

    return settle(base, sums_of, rounds)


def score(df: DataFrame, key: str, text: str, seeds: Sequence[str] = tuple(SEEDS), rounds: int = ROUNDS) -> DataFrame:
    """``(key, score)`` of every eligible row; above 0 the record is residue. Others have no row.

    Repeated rows and keys give a row each; a null key stays null. Of texts of any length the whole is read.
    """
    laid = lay_out(df, key, text, seeds)
    shared = df.sparkSession.sparkContext.broadcast(train(laid, rounds))
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = Laid.unpack([b.column(1 + j)[i].as_py() for j in range(7)])
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(scores(x, shared.value), pa.float64(), from_pandas=True)], names=[key, "score"])

    return laid.mapInArrow(work, f"`{key}` {kind}, score double").filter("score IS NOT NULL")
