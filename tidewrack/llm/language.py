"""Language of texts and of the parts of mixed texts, by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A text is parsed greedily into the longest
phrases that the automaton has; phrases times the logarithm of the training length, over the text's length, estimate
the cross entropy. The language that needs the fewest bits wins. A text is cut in two where the parts win
in different languages, each by a clear margin, and each part likewise.

Labels are often false, so the training text is cleaned first: naive Bayes over letter triples, each text
left out of its own class, judges the labelled sample, and only texts whose label it confirms stay.
"""

from __future__ import annotations

import gc
import math
import re
import zlib
from collections.abc import Iterator
from operator import length_hint

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import py_strip
from ..session import cut, spread

#: Labelled texts that the fit sees of each language, taken by hash: the automata are as large on any corpus.
SAMPLE = 600
#: Characters of training text that a language's automaton holds at most.
MOST_CHARS = 48_000
#: Places of the table of letter triples that cleans the sample.
TRIPLES = 1 << 16
#: A part wins clearly if the other part's language needs so many times its bits.
MARGIN = 1.25
#: A language that needs so many times the best one's bits is set aside, to be parsed on if it may be second. Above MARGIN
#: this decides nothing but the order of work.
FAR = 1.3
#: Letters that a part must have, in alphabets of letters and in scripts where a sign says more.
LEAST_LATIN, LEAST_OTHER = 12, 5

# Language code, three-letter codes and English name.
NAMES = """
ar ara arabic
bg bul bulgarian
ca cat catalan
cs ces cze czech
cy cym wel welsh
da dan danish
de deu ger german
el ell gre greek
en eng english
es spa spanish
fa fas per persian
fi fin finnish
fr fra fre french
gl glg galician
he heb hebrew
hi hin hindi
hu hun hungarian
id ind indonesian
it ita italian
ja jpn japanese
ko kor korean
la lat latin
lo lao lao
mr mar marathi
ne nep nepali
nl nld dut dutch
no nor norwegian
pl pol polish
pt por portuguese
ro ron rum romanian
ru rus russian
sv swe swedish
sw swa swahili
th tha thai
tr tur turkish
uk ukr ukrainian
ur urd urdu
vi vie vietnamese
zh zho chi chinese
"""
# The other two-letter codes of languages.
OTHERS = """
aa ab ae af ak am an as av ay az ba be bi bm bn bo br bs ce ch co cr cu cv dv dz ee eo et eu ff fj fo fy ga gd gn gu gv ha ho hr ht hy hz
ia ie ig ii ik io is iu jv ka kg ki kj kk kl km kn kr ks ku kv kw ky lb lg li ln lt lu lv mg mh mi mk ml mn ms mt my na nd ng nr nv ny
oc oj om or os pa pi ps qu rm rn rw sa sc sd se sg si sk sl sm sn so sq sr ss st su ta te tg ti tk tl tn to ts tt tw ty ug uz ve vo wa wo xh yi yo za zu
"""
CODES = {w: line.split()[0] for line in NAMES.strip().splitlines() for w in line.split()} | {w: w for w in OTHERS.split()} | {"nb": "no", "nn": "no"}
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_SPLIT = re.compile(r"\s*[|/=;]\s+|\s[–—-]\s|\s*[\[(（]\s*|[.?!]\s+|[。？！]\s*|:\s+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ'’\-]+\.?")


def label_code(c: Column | str) -> Column:
    """Two-letter code that a label names, or null: codes and names in any case, with region or script tags."""
    low = F.lower(py_strip(c))
    table = F.create_map(*[F.lit(x) for kv in sorted(CODES.items()) for x in kv])
    return F.coalesce(F.element_at(table, low), F.element_at(table, F.regexp_extract(low, r"^([a-z]{2,3})[-_ ]", 1)))


def plain(text: str) -> str:
    """Lower case without tags, digits as 0, white space closed up."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", _TAG.sub("", text))).strip().lower()


class Automaton:
    """Suffix automaton of a text, its transitions in one table."""

    def __init__(self, text: str):
        link, length, step = [-1], [0], [{}]
        last = 0
        for ch in text:
            c = ch
            cur = len(link)
            link.append(0), length.append(length[last] + 1), step.append({})
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(link)
                    link.append(link[q]), length.append(length[p] + 1), step.append(dict(step[q]))
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        # A state is the table of its transitions, so a step is one look-up.
        nodes: list[dict] = [{} for _ in step]
        for node, d in zip(nodes, step):
            for c, t in d.items():
                node[c] = nodes[t]
        self.root = nodes[0]
        self.bits = math.log2(len(text) + 2)
        self.chars = set(text)

    def parse(self, text: str, limit: float, state: tuple | None = None) -> tuple[int, tuple | None]:
        """Phrases of the greedy parse, an unknown character being one; stops once there are more than ``limit``.

        Beside the count comes where it stopped, to go on from there, or null at the end of the text.
        """
        root = self.root
        at, node, count = state or (0, root, 0)
        left = iter(text[at:] if at else text)
        for ch in left:
            to = node.get(ch)
            if to is None:
                if node is not root:
                    to = root.get(ch)
                count += 1
                node = root if to is None else to
                if count > limit:
                    return count, (len(text) - length_hint(left), node, count)
            else:
                if node is root:
                    count += 1
                node = to
        return count, None

    def phrases(self, text: str, limit: float) -> int:
        return self.parse(text, limit)[0]


class Judge:
    """Languages by their automata."""

    def __init__(self, texts: dict[str, list[str]]):
        self.last = ""
        self.by = {lang: Automaton("\n".join(t)[:MOST_CHARS]) for lang, t in sorted(texts.items()) if t}

    def rank(self, text: str) -> list[tuple[float, str, tuple | None]]:
        """``(bits a character, language, rest)``, best first; where a rest is left to parse the bits are a bound from below."""
        text = essence(text)
        if not text or not self.by:
            return []
        letters = {c for c in set(text) if c.isalpha()}
        able = [a for a in self.by if len(letters & self.by[a].chars) >= 0.7 * len(letters)] or list(self.by)
        # The last winner is tried first: what falls far behind it is not parsed to the end.
        best, out = math.inf, []
        for lang in sorted(able, key=lambda x: x != self.last):
            a = self.by[lang]
            count, rest = a.parse(text, FAR * best / a.bits)
            bits = count * a.bits
            best = min(best, bits)
            out.append((bits / len(text), lang, rest))
        out.sort(key=lambda x: x[:2])
        self.last = out[0][1]
        return out

    def confidence(self, text: str, ranked: list[tuple[float, str, tuple | None]]) -> float:
        """How far the winner is ahead of the second, from 0 to 1; 1 with no second.

        The second is parsed to its end: which languages were broken off, and where, depends on the order of trial.
        """
        if len(ranked) < 2:
            return 1.0
        text, second = essence(text), math.inf
        # Those that got furthest are likeliest to be second; the others then soon need more.
        for bits, lang, rest in sorted(ranked[1:], key=lambda x: -x[2][0] if x[2] else -math.inf):
            if rest:
                a = self.by[lang]
                bits = a.parse(text, second / a.bits, rest)[0] * a.bits
            else:
                bits *= len(text)
            second = min(second, bits)
        return round(1 - ranked[0][0] * len(text) / second, 4) if second else 0.0

    def holds(self, text: str, lang: str) -> bool:
        """Whether no language needs fewer bits than this one for the text."""
        text = essence(text)
        letters = {c for c in set(text) if c.isalpha()}
        if not text or len(letters & self.by[lang].chars) < 0.7 * len(letters):
            return False
        own = self.by[lang].phrases(text, math.inf) * self.by[lang].bits
        return all(a.phrases(text, own / a.bits) * a.bits >= own for x, a in self.by.items() if x != lang)

    def parts(self, text: str) -> list[tuple[int, int, str, float]]:
        """``(start, end, language, confidence)`` of each stretch in one language, in order."""
        if text.count("\ufffd") > sum(map(str.isalpha, text)):
            return []  # too little is left to tell
        one = self.rank(plain(text))
        return [(a, b, ranked[0][1], self.confidence(x, ranked)) for a, b, x, ranked in self.split(text, 0, one)] if one else []

    def split(self, text: str, at: int, one: list) -> list[tuple[int, int, str, list]]:
        """``(start, end, plain text, ranks)`` of a text's stretches: cut in two where that is best, then each side likewise."""
        best = None
        for m in _SPLIT.finditer(text):
            left, right = text[: m.start()], text[m.end() :]
            if not (enough(left) and enough(right)):
                continue
            x, y = plain(left), plain(right)
            if self.holds(x, one[0][1]) and self.holds(y, one[0][1]):
                continue
            a, b = self.rank(x), self.rank(y)
            if not a or not b or a[0][1] == b[0][1]:
                continue
            sure = min(other(a, b[0][1]) / a[0][0], other(b, a[0][1]) / b[0][0])
            total = a[0][0] * len(left) + b[0][0] * len(right)
            if sure >= MARGIN and (best is None or total < best[0]):
                best = total, (left, at, a), (right, at + m.end(), b)
        if not best:
            return [(at, at + len(text), plain(text), one)]
        out = [x for side in best[1:] for x in self.split(*side)]
        # Stretches of one language that a finer cut has put side by side are one.
        joined = [out[0]]
        for x in out[1:]:
            last = joined[-1]
            if x[3][0][1] == last[3][0][1]:
                whole = plain(text[last[0] - at : x[1] - at])
                joined[-1] = (last[0], x[1], whole, self.rank(whole))
            else:
                joined.append(x)
        return joined


def other(ranked: list[tuple[float, str, tuple | None]], lang: str) -> float:
    """Bits of a language, or twice the worst ranked one if it was left out."""
    return next((b for b, x, _ in ranked if x == lang), 2 * ranked[-1][0])


def essence(text: str) -> str:
    """The text without Latin words when another script carries it: names of species and places in it count for nothing."""
    others = 0 if text.isascii() else sum(c.isalpha() and ord(c) > 0x24F for c in text)
    if others >= 3 and others >= 0.15 * sum(map(str.isalpha, text)):
        return re.sub(r"\s+", " ", _LATIN.sub("", text)).strip()
    return text


def enough(text: str) -> bool:
    if text.isascii():
        return sum(map(str.isalpha, text)) >= LEAST_LATIN
    letters = [c for c in text if c.isalpha()]
    others = sum(ord(c) > 0x24F for c in letters)
    return others >= LEAST_OTHER or len(letters) - others >= LEAST_LATIN


def purify(sample: list[tuple[str, str]], total: dict[str, int], rounds: int = 3) -> dict[str, list[str]]:
    """Texts by language whose label naive Bayes over letter triples confirms, refitted on what stays.

    ``total`` has each label's count over all rows, for the priors. A language of which less than a third is
    confirmed is dropped: its labels are errors.
    """
    codes = sorted({c for _, c in sample})
    if not codes:
        return {}
    texts = [plain(t) for t, _ in sample]
    own = np.array([codes.index(c) for _, c in sample])
    feats = [triples(t) for t in texts]
    row, col = np.repeat(np.arange(len(texts)), [len(f) for f in feats]), np.concatenate(feats)
    keep = np.ones(len(texts), dtype=bool)
    prior = np.log([total.get(c, 1) for c in codes])
    for _ in range(rounds):
        on = keep[row]
        counts = np.zeros((len(codes), TRIPLES))
        np.add.at(counts, (own[row[on]], col[on]), 1)
        sizes = counts.sum(axis=1)
        score = np.zeros((len(texts), len(codes)))
        for k in range(len(codes)):
            mine = ((own == k) & keep)[row]
            n = np.where(mine, sizes[k] - np.bincount(row, minlength=len(texts))[row], sizes[k])
            score[:, k] = np.bincount(row, weights=np.log((counts[k, col] - mine + 0.05) / (n + 0.05 * TRIPLES)), minlength=len(texts)) + prior[k]
        new = score.argmax(axis=1) == own
        for k in range(len(codes)):
            if 3 * (new & (own == k)).sum() < (own == k).sum():
                new &= own != k
        if (new == keep).all():
            break
        keep = new
    odds = np.log((counts + 0.05) / (sizes + 0.05 * TRIPLES)[:, None])
    out: dict[str, list[str]] = {}
    for i in np.flatnonzero(keep):
        # A text that joins two languages would teach its label the other one.
        sides = [x for m in _SPLIT.finditer(texts[i]) for x in (texts[i][: m.start()], texts[i][m.end() :]) if enough(x)]
        if all((odds[:, triples(x)].sum(axis=1) + prior).argmax() == own[i] for x in sides):
            out.setdefault(codes[own[i]], []).append(texts[i])
    return out


def triples(text: str) -> np.ndarray:
    """Places of the different letter triples of a text."""
    return np.unique(np.fromiter((zlib.crc32(text[i : i + 3].encode()) % TRIPLES for i in range(max(1, len(text) - 2))), dtype=np.int64))


def train(texts: DataFrame, text: str, label: str) -> dict[str, list[str]]:
    """Clean training text by language from rows with a text and a label, most of them right."""
    named = texts.select(F.col(text).alias("t"), label_code(label).alias("code")).filter("code IS NOT NULL").filter(py_strip("t") != "")
    most = cut(named.groupBy("t", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("t").agg(F.max_by("code", F.struct("n", "code")).alias("code")))
    w = W.partitionBy("code").orderBy(F.xxhash64("t"), "t")
    rows = most.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SAMPLE).select("t", "code", "r").collect()
    total = {r.code: r.n for r in most.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    return purify([(r.t, r.code) for r in sorted(rows, key=lambda r: (r.code, r.r))], total)


PARTS = "array<struct<start:int,end:int,lang:string,confidence:double>>"


def judge_texts(texts: DataFrame, text: str, model: dict[str, list[str]], mend=None) -> DataFrame:
    """``(text, parts)`` of every distinct text that is not null or blank.

    ``mend`` makes a function, in the worker, that restores a damaged text before it is judged; positions
    are then those of the restored text. Each part has its language and a confidence.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    distinct = texts.select(F.col(text).alias("text")).filter(py_strip("text") != "").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # hundreds of thousands of small tables that stay: nothing to collect among them
        judge, fix = Judge(shared.value), mend() if mend else None
        gc.freeze()
        gc.enable()
        for b in batches:
            texts = b.column(0)
            got = [judge.parts(fix(t) if fix else t) for t in texts.to_pylist()]
            ends = np.zeros(len(got) + 1, dtype=np.int32)
            np.cumsum([len(g) for g in got], out=ends[1:])
            flat = [p for g in got for p in g]
            kinds = [("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]
            parts = pa.StructArray.from_arrays([pa.array([p[i] for p in flat], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])
            yield pa.RecordBatch.from_arrays([texts, pa.ListArray.from_arrays(pa.array(ends), parts)], names=["text", "parts"])

    return spread(distinct, "text").mapInArrow(work, f"text string, parts {PARTS}")
