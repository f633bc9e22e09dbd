"""Text decoded with the wrong character encoding: finding it and giving back what was meant.

Damage leaves ASCII alone. So a garbled text and a clean near-twin agree once everything non-ASCII is
stripped, and their non-ASCII runs face each other: aligned runs vote for the transformation that turns
the clean run into the garbled one. Known charsets are tried first; where none explains a run, its characters
are aligned with the bytes of the clean one, and what they agree on is a charset of its own. Transformations with
enough votes are applied to all other records. A repair only counts if the characters it gives are ones that the
corpus uses.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import busy, cut, spread

# Charsets that texts are wrongly read in, and those that they are really in.
WRONG = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "iso8859-2", "iso8859-5", "iso8859-7", "koi8-r", "cp437", "cp850", "cp866", "mac_roman"]
MEANT = ["utf-8", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr"]
WIDE = ["shift_jis", "euc_jp", "gbk", "big5", "euc_kr"]
_CYRILLIC = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯабвгдежзийклмнопрстуфхцчшщъыьэюя"
LATIN = ["latin-1", "cp1252", "mac_roman", "cp437"]
#: A transformation needs so many votes of different text pairs, two at least: this share of all votes.
VOTES, VOTE_SHARE = 2, 1e-5
#: A character is the corpus's own if it is in so many different texts, three at least: this share of those not in ASCII.
KNOWN, KNOWN_SHARE = 3, 2e-6
_RUN = re.compile(r"[^\x00-\x7f]+")
_FOUR = re.compile(r"[^\x00-\x7f](?:[^\x00-\x7f]{3}|[^\n]{0,3}[^\x00-\x7f]){1,}")
_SHIFT = re.compile(r"\+([A-Za-z0-9+/]{3,})(-?)")
#: What makes a text worth a look: anything beyond ASCII, or a run that seven-bit transports write.
STRANGE = r"[^\x00-\x7f]|\+[A-Za-z0-9+/]{3}"
_LONG = re.compile(r"(?:[^\x00-\x7f]{1,3}\s+)*[^\x00-\x7f]{4,}(?:[\s,:;.\-–]+[^\x00-\x7f]+)*")
# Marks that may close a word after a small letter with an accent.
_CLOSERS = "‘’“”–—…«»"
_TABLES: dict[str, tuple[list[str], dict[str, int]]] = {}


def table_of(charset: str) -> tuple[list[str], dict[str, int]]:
    """Character of each byte and back; bytes that a charset leaves open stand for themselves, as lenient decoders do."""
    if charset not in _TABLES:
        chars = []
        for i in range(256):
            try:
                chars.append(bytes([i]).decode(charset))
            except UnicodeDecodeError:
                chars.append(chr(i))
        _TABLES[charset] = chars, {c: i for i, c in enumerate(chars)}
    return _TABLES[charset]


def misread(text: str, meant: str, wrong: str) -> str | None:
    """The text as it looks when bytes of ``meant`` are read as ``wrong``."""
    try:
        return "".join(map(table_of(wrong)[0].__getitem__, text.encode(meant)))
    except UnicodeEncodeError:
        return None


def to_bytes(run: str, wrong: str) -> bytes | None:
    back = table_of(wrong)[1]
    try:
        return bytes(back[c] for c in run)
    except KeyError:
        return None


def skeleton(c: Column) -> Column:
    """ASCII of a text with white space closed up; null when it has fewer than three letters."""
    s = F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7f]", ""), r"\s+", " "))
    return F.when(F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 3, s)


#: Name of the charset that is made of aligned characters only.
ALIGNED = "aligned"


def table_from(aligned: dict[int, str]) -> None:
    """Make the charset of aligned characters known; bytes never seen stand for characters that no text has."""
    chars = [chr(i) if i < 128 else aligned.get(i, chr(0xF0000 + i)) for i in range(256)]
    _TABLES[ALIGNED] = chars, {c: i for i, c in enumerate(chars)}


def votes(garbled: str, clean: str) -> set[tuple[str, str, int]]:
    """``(meant, wrong, times)`` that explain some aligned run of the pair; times 2 is the same mistake made twice.

    A run that none explains, but that has a character for each byte of the clean one, always the same for the same,
    votes for what it makes of each clean character: ``("?", clean, garbled with a blank between)``.
    """
    out: set[tuple[str, str, int]] = set()
    a, b = _RUN.findall(garbled), _RUN.findall(clean)
    if len(a) != len(b):
        return out
    for g, c in zip(a, b):
        if g == c or "\ufffd" in g or len(g) < len(c):
            continue
        before = len(out)
        for meant in MEANT:
            if meant != "utf-8" and len(g) < 4:
                continue
            for wrong in WRONG if meant == "utf-8" else LATIN:
                x = misread(c, meant, wrong) if wrong != meant else None
                if x == g:
                    out.add((meant, wrong, 1))
                elif x is not None and meant == "utf-8" and misread(x, meant, wrong) == g:
                    out.add((meant, wrong, 2))
        raw = c.encode("utf-8", "surrogatepass")
        if len(out) == before and len(raw) == len(g) and len(set(raw)) == len(set(g)) == len(set(zip(raw, g))):
            at = 0
            for x in c:
                n = len(x.encode("utf-8", "surrogatepass"))
                if all(misread(x, "utf-8", w) != g[at : at + n] for w in WRONG):
                    out.add(("?", f"{x} {g[at : at + n]}", 1))
                at += n
    return out


def aligned_table(said: list[tuple[int, str, str]], chars: dict[str, int]) -> dict[int, str]:
    """Character of each byte that ``(votes, clean, garbled)`` agree on, the most voted first.

    Of what a clean character becomes one form must have four votes in five, and a byte stands for one character only and
    the other way round. Characters of a wrong charset are seldom in text that was read well: where fewer than a tenth of
    the texts that have one (``chars``) vote for it, two texts merely differ. Fewer than three characters make no charset.
    """
    every, seen = Counter(), Counter()
    for n, clean, garbled in said:
        every[clean] += n
        seen.update({x: n for x in set(garbled)})
    said = [x for x in said if all(10 * seen[c] >= chars.get(c, 0) for c in x[2])]
    table: dict[int, str] = {}
    used = 0
    for n, clean, garbled in sorted(said, key=lambda x: (-x[0], x[1], x[2])):
        raw = clean.encode("utf-8", "surrogatepass")
        if n >= 0.8 * every[clean] and all(table.get(b, x) == x for b, x in zip(raw, garbled)):
            new = {b: x for b, x in zip(raw, garbled) if b not in table}
            if not set(new.values()) & set(table.values()):
                table |= new
                used += 1
    return table if used >= 3 else {}


def unshift(coded: str) -> str | None:
    """Characters that a run of the seven-bit transport stands for, or null."""
    try:
        raw = base64.b64decode(coded + "=" * (-len(coded) % 4), validate=True)
        return raw[: len(raw) // 2 * 2].decode("utf-16-be") if len(raw) > 1 and not any(raw[len(raw) // 2 * 2 :]) else None
    except (ValueError, UnicodeDecodeError):
        return None


def _chosen(run: tuple[str, str | None, bool]) -> str:
    return run[1] if run[2] and run[1] is not None else run[0]


def _decodes(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def _block(c: str) -> int:
    """Coarse block of a character: ideographs and Hangul syllables are one each."""
    n = ord(c)
    return 0x4E if 0x3400 <= n <= 0x9FFF else 0xAC if 0xAC00 <= n <= 0xD7A3 else n >> 8


def _hint(wrong: str) -> re.Pattern:
    """What any misread sequence of a charset must hold: a lead byte's character, in either case, and one of a byte that goes on."""
    chars = table_of(wrong)[0]
    lead = {c for b in range(0xC2, 0xF5) for c in (chars[b], chars[b].upper(), chars[b].lower()) if len(c) == 1}
    rest = {c for b in range(0x80, 0xC0) for c in (chars[b], chars[b].upper(), chars[b].lower()) if len(c) == 1}
    return re.compile(f"[{re.escape(''.join(sorted(lead)))}][{re.escape(''.join(sorted(rest)))}]")


def change_back(c: str, change) -> str:
    """A letter restored from a text that changed case takes the text's case."""
    back = {str.upper: str.lower, str.lower: str.upper}.get(change)
    return back(c) if back and len(back(c)) == 1 else c


@dataclass
class Model:
    """Learned transformations by votes, and the characters of the corpus by texts."""

    moves: list[tuple[str, str, int]]
    chars: dict[str, int]
    texts: int = 0
    aligned: dict[int, str] | None = None

    def args(self) -> tuple:
        """What makes the same model in a worker."""
        return self.moves, self.chars, self.texts, self.aligned

    def __post_init__(self) -> None:
        if self.aligned:
            table_from(self.aligned)
        self.least = max(KNOWN, math.ceil(KNOWN_SHARE * self.texts))
        self.known = {c for c, n in self.chars.items() if n >= self.least and not "\x80" <= c <= "\x9f" and c != "\ufffd"}
        self.blocks = {_block(c) for c in self.known}
        charsets = [w for m, w, _ in self.moves if m == "utf-8"]
        self.hints = {w: _hint(w) for w in charsets}
        self.hint = re.compile("|".join(h.pattern for h in self.hints.values())) if charsets else None
        starts = {c.encode()[:2] for c in self.known if 0x2000 <= ord(c) <= 0x206F}
        self.stubs = {s for w in charsets for b in starts if (s := "".join(table_of(w)[0][x] for x in b))[0] not in _CYRILLIC}
        self.memo: dict[str, tuple[bool, str]] = {}

    def repair(self, text: str) -> tuple[bool, str]:
        """Whether any part is damaged, and the text with all that can be restored restored."""
        if text.isascii() and "+" not in text:
            return False, text
        got = self.memo.get(text)
        if got is None:
            got = self._repair(text)
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[text] = got
        return got

    def _repair(self, text: str) -> tuple[bool, str]:
        bad = False
        for _ in range(4):  # a text may be damaged more than once
            new = self._sequences(self._shifted(text))
            if new == text and (new := self._legacy(text)) == text:
                break
            bad, text = True, new
        left = any(c == "\ufffd" or ("\x80" <= c <= "\x9f" and c != "\x85") for c in text) or any(self._broken(m[0]) for m in _RUN.finditer(text))
        return bad or left, text

    def _shifted(self, text: str) -> str:
        """Seven-bit transport of UTF-16 read as ASCII, where it gives characters of the corpus only."""
        if not any(m == "utf-7" for m, *_ in self.moves):
            return text

        def one(m: re.Match) -> str:
            got = unshift(m[1])
            return got if got and all(c in self.known and not c.isascii() for c in got) else m[0]

        return _SHIFT.sub(one, text)

    def _sequences(self, text: str) -> str:
        """UTF-8 read as the one charset that restores most of the text, commoner characters deciding ties."""
        best, most = text, (0, 0.0)
        if self.hint is None or not self.hint.search(text):
            return text
        for meant, wrong, _ in self.moves:
            if meant == "utf-8" and self.hints[wrong].search(text):
                took = [0, 0.0]

                def one(m: re.Match, wrong: str = wrong, took: list = took) -> str:
                    done, n, weight, sure, guessed = self._scan(m[0], wrong)
                    if n < 0.6 * len(m[0]) or sure < guessed:
                        return m[0]
                    took[0] += n
                    took[1] += weight
                    return done

                new = _RUN.sub(one, text)
                if (took[0], took[1]) > most:
                    best, most = new, (took[0], took[1])
        return best

    def _scan(self, run: str, wrong: str) -> tuple[str, int, float, int, int]:
        """The run with whole UTF-8 sequences put back, how many characters they took, how common the results are, and how many of them the corpus knows and only may know."""
        out, i, n, weight, sure, guessed = [], 0, 0, 0.0, 0, 0
        while i < len(run):
            got, k = self._sequence(run, i, wrong)
            if got is not None:
                out.append(got)
                i, n, weight = i + k, n + k, weight + math.log1p(self.chars.get(got, 0))
                if got in self.known or got in self.half:
                    sure += 1
                else:
                    guessed += 1
            else:
                out.append(run[i])
                i += 1
        return "".join(out), n, weight, sure, guessed

    def _sequence(self, run: str, i: int, wrong: str) -> tuple[str | None, int]:
        back = table_of(wrong)[1]
        # A text may have changed case after the damage; then letters stand for their other case.
        for change in (None, str.upper, str.lower):
            lead = change(run[i]) if change else run[i]
            if change and (lead == run[i] or len(lead) != 1):
                continue
            b = back.get(lead, 0)
            k = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            if not k or i + k > len(run):
                continue
            rest = run[i + 1 : i + k]
            if change is str.upper and any(c in _CLOSERS for c in rest):
                continue
            raw = to_bytes(lead + rest, wrong)
            if change and (raw is None or not _decodes(raw)):
                raw = to_bytes(lead + "".join(c if len(change(c)) != 1 else change(c) for c in rest), wrong)
            if raw is None or not _decodes(raw):
                continue
            got = raw.decode("utf-8")
            # What comes out may itself still be damaged, so half-restored characters count as well.
            if got in self.known or got in self.half or (k == 3 and _block(got) in self.blocks):
                return (change_back(got, change), k)
        return None, 0

    @property
    def half(self) -> set[str]:
        if not hasattr(self, "_half"):
            twice = [w for m, w, _ in self.moves if m == "utf-8"]
            self._half = {c for w in twice for c in table_of(w)[0][128:] if not "\x80" <= c <= "\x9f"} if any(t == 2 for *_, t in self.moves) else set()
        return self._half

    def _legacy(self, text: str) -> str:
        """Text of a charset other than UTF-8: the whole, or runs of four or more and the short ones beside them."""
        if not _FOUR.search(text):
            return text
        best, most = text, -1.0
        for meant, wrong, _ in self.moves:
            if meant in ("utf-8", "utf-7"):
                continue
            # Charsets of two bytes also use ASCII bytes, so there the whole is read if it looks foreign at all.
            new = None
            if meant in WIDE and sum(map(len, _RUN.findall(text))) >= max(4, 0.4 * len(text)):
                new = self._foreign(text, meant, wrong)

            def near(m: re.Match, meant: str = meant, wrong: str = wrong) -> str:
                """Long runs that decode, and the short words beside one: it convicts its neighbours."""
                runs = _RUN.findall(m[0])
                got = [self._foreign(r, meant, wrong) for r in runs]
                sure = [g is not None and len(r) >= 4 for r, g in zip(runs, got)]
                for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
                    step = -1 if order.step > 0 else 1
                    for i in order:
                        sure[i] = sure[i] or (sure[i + step] and got[i] is not None and len(runs[i]) < 4)
                left = iter(zip(runs, got, sure))
                return _RUN.sub(lambda _: _chosen(next(left)), m[0])

            new = new or _LONG.sub(near, text)
            # Several charsets may read a run as known characters; the one that gives the commonest is meant.
            if new != text and (mean := self._commonness(new)) > most:
                best, most = new, mean
        return best

    def _commonness(self, text: str) -> float:
        strange = [math.log1p(self.chars.get(c, 0)) for c in text if not c.isascii()]
        return sum(strange) / len(strange) if strange else 0.0

    def _foreign(self, text: str, meant: str, wrong: str) -> str | None:
        """The text under the charset meant, if that gives known characters of another script only."""
        raw = to_bytes(text, wrong)
        try:
            got = raw.decode(meant) if raw else ""
        except UnicodeDecodeError:
            return None
        new = [c for c in got if not c.isascii()]
        if not new or got == text or any(c not in self.known and _block(c) not in self.blocks for c in new):
            return None
        return got if sum(c.isalpha() and ord(c) > 0x36F for c in new) >= max(1, 0.7 * len(new)) else None

    def _broken(self, run: str) -> bool:
        """A run that begins a three-byte character of the corpus under some learned charset and then stops."""
        return run[:2] in self.stubs


def _read_as(text: str, meant: str, wrong: str) -> str | None:
    raw = to_bytes(text, wrong)
    try:
        got = raw.decode(meant) if raw else None
    except UnicodeDecodeError:
        return None
    return got if got != text else None


def learn(texts: DataFrame, text: str = "text") -> Model:
    """Model of a table of texts; it is as large as the corpus's alphabet.

    Each group of texts with one skeleton has one rival, the text with the fewest non-ASCII characters;
    every other text is aligned with it, so a group of n texts gives n - 1 pairs.
    """
    distinct = cut(texts.select(F.col(text).alias("t")).filter(is_strange(F.col("t"))).groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    each = F.array_distinct(F.split(F.regexp_replace("t", r"[\x00-\x7f]", ""), ""))
    chars = {r.c: r.n for r in distinct.select(F.explode(each).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect() if len(r.c) == 1}
    keyed = distinct.withColumn("k", skeleton(F.col("t"))).filter("k IS NOT NULL").withColumn("strange", F.length(F.regexp_replace("t", r"[\x00-\x7f]", "")))
    rank = F.struct("strange", F.col("t").contains("\ufffd").alias("lost"), (-F.col("n")).alias("n"), "t")
    rival = keyed.groupBy("k").agg(F.min_by("t", rank).alias("rival"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    pairs = keyed.join(rival, "k").filter("t <> rival").select("t", "rival")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter(v for g, c in zip(b["t"], b["rival"]) for v in votes(g, c))
            yield pd.DataFrame([(*k, x) for k, x in n.items()], columns=["meant", "wrong", "times", "n"])

    # Charsets that change a text's length leave no common alignment: there the twin is the text that the transformation gives.
    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, "utf-7", "ascii", x) for t in b["t"] if (x := _SHIFT.sub(lambda m: unshift(m[1]) or m[0], t)) != t]
            rows += [(t, m, w, x) for t in b["t"] for m in MEANT[1:] for w in LATIN if (x := _read_as(t, m, w)) is not None]
            yield pd.DataFrame(rows, columns=["t", "meant", "wrong", "twin"])

    legacy = distinct.filter(F.col("t").rlike(r"\+[A-Za-z0-9+/]{3}|[\x{80}-\x{ff}\x{152}-\x{17e}\x{192}\x{2013}-\x{203a}]{4,}") & ~F.col("t").rlike(r"[\x{400}-\x{1fff}\x{3000}-\x{d7ff}]")).select("t")
    exact = spread(legacy, "t").mapInPandas(guess, "t string, meant string, wrong string, twin string").join(distinct.select(F.col("t").alias("twin")), "twin", "left_semi")
    said = spread(pairs, "t").mapInPandas(work, "meant string, wrong string, times int, n bigint").unionAll(exact.select("meant", "wrong", F.lit(1).alias("times"), F.lit(1).cast("bigint").alias("n")))
    # As many rows as the catalogue has transformations, and characters of the alphabet with what twins made of them.
    got = said.groupBy("meant", "wrong", "times").agg(F.sum("n").alias("n")).filter((F.col("meant") != "?") | (F.col("n") >= VOTES)).collect()
    total, named = distinct.count(), [r for r in got if r.meant != "?"]
    least = max(VOTES, VOTE_SHARE * sum(r.n for r in named))
    moves = sorted((r for r in named if r.n >= least), key=lambda r: (-r.n, r.meant, r.wrong, r.times))
    moves = [(r.meant, r.wrong, r.times) for r in moves]
    aligned = aligned_table([(r.n, *r.wrong.split(" ", 1)) for r in got if r.meant == "?" and r.n >= least], chars)
    if aligned:
        moves.append(("utf-8", ALIGNED, 1))
    return Model(moves, chars, total, aligned)


def find_damage(df: DataFrame, key: str, fields: dict[str, Column], model: Model) -> DataFrame:
    """``(key, field_name, restored)`` of each row and field with damaged text; ``restored`` holds the repaired texts.

    ``fields`` maps a name to a column of the field's non-ASCII texts, an array; null and empty arrays
    have no damage.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model.args())
    names = list(fields)
    strange = df.select(key, *[c.alias(f) for f, c in fields.items()])
    strange = strange.filter(" OR ".join(f"size(`{f}`) > 0" for f in names))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for b in batches:
            rows = []
            for f in names:
                for k, texts in zip(b[key], b[f]):
                    if texts is None:
                        continue
                    got = [m.repair(t) for t in texts]
                    if any(x for x, _ in got):
                        rows.append((k, f, [y for _, y in got]))
            yield pd.DataFrame(rows, columns=[key, "field_name", "restored"])

    return busy(strange, key).mapInPandas(work, f"`{key}` {kind}, field_name string, restored array<string>")


def is_strange(c: Column) -> Column:
    """As the pattern STRANGE, which only runs over ASCII that holds a plus."""
    return (F.octet_length(c) > F.char_length(c)) | (c.contains("+") & c.rlike(STRANGE))


def strange_words(c: Column | str) -> Column:
    """The words of an inverted index that are not plain ASCII."""
    return F.filter(F.coalesce(F.map_keys(c), F.array().cast("array<string>")), is_strange)


def whole_index(c: Column | str) -> Column:
    """An inverted index as a number that does not depend on the order of its words."""
    return F.aggregate(F.map_entries(c), F.lit(0).cast("bigint"), lambda a, e: a.bitwiseXOR(F.xxhash64(e["key"], e["value"])))


def strange_text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(is_strange(c), F.array(c)).otherwise(F.array().cast("array<string>"))


def tokens_of(c: Column) -> Column:
    """Words of a text that hold a character beyond ASCII and at least two of ASCII."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]*(?:[^\x00-\x7f\s][A-Za-z0-9]*)+"), 0), lambda w: F.length(F.regexp_replace(w, r"[^\x00-\x7f]", "")) >= 2)


def find_lossy(df: DataFrame, key: str, fields: dict[str, Column], model: Model, whole: dict[str, Column] | None = None) -> DataFrame:
    """``(key, field_name, restored)`` where words lost invisible characters after they were wrongly decoded.

    Such a word can't be decoded any more. It is found as what a learned transformation makes of a common
    clean word once control characters and soft hyphens are gone, and at most a quarter as frequent, in rows or
    in different texts: copies of one damaged text weigh one. ``whole`` gives the texts of those fields whose
    column has only some of their words.
    """
    kind = df.schema[key].dataType.simpleString()
    moves = [w for m, w, t in model.moves if m == "utf-8" and t == 1 and w != ALIGNED]
    each = None
    for f, c in fields.items():
        own = F.xxhash64(F.lit(f), (whole or {}).get(f, c))
        one = df.filter(F.size(c) > 0).select(key, F.lit(f).alias("field_name"), own.alias("own"), F.explode(F.flatten(F.transform(c, tokens_of))).alias("word"))
        each = one if each is None else each.unionAll(one)
    each = cut(each)
    common = each.groupBy("word", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for word in b["meant"]:
                for wrong in moves:
                    full = misread(word, "utf-8", wrong)
                    left = re.sub("[\x80-\x9f\xad]", "", full) if full else word
                    if full and left != full and left != word and not left.isascii():
                        rows.add((left, word))
            yield pd.DataFrame(sorted(rows), columns=["word", "meant"])

    clean = common.filter(F.col("n") >= model.least).select(F.col("word").alias("meant"), F.col("n").alias("m"), F.col("texts").alias("clean_texts"))
    made = spread(clean.select("meant"), "meant").mapInPandas(forms, "word string, meant string").join(clean, "meant").join(common, "word")
    rare = made.filter((F.col("n") * 4 <= F.col("m")) | (F.col("texts") * 4 <= F.col("clean_texts"))).groupBy("word").agg(F.max_by("meant", F.struct("m", "meant")).alias("meant"))
    return each.join(rare, "word").groupBy(key, "field_name").agg(F.sort_array(F.collect_set("meant")).alias("restored")).select(F.col(key).cast(kind), "field_name", "restored")
