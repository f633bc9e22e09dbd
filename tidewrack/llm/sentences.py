"""Sentences of documents in all scripts, by semi-Markov dynamic programming over whole spans.

A document is laid out into blocks at blank lines. Headings, list items and tagged lines are one unit each.
In running text every place that may end a sentence is a candidate, and the best division into spans is
chosen: a span scores by its length, by how often its first word opens and its last word closes a
sentence, and by whether its quotation marks and brackets balance.

How words open and close is learned from the corpus without labels: the ends of paragraphs are certain,
so an abbreviation shows by never standing there. The counts are then refined by dividing the corpus
and counting again. They cover all documents and are kept in tables of DIM hashed places.

A document's text is read once: blocks, candidates and the places of their words are laid out as numbers, and
the rounds of counting as well as the division itself run over these.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import busy, cut

DIM = 1 << 20
#: Rounds of dividing the corpus and counting again.
ROUNDS = 2
#: Characters of text in a stored row, about.
CHUNK = 1 << 19
#: Share of sentence ends that are paragraph ends, before anything is counted.
BASE = 0.2

# Characters that end sentences, that close after them, that open, and the pairs that balance.
WIDE = "。！？｡．"
STOPS = ".!?…؟।॥" + WIDE
CLOSERS = "\"'”’»›)]}）】」』〉》"
OPENERS = "\"'“‘«‹([{（【「『〈《¿¡„—–-"
PAIRS = {"“": "”", "«": "»", "„": "“", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "《": "》", "【": "】", "‹": "›"}
_CLOSING = CLOSERS + "“"
_PAIRED = set(PAIRS) | set(PAIRS.values())

_EOL = re.compile("(?>\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])")
_BLANK = re.compile(f"{_EOL.pattern}(?:[^\\S\r\n\x0b\x0c\x85\u2028\u2029]*{_EOL.pattern})+")
_STOP = re.compile(f"[{re.escape(STOPS)}]+[{re.escape(CLOSERS)}]*")
# Where „ opens, “ closes.
_STOP_LOW = re.compile(f"[{re.escape(STOPS)}]+[{re.escape(CLOSERS)}“]*")
_ITEM = re.compile(r"\s*(?:[-–—•*·‣◦●▪]|\d{1,3}[.)]|[a-z]\)|\(\w{1,3}\))\s+\S")
_MARK = re.compile(r"\s*(?:[-–—•*·‣◦●▪]|(\d{1,3})[.)]|[a-z]\)|\(\w{1,3}\))\s")
_TAG = re.compile(r"\s*\[(TITLE|VENUE|KEYWORDS|FIELD|ABSTRACT)\]", re.I)
_NUMBERED = re.compile(r"\s*\d+(?:\.\d+)+\.?\s+\S")
# A capital before small letters, not inside a word.
_CAPITAL = re.compile("(?<![A-Za-z0-9])[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽА-ЯЁ](?=[a-zà-öø-ÿа-яё’'])")
_DIGITS = re.compile(r"\d+").sub
_BIG, _SMALL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_UPPER, _LOWER = regex.compile(r"\p{Lu}+").findall, regex.compile(r"\p{Ll}+").findall
_AFTER = re.compile(r"[.!?](?<=[^\W\d_][^\W\d_][.!?])[”»)]?\s+[“«(¿¡]?([^\W\d_])").findall
_BEYOND = re.compile(r"[^\x00-\x7f]+").findall
_MARKS = re.compile(f'["{re.escape("".join(sorted(_PAIRED)))}]').findall
_THAI = re.compile("[฀-๿]")
_NARROW = re.compile("[぀-ヿ㐀-鿿]")
END, OPEN = 1, 2


def trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[a].isspace() or (text[a] == "﻿" and not text[:a].strip("﻿ \t\r\n　\xa0"))):
        a += 1
    while a < b and (text[b - 1].isspace() or (text[b - 1] == "﻿" and not text[b:].strip("﻿ \t\r\n　\xa0"))):
        b -= 1
    return a, b


class Norms(dict):
    """Words as they are counted: in small letters, numbers as 0."""

    def __missing__(self, word: str) -> str:
        low = word.lower()
        if len(self) > 500_000:
            self.clear()
        got = self[word] = low if low.isalpha() else _DIGITS("0", low)
        return got


_NORMS = Norms()


def norm(word: str) -> str:
    return _NORMS[word]


def place(kind: int, word: str) -> int:
    return zlib.crc32(f"{kind}{word}".encode()) % DIM


def closing(text: str, a: int, b: int) -> str:
    """The last word before ``b``, with its stop; the last characters in scripts without spaces."""
    words = text[max(a, b - 40) : b].rsplit(None, 2)
    w = words[-1] if words else ""
    core = w.rstrip(CLOSERS)
    if not core.isascii() and (_THAI.search(core) or _NARROW.search(core)):
        return norm(w[-4:])
    word = norm(w[-16:].lstrip("(["))
    if word[:1] == "0" and len(words) > 1 and word.rstrip(CLOSERS) in ("0.", "0"):
        # A number alone may be a figure's or a day's: the word before it tells.
        return f"{norm(words[-2][-12:])} {word}"
    return word


def opening(text: str, a: int, b: int, flat: bool) -> str:
    """The first word after ``a`` without opening marks, ``^`` before a capital; the first characters in scripts without spaces.

    In text where capitals say nothing both forms count, marked ``~``.
    """
    s = text[a : min(b, a + 40)].lstrip().lstrip(OPENERS).split(None, 1)
    w = s[0] if s else ""
    if w[:1] >= "\u0e00":
        if _THAI.match(w):
            return w[:5]
        if _NARROW.match(w):
            return w[:2]
    word = norm(w[:16].rstrip(".,;:!?…”»\"'"))
    return ("~" if flat else "^" if w[:1].isupper() else "") + word


@dataclass(slots=True)
class Cut:
    """A place that may end a sentence: the text before ``at`` ends there, the next begins at ``to``."""

    at: int
    to: int
    bias: float
    end: str = ""
    open: str = ""


@dataclass
class Block:
    start: int
    end: int
    whole: bool
    breaks: bool = False  # its line ends may end sentences


def lines_of(text: str, a: int, b: int) -> list[tuple[int, int]]:
    out, at = [], a
    for m in _EOL.finditer(text, a, b):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, b))
    return [(x, y) for x, y in out if text[x:y].strip("﻿ \t　\xa0")]


def wrapped(text: str, lines: list[tuple[int, int]], soft: bool = False) -> bool:
    """Whether the lines are those of text broken at a fixed width: no next word would have fitted.

    In scripts without spaces the lines but the last must be about equally long. ``soft`` says that the
    document as a whole is broken so; then lines of less than that width are enough.
    """
    if len(lines) < 2:
        return False
    width = max(y - x for x, y in lines)
    if not 50 <= width <= 120:
        return False
    if soft:
        return True
    for (x, y), (p, q) in zip(lines, lines[1:]):
        if ends_with_stop(text[x:y]):
            continue  # a new line after a sentence tells nothing
        if _NARROW.search(text, p, q) or _THAI.search(text, p, q):
            if y - x < 0.9 * width:
                return False
            continue
        first = text[p:q].split()[0] if text[p:q].split() else ""
        if y - x + 1 + len(first) <= width:
            return False
    return True


def broken_at_width(text: str, spans: list[tuple[int, int]]) -> bool | None:
    """Whether most inner lines of a document nearly reach one common width and end in mid-sentence; null when lines begin like sentences."""
    inner, heads = [], []
    for a, b in spans:
        lines = [(x, y) for x, y in lines_of(text, a, b) if not _ITEM.match(text, x, y) and not _TAG.match(text, x, y)]
        inner += lines[:-1]
        heads += [text[x:y].lstrip().lstrip(OPENERS)[:1] for x, y in lines[1:]]
    cased = [c for c in heads if c.isupper() or c.islower()]
    if len(cased) >= 2 and sum(c.isupper() for c in cased) >= 0.7 * len(cased) and not is_flat(text):
        return None  # lines begin as sentences do
    if len(inner) < 3:
        return False
    width = sorted(y - x for x, y in inner)[int(0.9 * (len(inner) - 1))]
    full = sum(y - x >= 0.7 * width for x, y in inner)
    stops = sum(ends_with_stop(text[x:y]) for x, y in inner)
    return 40 <= width <= 110 and full >= 0.85 * len(inner) and stops < 0.6 * len(inner)


def ends_with_stop(s: str) -> bool:
    s = s.rstrip().rstrip(CLOSERS)
    return bool(s) and s[-1] in STOPS


def layout(text: str) -> list[Block]:
    """Blocks between blank lines; units of one sentence are whole."""
    spans, at = [], 0
    for m in _BLANK.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    out: list[Block] = []
    soft = broken_at_width(text, spans)
    for a, b in spans:
        a, b = trim(text, a, b)
        if a >= b:
            continue
        lines = lines_of(text, a, b)
        run: list[tuple[int, int]] = []

        def flush(run: list[tuple[int, int]]) -> None:
            if not run:
                return
            x, y = run[0][0], run[-1][1]
            s = text[x:y]
            even = soft is not None and wrapped(text, run, soft)
            alone = len(run) == len(lines) and (len(run) == 1 or (even and not out and len(run) <= 3))
            head = alone and not ends_with_stop(s) and (x == a and (not out or len(s) <= 60 or _NUMBERED.match(s)))
            # The title of a document is one unit even with a stop inside.
            whole = head and not _THAI.search(s) or (head and len(s) <= 40)
            out.append(Block(x, y, whole, len(run) > 1 and not even))
            run.clear()

        listed = is_list(text, lines)
        tagged = any(_TAG.match(text, x, y) for x, y in lines)
        for i, (x, y) in enumerate(lines):
            tag = _TAG.match(text, x, y)
            if listed and _ITEM.match(text, x, y):
                flush(run)
                out.append(Block(x, y, True))
            elif tag and tag[1].upper() != "ABSTRACT":
                flush(run)
                out.append(Block(x, y, True))
            elif tagged and not tag and out and out[-1].whole and not run and i and wrapped(text, lines[i - 1 : i + 1]) and y - x < 100 and out[-1].end - out[-1].start > 50:
                out[-1].end = y  # a tagged line that was broken
            else:
                if tag:
                    flush(run)
                run.append((x, y))
        flush(run)
    return out


def is_list(text: str, lines: list[tuple[int, int]]) -> bool:
    """Whether the lines with marks are list items: bullets, or numbers that count on."""
    marks = [m for x, y in lines if _ITEM.match(text, x, y) and (m := _MARK.match(text, x, y))]
    if not marks:
        return False
    numbers = [int(m[1]) for m in marks if m[1]]
    if numbers and numbers != list(range(numbers[0], numbers[0] + len(numbers))):
        return False
    if numbers and len(numbers) == 1 and not (len(lines) == 1 and len(text[lines[0][0] : lines[0][1]]) <= 80 and not ends_with_stop(text[lines[0][0] : lines[0][1]])):
        return False
    return 2 * len(marks) >= len(lines) or len(marks) >= 2


def candidates(text: str, block: Block, flat: bool) -> list[Cut]:
    """Places in a running block where a sentence may end, with what their surroundings say before any count."""
    a, b = block.start, block.end
    out: list[Cut] = []
    for m in (_STOP_LOW if "„" in text[a:b] else _STOP).finditer(text, a, b):
        at = m.end()
        if at >= b:
            break
        stop, after = m[0], text[at]
        bare = stop if len(stop) == 1 else stop.rstrip(_CLOSING)
        if not bare:
            continue
        wide = bare[-1] in WIDE
        bias = 0.0
        if not after.isspace():
            before = text[m.start() - 1] if m.start() > a else ""
            if wide:
                pass
            elif bare[-1] in ".!?…" and glued(text, m.start(), at, b) and not re.search(r"[/_@]", _last_word(text, a, at)):
                bias -= 0.5
            else:
                continue
        to = at
        while to < b and text[to].isspace():
            to += 1
        if to >= b:
            break
        nxt = text[to : min(b, to + 12)].split(None, 1)[0]
        if not nxt[0].isalnum():
            nxt = first_letters(text, to, b)
        lead = text[to]
        if bare != ".":
            if bare[-1] in "!?؟" or wide:
                bias += 2.0
            if bare[-1] in "।॥":
                bias += 3.0
        if len(bare) > 1 and bare.strip(".") == "" or bare[-1] == "…":
            bias -= 3.0 if m.start() > a and text[m.start() - 1].isspace() else 0.5
        if lead.isalnum():
            pass
        elif lead in ",;:)]}”»/|" or lead in "—–-" and not (to + 1 < b and text[to + 1].isalnum()):
            bias -= 5.0
        if nxt.islower() and not flat and lead not in "“«„「『‘":
            bias -= 4.0
        elif nxt[:1].isupper() and not flat:
            bias += 0.7
        if lead in "“«„「『‘¿¡(" and stop[-1] not in "”»」』":
            bias += 0.7
        if stop[-1] in "”»」』“":
            bias -= 0.7
        if block.breaks and _EOL.search(text, at, to):
            bias += 2.0
        out.append(Cut(at, to, bias))
    taken = {c.at for c in out}
    if block.breaks:
        for m in _EOL.finditer(text, a, b):
            at, to = m.start(), m.end()
            while at > a and text[at - 1].isspace():
                at -= 1
            while to < b and text[to].isspace():
                to += 1
            if at in taken or at <= a or to >= b:
                continue
            if flat or not first_letters(text, to, b).islower():
                out.append(Cut(at, to, 1.5, "line"))
            taken.add(at)
    if _THAI.search(text, a, b):
        for m in re.finditer(r"(?<=[฀-๿”»\d%)A-Za-z.])\s+(?=[“฀-๿])", text[a:b]):
            at, to = a + m.start(), a + m.end()
            if at in taken or not (_THAI.match(text[at - 1]) or _THAI.match(text[to])):
                continue
            # Numbers, foreign words and quotations stand between spaces inside a sentence.
            out.append(Cut(at, to, -0.3 if _THAI.match(text[at - 1]) and _THAI.match(text[to]) else -1.0))
            taken.add(at)
    out.sort(key=lambda c: c.at)
    start = a
    for c in out:
        # Words at line ends without a stop are counted apart.
        c.end, c.open = closing(text, start, c.at) + c.end, opening(text, c.to, b, flat)
    return out


def glued(text: str, stop: int, at: int, b: int) -> bool:
    """A stop after a word or number with the next sentence's capital right behind it."""
    before = text[max(0, stop - 2) : stop]
    word = before[-1:].islower() or before[-1:] in ")”" or before[-1:].isdigit() or (len(before) == 2 and before[0].islower())
    return word and text[at].isupper() and at + 1 < b and text[at + 1].islower()


def first_letters(text: str, a: int, b: int) -> str:
    """The first word's beginning without opening marks: all in small letters it begins no sentence."""
    s = text[a : min(b, a + 12)].lstrip(OPENERS).split(None, 1)
    return s[0] if s else ""


def _last_word(text: str, a: int, at: int) -> str:
    s = text[max(a, at - 60) : at].split()
    return s[-1] if s else ""


def cases(text: str) -> tuple[int, int]:
    """Numbers of capital and small letters."""
    raw = text.encode("utf-8", "surrogatepass")
    up, low = len(raw) - len(raw.translate(None, _BIG)), len(raw) - len(raw.translate(None, _SMALL))
    if len(raw) > len(text):
        rest = "".join(_BEYOND(text))
        up, low = up + sum(map(len, _UPPER(rest))), low + sum(map(len, _LOWER(rest)))
    return up, low


def is_flat(text: str) -> bool:
    """Whether capitals say nothing: no word or hardly a sentence begins with one, or most letters are capitals."""
    up, low = cases(text)
    if up >= 1.5 * low or up < 0.004 * (up + low) or not _CAPITAL.search(text):
        return True
    after = _AFTER(text)
    return len(after) >= 3 and sum(c.islower() for c in after) >= 0.7 * len(after)


def flat_block(text: str, block: Block) -> bool:
    """As ``is_flat`` for one block that is long enough to tell: a document may join two texts."""
    return block.end - block.start >= 60 and is_flat(text[block.start : block.end])


class Table:
    """Counts of words at sentence ends and starts against all their candidates, as hashed tables."""

    def __init__(self, yes: np.ndarray | None = None, all_: np.ndarray | None = None, base: float = BASE):
        self.yes, self.all, self.base = yes, all_, base

    def odds(self, p: np.ndarray, prior: np.ndarray | float) -> np.ndarray:
        """Log odds that a boundary is at candidates with words of these places, little-seen words leaning to the prior."""
        y, n = (self.yes[p] / self.base, self.all[p]) if self.all is not None else (0.0, 0.0)
        share = np.clip((y + 3 * prior) / (n + 3), 0.015, 0.985)
        return np.log(share / (1 - share))


def shape_prior(word: str) -> float:
    """How likely a word with this look ends a sentence, before any count."""
    core = word.rstrip(CLOSERS)
    if core and core[-1] not in STOPS:
        return 0.5
    bare = core.rstrip(STOPS)
    if core[-1:] == ".":
        if len(bare.lstrip("(")) <= 1 and not bare.isdigit():
            return 0.04
        if "." in bare:
            return 0.3
        return 0.5 if len(bare) <= 3 else 0.9
    return 0.85


@dataclass
class Laid:
    """Documents as numbers: blocks, candidates and the marks between them; all that any later pass needs.

    ``blocks`` has start, end, number of candidates (-1 for a unit that is one sentence) and of marks, ``ends`` the places of a
    running block's last and first word, ``cuts`` at, to and the places of the last word, of the first, and of its
    bare and capital form where capitals say nothing (else -1). ``marks`` has the marks of each piece, a line each.
    """

    per: np.ndarray
    blocks: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray
    bias: np.ndarray
    prior: np.ndarray
    marks: list[str]

    def pack(self) -> list[bytes]:
        parts = [x.astype(k).tobytes() for x, k in zip((self.per, self.blocks, self.ends, self.cuts, self.bias, self.prior), ("<i4", "<i4", "<i4", "<i4", "<f8", "<f8"))]
        return [zlib.compress(x, 1) for x in [*parts, "\n".join(self.marks).encode()]]

    @classmethod
    def unpack(cls, cells: list[bytes]) -> "Laid":
        raw = [zlib.decompress(c) for c in cells]
        whole = lambda i, k: np.frombuffer(raw[i], dtype="<i4").reshape(-1, k)
        per = np.frombuffer(raw[0], dtype="<i4")
        return cls(per, whole(1, 4), whole(2, 2), whole(3, 6), np.frombuffer(raw[4], dtype="<f8"), np.frombuffer(raw[5], dtype="<f8"), raw[6].decode().split("\n"))

    @property
    def owner(self) -> np.ndarray:
        """The block of each candidate."""
        return np.repeat(np.arange(len(self.blocks)), np.maximum(self.blocks[:, 2], 0))

    def scores(self, table: Table) -> np.ndarray:
        """What each candidate adds to a division that uses it."""
        end, first, bare, capital = self.cuts[:, 2:].T
        opens = table.odds(first, 0.5)
        flat = bare >= 0
        # Small and capital form together, and what flat text itself shows.
        opens = np.where(flat, (table.odds(bare, 0.5) + table.odds(capital, 0.5) + 2 * opens) / 2, opens)
        return self.bias + table.odds(end, self.prior) + opens


def counted(word: str) -> str:
    return word.replace("~", "=", 1) if word[:1] == "~" else word


class Words(dict):
    """Places of words met before: of a kind and a word, and for last words what their look says as well."""

    def __missing__(self, key: tuple[int, str]) -> tuple:
        kind, word = key
        if kind == END:
            got = place(END, word), shape_prior(word)
        elif word[:1] == "~":
            got = place(OPEN, counted(word)), place(OPEN, word[1:]), place(OPEN, "^" + word[1:])
        else:
            got = place(OPEN, word), -1, -1
        if len(self) > 500_000:
            self.clear()
        self[key] = got
        return got


_WORDS = Words()


def lay(texts: list[str | None]) -> Laid:
    """Null, empty and blank texts have no blocks."""
    per, blocks, ends, cuts, bias, prior, marks = [], [], [], [], [], [], []
    words = _WORDS
    for text in texts:
        before = len(blocks)
        if text and text.strip("﻿ \t\r\n"):
            flat = is_flat(text)
            for block in layout(text):
                a, b = trim(text, block.start, block.end)
                if block.whole:
                    blocks.append((a, b, -1, 0))
                    continue
                low = flat or flat_block(text, block)
                found = candidates(text, block, low)
                ends.append((words[END, closing(text, a, b)][0], words[OPEN, opening(text, a, b, low)][0]))
                at = block.start
                held = _MARKS(text, at, block.end)
                for c in found:
                    end, look = words[END, c.end]
                    cuts.append((c.at, c.to, end, *words[OPEN, c.open]))
                    bias.append(c.bias)
                    prior.append(look)
                    marks.append("".join(_MARKS(text, at, c.at)) if held else "")
                    at = c.to
                marks.append("".join(_MARKS(text, at, block.end)) if held else "")
                blocks.append((a, b, len(found), len(held)))
        per.append(len(blocks) - before)
    grid = lambda x, k: np.array(x, dtype=np.int64).reshape(-1, k)
    return Laid(np.array(per, dtype=np.int64), grid(blocks, 4), grid(ends, 2), grid(cuts, 6), np.array(bias, dtype=float), np.array(prior, dtype=float), marks)


def divide(start: int, end: int, at: list[int], to: list[int], score: list[float], pieces: list[str], prune: bool = True) -> list[int]:
    """Indices of the cuts that the best division of a block uses; the first of equal ones.

    A span may reach over any number of candidates. Without ``prune`` all spans are tried. Else two kinds are left
    out that can't be in the best division: spans over a place where nothing is open and that is reached at a better
    value than the span's own start, and spans from a start that a longer one, begun earlier, outdoes at any end.
    """
    n = len(at)
    if not n:
        return []
    starts, stops = [start, *to], [*at, end]
    best, back = [0.0] + [-math.inf] * (n + 1), [0] * (n + 2)
    # Value below which a start is outdone by an earlier one that nothing separates from it.
    floor = [-math.inf] * (n + 2)
    for i in range(n + 1):
        mine = best[i]
        if mine == -math.inf or (prune and mine < floor[i]):
            continue
        open_: list[str] = []
        lost = 0
        straight = 0
        for j in range(i, n + 1):
            for c in pieces[j]:
                if c == '"':
                    straight ^= 1
                elif c == "“" and open_ and open_[-1] == "„":
                    open_.pop()
                elif c in PAIRS:
                    open_.append(c)
                elif open_ and PAIRS[open_[-1]] == c:
                    open_.pop()
                else:
                    lost += 1
            letters = stops[j] - starts[i]
            span = -4.0 * (len(open_) + lost + straight) - (2.0 if letters < 4 else 0.0) - max(0.0, math.log(max(letters, 1) / 600))
            v = mine + span + (score[j] if j < n else 0.0)
            if v > best[j + 1]:
                best[j + 1], back[j + 1] = v, i
            if prune and j < n and not open_ and not straight:
                # From the next start every span is as balanced and no longer; only a very short one costs 2 more.
                if best[j + 1] - 2.0 - 1e-9 > mine:
                    break
                # The other way round: a span from here costs at most the length up to there more.
                outdone = mine - 4.0 * lost - math.log((starts[j + 1] - starts[i] + 600) / 600) - 1e-9
                if outdone > floor[j + 1]:
                    floor[j + 1] = outdone
    out, j = [], n + 1
    while j > 0:
        j = back[j]
        if j > 0:
            out.append(j - 1)
    return out[::-1]


def stretches(x: Laid, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(block, start, end)`` of all blocks' spans when these candidates are used."""
    many = np.bincount(x.owner[used], minlength=len(x.blocks))
    block = np.repeat(np.arange(len(x.blocks)), many + 1)
    last = np.cumsum(many + 1) - 1
    start, end = np.empty(len(block), dtype=np.int64), np.empty(len(block), dtype=np.int64)
    inner = np.ones(len(block), dtype=bool)
    inner[last - many] = False
    start[last - many], start[inner] = x.blocks[:, 0], x.cuts[used, 1]
    inner[:] = True
    inner[last] = False
    end[last], end[inner] = x.blocks[:, 1], x.cuts[used, 0]
    return block, start, end


def divisions(x: Laid, table: Table) -> np.ndarray:
    """Which candidates the best divisions of all blocks use.

    Spans only ever cost. So where a block has no marks and the candidates that add something cut it into spans that cost
    nothing, these are the best division; all other blocks are divided one by one.
    """
    score = x.scores(table)
    used = score > 0
    if not len(x.blocks):
        return used
    _, start, end = stretches(x, used)
    free = (end - start >= 4) & (end - start <= 600)
    many = np.bincount(x.owner[used], minlength=len(x.blocks)) + 1
    hard = (x.blocks[:, 2] > 0) & ((x.blocks[:, 3] > 0) | ~np.logical_and.reduceat(free, np.cumsum(many) - many))
    if hard.any():
        used[hard[x.owner]] = False
        n = np.maximum(x.blocks[:, 2], 0)
        cut_at, mark_at = np.cumsum(n) - n, np.cumsum(x.blocks[:, 2] + 1) - x.blocks[:, 2] - 1
        for i in np.flatnonzero(hard).tolist():
            c, m, k = cut_at[i], mark_at[i], n[i]
            got = divide(int(x.blocks[i, 0]), int(x.blocks[i, 1]), x.cuts[c : c + k, 0].tolist(), x.cuts[c : c + k, 1].tolist(), score[c : c + k].tolist(), x.marks[m : m + k + 1])
            used[c + np.array(got, dtype=np.int64)] = True
    return used


def spans(x: Laid, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, end)`` of every sentence, documents by their place."""
    block, start, end = stretches(x, divisions(x, table))
    doc = np.repeat(np.arange(len(x.per)), x.per)[block]
    good = end > start
    return doc[good], start[good], end[good]


def sentences(text: str | None, table: Table) -> list[tuple[int, int]]:
    """``(start, end)`` of every sentence; none for null, empty and blank texts."""
    _, a, b = spans(lay([text]), table)
    return list(zip(a.tolist(), b.tolist()))


def observe(parts: Iterator[Laid], table: Table | None, most: int = 1 << 22) -> np.ndarray:
    """Words at certain ends and starts (no table yet) or at those of the division by a table, then words at all candidates.

    Behind them stand the numbers of paragraph ends and of candidates, for the share of the one in the other. Places are
    counted when ``most`` of them have come together.
    """
    out = np.zeros(2 * DIM + 2, dtype=np.int64)
    held: list[np.ndarray] = []

    def count_up() -> None:
        if held:
            out[: 2 * DIM] += np.bincount(np.concatenate(held), minlength=2 * DIM)
            held.clear()

    for x in parts:
        words = x.cuts[:, 2:4]
        sure = x.ends if table is None else words[divisions(x, table)]
        # A paragraph's end is no candidate, so there it counts on both sides.
        held += [sure.ravel(), words.ravel().astype(np.int64) + DIM, *([x.ends.ravel().astype(np.int64) + DIM] if table is None else [])]
        out[2 * DIM :] += (len(x.ends) if table is None else 0, len(x.cuts))
        if sum(map(len, held)) >= most:
            count_up()
    count_up()
    return out


CELLS = "abcdefg"


def lay_out(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All documents as numbers, with their keys: rows of many documents each, packed. The texts are read here only."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                # Long texts in small rows.
                n, chars = 0, 0
                while at + n < len(texts) and (n == 0 or chars < CHUNK):
                    chars += len(texts[at + n] or "")
                    n += 1
                cells = [pa.array([c], pa.binary()) for c in lay(texts[at : at + n]).pack()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys.slice(at, n)), *cells], names=["keys", *CELLS])
                at += n

    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return cut(busy(base, "k").mapInArrow(work, f"keys array<{kind}>, " + ", ".join(f"{c} binary" for c in CELLS)))


def count(laid: DataFrame, table: Table | None) -> Table:
    """Table over all documents: each task adds up its own, the sum has DIM rows at most."""
    shared = laid.sparkSession.sparkContext.broadcast((table.yes, table.all, table.base) if table else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(*shared.value) if shared.value else None
        sums = observe((Laid.unpack(cells) for b in batches for cells in zip(*(c.to_pylist() for c in b.columns))), t)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["at", "n"])

    got = laid.select(*CELLS).mapInArrow(work, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    shared.destroy()
    sums = np.zeros(2 * DIM + 2)
    sums[got["at"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=float)
    ends, cuts = sums[2 * DIM :]
    # About two thirds of the candidates end a sentence; the division then counts them itself.
    base = min(1.0, max(0.02, ends / max(1.0, ends + 0.65 * cuts))) if table is None else 1.0
    return Table(sums[:DIM], sums[DIM : 2 * DIM], base)


def train(laid: DataFrame, rounds: int = ROUNDS) -> Table:
    table = count(laid, None)
    for _ in range(rounds):
        table = count(laid, table)
    return table


def learn(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Table:
    return train(lay_out(docs.select(F.lit(0).alias("k"), F.col(text).alias("t")), "k", "t"), rounds)


def split(docs: DataFrame, key: str = "doc_id", text: str = "text", table: Table | None = None) -> DataFrame:
    """``(key, start_pos, end_pos)`` of every sentence of every document, in code points.

    Null, empty and blank texts have no rows; repeated rows give repeated sentences.
    """
    laid = lay_out(docs, key, text)
    t = table or train(laid)
    shared = docs.sparkSession.sparkContext.broadcast((t.yes, t.all, t.base))
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(*shared.value)
        for b in batches:
            for i in range(b.num_rows):
                doc, first, last = spans(Laid.unpack([b.column(1 + k)[i].as_py() for k in range(len(CELLS))]), own)
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values.take(pa.array(doc)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=[key, "start_pos", "end_pos"])

    return laid.mapInArrow(work, f"`{key}` {kind}, start_pos int, end_pos int")
