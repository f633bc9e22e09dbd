"""Free-entered values mapped to a canonical list by a prefix-filter set-similarity join.

Every run of words of a value and every listed name becomes a set of four-letter pieces. Pieces are ordered by
global rarity; two sets can only reach the wanted Jaccard similarity if their rare prefixes share a piece, so
the join is on prefixes only. Length and positional filters thin the candidates, Jaccard is verified exactly
and the best is kept. An exact check follows: the pair must be within a few edits, and no unlisted combination
of listed words may be nearer to what was written.

Nothing is collected: the list may be as long as the values.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import py_strip
from ..session import cut, spread

#: Jaccard similarity of pieces that a name and its misspelling reach: what two edits leave of nine letters.
AT_LEAST = 0.2
#: Names of fewer letters must be met exactly.
SHORT = 6
#: A piece's rows on the left are joined in so many independent parts.
SALTS = 8

_PAREN = re.compile(r"[\(\[\{/;:=|]|[\)\]\}]")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*\.?")


def fold(text: str) -> str:
    """Lower case without accents, tags, underscores and look-alike digits inside words."""
    t = re.sub(r"<[^<>]*>", "", unicodedata.normalize("NFKD", text))
    t = "".join(c for c in t if not unicodedata.combining(c)).replace("ø", "o").replace("Ø", "O")
    t = t.replace("_", " ").lower()
    return re.sub(r"(?<=[a-z])[01]|[01](?=[a-z]{2})", lambda m: "o" if m[0] == "0" else "l", t)


def letters(text: str) -> str:
    return "".join(c for c in text if c.isalpha())


def singular(word: str) -> list[str]:
    """The word and what it may be the plural of."""
    out = [word]
    if word.endswith("mice"):
        out.append(word[:-4] + "mouse")
    if word.endswith("ves"):
        out.append(word[:-3] + "f")
    if word.endswith("es"):
        out.append(word[:-2])
    if word.endswith("s"):
        out.append(word[:-1])
    return out


def variants(text: str, longest: int) -> set[tuple[str, str, str]]:
    """``(kind, letters, words)`` of everything in a value that may be a name.

    Kind is "name" for runs of up to ``longest`` words, also with a part after a comma put first, and "abbr"
    for a shortened first word with its second.
    """
    out: set[tuple[str, str, str]] = set()
    flat = fold(text)
    parts = [p for p in _PAREN.split(flat) if p.strip()]

    def runs(words: list[str]) -> None:
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + longest) + 1):
                run = [w.rstrip(".") for w in words[i:j]]
                for last in singular(run[-1]):
                    x = [*run[:-1], last]
                    key = letters("".join(x))
                    if key:
                        out.add(("name", key, " ".join(x)))
            if i + 1 < len(words) and 1 <= len(a := words[i].rstrip(".")) <= 3 and a.isalpha() and len(words[i + 1]) >= 5:
                if words[i].endswith(".") or len(a) == 1:
                    out.add(("abbr", a + letters(words[i + 1]), f"{a} {words[i + 1]}"))

    for p in [*parts, *([" ".join(parts)] if len(parts) > 1 else [])]:
        halves = p.split(",")
        for h in halves:
            runs(_WORD.findall(h))
        if len(halves) >= 2:
            for a, b in zip(halves, halves[1:]):
                left, right = _WORD.findall(a), _WORD.findall(b)
                if left and right:
                    runs([*right[: longest - 1], *left[:longest]])
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits, a swap of neighbours counting as one; ``most + 1`` when more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def allowed(kind: str, n: int) -> int:
    """Edits that a name of n letters may have."""
    return 0 if kind == "abbr" or n < SHORT else 2 if n >= 9 else 1


def pieces_of(c: Column, n: int) -> Column:
    """Runs of n letters of a string with its ends marked: a set."""
    s = F.concat(F.lit("^" * (n - 1)), c, F.lit("$" * (n - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n))))


def similar(left: DataFrame, right: DataFrame, at_least: Column | float, gap: int | None = None) -> DataFrame:
    """``(lid, rid, jaccard)`` of all pairs whose token sets reach ``at_least``, exactly.

    Both sides have ``(id, kind, tokens)``; only equal kinds are compared. ``at_least`` may be a column over
    ``id`` and ``kind``, then each pair must reach its left side's. ``gap`` is how far the sizes may be apart at
    most, for callers that keep no others. Tokens are ordered by rarity over both sides, ties by the token itself.
    """
    need = at_least if isinstance(at_least, Column) else F.lit(float(at_least))
    # Tokens are compared as 64-bit numbers: sets of numbers meet in generated code.
    left, right = (df.withColumn("tokens", F.transform("tokens", lambda t: F.xxhash64(t))) for df in (left, right))
    said = left.select("kind", F.explode("tokens").alias("t")).unionAll(right.select("kind", F.explode("tokens").alias("t")))
    rarity = said.groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def ordered(df: DataFrame) -> DataFrame:
        return (
            df.select("id", "kind", F.explode("tokens").alias("t"))
            .join(rarity, "t")
            .groupBy("id", "kind")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("tokens"))
            .withColumn("size", F.size("tokens"))
        )

    def prefix(df: DataFrame, side: str, need: Column) -> DataFrame:
        sized = df.withColumn("need", need)
        keep = F.col("size") - F.ceil(F.col("size") * F.col("need") - 1e-9) + 1
        return sized.select(F.col("id").alias(f"{side}id"), "kind", "need", F.col("tokens").alias(f"{side}tokens"), F.col("size").alias(f"{side}size"), F.posexplode(F.slice("tokens", F.lit(1), keep.cast("int"))).alias(f"{side}pos", "t"))

    a = prefix(cut(ordered(left)), "l", need)
    # A listed side's prefix must do for the least of what its partners need.
    low = a.agg(F.min("need").alias("m")).first()["m"]
    b = prefix(cut(ordered(right)), "r", F.lit(float(low if low is not None else 1.0))).drop("need")
    a = a.withColumn("salt", F.pmod(F.xxhash64("lid"), F.lit(SALTS)).cast("int"))
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by = ["kind", "t", "salt"]
    both = F.col("lsize") + F.col("rsize")
    met = spread(a, *by).join(spread(b, *by), by).filter(
        (F.col("lsize") >= F.col("rsize") * F.col("need") - 1e-9)
        & (F.col("rsize") >= F.col("lsize") * F.col("need") - 1e-9)
        & (F.abs(F.col("lsize") - F.col("rsize")) <= (gap if gap is not None else 1 << 30))
        # Positional: this token and what can follow it must suffice.
        & (1 + F.least(F.col("lsize") - F.col("lpos"), F.col("rsize") - F.col("rpos")) >= F.ceil(both * F.col("need") / (1 + F.col("need")) - 1e-9))
    )
    common = F.size(F.array_intersect("ltokens", "rtokens"))
    return (
        met.withColumn("jaccard", common / (both - common))
        .filter(F.col("jaccard") >= F.col("need") - 1e-9)
        .select("lid", "rid", "jaccard")
        .distinct()
    )


def listed_names(reference: DataFrame, id_: str, names: list[str], more: list[str]) -> DataFrame:
    """``(ref, name)``: every name of every entry; ``more`` are list columns."""
    every = F.concat(F.array(*[F.col(n) for n in names]), *[F.coalesce(F.col(m), F.array().cast("array<string>")) for m in more])
    return reference.select(F.col(id_).alias("ref"), F.explode(every).alias("name")).filter(py_strip("name") != "").distinct()


def map_values(values: DataFrame, value: str, reference: DataFrame, id_: str, names: list[str], more: list[str], at_least: float = AT_LEAST) -> DataFrame:
    """``(value, ref)`` of every distinct value that is not null or blank: the entry it names, or null if none.

    A name inside a longer one that the value names as well does not count; of the rest the greatest similarity
    wins. A value that names two entries equally well names none. An empty list leaves all values unmatched.
    """
    words = listed_names(reference, id_, names, more)
    distinct = values.select(F.col(value).alias("value")).filter(py_strip("value") != "").distinct()
    kind = reference.schema[id_].dataType.simpleString()

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ref, name in zip(b["ref"], b["name"]):
                f = fold(name)
                parts = f.split()
                if key := letters(f):
                    rows.append((ref, "name", key, f))
                if len(parts) == 2 and name[:1].isupper():
                    for k in (1, 2, 3):
                        rows.append((ref, "abbr", parts[0][:k] + letters(parts[1]), f"{parts[0][:k]} {parts[1]}"))
            yield pd.DataFrame(rows, columns=["ref", "kind", "key", "words"])

    listed = cut(spread(words, "name").mapInPandas(forms, f"ref {kind}, kind string, key string, words string"))
    longest = listed.filter("kind = 'name'").agg(F.max(F.size(F.split("words", r"\s+"))).alias("n")).first()["n"] or 1

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, *x) for v in b["value"] for x in sorted(variants(v, longest))]
            yield pd.DataFrame(rows, columns=["value", "kind", "key", "words"])

    entry = cut(spread(distinct, "value").mapInPandas(split, "value string, kind string, key string, words string"))
    keyed = lambda df: df.select("kind", "key").distinct().select(F.concat_ws(":", "kind", "key").alias("id"), "kind", pieces_of(F.col("key"), 4).alias("tokens"))
    exact = (F.col("kind") == "abbr") | (F.length("id") < len("name:") + SHORT)
    met = similar(keyed(entry), keyed(listed), F.when(exact, F.lit(1.0)).otherwise(F.lit(float(at_least))), gap=4)
    key_of = lambda c: F.substring_index(c, ":", -1)
    # A swap of neighbours is two of these edits.
    met = met.filter(F.levenshtein(key_of(F.col("lid")), key_of(F.col("rid")), 4) >= 0)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds = [x.partition(":")[0] for x in b["lid"]]
            said, ref = [x.partition(":")[2] for x in b["lid"]], [x.partition(":")[2] for x in b["rid"]]
            d = [distance(x, y, allowed(k, len(y))) for k, x, y in zip(kinds, said, ref)]
            keep = [i for i, (k, y) in enumerate(zip(kinds, ref)) if d[i] <= allowed(k, len(y))]
            yield b.iloc[keep].assign(d=[d[i] for i in keep])

    close = cut(spread(met, "lid").mapInPandas(check, "lid string, rid string, jaccard double, d int"))
    close = close.join(other_names(close, combinations(listed, close.filter("d > 0"))), ["lid", "rid"], "left_anti")
    tagged = lambda df: df.withColumn("id", F.concat_ws(":", "kind", "key"))
    found = (
        tagged(entry).select("value", "key", F.col("id").alias("lid")).distinct()
        .join(close, "lid")
        .join(tagged(listed).select("ref", F.col("id").alias("rid")).distinct(), "rid")
        .groupBy("value", "ref", "key")
        .agg(F.max("jaccard").alias("j"), F.min("d").alias("d"))
    )
    found = cut(found)
    longer = found.select("value", F.col("key").alias("_key")).distinct()
    inside = F.col("_key").contains(F.col("key")) & (F.length("_key") > F.length("key"))
    found = found.join(longer, "value").groupBy("value", "ref", "key", "j", "d").agg(F.max(inside).alias("in")).filter(~F.col("in"))
    best = found.groupBy("value").agg(F.max(F.struct("j", -F.col("d"))).alias("top"))
    level = found.join(best, "value").filter(F.struct("j", -F.col("d")) == F.col("top")).groupBy("value").agg(F.count_distinct("ref").alias("many"), F.min("ref").alias("ref"))
    return distinct.join(level, "value", "left").select("value", F.when(F.col("many") == 1, F.col("ref")).alias("ref"))


def combinations(listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(rid, other)``: for each wanted listed name the unlisted ones that have one end of another listed name instead of its own.

    Names are a first word and the rest; an end is swapped for one that is alike, by a similarity join of ends. A value
    nearer to such a name than to the listed one is that other name, well spelled or not.
    """
    plain = lambda c: F.regexp_replace(c, r"[^\p{L}]", "")
    whole = listed.filter("kind = 'name' AND words LIKE '% %'").select(F.concat_ws(":", "kind", "key").alias("rid"), F.substring_index("words", " ", 1).alias("head"), F.expr("substring(words, instr(words, ' ') + 1)").alias("tail")).distinct()
    near = cut(whole.join(wanted.select("rid").distinct(), "rid", "left_semi"))
    out = None
    for end, rest in (("head", "tail"), ("tail", "head")):
        ends = lambda df: df.select(F.col(end).alias("id")).distinct().select("id", F.lit(end).alias("kind"), pieces_of(plain(F.col("id")), 3).alias("tokens"))  # noqa: B023, E731
        alike = similar(ends(near), ends(whole), AT_LEAST, gap=4).filter("lid <> rid").filter(F.levenshtein(plain("lid"), plain("rid"), 4) >= 0)
        swapped = near.join(alike.select(F.col("lid").alias(end), F.col("rid").alias("new")), end)
        made = F.concat(plain("new"), plain(rest)) if end == "head" else F.concat(plain(rest), plain("new"))
        one = swapped.select("rid", made.alias("other"))
        out = one if out is None else out.unionAll(one)
    return out.distinct().join(listed.filter("kind = 'name'").select(F.col("key").alias("other")).distinct(), "other", "left_anti")


def other_names(close: DataFrame, combos: DataFrame) -> DataFrame:
    """``(lid, rid)`` of misspellings that are nearer to an unlisted combination than to the listed name."""
    said = F.substring_index("lid", ":", -1)
    near = close.filter("d > 0").join(combos, "rid").filter(F.levenshtein(said, F.col("other"), 2) >= 0)

    def nearer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [distance(x.partition(":")[2], o, d) < d for x, o, d in zip(b["lid"], b["other"], b["d"])]
            yield b.loc[keep, ["lid", "rid"]]

    return near.select("lid", "rid", "other", "d").mapInPandas(nearer, "lid string, rid string").distinct()
