"""Columnar shredding of nested records.

A record is taken apart into one column per leaf path. Each entry of a column carries a repetition level
(which list went on) and a definition level (how far down the path something was there), so the columns
alone say which entry belongs to which parent. ``related`` puts flat tables back together, one per
repeated ancestor of any schema, from the level sequences only: ordinals are running counts over repetition levels.
``tables`` gives the children of a bibliographic record with their keys, and ``assemble`` the records themselves.

A ``Node`` is a field. ``many`` makes it a list whose members may be null; every node may be absent.
Shapes are made regular on the way in: text that holds a JSON list or object where one belongs is read, a
single value where a list belongs is a list of one, and a plain string where a thing with names belongs
becomes its ``name`` leaf.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

STEP = 512
INT_MAX = 2**31 - 1


@dataclass(frozen=True)
class Node:
    name: str
    many: bool = False
    kids: tuple["Node", ...] = ()
    kind: str = "object"  # object, entries (an object read as a list of its members), text, whole


@dataclass
class Column:
    """Levels and values of one leaf path; ``slot`` is the definition level at which each list's place exists."""

    path: tuple[str, ...]
    top: int
    reps: list[int] = field(default_factory=list)
    defs: list[int] = field(default_factory=list)
    vals: list = field(default_factory=list)


def thing(name: str, many: bool = False, *more: Node) -> Node:
    """Something known by id, display_name or a plain string."""
    return Node(name, many, (Node("id", kind="text"), Node("display_name", kind="text"), Node("name", kind="text"), *more))


#: The nested fields of a bibliographic record.
WORK = Node(
    "",
    kids=(
        Node("authorships", True, (thing("author"), Node("name", kind="text"), thing("institutions", True))),
        thing("topics", True),
        Node("primary_location", False, (thing("source"), Node("name", kind="text"))),
        Node("abstract_inverted_index", True, (Node("key", kind="text"), Node("positions", True, kind="whole")), "entries"),
    ),
)


def parse_object(line: str | None) -> dict | None:
    """The JSON object that the line consists of, white space around it aside; else null."""
    if line is None:
        return None
    try:
        got = json.loads(line.strip(), parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _refuse(_: str):
    raise ValueError("not JSON")


def _held(v):
    """The list or object that a text holds as JSON, else the text."""
    if isinstance(v, str) and v.strip()[:1] in ("{", "["):
        try:
            got = json.loads(v.strip(), parse_constant=_refuse)
        except (ValueError, RecursionError):
            return v
        return got if isinstance(got, (dict, list)) else v
    return v


def _members(node: Node, v) -> list | None:
    v = _held(v)
    if node.kind == "entries":
        return [{"key": k, "positions": p} for k, p in v.items()] if isinstance(v, dict) else None
    return v if v is None or isinstance(v, list) else [v]


def _leaf(node: Node, v):
    if node.kind == "whole":
        if isinstance(v, str) and v.strip().lstrip("-").isdecimal():
            v = int(v)
        if isinstance(v, float) and v.is_integer():
            v = int(v)
        return v if isinstance(v, int) and not isinstance(v, bool) and abs(v) <= INT_MAX else None
    if isinstance(v, str):
        return v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not v.isascii() else v
    return str(v) if isinstance(v, int) and not isinstance(v, bool) else None


def _child(v, kid: Node):
    if isinstance(v, dict):
        return v.get(kid.name) if kid.name != "name" else None
    return v if kid.name == "name" and isinstance(v, str) else None


def columns(schema: Node) -> list[Column]:
    def walk(node: Node, path: tuple[str, ...], level: int) -> Iterator[Column]:
        level += 3 if node.many else 1
        if not node.kids:
            yield Column((*path, node.name), level)
        for kid in node.kids:
            yield from walk(kid, (*path, node.name), level)

    return [c for kid in schema.kids for c in walk(kid, (), 0)]


def shred(records: list[dict | None], schema: Node) -> list[Column]:
    """Levels and values of every leaf path over the records; a null record adds one undefined entry a path."""
    out = columns(schema)
    at = {c.path: c for c in out}

    def nothing(node: Node, path: tuple[str, ...], rep: int, level: int) -> None:
        if not node.kids:
            c = at[(*path, node.name)]
            c.reps.append(rep), c.defs.append(level), c.vals.append(None)
        for kid in node.kids:
            nothing(kid, (*path, node.name), rep, level)

    def put(node: Node, v, path: tuple[str, ...], rep: int, depth: int, level: int) -> None:
        if node.many:
            got = _members(node, v)
            if not got:
                return nothing(node, path, rep, level + (got is not None))
            for i, m in enumerate(got):
                one(node, m, path, rep if i == 0 else depth + 1, depth + 1, level + 2)
            return None
        return one(node, _held(v) if node.kids else v, path, rep, depth, level)

    def one(node: Node, v, path: tuple[str, ...], rep: int, depth: int, level: int) -> None:
        if not node.kids:
            v = _leaf(node, v)
        if v is None:
            return nothing(node, path, rep, level)
        if not node.kids:
            c = at[(*path, node.name)]
            c.reps.append(rep), c.defs.append(level + 1), c.vals.append(v)
        here = (*path, node.name)
        for kid in node.kids:
            put(kid, _child(v, kid), here, rep, depth, level + 1)
        return None

    for r in records:
        for kid in schema.kids:
            put(kid, None if r is None else r.get(kid.name), (), 0, 0, 0)
    return out


@dataclass
class Levels:
    """A column as arrays, with the record and the ordinals of each entry."""

    rec: np.ndarray
    ord1: np.ndarray
    ord2: np.ndarray
    defs: np.ndarray
    vals: np.ndarray


def levels(c: Column) -> Levels:
    """Ordinals from repetition levels alone: members counted since the record, or the outer member, began."""
    rep = np.asarray(c.reps, dtype=np.int64)
    i = np.arange(len(rep))
    outer = np.cumsum(rep <= 1)
    began = np.maximum.accumulate(np.where(rep == 0, i, 0)) if len(rep) else i
    inner = np.maximum.accumulate(np.where(rep <= 1, i, 0)) if len(rep) else i
    vals = np.empty(len(rep), dtype=object)
    vals[:] = c.vals
    return Levels(np.cumsum(rep == 0) - 1, outer - outer[began] if len(rep) else i, i - inner, np.asarray(c.defs, dtype=np.int64), vals)


def tables(cols: list[Column]) -> dict[str, tuple[Levels, np.ndarray]]:
    """Of each child kind its entries and keys: id, else display_name, else the plain string, else ''."""
    by = {c.path: levels(c) for c in cols}

    def named(*paths: tuple[str, ...], level: int) -> tuple[Levels, np.ndarray]:
        first = by[paths[0]]
        key = np.full(len(first.defs), "", dtype=object)
        there = np.zeros(len(first.defs), dtype=bool)
        for p in reversed(paths):
            x = by[p]
            key = np.where(np.not_equal(x.vals, None) & (x.vals != ""), x.vals, key)
            there |= x.defs >= level
        return _take(first, there), key[there]

    names = ("id", "display_name", "name")
    out = {
        "author": named(*[("authorships", "author", n) for n in names], ("authorships", "name"), level=3),
        "institution": named(*[("authorships", "institutions", n) for n in names], level=6),
        "topic": named(*[("topics", n) for n in names], level=3),
        "location": named(*[("primary_location", "source", n) for n in names], ("primary_location", "name"), level=1),
    }
    # The word of an entry stands once, its positions many times: repetition level 1 starts a new entry in both.
    word, pos = by[("abstract_inverted_index", "key")], by[("abstract_inverted_index", "positions")]
    entry = np.cumsum(np.diff(pos.rec * (1 << 32) + pos.ord1, prepend=-1) != 0) - 1
    there = np.not_equal(pos.vals, None)
    key = word.vals[entry[there]] if len(word.vals) else word.vals
    found = _take(pos, there)
    found.ord1 = pos.vals[there].astype(np.int64)
    out["word"] = (found, key)
    return out


def _take(x: Levels, keep: np.ndarray) -> Levels:
    return Levels(x.rec[keep], x.ord1[keep], x.ord2[keep], x.defs[keep], x.vals[keep])


def repeated(schema: Node) -> dict[tuple[str, ...], tuple[int, int, list[tuple[str, ...]]]]:
    """Of the root and each list of a schema: how many lists lead to it, the level of its members that are not null, and
    the leaf paths that its members have once each."""
    out: dict[tuple[str, ...], tuple[int, int, list[tuple[str, ...]]]] = {(): (0, 0, [])}

    def walk(node: Node, path: tuple[str, ...], owner: tuple[str, ...], level: int) -> None:
        here, level = (*path, node.name), level + (3 if node.many else 1)
        if node.many:
            out[here] = (out[owner][0] + 1, level, [])
            owner = here
        if not node.kids:
            out[owner][2].append(here)
        for kid in node.kids:
            walk(kid, here, owner, level)

    for kid in schema.kids:
        walk(kid, (), (), 0)
    return out


def places(reps: np.ndarray, depth: int) -> np.ndarray:
    """Of each entry its place in each of the lists that lead to it, outermost first, from repetition levels alone."""
    i = np.arange(len(reps))
    out = np.zeros((len(reps), depth), dtype=np.int64)
    for k in range(1, depth + 1):
        begun = np.cumsum(reps <= k)
        parent = np.maximum.accumulate(np.where(reps < k, i, 0)) if len(reps) else i
        out[:, k - 1] = begun - begun[parent]
    return out


def related(cols: list[Column], schema: Node) -> dict[str, tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """A flat table for the root and each list: records, places in the lists that lead there, and the values of each leaf.

    Members that are null have no row but keep their place. Lists whose members hold nothing but lists have no table.
    """
    by = {c.path: c for c in cols}
    out = {}
    for path, (depth, level, leaves) in repeated(schema).items():
        if not leaves:
            continue
        first = by[leaves[0]]
        reps, defs = np.asarray(first.reps, dtype=np.int64), np.asarray(first.defs, dtype=np.int64)
        values = {}
        for leaf in leaves:
            vals = np.empty(len(reps), dtype=object)
            vals[:] = by[leaf].vals
            values[".".join(leaf[len(path) :]) or leaf[-1]] = vals
            defs = np.maximum(defs, by[leaf].defs)
        keep = defs >= level
        out[".".join(path)] = ((np.cumsum(reps == 0) - 1)[keep], places(reps, depth)[keep], {k: v[keep] for k, v in values.items()})
    return out


def assemble(cols: list[Column], schema: Node) -> list[dict]:
    """The records back from levels and values: objects with all members of the schema, absent ones null."""
    by = {c.path: c for c in cols}

    def leaves(node: Node, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        here = (*path, node.name)
        return [x for kid in node.kids for x in leaves(kid, here)] if node.kids else [here]

    def read(node: Node, path: tuple[str, ...], at: dict, depth: int, level: int):
        if not node.many:
            return one(node, path, at, depth, level)
        under = leaves(node, path)
        d = by[under[0]].defs[at[under[0]][0]]
        if d <= level + 1:
            return None if d <= level else []
        begins = {p: [at[p][0], *(i for i in range(at[p][0] + 1, at[p][1]) if by[p].reps[i] <= depth + 1), at[p][1]] for p in under}
        return [one(node, path, {p: (b[i], b[i + 1]) for p, b in begins.items()}, depth + 1, level + 2) for i in range(len(begins[under[0]]) - 1)]

    def one(node: Node, path: tuple[str, ...], at: dict, depth: int, level: int):
        here = (*path, node.name)
        if not node.kids:
            i = at[here][0]
            return by[here].vals[i] if by[here].defs[i] > level else None
        first = leaves(node, path)[0]
        if by[first].defs[at[first][0]] <= level:
            return None
        return {kid.name: read(kid, here, at, depth, level + 1) for kid in node.kids}

    begins = {c.path: [i for i, r in enumerate(c.reps) if r == 0] + [len(c.reps)] for c in cols}
    n = len(next(iter(begins.values()))) - 1 if begins else 0
    return [{kid.name: read(kid, (), {p: (b[i], b[i + 1]) for p, b in begins.items()}, 0, 0) for kid in schema.kids} for i in range(n)]


RELATED = "line_no bigint, table string, places array<int>, fields map<string,string>"


def related_rows(lines: DataFrame, schema: Node = WORK, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Rows of all tables of ``related`` in one pass: ``(line_no, table, places, fields)``; ``related_table`` picks one.

    Lines that are not exactly one JSON object give no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                pairs = [(n, r) for n, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if (r := parse_object(x)) is not None]
                if not pairs:
                    continue
                numbers = np.array([n for n, _ in pairs], dtype=object)
                for name, (rec, place, values) in related(shred([r for _, r in pairs], schema), schema).items():
                    fields = [[(k, None if v is None else str(v)) for k, v in zip(values, row)] for row in zip(*values.values())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[rec].tolist(), pa.int64()), pa.array([name] * len(rec), pa.string()), pa.array(place.tolist(), pa.list_(pa.int32())), pa.array(fields, pa.map_(pa.string(), pa.string()))],
                        names=["line_no", "table", "places", "fields"],
                    )

    return lines.select(line_no, line).mapInArrow(work, RELATED)


def related_table(rows: DataFrame, name: str, schema: Node = WORK) -> DataFrame:
    """The flat table of one list: ``line_no``, the place in each list that leads to it, and a column a leaf."""
    path = tuple(name.split(".")) if name else ()
    depth, _, leaves = repeated(schema)[path]
    lists = [".".join(path[: i + 1]) for i in range(len(path)) if path[: i + 1] in repeated(schema)]
    one = rows.filter(F.col("table") == name)
    relative = [".".join(x[len(path) :]) or x[-1] for x in leaves]
    return one.select("line_no", *[F.col("places")[i].alias(f"{lists[i]}_place") for i in range(depth)], *[F.col("fields")[k].alias(k) for k in relative])


CHILDREN = pa.schema([("line_no", pa.int64()), ("child", pa.string()), ("ord1", pa.int32()), ("ord2", pa.int32()), ("child_key", pa.string())])


def flat_children(lines: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """One row per author, institution, topic, location and abstract word of each usable line.

    ``(line_no, child, ord1, ord2, child_key)``: ``ord1`` ties a row to its place in the line (a word to
    its position), ``ord2`` an institution to its place under author ``ord1``; -1 where there is none.
    Null, empty and unusable lines (not exactly one JSON object) give no rows; null members give none but
    keep their place. Exactly repeated positions of a word give one row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                numbers = part.column(0).to_numpy(zero_copy_only=False)
                records = [parse_object(x.as_py()) for x in part.column(1)]
                keep = [i for i, r in enumerate(records) if r is not None]
                if not keep:
                    continue
                numbers = numbers[keep]
                got = tables(shred([records[i] for i in keep], WORK))
                for kind, (x, key) in got.items():
                    if not len(key):
                        continue
                    single = np.full(len(key), -1, dtype=np.int64)
                    ord1 = np.zeros(len(key), dtype=np.int64) if kind == "location" else x.ord1
                    t = pa.table(
                        [pa.array(numbers[x.rec], pa.int64()), pa.array([kind] * len(key), pa.string()), pa.array(ord1, pa.int32()), pa.array(x.ord2 if kind == "institution" else single, pa.int32()), pa.array(key, pa.string())],
                        schema=CHILDREN,
                    )
                    if kind == "word":
                        t = t.group_by(t.column_names, use_threads=False).aggregate([]).select(CHILDREN.names).cast(CHILDREN)
                    yield from t.to_batches()

    return lines.select(line_no, line).mapInArrow(work, "line_no bigint, child string, ord1 int, ord2 int, child_key string")


LEVELS = "line_no bigint, path string, place int, rep int, def int, value string"


def level_table(lines: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """The shredded columns themselves, one row per entry: path, place in the path, levels and value as text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                for n, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if (r := parse_object(text)) is None:
                        continue
                    for c in shred([r], WORK):
                        k = len(c.reps)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([n] * k, pa.int64()), pa.array([".".join(c.path)] * k, pa.string()), pa.array(range(k), pa.int32()), pa.array(c.reps, pa.int32()), pa.array(c.defs, pa.int32()), pa.array([None if v is None else str(v) for v in c.vals], pa.string())],
                            names=["line_no", "path", "place", "rep", "def", "value"],
                        )

    return lines.select(line_no, line).mapInArrow(work, LEVELS)
