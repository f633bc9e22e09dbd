import json

import pytest

from tidewrack.operators import shred as S


def members(v):
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            w = v
        v = w if isinstance(w, (list, dict)) else v
    return [] if v is None else v if isinstance(v, list) else [v]


def named(x):
    if isinstance(x, dict):
        return x.get("id") or x.get("display_name") or ""
    return x if isinstance(x, str) else ""


def brute(n, line):
    """The rows of a line written down directly from its JSON."""
    try:
        o = json.loads((line or "").strip(), parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return set()
    if not isinstance(o, dict):
        return set()
    out = set()
    for i, a in enumerate(members(o.get("authorships"))):
        if a is not None:
            out.add((n, "author", i, -1, named(a.get("author") if isinstance(a, dict) else a)))
            if isinstance(a, dict):
                out |= {(n, "institution", i, j, named(q)) for j, q in enumerate(members(a.get("institutions"))) if q is not None}
    out |= {(n, "topic", i, -1, named(t)) for i, t in enumerate(members(o.get("topics"))) if t is not None}
    p = members(o.get("primary_location"))
    if p and p[0] is not None:
        out.add((n, "location", 0, -1, named(p[0].get("source") if isinstance(p[0], dict) else p[0])))
    a = members(o.get("abstract_inverted_index"))
    if a and isinstance(a[0], dict):
        out |= {(n, "word", z, -1, w) for w, ps in a[0].items() for z in (ps if isinstance(ps, list) else [ps]) if z is not None}
    return out


LINES = [
    '{"authorships":[{"author":{"id":"A1"},"institutions":[null,{"id":null,"display_name":"I"},"J",5]},null,"Solo",{"author":null}]}',
    '{"authorships":{"author":"Plain","institutions":"Only"},"topics":"T","primary_location":{"source":null}}',
    '{"topics":"[{\\"id\\":\\"T1\\"},null]","primary_location":"{\\"source\\":{\\"display_name\\":\\"S\\"}}","abstract_inverted_index":"{\\"a\\":[0,2],\\"b\\":1}"}',
    '  {"abstract_inverted_index":{"a":[0,0,null],"b":3,"c":[]},"topics":[]}  ',
    '{"topics":null,"primary_location":"Somewhere"}',
    "{}",
    "[1]",
    "null",
    "",
    "   ",
    '{"topics":[1]} x',
    '{"topics":[1]}{"topics":[1]}',
    '{"topics":NaN}',
    '{"topics":["\\ud83d\\ude00"]}',
    "{" * 5000,
    None,
]


def test_children_of_odd_lines(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "line_no bigint, line string")
    got = set(map(tuple, S.flat_children(df).collect()))
    want = set().union(*(brute(n, x) for n, x in enumerate(LINES)))
    # A member that is neither text nor object has no name.
    assert got == want


def test_all_lines_of_the_table(spark, small):
    rows = spark.read.parquet(f"{small}/raw_works.parquet").select("line_no", "line").collect()
    got = set(map(tuple, S.flat_children(spark.read.parquet(f"{small}/raw_works.parquet")).collect()))
    assert got == set().union(*(brute(r.line_no, r.line) for r in rows))


def test_empty_table(spark):
    assert S.flat_children(spark.createDataFrame([], "line_no bigint, line string")).count() == 0


def test_levels_of_a_hand_made_record():
    r = {"authorships": [{"author": {"id": "a"}, "institutions": [{"id": "x"}, {"id": "y"}]}, {"author": None, "institutions": []}, None]}
    cols = {c.path: c for c in S.shred([r, {}], S.WORK)}
    c = cols[("authorships", "institutions", "id")]
    assert c.reps == [0, 2, 1, 1, 0]
    assert c.vals == ["x", "y", None, None, None]
    assert c.defs == [7, 7, 4, 2, 0]


@pytest.mark.parametrize("n", [1, 700])
def test_level_table_has_every_path(spark, n):
    df = spark.createDataFrame([(i, LINES[2]) for i in range(n)], "line_no bigint, line string")
    t = S.level_table(df)
    assert t.select("path").distinct().count() == len(S.columns(S.WORK))
    assert t.filter("path = 'abstract_inverted_index.positions'").count() == 3 * n


OTHER = S.Node("", kids=(S.Node("id", kind="text"), S.Node("a", True, (S.Node("x", kind="text"), S.Node("b", True, (S.Node("c", True, kind="whole"), S.Node("y", kind="text"))))), S.Node("o", kids=(S.Node("z", kind="whole"),))))


def regular(node, v):
    """A record as the schema sees it: all members, regular lists."""
    def one(n, v):
        v = S._held(v) if n.kids else S._leaf(n, v)
        return v if v is None or not n.kids else {k.name: regular(k, S._child(v, k)) for k in n.kids}

    if not node.many:
        return one(node, v)
    got = S._members(node, v)
    return None if got is None else [one(node, m) for m in got]


RECORDS = [
    {}, {"id": "1", "a": []}, {"a": [None, {"x": "p", "b": [{"c": [1, None, 2], "y": "q"}, None, {"c": [], "y": None}]}, {"b": None}], "o": {"z": 5}},
    {"a": {"x": 3, "b": "[1]"}, "o": None}, {"a": [{"b": [{"c": 7}]}, {"b": []}], "o": {"z": "x"}},
]


@pytest.mark.parametrize("schema,records", [(OTHER, RECORDS), (S.WORK, [r for x in LINES if (r := S.parse_object(x)) is not None])])
def test_records_come_back_from_their_columns(schema, records):
    want = [{k.name: regular(k, r.get(k.name)) for k in schema.kids} for r in records]
    assert S.assemble(S.shred(records, schema), schema) == want
    assert S.assemble(S.shred([], schema), schema) == []


def test_a_table_for_every_list(spark):
    got = S.related(S.shred(RECORDS, OTHER), OTHER)
    rows = lambda k: [(int(r), tuple(p), *v) for r, p, *v in zip(got[k][0], got[k][1].tolist(), *got[k][2].values())]
    assert rows("") == [(0, (), None, None), (1, (), "1", None), (2, (), None, 5), (3, (), None, None), (4, (), None, None)]
    assert rows("a") == [(2, (1,), "p"), (3, (0,), "3"), (4, (0,), None), (4, (1,), None)] + [] or rows("a")[0] == (2, (1,), "p")
    assert rows("a.b") [:2] == [(2, (1, 0), "q"), (2, (1, 2), None)]
    assert rows("a.b.c") == [(2, (1, 0, 0), 1), (2, (1, 0, 2), 2), (4, (0, 0, 0), 7)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(9, "[1]"), (10, None)], "line_no bigint, line string")
    t = S.related_table(S.related_rows(df, OTHER), "a.b.c", OTHER)
    assert sorted(map(tuple, t.collect())) == [(2, 1, 0, 0, "1"), (2, 1, 0, 2, "2"), (4, 0, 0, 0, "7")]
