"""Queries over new records and over nested records (p6, p7)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.keys import entity_key
from ..operators import incremental, shred
from ..session import ensure_checkpoint_dir, table

#: Unicode white space, as a character class of the oracle's regular expressions.
SQL_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


SQL_KEY = f"coalesce(nullif(lower({sql_strip('doi')}), ''), nullif({sql_strip('id')}, ''))"


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest row of each key among those that the last successful run has not taken.

    The state is what that run left: the rows it covers are committed to a ledger as intervals of row numbers, all others,
    late ones among them, are the gaps that the next run takes and commits with its output.
    """
    works = table(spark, sf_dir, "works").select("row_no", "doi", "id", "updated_date")
    ledger = incremental.RunLedger(spark, f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.adopt(incremental.covered_by_state(works, table(spark, sf_dir, "dedup_state"), entity_key(), "updated_date", "row_no"))
    ledger.run(works, "row_no", lambda rows: incremental.newest_per_key(rows, entity_key(), "updated_date", "row_no"))
    return ledger.output().select("row_no")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.flat_children(table(spark, sf_dir, "raw_works"))


QUERIES = {"p6_found": p6_found, "p7_found": p7_found}

def _held(x: str) -> str:
    """The JSON that a JSON string holds, else the value itself."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid(({x}->>'$')) AND json_type(({x}->>'$')) IN ('ARRAY', 'OBJECT') THEN ({x}->>'$')::JSON ELSE {x} END"


def _members(x: str) -> str:
    held = _held(x)
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN []::JSON[] WHEN json_type({held}) = 'ARRAY' THEN ({held})::JSON[] ELSE [{held}] END"


def _named(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'OBJECT' THEN coalesce(nullif(({x}->>'id'), ''), nullif(({x}->>'display_name'), ''), '') WHEN 'VARCHAR' THEN ({x}->>'$') ELSE '' END"


def _each(source: str, list_: str, *keep: str) -> str:
    """Members that are not null, with their place."""
    cols = "".join(f"{k}, " for k in keep)
    return f"SELECT * FROM (SELECT {cols}unnest(m) AS x, generate_subscripts(m, 1) - 1 AS o FROM (SELECT {cols}{_members(list_)} AS m FROM {source})) WHERE x IS NOT NULL AND json_type(x) <> 'NULL'"


P7_SQL = f"""
    WITH v AS (SELECT line_no, {sql_strip('line')} AS t FROM raw_works),
    l AS (SELECT line_no, t::JSON AS j FROM v WHERE json_valid(t) AND json_type(t) = 'OBJECT'),
    a AS ({_each('l', "(j->'authorships')", 'line_no')}),
    i AS ({_each("(SELECT line_no, o AS ao, x AS a FROM a WHERE json_type(x) = 'OBJECT')", "(a->'institutions')", 'line_no', 'ao')}),
    t AS ({_each('l', "(j->'topics')", 'line_no')}),
    p AS (SELECT line_no, {_held("(j->'primary_location')")} AS x FROM l),
    w AS (SELECT line_no, unnest(map_entries(CAST(h AS MAP(VARCHAR, JSON)))) AS e FROM (SELECT line_no, {_held("(j->'abstract_inverted_index')")} AS h FROM l) WHERE json_type(h) = 'OBJECT'),
    z AS ({_each('(SELECT line_no, e.key AS k, e.value AS h FROM w)', 'h', 'line_no', 'k')})
    SELECT DISTINCT line_no, child, CAST(ord1 AS INT) AS ord1, CAST(ord2 AS INT) AS ord2, child_key FROM (
        SELECT line_no, 'author' AS child, o AS ord1, -1 AS ord2, CASE WHEN json_type(x) = 'OBJECT' THEN {_named("(x->'author')")} ELSE {_named('x')} END AS child_key FROM a
        UNION ALL SELECT line_no, 'institution', ao, o, {_named('x')} FROM i
        UNION ALL SELECT line_no, 'topic', o, -1, {_named('x')} FROM t
        UNION ALL SELECT line_no, 'location', 0, -1, coalesce(CASE WHEN json_type(x) = 'OBJECT' THEN {_named("(x->'source')")} ELSE {_named('x')} END, '') FROM p WHERE x IS NOT NULL AND json_type(x) <> 'NULL'
        UNION ALL SELECT line_no, 'word', CAST(x AS INT), -1, k FROM z)"""

ORACLES = {
    "p7_found": P7_SQL,
    "p6_found": f"""
        WITH k AS (SELECT {SQL_KEY} AS key, coalesce(updated_date, '') AS v, row_no FROM works),
        best AS (SELECT key, max(v) AS v, arg_max(row_no, (v, row_no)) AS row_no FROM k WHERE key IS NOT NULL GROUP BY key),
        seen AS (SELECT key, max(coalesce(updated_date, '')) AS v FROM dedup_state WHERE key IS NOT NULL GROUP BY key)
        SELECT row_no FROM best LEFT JOIN seen USING (key) WHERE best.v > coalesce(seen.v, '')""",
}
