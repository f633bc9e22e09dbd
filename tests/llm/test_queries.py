import pytest

from oracle import both
from tidewrack.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    got, want = both(spark, small, queries.queries()[name], queries.oracle_sql()[name])
    assert got == want


COLUMNS = {
    "p1_found": {"row_no": "bigint", "field_name": "string"},
    "p2_found": {"oa_id": "string"},
    "p3_found": {"row_no": "bigint", "lang": "string"},
    "p4_found": {"group_row": "bigint", "field_name": "string", "row_no": "bigint"},
    "p5_found": {"rec_no": "bigint", "pos": "int", "species_id": "bigint"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p10_found": {"doc_id": "bigint", "start_pos": "int", "end_pos": "int"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, small, name):
    df = queries.queries()[name](spark, small)
    assert dict(df.dtypes) == COLUMNS[name]
    if name != "p8_ids":
        rows = df.collect()
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", ["p1_restored", "p3_segments", "p4_records", "p9_containers"])
def test_other_queries_run(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0
