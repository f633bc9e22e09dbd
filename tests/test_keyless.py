from tidewrack.operators import dedup, state


def test_records_without_an_id_are_all_kept(spark):
    rows = [(1, "a", "2024"), (2, "a", "2025"), (3, None, "2024"), (4, None, None), (5, None, "2024"), (6, "b", None)]
    df = spark.createDataFrame(rows, "row_no int, oa_id string, updated_date string")
    best = dedup.latest_or_keyless(df, "oa_id", "updated_date", "row_no")
    assert sorted(r.row_no for r in best.collect()) == [2, 3, 4, 5, 6]
    seen = spark.createDataFrame([("a", 0, 0, "x", "s", "t", "2025"), ("b", 1, 5, "x", "s", "t", "")], state.VERDICTS)
    assert sorted(r.row_no for r in state.pending_records(best, seen).collect()) == [3, 4, 5]
    assert sorted(r.row_no for r in state.pending_records(best, seen, "all_rejected").collect()) == [2, 3, 4, 5]
    assert dedup.latest_or_keyless(df.limit(0), "oa_id", "updated_date").count() == 0
