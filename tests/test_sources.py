import gzip
import json
import os
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tidewrack.functions.keys import entity_key
from tidewrack.operators.state import STATE
from tidewrack.sources import readers, sinks
from tidewrack.streaming.watermark import WatermarkStream


def write_gz(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(lines))


def test_gz_lines_keep_their_own_dates(spark, tmp_path):
    write_gz(f"{tmp_path}/s/updated_date=2024-01-01/p.gz", ['{"id":"W1","updated_date":"2025-02-03T11:00:00","abstract_inverted_index":{"a":[0]}}', "broken", "[1]", '{"id":"W2"} x', "", '{"id":"W3","publication_year":"1900"}'])
    df = readers.read_gz_jsonl(spark, f"{tmp_path}/s", partitions=2)
    rows = {r.id: r for r in df.select("id", "updated_date", "path", F.schema_of_variant("publication_year").alias("y")).collect()}
    assert set(rows) == {"W1", "W3"} and rows["W1"].updated_date == "2025-02-03T11:00:00" and rows["W3"].y == "STRING"
    files = readers.list_files(spark, f"{tmp_path}/s", "*.gz")
    assert readers.after_date(files, "2024-01-01").count() == 1 and readers.after_date(files, "2024-01-02").count() == 0
    assert readers.first_files(files, 3).count() == 1
    slots = [r.slot for r in readers.seeded_order(files, 7, 5).collect()]
    assert slots == [r.slot for r in readers.seeded_order(files.repartition(3), 7, 5).collect()] and 0 <= slots[0] < 5


def test_state_lines(spark):
    lines = [("key\tyear\tupdated_date",), ("a\t1",), ("b\t2\t2024",), ("c\t1\t2\t3",), ("d\tx\t2024",), ("b\t3\t2023",)]
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(lines)], "i int, value string")
    assert {tuple(r) for r in readers.parse_state_lines(df).collect()} == {("a", 1, ""), ("b", 2, "2024")}
    assert {tuple(r) for r in readers.parse_state_lines(df, order="i").collect()} == {("a", 1, ""), ("b", 3, "2023")}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 10, "é") for i in range(10)], "i int, bert_score double, t string")
    sinks.rolling_parquet(df.coalesce(1), f"{tmp_path}/p", 4)
    assert len([f for f in os.listdir(f"{tmp_path}/p") if f.endswith(".parquet")]) == 3
    sinks.append_jsonl(df, f"{tmp_path}/j")
    sinks.append_jsonl(df.limit(1), f"{tmp_path}/j")
    assert readers.read_jsonl(spark, f"{tmp_path}/j", "i int, t string").filter("t = 'é'").count() == 11
    sinks.dual_sink(df, f"{tmp_path}/all", f"{tmp_path}/pos", 0.45)
    assert spark.read.parquet(f"{tmp_path}/pos").count() == 5
    sinks.stats_sidecar(df.limit(2), f"{tmp_path}/stats", " Title ", "{i}: {t}")
    assert spark.read.text(f"{tmp_path}/stats").count() == 5
    with pytest.raises(ValueError):
        sinks.stats_sidecar(df, f"{tmp_path}/stats2", "T", "{i}", most=3)
    assert sinks.rewrite_if_smaller(df, df.limit(3), f"{tmp_path}/less") == (10, 3)
    assert sinks.rewrite_if_smaller(df, df, f"{tmp_path}/same") == (10, 10) and not os.path.exists(f"{tmp_path}/same")


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, f"{tmp_path}/t", STATE)
    assert t.read().count() == 0
    one = spark.createDataFrame([("a", 1, "x")], STATE)
    assert t.write(one) == 1 and t.write(t.read().unionByName(one)) == 2 and t.read().count() == 2
    with pytest.raises(ValueError):
        t.write(one.limit(0))
    assert t.versions() == [1, 2] and t.read().count() == 2
    os.makedirs(f"{tmp_path}/t/v=9")
    assert t.versions() == [1, 2]  # never completed
    assert spark.read.parquet(t.snapshot(f"{tmp_path}/snap")).count() == 2
    assert t.drop_old(1) == [1] and t.versions() == [2]


def test_run_state_and_deletion(spark, tmp_path):
    assert sinks.read_run_state(f"{tmp_path}/x.json") == {}
    sinks.write_run_state(f"{tmp_path}/x.json", "index")
    assert sinks.read_run_state(f"{tmp_path}/x.json")["last_stage"] == "index"
    os.makedirs(f"{tmp_path}/d")
    open(f"{tmp_path}/d/f.gz", "w").close()
    assert sinks.delete_processed(spark, [f"{tmp_path}/d/f.gz"]) == [] and os.path.exists(f"{tmp_path}/d/f.gz")
    assert sinks.delete_processed(spark, [f"{tmp_path}/d/f.gz"], really=True) and not os.path.exists(f"{tmp_path}/d")


def test_config_and_specs(tmp_path):
    yaml = pytest.importorskip("yaml")

    @dataclass
    class Config:
        a: int = 1

    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"a": 5}))
    (tmp_path / "e.yaml").write_text("")
    (tmp_path / "b.yaml").write_text("z: 1")
    assert readers.load_config(str(tmp_path / "c.yaml"), Config).a == 5 and readers.load_config(str(tmp_path / "e.yaml"), Config).a == 1
    with pytest.raises(ValueError):
        readers.load_config(str(tmp_path / "b.yaml"), Config)


def test_worker_specs():
    assert [(w.device, w.settings) for w in readers.parse_worker_spec("0:batch=64,chunk=8 1")] == [(0, {"batch": 64, "chunk": 8}), (1, {})]
    with pytest.raises(ValueError):
        readers.parse_worker_spec("0:speed=1")


def test_release_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "year int, venue string").write.parquet(f"{tmp_path}/r")
    assert readers.read_release(spark, f"{tmp_path}/r", ["year"]).columns == ["year"]
    with pytest.raises(ValueError):
        readers.read_release(spark, f"{tmp_path}/r", ["species"])
    readers.assert_list_like(spark.createDataFrame([(["a"],)], "x array<string>"), "x")
    with pytest.raises(TypeError):
        readers.assert_list_like(spark.range(1), "id")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    kind = "id string, doi string, updated_date string, row_no bigint"
    put = lambda name, rows: spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    put("a", [("W1", None, "2", 1), ("W1", None, "1", 2), ("W2", None, "5", 3), ("W9", None, None, 4)])
    stream = lambda: WatermarkStream(spark, f"{tmp_path}/in", kind, f"{tmp_path}/out", f"{tmp_path}/ck", entity_key(), "updated_date")
    stream().run()
    put("b", [("W1", None, "3", 5), ("W2", None, "4", 6), ("W2", None, "5", 7), ("W3", None, "1", 8)])
    stream().run()
    stream().run()
    s = stream()
    assert {(r.key, r.updated_date) for r in s.latest().collect()} == {("W1", "3"), ("W2", "5"), ("W3", "1")}
    assert s.rows().count() == 4
    # A replayed batch leaves everything as it was.
    s.batch(spark.read.schema(kind).parquet(f"{tmp_path}/in/b"), 1)
    assert stream().rows().count() == 4 and stream().state.read().count() == 4


def test_raw_lines_with_repeated_members(spark):
    df = spark.createDataFrame([('{"id":"a","id":"b"}',), ('{"end":1}',), ("{}",)], "value string")
    assert readers.parse_lines(df, "id string").count() == 3
    assert json.loads("{}") == {}
