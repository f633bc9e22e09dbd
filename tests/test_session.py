from types import SimpleNamespace

import pytest

from tidewrack import session as S
from tidewrack.operators import dedup
from tidewrack.streaming.watermark import KeyState


def test_small_inputs_keep_all_cores_busy(spark, small):
    df = S.table(spark, small, "works").select("row_no", "id")
    got = S.spread(df, "row_no")
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert got.count() == df.count()


def test_large_inputs_are_sized_by_what_comes(spark, small, monkeypatch):
    monkeypatch.setattr(S, "LARGE", 0)
    df = S.table(spark, small, "works").select("row_no", "id")
    got = S.spread(df, "row_no")
    assert "Rebalance" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.row_no for r in got.collect()) == sorted(r.row_no for r in df.collect())


def test_a_checkpoint_counts_its_parts(spark):
    cut = S.cut(spark.range(100).repartition(13))
    assert S.spread(cut, "id").rdd.getNumPartitions() >= 13


def test_a_cluster_must_name_its_checkpoint_folder():
    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), getConf=lambda: SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_key_state_is_merged_now_and_then(spark, tmp_path):
    state = KeyState(spark, f"{tmp_path}/s", merge_every=2)
    rows = lambda *x: spark.createDataFrame(list(x), "key string, year int, updated_date string")
    assert state.read().count() == 0
    for i in range(5):
        state.merge(i)
        state.add(i, rows(("a", 1, f"2020-0{i + 1}"), (f"k{i}", 2, "2020")))
    # Three parts made a base; what came since stands beside it.
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if "=" in p.name) == ["base=2", "batch=3", "batch=4"]
    best = {r.key: r.updated_date for r in dedup.merge_states([state.read()]).collect()}
    assert best == {"a": "2020-05"} | {f"k{i}": "2020" for i in range(5)}
    assert {r.key for r in state.read(4).collect()} == {"a", "k0", "k1", "k2", "k3"}
    # A batch that is replayed replaces its own part.
    state.add(4, rows(("a", 1, "2020-09")))
    assert state.read().filter("key = 'k4'").count() == 0
