"""Session factory and the two settings every operator shares: shuffle width and the checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidewrack", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller's own session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cutting lineage.

    ``spark.checkpoint.dir`` as the cluster names it wins. Only where neither it nor a folder on the context is set, and
    everything runs on this machine, is a local one made, which goes when Python ends. On a cluster it must be set.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidewrack-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: later plans start there and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a task beyond which tasks are sized by what comes, not counted by the cores.
LARGE = 64 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned for Python work.

    Small inputs, which adaptive execution would join into one task, keep all cores busy: two tasks a core at least, and
    as many as a checkpoint below has. Where the files below hold more than LARGE for each core, adaptive execution
    sizes the tasks by what comes and splits what is skewed. Judged by the plan, without running anything.
    """
    sc = df.sparkSession.sparkContext
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = parts = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName() == "LogicalRDD":
            parts = max(parts, leaf.rdd().getNumPartitions())
        elif "Relation" in leaf.nodeName():
            files += int(str(leaf.stats().sizeInBytes()))
    if files > LARGE * sc.defaultParallelism:
        return df.hint("rebalance", *keys)
    return df.repartition(max(sc.defaultParallelism * 2, parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def busy(df: DataFrame, *keys: str) -> DataFrame:
    """The input as it is if its scan gives every core a task, else spread over them by key.

    Only a small input of fewer files than cores is spread. Judged by the plan's size estimate, without
    running anything; a large input is never shuffled for it.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    task = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    cores = spark.sparkContext.defaultParallelism
    return spread(df, *keys) if size < task * cores and len(df.inputFiles()) < cores else df
