"""Sinks: rolling Parquet, versioned state, dual outputs, sidecars and clean-up."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS_PER_FILE = 500_000


def rolling_parquet(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "errorifexists") -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).mode(mode).parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Compact JSON lines, non-ASCII kept, appended through the commit protocol: no torn tails."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def dual_sink(df: DataFrame, all_path: str, positive_path: str, threshold: float, score: str = "bert_score", run: str | None = None) -> str:
    """Every scored row, and those at or above the threshold, each in a folder ``run=<run>`` of its own; returns the run.

    The positives are filtered from what this run wrote: the model runs once, nothing is cached, and no earlier run is
    read again. A run that is repeated under its name replaces itself.
    """
    run = run or uuid.uuid4().hex
    df.write.mode("overwrite").parquet(f"{all_path}/run={run}")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{all_path}/run={run}")
    written.filter(F.col(score) >= threshold).write.mode("overwrite").parquet(f"{positive_path}/run={run}")
    return run


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all runs below a path."""
    return spark.read.parquet(path).drop("run")


class VersionedTable:
    """A table in folders ``v=<n>``; readers see the last one that was completed.

    A new version is written whole and counts once its success marker is there, so a table is never read
    and overwritten at once, and an empty result never replaces a filled one.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(self.root)
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={have[-1] if version is None else version}")

    def write(self, df: DataFrame, allow_empty: bool = False) -> int:
        have = self.versions()
        names = [f.split()[0] for f in self.schema.replace("\n", " ").split(",") if f.strip()]
        version = (have[-1] if have else 0) + 1
        df.select(*names).write.mode("overwrite").parquet(f"{self.root}/v={version}")
        if have and not allow_empty and self.spark.read.parquet(f"{self.root}/v={version}").isEmpty() and not self.read(have[-1]).isEmpty():
            self._fs.delete(self._path(f"{self.root}/v={version}"), True)
            raise ValueError("an empty state would replace a filled one")
        return version

    def snapshot(self, to: str) -> str:
        """A copy of the present version with a time in its name."""
        path = f"{to.rstrip('/')}/{time.strftime('%Y%m%d-%H%M%S', time.gmtime())}"
        self.read().write.parquet(path)
        return path

    def drop_old(self, keep: int = 2) -> list[int]:
        """Delete all but the last versions; returns those deleted."""
        old = self.versions()[:-keep] if keep > 0 else []
        for v in old:
            self._fs.delete(self._path(f"{self.root}/v={v}"), True)
        return old


def rewrite_if_smaller(before: DataFrame, after: DataFrame, path: str) -> tuple[int, int]:
    """Write ``after`` to a new path only if it has fewer rows; returns both counts."""
    n, m = before.count(), after.count()
    if m < n:
        after.write.mode("errorifexists").parquet(path)
    return n, m


def stats_sidecar(df: DataFrame, path: str, title: str, line: str, most: int = 1000) -> None:
    """A title, its underline and one formatted line a row of a small report; more rows than ``most`` are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    head = title.strip()
    lines = [head, "=" * len(head), "", *(line.format(**r.asDict()) for r in rows)]
    spark = df.sparkSession
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_run_state(path: str, stage: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"last_run": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "last_stage": stage}, f)


def read_run_state(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def delete_processed(spark: SparkSession, files: list[str], really: bool = False) -> list[str]:
    """Delete source files that are done and their folders if empty; off unless asked for."""
    if not really:
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = []
    for f in files:
        p = path(f)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.delete(p, False):
            gone.append(f)
            if len(fs.listStatus(p.getParent())) == 0:
                fs.delete(p.getParent(), False)
    return gone
