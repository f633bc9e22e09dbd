"""File streams into versioned key state: new files only, newest version of each key, older arrivals dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup
from ..operators.state import STATE


class KeyState:
    """Greatest version of each key, as a base and the batches since.

    A batch adds a folder with its own keys only. Once there are ``merge_every`` of them they are merged into a new base,
    one row a key, named by the last batch in it; a base counts once its success marker is there, and only then are what
    it replaces deleted. So a batch costs what it brings, and the state is written whole once in many batches.
    """

    def __init__(self, spark: SparkSession, root: str, merge_every: int = 50):
        self.spark, self.root, self.merge_every = spark, root.rstrip("/"), merge_every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        at = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removeprefix(kind)) for n in names if n.startswith(kind) and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def _parts(self, before: int | None) -> tuple[list[str], int | None]:
        """Folders that hold the state before a batch, and the base's number."""
        bases = [b for b in self._numbers("base=") if before is None or b < before]
        base = bases[-1] if bases else None
        deltas = [n for n in self._numbers("batch=") if (base is None or n > base) and (before is None or n < before)]
        return [*([f"base={base}"] if bases else []), *[f"batch={n}" for n in deltas]], base

    def read(self, before: int | None = None) -> DataFrame:
        """State rows, of batches before one if given; a key may have several."""
        parts, _ = self._parts(before)
        if not parts:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*[f"{self.root}/{p}" for p in parts])

    def add(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def merge(self, before: int) -> None:
        """Merge what is there before a batch once it has come to ``merge_every`` parts."""
        parts, base = self._parts(before)
        if len(parts) <= self.merge_every:
            return
        last = max(int(p.partition("=")[2]) for p in parts)
        dedup.merge_states([self.read(before)]).write.mode("overwrite").parquet(f"{self.root}/base={last}")
        for p in parts:
            self._fs.delete(self._path(f"{self.root}/{p}"), True)


class WatermarkStream:
    """Runs a file stream through key state, once over all new files and then ends.

    The checkpoint remembers files, the state the greatest version of each key. Every batch writes its output and
    its part of the state below ``batch=<id>``, so a batch that is replayed after a crash overwrites its own and never
    moves the state twice. ``ties`` are columns that decide between equal versions of a key within a batch; of equal
    versions in two batches the earlier one stays.
    """

    def __init__(self, spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: Column, version: str, year: str | None = None, files_per_batch: int = 1000, fmt: str = "parquet", ties: tuple[str, ...] = (), merge_every: int = 50):
        self.spark, self.source, self.schema, self.out, self.checkpoint = spark, source, schema, out.rstrip("/"), checkpoint.rstrip("/")
        self.key, self.version, self.year, self.files_per_batch, self.fmt, self.ties = key, version, year, files_per_batch, fmt, ties
        self.state = KeyState(spark, f"{self.out}/state", merge_every)

    def batch(self, df: DataFrame, batch_id: int) -> None:
        rows = df.withColumn("key", self.key).filter("key IS NOT NULL")
        best = dedup.latest_per_key(rows, "key", self.version, *self.ties)
        self.state.merge(batch_id)
        # The state before this batch: what the batch itself wrote in an earlier try does not count.
        before = self.state.read(batch_id)
        fresh = dedup.still_needed(best.withColumnRenamed(self.version, "_version"), before.select("key", F.col("updated_date").alias("_version")), "key", "_version")
        fresh.withColumnRenamed("_version", self.version).write.mode("overwrite").parquet(f"{self.out}/rows/batch={batch_id}")
        done = self.spark.read.parquet(f"{self.out}/rows/batch={batch_id}")
        year = F.col(self.year).cast("int") if self.year else F.lit(None).cast("int")
        self.state.add(batch_id, done.select("key", year.alias("year"), F.col(self.version).cast("string").alias("updated_date")))

    def run(self) -> StreamingQuery:
        stream = self.spark.readStream.format(self.fmt).schema(self.schema).option("maxFilesPerTrigger", self.files_per_batch).option("recursiveFileLookup", "true").load(self.source)
        query = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def rows(self) -> DataFrame:
        """Everything that passed the watermark."""
        return self.spark.read.parquet(f"{self.out}/rows")

    def latest(self) -> DataFrame:
        """Latest row of each key over all batches: a re-touched record supersedes its older output."""
        return dedup.latest_per_key(self.rows(), "key", self.version, "batch")
