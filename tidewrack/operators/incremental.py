"""Runs over new or changed records only.

The ledger of a run is a set of disjoint closed intervals of sequence numbers, kept as a table
``(lo, hi)``. A run takes the ranges now available, subtracts what is committed and processes the gaps,
so a record that lands late, with a number far below the greatest one seen, is a gap like any other. The
merged intervals are committed in one step with the output: a run that dies leaves nothing behind that a
later run would read.

All interval work happens in blocks of ``block`` numbers. A number is in one block, so no group ever
holds more than ``block`` rows, however the numbers are spread.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

BLOCK = 65_536
INTERVALS = "lo bigint, hi bigint"


def available_intervals(rows: DataFrame, seq: str, block: int = BLOCK) -> DataFrame:
    """Disjoint ``(lo, hi)`` of the numbers present, cut at block borders.

    Repeated numbers count once; rows whose number is null can't be tracked and are left out. An empty
    table gives no interval.
    """
    numbers = rows.select(F.col(seq).cast("bigint").alias("lo")).filter("lo IS NOT NULL").distinct()
    return merge_intervals(numbers.withColumn("hi", F.col("lo")), block)


def merge_intervals(intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Union of possibly overlapping intervals as disjoint ones, cut at block borders."""
    pieces = _by_block(intervals, block)
    w = W.partitionBy("_block").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    return (
        pieces.withColumn("_new", F.when(F.col("lo") > F.coalesce(before, F.col("lo") - 2) + 1, 1).otherwise(0))
        .withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("_block", "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select("lo", "hi")
    )


def subtract_intervals(available: DataFrame, done: DataFrame, block: int = BLOCK) -> DataFrame:
    """Parts of ``available`` not covered by ``done``: a sweep over the ends of both inside each block."""

    def ends(df: DataFrame, have: int, gone: int) -> DataFrame:
        p = _by_block(df, block)
        return p.select("_block", F.col("lo").alias("at"), F.lit(have).alias("a"), F.lit(gone).alias("d")).unionAll(
            p.select("_block", F.col("hi") + 1, F.lit(-have), F.lit(-gone))
        )

    points = ends(available, 1, 0).unionAll(ends(done, 0, 1)).groupBy("_block", "at").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    w = W.partitionBy("_block").orderBy("at")
    return (
        points.withColumn("_a", F.sum("a").over(w))
        .withColumn("_d", F.sum("d").over(w))
        .withColumn("hi", F.lead("at").over(w) - 1)
        .filter("_a > 0 AND _d = 0 AND hi IS NOT NULL")
        .select(F.col("at").alias("lo"), "hi")
    )


def rows_in(rows: DataFrame, intervals: DataFrame, seq: str, block: int = BLOCK) -> DataFrame:
    """Rows whose number lies in one of the disjoint intervals: a sweep inside each block.

    Rows and intervals' beginnings are read in order; a row is in if the greatest end so far reaches it. So the cost does
    not depend on how many pieces the intervals are in. Rows without a number are in none.
    """
    n = F.col(seq).cast("bigint")
    r = rows.filter(n.isNotNull()).select(F.floor(n / F.lit(block)).cast("bigint").alias("_block"), n.alias("_at"), F.lit(None).cast("bigint").alias("_hi"), F.struct(*[rows[c] for c in rows.columns]).alias("_row"))
    p = _by_block(intervals, block).select("_block", F.col("lo").alias("_at"), F.col("hi").alias("_hi"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row"))
    w = W.partitionBy("_block").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = r.unionAll(p).withColumn("_end", F.max("_hi").over(w))
    return swept.filter(F.col("_row").isNotNull() & (F.col("_end") >= F.col("_at"))).select("_row.*")


def pending(rows: DataFrame, done: DataFrame, seq: str, block: int = BLOCK) -> DataFrame:
    """Rows that no committed run has processed."""
    return rows_in(rows, subtract_intervals(available_intervals(rows, seq, block), done, block), seq, block)


def _by_block(intervals: DataFrame, block: int) -> DataFrame:
    b = lambda c: F.floor(F.col(c) / F.lit(block)).cast("bigint")
    cut = intervals.filter("lo <= hi").withColumn("_block", F.explode(F.sequence(b("lo"), b("hi"))))
    return cut.select(
        "_block",
        F.greatest("lo", F.col("_block") * block).alias("lo"),
        F.least("hi", (F.col("_block") + 1) * block - 1).alias("hi"),
    )


def newer_than_state(rows: DataFrame, state: DataFrame, key, version: str, seq: str) -> DataFrame:
    """Per key the row with the greatest version (text, null as ''), then the greatest number, if it is newer than the state.

    ``key`` is a column expression over ``rows``; rows whose key is null are left out. ``state`` has
    ``(key, updated_date)`` and may list a key often; its greatest date counts, null or absent as ''.
    Returns ``(key, version, seq)``. Both sides are aggregated before they meet, so a hot key is one row.
    """
    v = F.coalesce(F.col(version), F.lit(""))
    best = (
        rows.select(key.alias("key"), F.struct(v.alias("v"), F.col(seq).alias("n")).alias("b"))
        .filter("key IS NOT NULL")
        .groupBy("key")
        .agg(F.max("b").alias("b"))
    )
    seen = state.filter("key IS NOT NULL").groupBy("key").agg(F.max(F.coalesce(F.col("updated_date"), F.lit(""))).alias("_seen"))
    return (
        best.join(seen, "key", "left")
        .filter(F.col("b.v") > F.coalesce(F.col("_seen"), F.lit("")))
        .select("key", F.col("b.v").alias(version), F.col("b.n").alias(seq))
    )


def covered_by_state(rows: DataFrame, state: DataFrame, key, version: str, seq: str, block: int = BLOCK) -> DataFrame:
    """Intervals of the rows that a state says an earlier run has taken: those not newer than their key's greatest date.

    Rows without a key are no run's business and count as taken. The state is reduced to one row a key before it meets
    the rows, which are joined as they are.
    """
    keyed = rows.select(key.alias("key"), F.coalesce(F.col(version), F.lit("")).alias("v"), F.col(seq).cast("bigint").alias("lo"))
    seen = state.filter("key IS NOT NULL").groupBy("key").agg(F.max(F.coalesce(F.col("updated_date"), F.lit(""))).alias("_seen"))
    taken = keyed.join(seen, "key", "left").filter(F.col("key").isNull() | (F.col("v") <= F.coalesce("_seen", F.lit(""))))
    return merge_intervals(taken.select("lo", F.col("lo").alias("hi")).filter("lo IS NOT NULL").distinct(), block)


def newest_per_key(rows: DataFrame, key, version: str, seq: str) -> DataFrame:
    """``(key, version, seq)``: of each key that is not null the row with the greatest version as text, then the greatest number."""
    best = F.max(F.struct(F.coalesce(F.col(version), F.lit("")).alias("v"), F.col(seq).alias("n")))
    return rows.select(key.alias("key"), version, seq).filter("key IS NOT NULL").groupBy("key").agg(best.alias("b")).select("key", F.col("b.v").alias(version), F.col("b.n").alias(seq))


class RunLedger:
    """Committed runs below ``root``.

    Each attempt writes ``attempts/<id>/output`` and ``attempts/<id>/intervals``; the commit ``commits/<n>.json`` is
    written aside and renamed into its place, which fails if another run was there first. So a commit is whole or absent,
    and makes output and intervals visible at once. Attempts without a commit are never read, and a commit file that
    holds no commit (a torn one of other writers) counts as none.
    """

    def __init__(self, spark: SparkSession, root: str, block: int = BLOCK):
        self.spark, self.root, self.block = spark, root.rstrip("/"), block
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _names(self) -> list[str]:
        at = self._path(f"{self.root}/commits")
        if not self._fs.exists(at):
            return []
        return sorted(n for s in self._fs.listStatus(at) if (n := s.getPath().getName()).endswith(".json") and not n.startswith((".", "_")))

    def last(self) -> dict | None:
        """The last commit; only as many files are read as it takes to find a whole one."""
        for n in reversed(self._names()):
            if (got := self._commit(n)) is not None:
                return got
        return None

    def commits(self) -> list[dict]:
        return [c for n in self._names() if (c := self._commit(n)) is not None]

    def _commit(self, name: str) -> dict | None:
        try:
            got = json.loads(self._read(f"{self.root}/commits/{name}"))
        except ValueError:
            return None
        return got if isinstance(got, dict) and "attempt" in got else None

    def done(self) -> DataFrame:
        """Intervals of the last commit."""
        found = self.last()
        if not found:
            return self.spark.createDataFrame([], INTERVALS)
        return self.spark.read.schema(INTERVALS).parquet(f"{self.root}/attempts/{found['attempt']}/intervals")

    def output(self) -> DataFrame | None:
        """Output of all committed runs that had any."""
        paths = [f"{self.root}/attempts/{c['attempt']}/output" for c in self.commits() if c.get("output", True)]
        return self.spark.read.parquet(*paths) if paths else None

    def adopt(self, intervals: DataFrame) -> dict:
        """Commit the intervals of runs that another system has made; their output is not here."""
        attempt = uuid.uuid4().hex
        merge_intervals(self.done().unionAll(intervals.select("lo", "hi")), self.block).write.parquet(f"{self.root}/attempts/{attempt}/intervals")
        return self._commit_attempt(attempt, output=False)

    def run(self, rows: DataFrame, seq: str, process: Callable[[DataFrame], DataFrame]) -> dict:
        """Process the gaps and commit. The gaps are written first, so rows that arrive meanwhile wait for the next run."""
        attempt = uuid.uuid4().hex
        base = f"{self.root}/attempts/{attempt}"
        number, done = self._next(), self.done()
        subtract_intervals(available_intervals(rows, seq, self.block), done, self.block).write.parquet(f"{base}/gaps")
        gaps = self.spark.read.schema(INTERVALS).parquet(f"{base}/gaps")
        process(rows_in(rows, gaps, seq, self.block)).write.parquet(f"{base}/output")
        merge_intervals(done.unionAll(gaps), self.block).write.parquet(f"{base}/intervals")
        return self._commit_attempt(attempt, number)

    def _next(self) -> int:
        names = self._names()
        return int(names[-1].removesuffix(".json")) + 1 if names else 1

    def _commit_attempt(self, attempt: str, number: int | None = None, output: bool = True) -> dict:
        number = number or self._next()
        commit = {"run": number, "attempt": attempt} | ({} if output else {"output": False})
        self._create(f"{self.root}/commits/{number:09d}.json", json.dumps(commit))
        return commit

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> None:
        """A whole file at the path, or an error if one is there."""
        aside = self._path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        try:
            self._files.rename(aside, self._path(path), never_over)
        except Exception:
            self._fs.delete(aside, False)
            raise
