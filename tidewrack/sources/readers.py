"""Readers: compressed JSON lines, index chunks, state tables and releases."""

from __future__ import annotations

from dataclasses import dataclass, fields as dataclass_fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.keys import partition_date

#: A raw record. Members whose shape varies are VARIANT.
RAW_WORK = """
id string, doi string, display_name string, title string, type string, language string, updated_date string,
publication_date string, created_date string, publication_year variant, is_retracted boolean, is_paratext boolean,
locations array<struct<is_published:boolean,is_accepted:boolean>>, primary_location variant,
abstract_inverted_index map<string,array<int>>, abstract string, venue string, primary_topic variant,
keywords variant, topics variant, concepts variant, authorships variant, best_oa_location variant,
open_access variant, biblio variant, counts_by_year variant, referenced_works variant, related_works variant,
grants variant, mesh variant, indexed_in variant, cited_by_count variant
"""


def text_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``(value, path)`` of every line below the path, partition folders not taken for columns."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def parse_lines(lines: DataFrame, schema: str = RAW_WORK, value: str = "value", strict: bool = True) -> DataFrame:
    """Records of lines that hold one JSON object; all others are left out.

    The parser is lenient about what follows the object; with ``strict`` such lines are left out too. A
    member of another shape than the schema's is null, the record stays.
    """
    parsed = lines.withColumn("_r", F.from_json(value, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    good = F.col("_r").isNotNull() & F.col("_r._corrupt").isNull() & F.col(value).rlike(r"(?U)^\s*\{")
    if strict:
        good = good & one_object(F.col(value))
    names = [f.name for f in T._parse_datatype_string(schema).fields] if "variant" not in schema else [x.split()[0] for x in _members(schema)]
    return parsed.filter(good).select(*[c for c in lines.columns if c != value], *[F.col(f"_r.{n}").alias(n) for n in names])


def one_object(c: Column) -> Column:
    """Whether a text is one JSON object and nothing after it; lines with repeated members count as one."""
    held = F.concat(F.lit('{"v":'), c, F.lit(',"end":1}'))
    return F.coalesce(F.get_json_object(held, "$.end") == "1", F.lit(False))


def _members(schema: str) -> list[str]:
    """Top-level members of a DDL schema."""
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def read_gz_jsonl(spark: SparkSession, path: str, partitions: int | None = None, glob: str = "*.gz", schema: str = RAW_WORK) -> DataFrame:
    """Records of all compressed files; gzip can't be split, so rows are spread after the scan where asked."""
    out = text_lines(spark, path, glob)
    if partitions:
        out = out.repartition(partitions)
    return parse_lines(out, schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines; blank and broken ones, also a torn last one, are skipped."""
    return parse_lines(text_lines(spark, path), schema).drop("path")


def read_index(spark: SparkSession, path: str, schema: str = RAW_WORK) -> DataFrame:
    """Records of index chunks ``(key, updated_date, payload)``; only the payload is read."""
    return parse_lines(spark.read.parquet(path).select(F.col("payload").alias("value")), schema)


def parse_state_lines(lines: DataFrame, value: str = "value", order: str | None = None) -> DataFrame:
    """State ``(key, year, updated_date)`` of tab-separated lines.

    Two columns mean a blank date; other arities, the header and years that are no whole number are
    skipped. With ``order`` the last line of a key wins, else the greatest date.
    """
    cols = F.split(F.col(value), "\t", -1)
    year = F.trim(cols[1]).try_cast("int")
    rows = lines.filter(F.size(cols).isin(2, 3)).select(cols[0].alias("key"), year.alias("year"), F.when(F.size(cols) == 3, cols[2]).otherwise("").alias("updated_date"), *([F.col(order).alias("_o")] if order else []))
    rows = rows.filter(F.col("year").isNotNull())
    by = F.struct("_o") if order else F.struct("updated_date", "year")
    return rows.groupBy("key").agg(F.max_by(F.struct("year", "updated_date"), by).alias("r")).select("key", "r.year", "r.updated_date")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return parse_state_lines(spark.read.text(path))


def read_release(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Release columns, all of which must be there."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    return df.select(*columns)


def assert_list_like(df: DataFrame, c: str) -> None:
    """A column that lists are read from must be an array of strings or a string."""
    kind = df.schema[c].dataType.simpleString()
    if kind not in ("array<string>", "string", "void"):
        raise TypeError(f"{c} is {kind}")


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, size)`` of files below a folder, largest first; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size")).orderBy(F.desc("size"), "path")


def after_date(files: DataFrame, date: str | None, path: str = "path") -> DataFrame:
    """Files whose partition date is at or after a date; those without a partition date drop out."""
    if date is None:
        return files
    return files.filter(partition_date(path) >= date)


def first_files(files: DataFrame, n: int, path: str = "path") -> DataFrame:
    """The first n files by path: the smoke mode."""
    return files.orderBy(path).limit(n)


def seeded_order(files: DataFrame, seed: int, slots: int, path: str = "path") -> DataFrame:
    """Files with a slot that depends on path and seed only: a stable shuffle for samples and shards."""
    return files.withColumn("slot", F.pmod(F.xxhash64(F.col(path), F.lit(seed)), F.lit(slots)).cast("int"))


def load_config(path: str, kind: type):
    """A dataclass from a YAML file; an empty file gives the defaults, unknown names are an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f) or {}
    known = {x.name for x in dataclass_fields(kind)}
    if extra := set(got) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return kind(**got)


@dataclass(frozen=True)
class WorkerSpec:
    """What a spec such as ``0:batch=64,chunk=8`` says of one device."""

    device: int
    settings: dict


def parse_worker_spec(spec: str) -> list[WorkerSpec]:
    """Specs separated by ``;`` or blanks; names other than batch, chunk, queue and readers are an error."""
    out = []
    for part in spec.replace(";", " ").split():
        device, _, rest = part.partition(":")
        settings = {}
        for item in filter(None, rest.split(",")):
            name, _, value = item.partition("=")
            if name not in ("batch", "chunk", "queue", "readers"):
                raise ValueError(f"unknown setting: {name}")
            settings[name] = int(value)
        out.append(WorkerSpec(int(device), settings))
    return out
