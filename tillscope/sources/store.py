"""Stored tables whose readers never see half a write.

A write puts its Parquet files into a new folder of the table. It counts once a marker, a small JSON
file with the next number, lists that folder; a marker can be made by one writer only. Readers take the
folders of the highest marker, so a table can be replaced by a query that reads it, a failed or repeated
job leaves no trace in it, and a batch that was appended once is not appended again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MARKERS = "_markers"


class Conflict(RuntimeError):
    """Another writer has committed the number first."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, base: str) -> list[int]:
    path, fs = _path(spark, f"{base}/{MARKERS}")
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def state(spark: SparkSession, base: str) -> dict:
    """What the highest marker says: number, folders, batches, schema; number 0 for no table."""
    numbers = _numbers(spark, base)
    if not numbers:
        return {"number": 0, "folders": [], "batches": [], "schema": None}
    path, fs = _path(spark, f"{base}/{MARKERS}/{numbers[-1]:08d}.json")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {**json.loads(text), "number": numbers[-1]}


def _commit(spark: SparkSession, base: str, number: int, said: dict) -> None:
    path, fs = _path(spark, f"{base}/{MARKERS}/{number:08d}.json")
    try:
        stream = fs.create(path, False)
    except Exception as e:
        raise Conflict(f"{base}: number {number} is taken") from e
    stream.write(bytearray(json.dumps(said).encode()))
    stream.close()


def _add(df: DataFrame, base: str) -> str:
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{folder}")
    return folder


def load(spark: SparkSession, base: str) -> DataFrame:
    """The rows of the committed table."""
    now = state(spark, base)
    if not now["number"]:
        raise FileNotFoundError(f"{base} has no committed table")
    schema = T.StructType.fromJson(now["schema"])
    if not now["folders"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{base}/{f}" for f in now["folders"]])


def replace(df: DataFrame, base: str) -> DataFrame:
    """Replaces the table by `df`, which may read the table itself; returns the stored rows."""
    spark = df.sparkSession
    number = state(spark, base)["number"]
    folder = _add(df, base)
    _commit(spark, base, number + 1, {"folders": [folder], "batches": [], "schema": json.loads(df.schema.json())})
    return load(spark, base)


def replace_by(spark: SparkSession, base: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replaces the table by a query on it."""
    return replace(change(load(spark, base)), base)


def append(df: DataFrame, base: str, batch: str) -> DataFrame:
    """Appends `df` under a batch name; a batch that is in the table already is left alone."""
    spark = df.sparkSession
    now = state(spark, base)
    if batch in now["batches"]:
        return load(spark, base)
    schema = now["schema"] or json.loads(df.schema.json())
    names = [f["name"] for f in schema["fields"]]
    if sorted(names) != sorted(df.columns):
        raise ValueError(f"{base} has the columns {names}, not {df.columns}")
    typed = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in T.StructType.fromJson(schema)])
    folder = _add(typed, base)
    _commit(spark, base, now["number"] + 1, {"folders": [*now["folders"], folder], "batches": [*now["batches"], batch], "schema": schema})
    return load(spark, base)


def clean(spark: SparkSession, base: str, keep: int = 1) -> list[str]:
    """Removes data folders that none of the last `keep` markers lists, and older markers; returns
    the folders. Not to be run beside a writer, whose folder is not listed yet."""
    numbers = _numbers(spark, base)
    if not numbers:
        return []
    listed: set[str] = set()
    for n in numbers[-keep:]:
        path, fs = _path(spark, f"{base}/{MARKERS}/{n:08d}.json")
        stream = fs.open(path)
        listed |= set(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"])
        stream.close()
    path, fs = _path(spark, base)
    gone = [s.getPath().getName() for s in fs.listStatus(path)]
    gone = sorted(n for n in gone if n.startswith("data-") and n not in listed)
    for n in numbers[:-keep]:
        fs.delete(_path(spark, f"{base}/{MARKERS}/{n:08d}.json")[0], False)
    for n in gone:
        fs.delete(_path(spark, f"{base}/{n}")[0], True)
    return gone
