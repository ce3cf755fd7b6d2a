"""Tables in the cluster's shared folder, so that lost executors cost no recomputation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .session import shared_dir

ROWS_A_TASK = 20_000  # of tables of so few rows that tasks and files would outweigh them
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20  # texts go to Python in batches of so much, not of 10,000 rows


class Stages:
    """``save`` writes a DataFrame as Parquet and reads it again, which also cuts its lineage;
    ``drop`` deletes tables that later ones have replaced, ``keep_only`` all but those a result still reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.written: set[str] = set()

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """``most``, where it is known, bounds the rows: a small table is written by few tasks, into few
        files."""
        path = self.path(name)
        few = -(-most // ROWS_A_TASK) if most is not None else None
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(1, few)) if few is not None and few < spread else df
        # a query's shuffle files go when it ends: its result is a table by then
        with held(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH_SETTING: str(BATCH_BYTES)}):
            df.write.parquet(path)
        self.written.add(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._vigilake_path, saved._vigilake_rows = path, None
        return saved

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, df._vigilake_path)
            self.written.discard(df._vigilake_path)

    def keep_only(self, *tables: DataFrame) -> None:
        for path in self.written - {df._vigilake_path for df in tables}:
            delete(self.spark, path)
            self.written.discard(path)


def rows_of(saved: DataFrame) -> int:
    """How many rows ``save`` wrote, by the files' own counts. (An observation of the write would tell it
    too, but leaves the session an object that models trained in it can't be shipped with.)"""
    if saved._vigilake_rows is None:
        saved._vigilake_rows = saved.count()
    return saved._vigilake_rows


def _at(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, store = _at(spark, path)
    return store.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """What stands in a folder; nothing where there is none."""
    target, store = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    target, store = _at(spark, f"{path}.part")
    out = store.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename(spark, f"{path}.part", path)


def rename(spark: SparkSession, path: str, to: str) -> None:
    target, store = _at(spark, path)
    if not store.rename(target, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't become {to}")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file of whatever store, if it is there."""
    target, store = _at(spark, path)
    store.delete(target, True)


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Within it the session has these settings."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
