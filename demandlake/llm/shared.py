"""Small helpers shared by the operators: staged tables and free column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from demandlake.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    for paths in _RECORDED:
        paths.append(path)
    return path


_RECORDED: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The work folders that are made inside, so that a caller can drop them when their reader is done."""
    paths: list[str] = []
    _RECORDED.append(paths)
    try:
        yield paths
    finally:
        _RECORDED.remove(paths)


def drop_folders(spark: SparkSession, paths: list[str], still_read_by: DataFrame) -> list[str]:
    """Deletes the folders that ``still_read_by`` does not read; returns the others."""
    folders = {part for f in still_read_by.inputFiles() for part in f.split("/")}  # of the form of ``work_path``
    kept = [p for p in paths if p.rsplit("/", 1)[1] in folders]
    for path in set(paths) - set(kept):
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    return kept


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage and survives lost executors (no copy lives on an executor only).
    ``arrow_rows`` bounds the rows that this write hands to a Python worker at once,
    for rows that hold whole texts."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    before = spark.conf.get(ARROW_ROWS)
    try:
        if arrow_rows:
            spark.conf.set(ARROW_ROWS, str(arrow_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
