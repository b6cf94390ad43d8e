"""A stored keyed table whose merges rewrite only the parts they touch (C4, S3).

Rows are dealt over ``parts`` hash parts of their key. A version (see
``sources.versions``) maps every part to the folder that holds it now; a merge reads
and rewrites the parts of its batch's keys, writes them to a folder of its own and
commits a version that points there. Parts without a key in the batch are neither
read nor written. Two merges at once: one commits, the other merges again on top of
the new version.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.operators.contract import upsert
from demandlake.session import stored
from demandlake.sources.versions import VersionLog

PART = "_part"


class StoredTable:
    """One row per ``keys``; of several the one with the largest ``order`` is kept (as in ``contract.upsert``)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], order: str, parts: int = 64):
        self.spark, self.folder, self.keys, self.order, self.parts = spark, folder, list(keys), order, parts
        self.schema = spark.createDataFrame([], schema).schema
        self.log = VersionLog(spark, folder)

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.parts)).cast("int")

    def _read(self, folders: dict[str, str], parts: Sequence[str]) -> DataFrame:
        paths = [f"{self.folder}/{folders[p]}/{PART}={p}" for p in parts if p in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the newest); empty before the first."""
        entry = self.log.latest()[1] if version is None else self.log.entry(version)
        folders = entry["folders"] if entry else {}
        return self._read(folders, sorted(folders, key=int))

    def merge(self, batch: DataFrame) -> int:
        """Merges the batch's rows and returns the version that holds them. Rows of a null key form a key
        like any other; an empty batch makes no version."""
        batch = stored(batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]), "batch")  # read twice
        touched = [str(r[0]) for r in batch.select(self.part_of()).distinct().collect()]  # at most ``parts`` numbers

        def rewrite(number: int, entry: dict | None) -> dict | None:
            folders = dict(entry["folders"]) if entry else {}
            if not touched:
                return None
            target = f"data/{uuid.uuid4().hex}"
            # grouped by part as well, so the rows are shuffled once, a part over many tasks
            old, new = (df.withColumn(PART, self.part_of()) for df in (self._read(folders, touched), batch))
            upsert(old, new, [PART, *self.keys], self.order).select(*self.schema.names, PART).write.partitionBy(PART).parquet(
                f"{self.folder}/{target}")
            return {"folders": folders | dict.fromkeys(touched, target), "rewritten": sorted(touched, key=int)}

        return self.log.update(rewrite) or self.log.latest()[0]
