"""Token counts as delta-maintained rollups.

Changes of documents (insert, revise, delete) become signed rows: the old count of a
document with sign -1, its new count with sign +1. Their sums by source, language and
tokenizer version are added to running totals, so a batch costs its own size and not
the corpus's. A batch is committed once: its rows are written under a fresh
attempt folder first and then named by one row in the commit table; a batch id that has been
committed is skipped, and folders of attempts that were never named are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm.shared import read_table, work_path

KEYS = ("source", "lang", "tokenizer")
CHANGES = "doc_id bigint, op string, source string, lang string, tokenizer string, n_tokens bigint"
SIGNED = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, sign int"
COMMITS = "batch bigint, attempt string"
COUNTERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[^\x20\x09-\x0D.,|]+|[.,|]"}


def count_tokens(text: Column, version: str) -> Column:
    """Matches of the version's pattern; 0 for null texts."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[version])), F.lit(0)).cast("bigint")


class Rollup:
    """Totals under ``folder`` (shared storage). Single writer; readers may run at any time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], COMMITS).write.mode("append").parquet(f"{folder}/commits")

    def commits(self) -> list[tuple[int, str]]:
        """(batch, attempt) in order of batch; of two commits of one batch the first attempt name counts."""
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits").groupBy("batch").agg(
            F.min("attempt").alias("attempt")).orderBy("batch").collect()
        return [(r.batch, r.attempt) for r in rows]

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{attempt}" for _, attempt in self.commits()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def current(self) -> DataFrame:
        """Documents counted now: rows of ``SIGNED`` that no later row takes back."""
        return self._read("signed", SIGNED).groupBy("doc_id", *KEYS, "n_tokens").agg(
            F.sum("sign").alias("copies")).filter("copies <> 0")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies the changes (columns of ``CHANGES``) as batch ``batch``; False when it was committed before.

        ``op`` insert or revise sets the count of (doc_id, tokenizer), whatever it was; delete takes it
        away, for all tokenizers when ``tokenizer`` is null. Deletes of unknown documents change
        nothing. Several changes of one key in a batch: the last by (op, source, lang, n_tokens)
        counts, revise over insert over delete; equal rows count once. Null ids form one document;
        null source, language or tokenizer (of an insert or revise) is a group of its own; a null count is 0. An
        empty batch is committed and changes nothing. Other columns are ignored."""
        if batch in dict(self.commits()):
            return False
        attempt = f"batch={batch}-{uuid.uuid4().hex}"
        changes = changes.select("doc_id", F.lower("op").alias("op"), *KEYS,
                                 F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
        value = F.struct(F.col("op"), F.col("source"), F.col("lang"), F.col("n_tokens"))
        latest = changes.filter("tokenizer is not null or op <> 'delete'").groupBy("doc_id", "tokenizer").agg(F.max(value).alias("v"))
        latest = latest.select("doc_id", "tokenizer", "v.*")
        known = self.current()
        gone = changes.filter("op = 'delete' and tokenizer is null").select("doc_id").distinct()
        touched = latest.select("doc_id", "tokenizer")
        same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
        old = known.join(touched, same(known, touched, "doc_id", "tokenizer"), "left_semi").union(
            known.join(gone, same(known, gone, "doc_id"), "left_semi")).distinct()
        minus = old.select("doc_id", *KEYS, "n_tokens", (-F.col("copies")).cast("int").alias("sign"))
        plus = latest.filter("op <> 'delete'").select("doc_id", *KEYS, "n_tokens", F.lit(1).alias("sign"))
        minus.union(plus).write.parquet(f"{self.folder}/signed/{attempt}")
        signed = self.spark.read.schema(SIGNED).parquet(f"{self.folder}/signed/{attempt}")
        signed.groupBy(*KEYS).agg(
            F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")
        ).write.parquet(f"{self.folder}/deltas/{attempt}")
        self.spark.createDataFrame([(batch, attempt)], COMMITS).coalesce(1).write.mode("append").parquet(
            f"{self.folder}/commits")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens): the sum of all committed deltas; groups that
        hold no document any more are left out."""
        schema = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
        return self._read("deltas", schema).groupBy(*KEYS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")


def change_feed(docs: DataFrame, op: str, version: str) -> DataFrame:
    """Changes of one kind for all ``docs``."""
    return docs.select("doc_id", F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"),
                       count_tokens(F.col("text"), version).alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after four batches: all are inserted with the first tokenizer version; those whose
    text an earlier document has are deleted; all but these are counted by the second version as well; labelled
    ones of low quality have their first count revised to 0. Each batch is sent twice."""
    docs = read_table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", F.sha2("text", 256).alias("hash"))
    firsts = texts.groupBy("hash").agg(F.min("doc_id").alias("first"))
    copies = texts.join(firsts, texts["hash"].eqNullSafe(firsts["hash"])).filter("doc_id <> first").select("doc_id")
    bad = read_table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    deleted = copies.select("doc_id", F.lit("delete").alias("op"), *[F.lit(None).cast("string").alias(k) for k in KEYS],
                            F.lit(0).alias("n_tokens"))
    rest = docs.join(copies, "doc_id", "left_anti")
    revised = rest.join(bad, "doc_id", "left_semi").select(
        "doc_id", F.lit("revise").alias("op"), "source", "lang", F.lit("words-1").alias("tokenizer"),
        F.lit(0).alias("n_tokens"))
    batches = [change_feed(docs, "insert", "words-1"), deleted, change_feed(rest, "insert", "words-2"), revised]
    rollup = Rollup(spark, work_path(spark, "rollup"))
    for k, changes in enumerate(batches):
        for _ in range(2):
            rollup.commit(k, changes)
    return rollup.totals()


SQL = r"""
WITH kept AS (SELECT * FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)),
bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
counted AS (
  SELECT source, lang, 'words-1' AS tokenizer, CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN 0 ELSE
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS n FROM kept
  UNION ALL
  SELECT source, lang, 'words-2', len(regexp_extract_all(text, '[^\x20\x09-\x0D.,|]+|[.,|]')) FROM kept)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counted
GROUP BY source, lang, tokenizer
"""
