"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.llm.components import connected_components
from demandlake.llm.shared import stage

_PART = 1 << 15
#: texts handed to a Python worker at once
TEXT_ROWS = 500


def simhash(text: str | None, words: int) -> int:
    """Unsigned fingerprint: majority bit over the XXH64 (seed 42) of all word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)))
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(shingles), _PART):
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles[lo:lo + _PART]], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # sums of up to 255 rows fit a byte: add within blocks first
        full = len(bits) // 255 * 255
        if full:
            counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """Column of 64-bit fingerprints (signed long); null and empty texts have 0."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        out = np.fromiter((simhash(t.as_py(), words) for t in texts), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return run(text)


def ball_masks(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``max_distance`` bits.

    Every fingerprint emits all variants within half the distance; two that are
    close enough meet at a variant midway. A variant's ball holds a bounded number
    of fingerprints (65 for distance 2), all within ``max_distance`` of each other,
    so each is linked to the smallest: links grow linearly and none is lost for
    the components. ``max_distance`` must be even."""
    if max_distance % 2:
        raise ValueError("max_distance must be even: balls of half the distance meet in the middle")
    masks = F.array(*[F.lit(m).cast("bigint") for m in ball_masks(max_distance // 2)])
    ball = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    groups = ball.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n"))
    groups = groups.filter("n > 1")
    two = groups.filter("n = 2").select("a", F.col("z").alias("b"))
    # fuller balls: their members lie within the same masks of the variant
    more = groups.filter("n > 2").select("a", "v", F.explode(masks).alias("m"))
    more = more.select("a", F.col("v").bitwiseXOR(F.col("m")).alias("b")).distinct().join(
        fps.select(F.col("fp").alias("b")), "b").select("a", "b")
    links = two.union(more).filter("a <> b").distinct()
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    max_distance: int = 2, row_col: str | None = None) -> DataFrame:
    """One row per input row: ``row_id``, ``doc_id``, ``fp`` (long), ``component_id`` and ``first``.

    ``component_id`` is the smallest id reachable over fingerprints within
    ``max_distance`` bits; ``first`` marks one row per component (smallest id, then
    smallest ``row_id``, which numbers the input rows or is the column ``row_col``, unique longs). Texts travel to the
    fingerprint only; every later step carries ids and fingerprints.
    Null and empty texts have fingerprint 0 and are linked like any other. Null ids
    sort last: a component of null ids only has a null ``component_id``. Repeated rows
    share a component. Very long texts are hashed in bounded parts. An empty table gives no rows. Extra columns,
    whatever their names, are ignored."""
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row_id"), F.col(id_col).alias("doc_id"),
                       fingerprint(F.col(text_col), words).alias("fp"))
    rows = stage(rows, "fingerprints", arrow_rows=TEXT_ROWS)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_id").alias("row"))
    classes = rows.groupBy("fp").agg(F.min(rank).alias("low"))
    classes = stage(classes, "classes")
    comps = connected_components(ball_links(classes.select("fp"), max_distance))
    comps = comps.select(F.col("node").alias("fp"), "component")
    classes = classes.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = classes.groupBy("component").agg(F.min("low").alias("first"))
    heads = classes.join(lows, "component").select("fp", "first")
    out = rows.join(heads, "fp")
    return out.select("row_id", "doc_id", "fp", F.col("first")["id"].alias("component_id"),
                      (F.col("row_id") == F.col("first")["row"]).alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                         max_distance: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate component (see ``near_duplicates``),
    all columns unchanged; any column names are allowed."""
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row_id"),
                             F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")), "rows")
    whole = F.col("whole")
    found = near_duplicates(rows.select("row_id", whole[id_col].alias("doc_id"), whole[text_col].alias("text")),
                            "doc_id", "text", words, max_distance, row_col="row_id")
    gone = stage(found.filter("not first").select("row_id"), "superfluous")  # a table, so its size is known
    return rows.join(gone, "row_id", "left_anti").select("whole.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = near_duplicates(docs)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
