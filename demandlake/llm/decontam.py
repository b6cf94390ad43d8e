"""Benchmark decontamination: rare n-gram seeds join documents to test items, then
Smith-Waterman alignment of words scores exact, edited and paraphrased copies.

Words are runs of letters and digits in lower case. An n-gram is rare by the corpus
frequencies of its words (their product), not by its own count: a leaked passage may
stand in a third of all documents and must still seed. Each item keeps at least its
``MIN_SEEDS`` rarest n-grams, so no item goes unsearched. Items are searched in blocks
of bounded size, each against all documents; nothing of the documents is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import textarrays as ta
from demandlake.llm.shared import read_table, stage

SEED_WORDS = 4
#: Expected chance matches of a rare n-gram per word of text.
RARE = 1e-7
MIN_SEEDS = 8
#: Items per block, and their words: what a block broadcasts is at most 8 * (1 + seeds) bytes a word.
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the item's best possible score, and of its words, that a leak reaches.
MIN_SCORE = 0.5

WORDS_SCHEMA = "item_id bigint, words binary"
HIT_SCHEMA = ("doc_id bigint, row_id bigint, item_id bigint, score double, matched int, item_words int, "
              "doc_from int, doc_to int")


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words: 64-bit word hashes) of the items that have a word; equal texts once, smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for w in ta.word_chunks(ta.normalized(batch.column(1))):
                for k in range(len(w.bounds) - 1):
                    h = w.hash[w.bounds[k]:w.bounds[k + 1]]
                    if len(h):
                        out.append((ids[w.first + k].as_py(), h.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                              pa.array([x[1] for x in out], pa.binary())], ["item_id", "words"])

    rows = items.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, WORDS_SCHEMA)
    return rows.groupBy("words").agg(F.min("item_id").alias("item_id")).select("item_id", "words")


def word_rates(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Corpus counts of the sorted word hashes ``vocabulary`` and of all words, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(shared.value)
        counts, total = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for w in ta.word_chunks(ta.normalized(batch.column(0))):
                at, slot = known.find(w.hash)
                counts += np.bincount(slot, minlength=len(counts))
                total += len(w.hash)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], total))],
                                         ["slot", "n"])

    rows = docs.select(text_col).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    counts, total = np.zeros(len(vocabulary), np.int64), 0
    for slot, n in rows.collect():  # at most one row per word of the item block
        if slot < 0:
            total = n
        else:
            counts[slot] = n
    shared.unpersist()
    return counts, total


class Lookup:
    """Positions of 64-bit hashes in a sorted array, behind a bitmap filter."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(16, int(len(keys)).bit_length() + 5)
        self.shift = np.uint64(64 - self.bits)
        self.may = np.zeros(1 << self.bits, bool)
        self.may[keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, positions in the keys) of all hashes that are keys."""
        at = np.flatnonzero(self.may[hashes >> self.shift])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[slot] == hashes[at]
        return at[same], slot[same]


def choose_seeds(items: list[np.ndarray], rate: dict[int, float]) -> tuple[np.ndarray, ...]:
    """Sorted seed hashes with the item and the position of each: per item all rare
    n-grams, at least the ``MIN_SEEDS`` rarest. Items shorter than an n-gram seed whole."""
    hashes, owner, where = [], [], []
    for k, words in enumerate(items):
        n = min(SEED_WORDS, len(words))
        g = ta.grams(words, n)
        logs = np.log(np.array([rate[int(x)] for x in words]))
        chance = np.array([logs[i:i + n].sum() for i in range(len(g))])
        order = np.argsort(chance, kind="stable")
        take = order[: max(MIN_SEEDS, int((chance <= np.log(RARE)).sum()))]
        hashes.append(g[take] ^ np.uint64(n))
        owner.append(np.full(len(take), k))
        where.append(take)
    h, o, p = np.concatenate(hashes), np.concatenate(owner), np.concatenate(where)
    order = np.argsort(h, kind="stable")
    return h[order], o[order], p[order]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matches, start, end) of the best local alignment of ``a`` within ``b``;
    start and end are positions in ``b``. Ties go to the earliest end."""
    m = len(b)
    steps = np.arange(m + 1) * -GAP
    rows = np.zeros((len(a) + 1, m + 1), np.int32)
    for i in range(1, len(a) + 1):
        best = np.zeros(m + 1, np.int32)
        best[1:] = np.maximum(rows[i - 1, :-1] + np.where(b == a[i - 1], MATCH, MISMATCH), rows[i - 1, 1:] + GAP)
        best = np.maximum(best, 0)
        rows[i] = np.maximum(best, np.maximum.accumulate(best + steps) - steps)  # gaps along b
    end = int(rows.max(axis=0).argmax())
    i, j = int(rows[:, end].argmax()), end
    score, matches = int(rows[i, j]), 0
    while i and j and rows[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if rows[i, j] == rows[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matches += bool(same)
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matches, j, end


def _align(words: np.ndarray, hits: list[tuple[int, int]], item: np.ndarray) -> tuple[int, int, int, int] | None:
    """Best alignment of ``item`` over the windows around its seed hits (position in
    the document, position in the item); windows that overlap are joined."""
    reach = len(item) + len(item) // 2 + 4
    best, last = None, -1
    spans: list[list[int]] = []
    for at, pos in hits:
        lo, hi = max(0, at - pos - reach // 2), min(len(words), at - pos + len(item) + reach // 2)
        if spans and lo <= last:
            spans[-1][0] = min(spans[-1][0], lo)
            spans[-1][1] = last = max(last, hi)
        else:
            spans.append([lo, hi])
            last = hi
    wide = 64 * (len(item) + 16)  # a joined window is searched in overlapping pieces
    for lo, hi in spans:
        for s in range(lo, hi, wide):
            e = min(hi, s + wide + 3 * len(item))
            score, matched, x, y = smith_waterman(item, words[s:e])
            if best is None or score > best[0]:
                best = (score, matched, s + x, s + y)
    return best


def _search(docs: DataFrame, id_col: str, row_col: str, text_col: str, ids: list[int],
            items: list[np.ndarray]) -> DataFrame:
    """Leaks of one block of items in all documents."""
    vocabulary = np.unique(np.concatenate(items))
    counts, total = word_rates(docs, text_col, vocabulary)
    rate = dict(zip(vocabulary.tolist(), ((counts + 1) / (total + len(vocabulary))).tolist(), strict=True))
    seeds = choose_seeds(items, rate)
    shared = docs.sparkSession.sparkContext.broadcast((ids, items, seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, (keys, owner, where) = shared.value
        known = Lookup(np.unique(keys))
        lo, hi = np.searchsorted(keys, known.keys, "left"), np.searchsorted(keys, known.keys, "right")
        sizes = sorted({min(SEED_WORDS, len(x)) for x in items})
        for batch in batches:
            out: list[tuple] = []
            for w in ta.word_chunks(ta.normalized(batch.column(2))):
                doc = w.doc_of()
                found: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for n in sizes:
                    g, at = ta.gram_rows(w, n)
                    hit, slot = known.find(g ^ np.uint64(n))
                    for x, s in zip(at[hit].tolist(), slot.tolist(), strict=True):
                        d = int(doc[x])
                        for k in range(lo[s], hi[s]):
                            found.setdefault((d, int(owner[k])), []).append((x - int(w.bounds[d]), int(where[k])))
                for (d, k), hits in found.items():
                    words = w.hash[w.bounds[d]:w.bounds[d + 1]]
                    score, matched, x, y = _align(words, sorted(hits), items[k])
                    if score >= MIN_SCORE * MATCH * len(items[k]):
                        r = w.first + d
                        out.append((batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), ids[k],
                                    score / (MATCH * len(items[k])), matched, len(items[k]), x, y))
            names = [c.split()[0] for c in HIT_SCHEMA.split(", ")]
            kinds = [pa.int64()] * 3 + [pa.float64()] + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

    return docs.select(F.col(id_col).cast("bigint"), row_col, text_col).mapInArrow(run, HIT_SCHEMA)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document and item found in it: doc_id, row_id (``row_col``, else null),
    item_id, score (share of the best possible alignment score, at least ``MIN_SCORE``),
    matched and item_words (word counts), doc_from and doc_to (word span).

    Items without a word, and null or empty texts, match nothing. Items of equal words are
    searched once under their smallest id. Repeated documents each give rows; null ids
    are carried as null. No items or no documents: no rows. Extra columns are ignored."""
    spark = docs.sparkSession
    words = stage(item_words(items, item_id_col, item_text_col), "items")
    size = words.agg(F.count("*"), F.coalesce(F.sum(F.length("words") / 8), F.lit(0)),
                     F.coalesce(F.max(F.length("words") / 8), F.lit(0))).first()
    blocks = int(max(1, -(-size[0] // BLOCK_ITEMS), -(-size[1] // BLOCK_WORDS)))
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       (F.col(row_col) if row_col else F.lit(None).cast("bigint")).alias("row_id"),
                       F.col(text_col).alias("text"))
    numbered = words.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    found = spark.createDataFrame([], HIT_SCHEMA)
    for block in range(blocks):
        part = [(r.item_id, np.frombuffer(r.words, np.uint64)) for r in
                numbered.filter(F.col("block") == block).select("item_id", "words").collect()]
        part.sort(key=lambda x: (x[0] is None, x[0] or 0))
        if part:
            hits = _search(rows, "doc_id", "row_id", "text", [i for i, _ in part], [x for _, x in part])
            found = found.union(stage(hits, f"leaks{block}"))
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item was found; columns unchanged.

    Rows are numbered in a staged copy, so of rows that share an id only those with a leak go. Null and empty texts
    have none; repeated rows go alike; very long texts are searched whole; an empty table stays empty."""
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row_id"),
                             F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")), "rows")
    whole = F.col("whole")
    leaks = find_leaks(rows.select("row_id", whole[id_col].alias("doc_id"), whole[text_col].alias("text")), items,
                       row_col="row_id")
    gone = stage(leaks.select("row_id").distinct(), "leaked")  # a table, so its size is known
    return rows.join(gone, "row_id", "left_anti").select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("row_id")
