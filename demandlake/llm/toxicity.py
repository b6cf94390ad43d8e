"""Toxicity by multiple-instance learning: a document is a bag of sentences, each sentence
has a logistic score of its words, and the document's score is their noisy-or,
``1 - prod(1 - p)``. Only document labels are needed for training; the sentence scores
then say which sentences offend.

Sentences end at . ! ? or a line end; words are runs of letters and digits in lower case.
A word has three features, itself and its first 4 and 5 bytes (word stems), hashed to
``BUCKETS`` weights. Features that toxic training documents do not have clearly more often are
left at weight 0 (``MIN_Z``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import textarrays as ta
from demandlake.llm.shared import read_table, stage

BITS = 20
BUCKETS = 1 << BITS
#: Labelled documents that the classifier is fitted on, at most (chosen by a hash of the id).
MAX_TRAIN = 12_000
MIN_DOCS, MIN_Z = 5, 3.0
STEPS, RATE, PENALTY = 60, 0.3, 1e-5
STEMS = (4, 5)
FEATURES = 1 + len(STEMS)


@dataclass
class Model:
    weights: np.ndarray  # float32 per bucket
    bias: float


def _buckets(w: ta.Words) -> np.ndarray:
    """The features of each word: FEATURES rows."""
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in (w.hash, *w.prefixes)])


def _sentences(w: ta.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence that has words, and the document of each."""
    doc = w.doc_of()
    if not len(doc):
        return np.zeros(0, np.int64), doc
    new = np.concatenate(([True], (np.diff(w.sentence) != 0) | (np.diff(doc) != 0)))
    first = np.flatnonzero(new)
    return first, doc[first]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int, id_col: str, text_col: str, label_col: str,
                    allowed: Column) -> DataFrame:
    """(text, label) of at most about ``max_docs`` labelled documents for which ``allowed`` (of the id) holds.
    An id labelled twice takes the larger label; rows without id, text or label are left out."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(
        known, "id").filter(allowed)
    n = max(1, rows.select("id").count())
    share = F.lit(min(1_000_000, max_docs * 1_000_000 // n))
    return rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).select("text", "label")


def fit(sample: DataFrame) -> Model:
    """The model of a bounded (text, label) sample, by full-batch gradient steps (Adam) on the noisy-or
    likelihood. Tasks count the features of each label first; only the features that pass the
    screening, and where they stand in the sample's sentences, reach the driver. Without both labels
    in the sample all scores are the label's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        docs = np.zeros(2, np.int64)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for w in ta.word_chunks(ta.normalized(batch.column(0)), STEMS):
                b = _buckets(w)
                for k in range(len(w.bounds) - 1):
                    y = int(labels[w.first + k] > 0)
                    docs[y] += 1
                    seen[y, np.unique(b[:, w.bounds[k]:w.bounds[k + 1]])] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(seen[0, at], docs[0])),
             pa.array(np.append(seen[1, at], docs[1]))], ["feature", "clean", "toxic"])

    counts = sample.mapInArrow(count, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stage(counts, "features")
    total = counts.filter("feature < 0").first()
    clean, toxic = (total["clean"], total["toxic"]) if total else (0, 0)
    if not clean or not toxic:
        return Model(np.zeros(BUCKETS, np.float32), 20.0 if toxic else -20.0)
    n, share = clean + toxic, toxic / (clean + toxic)
    has = F.col("clean") + F.col("toxic")
    z = (F.col("toxic") - share * has) / F.sqrt(has * (share * (1 - share)))
    used = np.sort(np.array([r.feature for r in counts.filter("feature >= 0").filter(
        (has >= min(MIN_DOCS, max(1, n // 50))) & (z >= MIN_Z)).select("feature").collect()], np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(BUCKETS, -1, np.int32)
        slot[used] = np.arange(len(used))
        for batch in batches:
            labels = batch.column(1).to_pylist()
            out = []
            for w in ta.word_chunks(ta.normalized(batch.column(0)), STEMS):
                kinds = slot[_buckets(w)]
                first, doc = _sentences(w)
                kind, word = np.nonzero(kinds >= 0)
                sentence = np.searchsorted(first, word, "right") - 1
                pair = np.unique(sentence.astype(np.int64) << BITS | kinds[kind, word])  # once in a sentence
                cut = np.searchsorted(doc, np.arange(len(w.bounds)))
                at = np.searchsorted(pair, cut.astype(np.int64) << BITS)
                for k in range(len(w.bounds) - 1):
                    mine = pair[at[k]:at[k + 1]] - (int(cut[k]) << BITS)
                    out.append((int(labels[w.first + k] > 0), int(cut[k + 1] - cut[k]), mine.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()),
                 pa.array([x[2] for x in out], pa.binary())], ["label", "sentences", "pairs"])

    rows = sample.mapInArrow(place, "label int, sentences int, pairs binary").orderBy("label", "sentences", "pairs").toArrow()
    pairs = [np.frombuffer(x.as_py(), "<i8") for x in rows.column("pairs")]
    return fit_bags(used, rows.column("label").to_numpy().astype(np.float64),
                    rows.column("sentences").to_numpy(), pairs)


def fit_bags(used: np.ndarray, label: np.ndarray, sentences: np.ndarray, pairs: list[np.ndarray]) -> Model:
    """The same from the features ``used`` and each document's label, number of sentences and (sentence, index in
    ``used``) pairs, packed with ``BITS`` low bits."""
    n = len(label)
    starts = np.concatenate(([0], np.cumsum(sentences)))
    size = np.empty(starts[-1])
    sent_doc = np.repeat(np.arange(n), sentences)
    sent = np.concatenate([(p >> BITS) + s for p, s in zip(pairs, starts, strict=False)])
    flat = np.concatenate([p & (BUCKETS - 1) for p in pairs])
    weights = np.zeros(BUCKETS, np.float32)
    w, bias = np.zeros(len(used)), -float(np.log(max(2.0, len(size) / max(1.0, label.sum()))))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sent, weights=w[flat], minlength=len(size))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(sent_doc, weights=-_softplus(z), minlength=n)  # log of prod(1 - p)
        any_bad = np.maximum(-np.expm1(clean), 1e-9)
        pull = np.where(label > 0, -np.exp(clean) / any_bad, 1.0)
        g = p * pull[sent_doc] / n
        grad = np.append(np.bincount(flat, weights=g[sent], minlength=len(used)) + PENALTY * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        w -= move[:-1]
        bias -= move[-1]
    weights[used] = w
    return Model(weights, float(bias))


def _score_chunk(w: ta.Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, sentence number in the document, logit) of every sentence that has words."""
    first, doc = _sentences(w)
    if not len(first):
        return doc, doc, np.zeros(0)
    b = _buckets(w)
    kind, word = np.nonzero(model.weights[b])
    hot = b[kind, word].astype(np.int64)
    owner = np.searchsorted(first, word, "right") - 1
    pair = np.unique(owner << BITS | hot)  # a feature counts once in a sentence
    z = model.bias + np.bincount(pair >> BITS, weights=model.weights[pair & (BUCKETS - 1)], minlength=len(first))
    return doc, first, z


def score(text: Column, model: Model, spark: SparkSession) -> Column:
    """Noisy-or of the sentence scores, 0 to 1; null texts and texts without a word have 0."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for w in ta.word_chunks(ta.normalized(texts), STEMS):
            doc, _, z = _score_chunk(w, shared.value)
            clean = np.bincount(doc, weights=-_softplus(z), minlength=len(w.bounds) - 1)
            out[w.first:w.first + len(clean)] = -np.expm1(clean)
        return pa.array(np.clip(out, 0.0, 1.0) + 0.0)  # no negative zeros

    return run(text)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """(doc_id, sentence, score) of every sentence that scores at least ``least`` by itself: ``sentence`` counts
    the sentence ends before it, as in ``re.split("[.!?\\n]", text)[sentence]``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower, out = ta.normalized(batch.column(1)), []
            for w in ta.word_chunks(lower, STEMS):
                doc, first, z = _score_chunk(w, shared.value)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                for s in np.flatnonzero(p >= least):
                    r = w.first + int(doc[s])
                    before = lower[r].as_py().encode()[:w.start[first[s]]]
                    out.append((batch.column(0)[r].as_py(), len(re.findall(rb"[.!?\n]", before)), float(p[s])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()),
                 pa.array([x[2] for x in out], pa.float64())], ["doc_id", "sentence", "score"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(
        run, "doc_id bigint, sentence int, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model from labelled documents that are not held out."""
    sample = training_sample(docs, labels, max_docs, id_col, text_col, label_col, ~held_out(F.col("id")))
    return fit(stage(sample, "sample"))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. Repeated rows score alike; null and
    empty texts score 0; an empty table gives no rows; extra columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       score(F.col(text_col), model, docs.sparkSession).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))
