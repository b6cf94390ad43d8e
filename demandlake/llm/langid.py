"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams tells the languages
with a one from those with a zero: the log ratio of the n-gram distributions of both halves, averaged over a text.
Decoding takes the codeword of least loss, where the loss of a bit is weighted by how well its classifier does on
training documents of that language (at most ``MAX_CHECK`` in all); a text is ambiguous if the next codeword is nearly as close.

Texts are lower-cased; ASCII other than letters counts as one space. N-grams are ``LENGTHS`` bytes long. All labelled
documents are counted, in a pass that gives per-language counts in ``CHUNKS`` pieces of the buckets; no
per-language table reaches the driver, only weights of bits x ``BUCKETS`` and a few numbers per language and bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import textarrays as ta
from demandlake.llm.shared import read_table, stage

BITS = 17
BUCKETS = 1 << BITS
CHUNKS = 32
WIDTH = BUCKETS // CHUNKS
LENGTHS = (1, 2, 3, 4)
#: bytes of text whose n-grams are held at once
WINDOW = 1 << 18
#: bytes of text that are folded at once
SLICE = 1 << 21
SMOOTHING = 0.1
#: languages up to which all splits into two halves are bits; beyond, ``BITS_PER_DOUBLING`` random bits for each doubling
EXHAUSTIVE, BITS_PER_DOUBLING, TRIES, SEED = 7, 10, 64, 11
#: labelled documents on which the bits' accuracies and margins are measured, at most (chosen by a hash of the text)
MAX_CHECK = 40_000
#: a typical margin of a bit counts as this logit
SHARPNESS = 3.0
#: a text is ambiguous if the losses of the two nearest codewords differ by less
LEAST_LEAD = 0.05
UNKNOWN = "und"


# -- codewords ---------------------------------------------------------------------

def codewords(n: int) -> np.ndarray:
    """Codewords (n x bits, entries 0 and 1) of n languages. No bit is constant or the complement of another for few
    languages; for many, the random code of greatest least distance among ``TRIES`` is taken."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        return np.array([[1] + [m >> k & 1 for k in range(n - 1)] for m in range((1 << (n - 1)) - 1)], np.int8).T
    rng, best, least = np.random.default_rng(SEED), None, -1
    for _ in range(TRIES):
        code = rng.integers(0, 2, (n, int(np.ceil(BITS_PER_DOUBLING * np.log2(n)))), dtype=np.int8)
        code[rng.integers(n), code.all(axis=0)] = 0
        code[rng.integers(n), ~code.any(axis=0)] = 1
        ones = code.astype(np.int32)
        apart = ones @ (1 - ones).T
        apart = apart + apart.T
        distance = int(apart[~np.eye(n, dtype=bool)].min())
        if distance > least:
            best, least = code, distance
    return best


def least_distance(code: np.ndarray) -> int:
    return min((int((a != b).sum()) for a, b in combinations(code, 2)), default=0)


# -- n-grams -----------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalpha():
        _FOLD[_b] = 32
_ODD = np.uint32(0x9E3779B1)
#: bucket of places where no whole n-gram begins; its weight is 0
NOTHING = BUCKETS


def bucket_of(code: np.ndarray, length: int) -> np.ndarray:
    """Buckets of n-grams whose bytes, first highest, make the 32-bit ``code``."""
    return ((code + np.uint32(length * 0x3C6EF372 % 2**32)) * _ODD >> np.uint32(32 - BITS)).astype(np.intp)


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about ``SLICE`` bytes (a longer text alone), each with the number of its first text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + SLICE, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


class Grams:
    """N-grams of the folded texts. A window is some whole texts of ``WINDOW`` bytes in all, or a part of a longer text,
    counted from its start, so a text's sums do not depend on the texts beside it."""

    def __init__(self, texts: pa.Array):
        lower = ta.normalized(texts)
        n = len(lower)
        cuts = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset:lower.offset + n + 1]
        body = lower.buffers()[2]
        data = _FOLD[np.frombuffer(body, np.uint8)[cuts[0]:cuts[-1]]] if body else np.zeros(0, np.uint8)
        cuts = cuts - cuts[0]
        keep = data != 32
        keep[1:] |= keep[:-1]
        some = np.flatnonzero(np.diff(cuts))
        keep[cuts[some]] = True
        size = np.zeros(n, np.int64)
        if len(some):
            size[some] = np.add.reduceat(keep, cuts[some], dtype=np.int64)
        self.data, self.cuts = data[keep], np.concatenate(([0], np.cumsum(size)))

    def totals(self) -> np.ndarray:
        """Number of n-grams of each text."""
        size = np.diff(self.cuts)
        return sum(np.maximum(size - k + 1, 0) for k in LENGTHS)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, where each begins, bucket of the n-gram at every place): one for each length and window."""
        cuts, n, lo = self.cuts, len(self.cuts) - 1, 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + WINDOW, "right")) - 1)
            who = lo + np.flatnonzero(np.diff(cuts[lo:hi + 1]))
            for a in range(int(cuts[lo]), int(cuts[hi]), WINDOW):
                b = min(a + WINDOW, int(cuts[hi]))
                starts = np.maximum(cuts[who] - a, 0)
                ends = cuts[who + 1] - a
                part = np.zeros(b - a + max(LENGTHS), np.uint32)
                whole = self.data[a:min(b + max(LENGTHS), int(cuts[hi]))]
                part[:len(whole)] = whole
                code = np.zeros(b - a, np.uint32)
                for k in range(1, max(LENGTHS) + 1):
                    code = code << np.uint32(8) | part[k - 1:k - 1 + b - a]
                    if k in LENGTHS:
                        bucket = bucket_of(code, k)
                        over = (ends[:, None] - np.arange(1, k)).ravel()  # these run over the end of a text
                        bucket[over[(over >= 0) & (over < b - a)]] = NOTHING
                        yield who, starts, bucket
            lo = hi


# -- training ----------------------------------------------------------------------

@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # langs x bits, 0 and 1
    weights: np.ndarray  # bits x BUCKETS, float32
    scale: np.ndarray  # per bit
    trust: np.ndarray  # langs x bits, rows sum to 1

    def margins(self, texts: pa.Array) -> np.ndarray:
        """texts x bits: the mean weight of the n-grams, 0 without any."""
        total = np.zeros((len(texts), len(self.scale)))
        weights = np.pad(self.weights, ((0, 0), (0, 1)))
        for first, part in slices(texts):
            grams = Grams(part)
            mine = total[first:first + len(part)]
            for who, starts, bucket in grams.windows():
                for j, w in enumerate(weights):
                    mine[who, j] += np.add.reduceat(np.take(w, bucket), starts)
            mine /= np.maximum(grams.totals(), 1)[:, None]
        return total

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """texts x langs: the weighted mean over the bits of the logistic loss of the margins."""
        z = SHARPNESS * margins / self.scale
        sign = 2.0 * self.code - 1
        out = np.zeros((len(z), len(self.langs)))
        for j in range(z.shape[1]):
            out += self.trust[:, j] * np.logaddexp(0.0, -z[:, j, None] * sign[:, j])
        return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, chunk, n, counts): n-grams of all texts of a language, in all and as 64-bit counts of the chunk's
    buckets. Every task adds up its own texts first, so a language of a third of all rows costs a few rows per task."""
    schema = "lang string, chunk int, n bigint, counts binary"

    def rows(found: dict[tuple[str, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (lang, chunk), n in found.items():
            yield _table({"lang": ([lang], pa.string()), "chunk": ([chunk], pa.int32()),
                          "n": ([int(n.sum())], pa.int64()), "counts": ([n.astype("<i8").tobytes()], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = batch.column(0).filter(pc.equal(langs.indices, k))
                n = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, part in slices(mine):
                    for _, _, bucket in Grams(part).windows():
                        n += np.bincount(bucket, minlength=BUCKETS + 1)[:BUCKETS]
        yield from rows({(lang, c): n[c * WIDTH:(c + 1) * WIDTH] for lang, n in found.items() for c in range(CHUNKS)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, chunk, _, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(counts, "<i8")
                found[lang, chunk] = found[lang, chunk] + n if (lang, chunk) in found else n
        yield from rows(found)

    parts = sample.select("text", "lang").mapInArrow(count, schema).repartition("lang", "chunk")
    return stage(parts.mapInArrow(add, schema), "grams")


def bit_weights(counts: DataFrame, totals: dict[str, int], code: np.ndarray) -> np.ndarray:
    """bits x BUCKETS: log ratio of the mean smoothed distributions of the languages with a one and a zero."""
    langs = {lang: i for i, lang in enumerate(sorted(totals))}
    size = np.array([totals[lang] for lang in langs], float)[:, None]
    share = {b: (code == b).T / (code == b).sum(axis=0)[:, None] for b in (0, 1)}

    def weigh(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        n = np.zeros((len(langs), WIDTH))
        for lang, counts in zip(t.column("lang").to_pylist(), t.column("counts").to_pylist(), strict=True):
            n[langs[lang]] = np.frombuffer(counts, "<i8")
        p = (n + SMOOTHING) / (size + SMOOTHING * BUCKETS)
        w = np.log(share[1] @ p) - np.log(share[0] @ p)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()),
                         "weights": pa.array([w.astype("<f4").tobytes()], pa.binary())})

    rows = counts.groupBy("chunk").applyInArrow(weigh, "chunk int, weights binary").collect()
    out = np.zeros((code.shape[1], BUCKETS), np.float32)
    for r in rows:
        out[:, r.chunk * WIDTH:(r.chunk + 1) * WIDTH] = np.frombuffer(r.weights, "<f4").reshape(-1, WIDTH)
    return out


def fit(sample: DataFrame) -> Model:
    """The model of (text, lang) rows, null langs left out. Without a row there is no language, and with one
    language no bit."""
    sample = sample.filter("lang is not null")
    counts = gram_counts(sample)
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    code = codewords(len(langs))
    bits = code.shape[1]
    model = Model(langs, code, np.zeros((0, BUCKETS), np.float32), np.ones(bits), np.zeros((len(langs), bits)))
    if not bits:
        return model
    model.weights = bit_weights(counts, totals, code)
    shared = sample.sparkSession.sparkContext.broadcast(model)
    place = {lang: i for i, lang in enumerate(langs)}

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, right, size = (np.zeros((len(langs), bits)) for _ in range(3))
        for batch in batches:
            m = shared.value.margins(batch.column(0))
            at = np.array([place.get(lang, -1) for lang in batch.column(1).to_pylist()])
            for i in np.unique(at[at >= 0]):
                mine = m[at == i]
                n[i] += len(mine)
                right[i] += ((mine > 0) == (code[i] > 0)).sum(axis=0)
                size[i] += np.abs(mine).sum(axis=0)
        i, j = np.nonzero(n)
        yield _table({"lang": (i, pa.int32()), "bit": (j, pa.int32()), "n": (n[i, j], pa.float64()),
                      "good": (right[i, j], pa.float64()), "size": (size[i, j], pa.float64())})

    share = min(1_000_000, MAX_CHECK * 1_000_000 // max(1, sample.count()))
    some = sample.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share)
    found = some.select("text", "lang").mapInArrow(check, "lang int, bit int, n double, good double, size double")
    n, size, good = np.zeros(bits), np.zeros(bits), np.full((len(langs), bits), 0.5)
    for r in found.groupBy("lang", "bit").agg(*[F.sum(c).alias(c) for c in ("n", "good", "size")]).collect():
        n[r.bit] += r.n
        size[r.bit] += r["size"]
        good[r.lang, r.bit] = (r.good + 1) / (r.n + 2)
    model.scale = np.maximum(size / np.maximum(n, 1), 1e-9)
    model.trust = good / good.sum(axis=1, keepdims=True)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all documents with id, text and language that are not held out."""
    known = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    return fit(known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))


# -- prediction --------------------------------------------------------------------

def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, runner_up, ambiguous), one row per input row. ``score`` is the share
    of the nearest codeword among all, by their losses; ``runner_up`` the next language.

    Null texts and texts without a letter are ``und`` with score 0, not ambiguous; so are all texts of a model
    without languages. A model of one language gives it to every text with a letter. Equal losses go to the
    language first in order and are ambiguous. Repeated rows are judged alike, very long texts are gone through in
    windows, an empty table gives no rows, extra columns, whatever their names, are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, lang_pred string, score double, runner_up string, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = m.langs or [UNKNOWN]
        for batch in batches:
            asked = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool) & bool(m.langs)
            loss = m.losses(m.margins(batch.column(1))) if m.langs else np.zeros((len(asked), 1))
            order = np.argsort(loss, axis=1, kind="stable")[:, :2]
            rows = np.arange(len(loss))
            near = loss[rows, order[:, 0]]
            share = 1 / np.exp(np.minimum(near[:, None] - loss, 0) * max(1, len(m.scale))).sum(axis=1)
            lead = loss[rows, order[:, -1]] - near
            several = order.shape[1] > 1
            yield _table({
                "doc_id": (batch.column(0), pa.int64()),
                "lang_pred": ([langs[k] if a else UNKNOWN for k, a in zip(order[:, 0], asked, strict=True)], pa.string()),
                "score": (np.where(asked, share, 0.0), pa.float64()),
                "runner_up": ([langs[k] if a and several else None for k, a in zip(order[:, -1], asked, strict=True)],
                              pa.string()),
                "ambiguous": (asked & (lead < LEAST_LEAD) & several, pa.bool_())})

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("asked")).mapInArrow(run, schema)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "runner_up",
                       "ambiguous")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
