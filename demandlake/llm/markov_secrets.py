"""Secret scans: fixed patterns, plus character Markov models of random strings and of
ordinary identifiers compared by log-likelihood ratio.

The samples are labelled by the fixed patterns: the values they find are the random
class, the identifiers of the same texts outside them the ordinary class. Transition
counts cover all documents; a model is one table of ``len(ALPHABET) + 1`` squared
numbers per class, whatever the input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm.shared import read_table

# FIXED VALUES: the base patterns and their least lengths (assign: of group 2)
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
MIN_CANDIDATE = 16
MIN_SAMPLE = 6
#: Least mean log-likelihood ratio per character of a found string (nats), and of the whole.
MIN_MEAN, MIN_SUM = 0.7, 16.0
#: Weight of a class's character frequencies in each of its transition rows, in counts.
BACKOFF = 20.0

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX.replace("+", "{%d,}" % MIN_HEX))  # the same runs: a run is always matched whole
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_CANDIDATE)
_N = len(ALPHABET) + 1
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, _N)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value), in order of start, then kind."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def _transitions(data: bytes, counts: np.ndarray) -> None:
    """Adds the transitions within identifiers of at least ``MIN_SAMPLE`` characters;
    code 0 stands for an identifier's edge."""
    code = _CODE[np.frombuffer(b" " + data + b" ", np.uint8)]
    edge = np.flatnonzero(code == 0)
    long = np.diff(edge) > MIN_SAMPLE
    keep = np.repeat(long, np.diff(edge))  # for each position but the last edge
    pair = code[:-1] * _N + code[1:]
    counts += np.bincount(pair[keep], minlength=_N * _N)


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio (random against ordinary) of every transition, from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _N * _N), np.int64)
        for batch in batches:
            plain: list[bytes] = []
            size = 0
            for text in batch.column(0).to_pylist():
                text = text or ""
                at = 0
                for start, _, end, value in base_spans(text):
                    _transitions(text[value:end].encode("ascii", "replace"), counts[0])
                    plain.append(text[at:start].encode("ascii", "replace").replace(b"?", b" "))
                    at = max(at, end)
                plain.append(text[at:].encode("ascii", "replace").replace(b"?", b" "))
                size += len(text)
                if size > 1 << 20:
                    _transitions(b" ".join(plain), counts[1])
                    plain, size = [], 0
            _transitions(b" ".join(plain), counts[1])
        kind, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(pair), pa.array(counts[kind, pair])],
                                         ["kind", "pair", "n"])

    rows = docs.select(text_col).mapInArrow(run, "kind bigint, pair bigint, n bigint")
    return fit(rows)


def train_labelled(samples: DataFrame, string_col: str, label_col: str) -> np.ndarray:
    """The same from labelled strings: label true or 1 for random strings. Null strings or labels are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _N * _N), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None and label is not None:
                    _transitions(text.encode("ascii", "replace"), counts[0 if label else 1])
        kind, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(pair), pa.array(counts[kind, pair])],
                                         ["kind", "pair", "n"])

    return fit(samples.select(string_col, F.col(label_col).cast("int")).mapInArrow(
        run, "kind bigint, pair bigint, n bigint"))


def fit(transitions: DataFrame) -> np.ndarray:
    """Ratio table from (kind, pair, n) rows: at most 2 * 67 * 67 sums reach the driver.
    A transition's probability backs off to its class's character frequencies; the random class is
    mixed half and half with uniform letters and digits, since keys are drawn from many alphabets."""
    counts = np.zeros((2, _N, _N))
    for kind, pair, n in transitions.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        counts[kind, pair // _N, pair % _N] = n
    letters = counts.sum(axis=1) + 0.5
    letters /= letters.sum(axis=1, keepdims=True)
    p = (counts + BACKOFF * letters[:, None, :]) / (counts.sum(axis=2, keepdims=True) + BACKOFF)
    uniform = np.zeros(_N)
    uniform[1:63] = 1 / 62
    return np.log((p[0] + uniform) / 2) - np.log(p[1])


def _ratio(run: str, ratio: np.ndarray) -> float:
    code = _CODE[np.frombuffer(run.encode(), np.uint8)]
    return float(ratio[code[:-1], code[1:]].sum())


def markov_spans(text: str, taken: list[tuple[int, int, int, int]], ratio: np.ndarray) -> list[tuple[int, int]]:
    """Candidates whose ratio passes both thresholds. Of a candidate that overlaps base spans the parts outside
    them are taken that pass the threshold per character, as the rest of one longer secret."""
    out = []
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        run = m.group()
        total = _ratio(run, ratio)
        if total < MIN_SUM or total < MIN_MEAN * (len(run) - 1):
            continue
        at, parts = s, []
        for a, _, b, _ in taken:
            if a < e and at < b:
                parts.append((at, a))
                at = max(at, b)
        parts.append((at, e))
        out += [(a, b) for a, b in parts if a < b and (
            (a, b) == (s, e) or _ratio(text[a:b], ratio) >= MIN_MEAN * (b - a - 1))]
    return out


SCAN_SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, redacted string"


def scan_text(text: str | None, ratio: np.ndarray, redact: bool) -> tuple:
    text = text or ""
    base = base_spans(text)
    names = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base]
    extra = markov_spans(text, base, ratio)
    every = sorted([(s, k, e) for s, k, e, _ in base] + [(s, 3, e) for s, e in extra])
    clean = None
    if redact and every:
        values = sorted([(v, e) for _, _, e, v in base] + extra)
        parts, at = [], 0
        for s, e in values:
            if e > at:
                parts += [text[at:max(at, s)], "[SECRET]" if s >= at else ""]
                at = e
        clean = "".join(parts) + text[at:]
    return (*(sum(k == i for _, k, _, _ in base) for i in range(3)),
            hashlib.sha256(",".join(names).encode()).hexdigest(),
            ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in every), clean)


def scan(text: Column, ratio: np.ndarray, redact: bool = False) -> Column:
    """Struct column: counts of the base kinds, ``base_sha256``, ``spans`` (all, by start, then
    kind; code points, end exclusive) and, with ``redact``, ``redacted``: the text with each
    found value replaced by [SECRET], null when nothing was found. Null and empty texts
    have no spans."""

    @F.arrow_udf(f"struct<{SCAN_SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [scan_text(t.as_py(), ratio, redact) for t in texts]
        kinds = [pa.int64()] * 3 + [pa.string()] * 3
        names = [c.split()[0] for c in SCAN_SCHEMA.split(", ")]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row; the model is trained
    on the same texts. Repeated rows and null ids are kept as they are; an empty table
    gives no rows; extra columns are ignored."""
    ratio = train(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col), ratio).alias("s"))
    return rows.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret value replaced by [SECRET]; ``length_col``, where it exists, becomes
    the new length of the changed texts. All rows and columns stay, whatever their names: null and empty texts
    and null ids as they are, repeated rows alike; very long texts are scanned whole; an empty table stays empty."""
    ratio = train(docs, text_col)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"),
                      scan(F.col(text_col), ratio, redact=True)["redacted"].alias("redacted"))
    whole = F.col("whole")
    columns = []
    for c in docs.columns:
        old = whole.getField(c)
        if c == text_col:
            columns.append(F.coalesce("redacted", old).alias(c))
        elif c == length_col:
            kind = docs.schema[c].dataType
            columns.append(F.when(F.col("redacted").isNull(), old).otherwise(F.length("redacted").cast(kind)).alias(c))
        else:
            columns.append(old.alias(c))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))
