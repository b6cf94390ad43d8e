"""Token ids as directly addressable codes in binary segments.

Ids are cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id, level k
the k-th chunk of the ids that have one; a bitmap per level says which ids go on, and a
rank directory over the bitmap (one count per 512 bits) gives an id's position in
the next level. Any token is read with one chunk and one rank per level, without
decoding its neighbours.

A segment is one binary value, all integers little-endian: magic, counts (documents, tokens,
levels: u64), document ids (i64) and whether each is null (u8), tokens per document (u64),
then per level its length (u64), chunks (u8), bitmap (bits from the lowest) and directory (u32).
Segments hold whole documents in ascending id and are written by Spark as Parquet rows,
so any file system Spark writes to and its commit protocol will do; rows of one ``part`` in
the order of ``part_start``, parts in the order of ``part``, give all ids in order.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandlake.llm.memo import Memo
from demandlake.llm.shared import read_table, work_path

MAGIC = b"DACS0001"
END_ID = 2
SEGMENT_TOKENS = 1 << 18
#: characters of text encoded together
CHUNK = 1 << 23
BLOCK = 512
MEMO_LIMIT = 300_000
FILE_SCHEMA = "part int, part_start bigint, n_docs bigint, n_tokens bigint, payload binary"


# -- codes -------------------------------------------------------------------------

def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One segment of the documents' ids (unsigned 32-bit, documents one after another)."""
    levels, rest = [], np.asarray(ids, "<u4")
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        pad = -len(more) % BLOCK
        per_block = np.concatenate((more, np.zeros(pad, bool))).reshape(-1, BLOCK).sum(axis=1, dtype="<u4")
        directory = np.concatenate(([0], np.cumsum(per_block)[:-1])).astype("<u4") if len(per_block) else per_block
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits
                      + directory.astype("<u4").tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<QQQ", len(doc_ids), len(ids), len(levels))
    table = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    table += bytes(d is None for d in doc_ids) + np.array(counts, "<u8").tobytes()
    return head + table + b"".join(levels)


class Segment:
    """A view of one segment; nothing is decoded before it is asked for."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", payload, 8)
        at = 32
        ids = np.frombuffer(payload, "<i8", self.n_docs, at)
        none = np.frombuffer(payload, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, none, strict=True)]
        self.counts = np.frombuffer(payload, "<u8", self.n_docs, at + 9 * self.n_docs).astype(np.int64)
        at += 17 * self.n_docs
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            n_bits, blocks = -(-n // 8), -(-n // BLOCK)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bitmap = np.frombuffer(payload, np.uint8, n_bits, at + 8 + n)
            directory = np.frombuffer(payload, "<u4", blocks, at + 8 + n + n_bits)
            self.levels.append((chunks, bitmap, directory))
            at += 8 + n + n_bits + 4 * blocks

    def token(self, i: int) -> int:
        """The id at position ``i``: a chunk and a rank per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            byte = int(bitmap[i >> 3])
            if not byte >> (i & 7) & 1:
                break
            first = i // BLOCK * (BLOCK // 8)
            before = int.from_bytes(bitmap[first:i >> 3].tobytes(), "little").bit_count()
            i = int(directory[i // BLOCK]) + before + (byte & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all_tokens(self) -> np.ndarray:
        at = np.arange(self.n_tokens)
        out = np.zeros(self.n_tokens, "<u4")
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype("<u4") << np.uint32(8 * k)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out


# -- encoding ----------------------------------------------------------------------

_PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
_SPACE, _MARK, _INK = 0, 1, 2
#: plain words encoded in one call
_TOGETHER = 200


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _INK, np.uint8)
    kinds[list(b" \t\n\x0b\x0c\r")] = _SPACE
    kinds[list(b".,!?;:|%&$#*()\"")] = _MARK
    return kinds


_KINDS = _byte_kinds()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def _units(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units of lower-cased texts that stand one after another (text k is ``data[cuts[k]:cuts[k + 1]]``):
    their bytes without the white space between, where each starts in these, and the first unit of each text.

    A unit ends at ASCII white space and where an ASCII letter or digit meets ASCII punctuation."""
    kind, alnum = _KINDS[data], _ALNUM[data]
    new = np.ones(len(data) + 1, bool)
    a, b = kind[:-1], kind[1:]
    new[1:-1] = (a == _SPACE) | ((a == _INK) & (b == _MARK) & alnum[:-1]) | ((a == _MARK) & (b == _INK) & alnum[1:])
    new[cuts] = True
    ink = kind != _SPACE
    starts = np.flatnonzero(new[:-1] & ink)
    place = np.cumsum(ink)
    return data[ink], np.append(place[starts] - 1, ink.sum()), np.searchsorted(starts, cuts)


class WordEncoder:
    """Ids of texts by a word-level tokenizer that drops white space and folds case.

    Units of a text (see ``_units``) encode independently of each other, so the distinct units of many texts are
    found by Arrow, those not in a bounded memo are encoded, and the ids are put together by index. A text with
    "<|", which may name a special token, goes to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Memo(self._ids, MEMO_LIMIT)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _ids(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Encodes new units. Each of letters only is one word of the tokenizer, closed by one piece, so
        many of them are encoded as one text."""
        known = self.words
        plain = [w for w in new if _PLAIN.fullmatch(w.decode())]
        for lo in range(0, len(plain), _TOGETHER):
            part = plain[lo:lo + _TOGETHER]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                continue  # some unit is not one word for the tokenizer: each is encoded alone
            raw, a = ids.tobytes(), 0
            for w, b in zip(part, ends.tolist(), strict=True):
                known[w] = raw[4 * a:4 * b]
                a = b

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers, without an end id."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        special = {k for k, r in enumerate(raw) if b"<|" in r}
        cuts = np.cumsum([0] + [0 if k in special else len(r) for k, r in enumerate(raw)])
        data = _LOWER[np.frombuffer(b"".join(r for k, r in enumerate(raw) if k not in special), np.uint8)]
        ink, starts, first = _units(data, cuts)
        units = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(ink)]).dictionary_encode()
        distinct, words = units.dictionary.to_pylist(), self.words
        words.trim()
        self._learn([w for w in distinct if w not in words and w not in words.older])
        coded = [words[w] for w in distinct]
        flat = np.frombuffer(b"".join(coded), "<u4")
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        at = units.indices.to_numpy()
        count = size[at]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        shift = (np.cumsum(size) - size)[at] - (ends - count)
        out = flat[np.arange(total) + np.repeat(shift, count)].tobytes()
        bounds = (4 * np.concatenate(([0], ends))[first]).tolist()
        return [self._ids(r) if k in special else out[bounds[k]:bounds[k + 1]] for k, r in enumerate(raw)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker: its memo serves all tasks."""
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- files -------------------------------------------------------------------------

def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encodes every text, appends the end id and writes segments to the new folder ``path`` in
    ascending id (nulls first; rows of one id in the order of their text's hash). Null
    texts count as empty."""
    tokenizer_path = tokenizer_path or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        coded: list[bytes] = []
        names = [c.split()[0] for c in FILE_SCHEMA.split(", ")]

        def segment() -> pa.RecordBatch:
            nonlocal before
            counts = [len(x) // 4 for x in coded]
            payload = pack(doc_ids, counts, np.frombuffer(b"".join(coded), "<u4"))
            row = [pa.array([part], pa.int32()), pa.array([before]), pa.array([len(counts)]),
                   pa.array([sum(counts)]), pa.array([payload], pa.binary())]
            before += sum(counts)
            doc_ids.clear()
            coded.clear()
            return pa.RecordBatch.from_arrays(row, names)

        size = 0
        for batch in batches:
            lo, texts, ids = 0, batch.column(1), batch.column(0).to_pylist()
            while lo < len(texts):
                some, chars, hi = [], 0, lo
                while hi < len(texts) and chars < CHUNK:
                    some.append(texts[hi].as_py() or "")
                    chars += len(some[-1])
                    hi += 1
                for d, x in zip(ids[lo:hi], enc.encode(some), strict=True):
                    doc_ids.append(d)
                    coded.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= SEGMENT_TOKENS:
                        yield segment()
                        size = 0
                lo = hi
        if doc_ids:
            yield segment()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def part_starts(files: DataFrame) -> DataFrame:
    """(part, start): tokens before each part. One row per part is summed up in order."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _value(x: pa.Scalar):
    return x.as_py()


def open_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    files = open_files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, part_start, payload in zip(*(map(_value, batch.column(i)) for i in range(3)), strict=True):
                seg = Segment(payload)
                tokens = seg.all_tokens()
                ends = np.concatenate(([0], np.cumsum(seg.counts)))
                crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(seg.n_docs, part, np.int32)), pa.array(seg.doc_ids, pa.int64()),
                     pa.array(part_start + ends[:-1]), pa.array(seg.counts), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    schema = "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    rows = files.select("part", "part_start", "payload").mapInArrow(run, schema)
    return rows.join(part_starts(files), "part").select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, positions: DataFrame, position_col: str = "position") -> DataFrame:
    """(position, token) for the distinct positions within the files: the positions are joined to the segment
    that holds each (by part, then the range within it) and read there by rank, without decoding the segment.
    Positions outside the files and nulls give no row."""
    files = open_files(spark, path)
    places = files.join(part_starts(files), "part").select(
        "part", "part_start", (F.col("start") + F.col("part_start")).alias("lo"), "n_tokens")
    # positions are dealt into equal cells; a segment is listed under each cell it touches
    cell = lambda c: F.floor(c / SEGMENT_TOKENS)
    places = places.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("lo") + F.col("n_tokens") - 1))))
    want = positions.select(F.col(position_col).cast("bigint").alias("position")).distinct()
    want = want.withColumn("cell", cell(F.col("position")))
    hits = want.join(places, "cell").filter("position >= lo and position < lo + n_tokens")
    asked = hits.groupBy("part", "part_start").agg(F.first("lo").alias("lo"), F.collect_list("position").alias("positions"))
    rows = asked.join(files.select("part", "part_start", "payload"), ["part", "part_start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, positions, payload in zip(*(map(_value, batch.column(i)) for i in range(3)), strict=True):
                seg = Segment(payload)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(positions, pa.int64()), pa.array([seg.token(p - lo) for p in positions], pa.int64())],
                    ["position", "token"])

    return rows.select("lo", "positions", "payload").mapInArrow(run, "position bigint, token bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
