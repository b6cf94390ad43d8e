"""Alignment of two tokenizers over a corpus.

Equal texts are brought together by a shuffle of the full text, and each distinct text is tokenized by both
tokenizers and aligned once. Byte offsets at which tokens of both end cut a text into groups; every A token of a
group is linked to every B token of it. How many documents hold a pair of ids linked is counted once per
distinct text, times its number of copies.

Neither tokenizer lets a token run from a visible character over the space after it, so every text is cut before
such spaces into units, tokens of both end there, and a unit is tokenized and aligned once for all texts of a block.
A block (a row of a staged table) holds some ``BLOCK_CHARS`` characters of distinct texts: its distinct units with
their ids and group cuts, the texts as numbers of units, and the block's distinct pairs. Only (pair, block) rows are shuffled to be counted, and the
counts return to the blocks that asked for them, so no link is ever a row of its own.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm.shared import read_table, stage

#: characters of distinct texts in a block; a longer text is a block of its own
BLOCK_CHARS = 1 << 22
#: bytes tokenized in one call, and links handled at once
CALL_BYTES, LINKS = 1 << 16, 1 << 20
#: a pair of ids is one long: the A id above ``ID_BITS`` bits of the B id
ID_BITS = 20
BLOCKS = "block bigint, keys array<binary>, payload binary, pairs array<bigint>, n_docs array<bigint>"
MEASURES = ("key binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
            "groups_sha256 string")
GROUPS = "key binary, position bigint, a_ids array<bigint>, b_ids array<bigint>"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


# -- tokenizers --------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies name bytes: printable Latin-1 characters name themselves, the
    other bytes take the letters from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of every id, one after another."""

    def __init__(self, pieces: list[bytes]):
        if len(pieces) >> ID_BITS:
            raise ValueError(f"at most {1 << ID_BITS} ids")
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.kind = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")

    def __len__(self) -> int:
        return len(self.size)

    def spells(self, ids: np.ndarray, data: bytes) -> bool:
        size = self.size[ids]
        if size.sum() != len(data):
            return False
        at = np.arange(len(data)) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.data[at].tobytes() == data


class Tokenizers:
    """A: a byte-level tokenizer file, given a space and the text. B: a piece model that adds the space itself."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        names = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.bytes_a = Vocabulary([bytes(letters[c] for c in name) for name, _ in names])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = Vocabulary([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))])

        if any("▁" in p.lstrip("▁") for p in (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))):
            raise ValueError("a piece runs over a space: texts cannot be cut there")

    def _ids(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both for bytes that begin with the space; B adds it itself."""
        text = data.decode()
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(a, np.int64), np.array(self.b.encode(text[1:]), np.int64)

    def encode(self, units: list[bytes]) -> Coded:
        """Ids of the units by both, many units in a call; none for a unit that its tokens do not spell."""
        out = Coded([], [], [], [], [])
        alone = [k for k, u in enumerate(units) if not _seen_end(u)]
        together = [k for k, u in enumerate(units) if _seen_end(u)]
        cuts = np.cumsum([0] + [len(units[k]) for k in together])
        lo = 0
        while lo < len(together):
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + CALL_BYTES, "right")) - 1)
            part = together[lo:hi]
            data = b"".join([units[k] for k in part])
            ids, ends = self._ids(data), cuts[lo + 1:hi + 1] - cuts[lo]
            upto = [np.cumsum(v.size[x]) for v, x in zip((self.bytes_a, self.bytes_b), ids, strict=True)]
            at = [np.searchsorted(u, ends) for u in upto]
            if all(v.spells(x, data) and (u[k] == ends).all() for v, x, u, k in zip(
                    (self.bytes_a, self.bytes_b), ids, upto, at, strict=True)):
                out.add(part, *(np.diff(k, prepend=-1) for k in at), *ids)
            else:  # some unit is not spelled by its tokens: one by one
                alone += part
            lo = hi
        for k in alone:
            a, b = self._ids(units[k])
            good = self.bytes_a.spells(a, units[k]) and self.bytes_b.spells(b, units[k])
            out.add([k], *(np.array([len(x) if good else 0]) for x in (a, b)), *(x if good else x[:0] for x in (a, b)))
        return out


@dataclass
class Coded:
    """Units in the order they were tokenized (``units``: their numbers), their numbers of ids, and the ids."""

    units: list[int]
    n_a: list[np.ndarray]
    n_b: list[np.ndarray]
    a: list[np.ndarray]
    b: list[np.ndarray]

    def add(self, units: list[int], *arrays: np.ndarray) -> None:
        self.units += units
        for held, x in zip((self.n_a, self.n_b, self.a, self.b), arrays, strict=True):
            held.append(x)


def _seen_end(unit: bytes) -> bool:
    """Whether a unit ends in a character that ``cut_units`` takes as visible."""
    return 32 < unit[-1] < 127 or (unit[-1] > 127 and len(unit) > 1 and 0xC3 <= unit[-2] <= 0xC9)


def cut_units(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where units begin in texts of two bytes or more that stand one after another: at each text, and at each space
    after a visible character (ASCII, or U+00C0 to U+024F, by their bytes) that does not end its text, as B gives a
    space by itself no token."""
    new = np.zeros(len(data), bool)
    before, second = data[1:-1], data[:-2]
    new[2:] = (data[2:] == 32) & (((before > 32) & (before < 127)) | ((before > 127) & (second >= 0xC3) & (second <= 0xC9)))
    new[cuts[1:] - 1] = False
    new[cuts[:-1]] = True
    return np.flatnonzero(new)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One pair per Python worker."""
    return Tokenizers(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- blocks ------------------------------------------------------------------------

def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


@dataclass
class Block:
    """Some texts as numbers of distinct units, one text after another, and the units' ids."""

    n_units: np.ndarray  # units of each text
    unit_of: np.ndarray
    n_a: np.ndarray  # tokens of each distinct unit
    n_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray  # for each token of A and B, whether it ends a group
    last_b: np.ndarray

    def pack(self, kind_a: np.dtype, kind_b: np.dtype) -> bytes:
        parts = [x.astype("<u4") for x in (self.n_units, self.unit_of, self.n_a, self.n_b)]
        parts += [self.a.astype(kind_a), self.b.astype(kind_b), np.packbits(self.last_a), np.packbits(self.last_b)]
        head = struct.pack("<5QBB", *map(len, (self.n_units, self.unit_of, self.n_a, self.a, self.b)),
                           kind_a.itemsize, kind_b.itemsize)
        return zstandard.compress(head + b"".join(p.tobytes() for p in parts), 3)

    @staticmethod
    def unpack(payload: bytes) -> Block:
        raw = zstandard.decompress(payload)
        texts, units, distinct, a, b, kind_a, kind_b = struct.unpack_from("<5QBB", raw)
        at, out = struct.calcsize("<5QBB"), []
        for count, kind in ((texts, "<u4"), (units, "<u4"), (distinct, "<u4"), (distinct, "<u4"), (a, f"<u{kind_a}"),
                            (b, f"<u{kind_b}"), (-(-a // 8), "u1"), (-(-b // 8), "u1")):
            out.append(np.frombuffer(raw, kind, count, at))
            at += out[-1].nbytes
        return Block(*(x.astype(np.int64) for x in out[:6]), np.unpackbits(out[6], count=a).astype(bool),
                     np.unpackbits(out[7], count=b).astype(bool))

    def groups(self) -> Groups:
        end_a, end_b = np.flatnonzero(self.last_a) + 1, np.flatnonzero(self.last_b) + 1
        x, y = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        return Groups(np.searchsorted(np.cumsum(self.n_a), end_a), x, y, end_a - x, end_b - y)

    def per_text(self, of_unit: np.ndarray) -> np.ndarray:
        """Sums over the units of each text."""
        return np.diff(_starts(of_unit[self.unit_of])[_starts(self.n_units)])


@dataclass
class Groups:
    """For each group of the distinct units its unit, its numbers of tokens and its first tokens."""

    unit: np.ndarray
    x: np.ndarray
    y: np.ndarray
    a_from: np.ndarray
    b_from: np.ndarray

    def links(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | int]]:
        """(text, pair, times) in parts of about ``LINKS`` links, texts ascending. of more links comes as its distinct pairs with how often each stands in it."""
        n = self.x * self.y
        upto = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - n[lo] + LINKS, "right")))
            if n[lo] > LINKS:
                a, times_a = np.unique(block.a[self.a_from[lo]:self.a_from[lo] + self.x[lo]], return_counts=True)
                b, times_b = np.unique(block.b[self.b_from[lo]:self.b_from[lo] + self.y[lo]], return_counts=True)
                step = max(1, LINKS // len(b))
                for k in range(0, len(a), step):
                    pair = (a[k:k + step, None] << ID_BITS | b).ravel()
                    yield np.full(len(pair), self.unit[lo]), pair, np.outer(times_a[k:k + step], times_b).ravel()
            else:
                g = np.repeat(np.arange(lo, hi), n[lo:hi])
                k = np.arange(len(g)) - np.repeat(_starts(n[lo:hi])[:-1], n[lo:hi])
                down = k // self.y[g]
                pair = block.a[self.a_from[g] + down] << ID_BITS | block.b[self.b_from[g] + k - down * self.y[g]]
                yield self.unit[g], pair, 1
            lo = hi


def align(texts: list[str], tok: Tokenizers) -> Block:
    """Texts with a unit whose tokens spell anything but its bytes have no tokens."""
    raw = [b" " + t.encode() for t in texts]
    data, cuts = np.frombuffer(b"".join(raw), np.uint8), _starts([len(r) for r in raw])
    starts = cut_units(data, cuts)
    n_units = np.diff(np.searchsorted(starts, cuts))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    unit_of, units = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    coded = tok.encode(units)
    n_a, n_b, a, b = (np.concatenate(x) for x in (coded.n_a, coded.n_b, coded.a, coded.b))
    place = np.empty(len(units), np.int64)
    place[coded.units] = np.arange(len(units))
    unit_of = place[unit_of]
    if not n_a.all():
        wrong = np.diff(_starts(n_a[unit_of] == 0)[_starts(n_units)]) > 0
        unit_of, n_units = unit_of[np.repeat(~wrong, n_units)], np.where(wrong, 0, n_units)
    end_a, end_b = np.cumsum(tok.bytes_a.size[a]), np.cumsum(tok.bytes_b.size[b])
    at_a, at_b = (np.zeros(len(data) + 1, bool) for _ in range(2))
    at_a[end_a] = True
    at_b[end_b] = True
    return Block(n_units, unit_of, n_a, n_b, a, b, at_b[end_a], at_a[end_b])


def distinct_pairs(block: Block, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's pairs in order, and how many documents hold each (a text counts as its copies)."""
    none = np.zeros(0, np.int64)
    keys = [none] + [_distinct(unit << 2 * ID_BITS | pair) for unit, pair, _ in block.groups().links(block)]
    keys = _distinct(np.concatenate(keys))  # a block's units and texts number under 2 ** 23
    own = keys & ((1 << 2 * ID_BITS) - 1)
    pairs = _distinct(own)
    of_unit = np.searchsorted(pairs, own)
    n_pairs = np.bincount(keys >> 2 * ID_BITS, minlength=len(block.n_a))
    first = _starts(n_pairs)[:-1]
    held = _distinct(np.repeat(np.arange(len(block.n_units)), block.n_units) << 32 | block.unit_of)
    text, unit = held >> 32, held & 0xFFFFFFFF
    n = n_pairs[unit]
    upto, n_docs, lo = np.cumsum(n), np.zeros(len(pairs), np.int64), 0
    while lo < len(held):
        # whole texts of about ``LINKS`` pairs
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - n[lo] + LINKS, "right")))
        hi = int(np.searchsorted(text, text[hi - 1], "right"))
        m = n[lo:hi]
        at = np.repeat(first[unit[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        seen = _distinct(np.repeat(text[lo:hi], m) << 32 | of_unit[at])
        np.add.at(n_docs, seen & 0xFFFFFFFF, copies[seen >> 32])
        lo = hi
    return pairs, n_docs


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()),
             "array<binary>": pa.list_(pa.binary())}
    names, types = zip(*(c.rsplit(" ", 1) for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def align_texts(docs: DataFrame, text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """The staged blocks (``BLOCKS``) of all distinct non-empty texts; ``keys`` are the SHA-256 values of the texts."""
    path_a, path_b = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        texts, copies, keys, chars = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, chars
            made = align(texts, tok)
            pairs, n_docs = distinct_pairs(made, np.array(copies, np.int64))
            row = _batch(BLOCKS, [number], [keys], [made.pack(tok.bytes_a.kind, tok.bytes_b.kind)], [pairs], [n_docs])
            number, chars = number + 1, 0
            for held in (texts, copies, keys):
                held.clear()
            return row

        for batch in batches:
            for text, n, key in zip(*(batch.column(i) for i in range(3)), strict=True):
                texts.append(text.as_py())
                copies.append(n.as_py())
                keys.append(key.as_py())
                chars += len(texts[-1])
                if chars >= BLOCK_CHARS:
                    yield block()
        if texts:
            yield block()

    texts = docs.select(F.col(text_col).alias("text")).filter("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    return stage(texts.select("text", "n", _key(F.col("text"))).mapInArrow(run, BLOCKS), "aligned")


def _key(text):
    return F.unhex(F.sha2(text, 256)).alias("key")


# -- counts ------------------------------------------------------------------------

def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents that hold the pair linked, and whether no pair of the same A id has more."""
    asked = aligned.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).select("x.pairs", "x.n_docs")
    counts = stage(asked.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("n_docs")), "paircounts")
    own = counts.withColumn("a", F.shiftright("pair", ID_BITS))
    top = own.groupBy("a").agg(F.max("n_docs").alias("top"))
    return own.join(top, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def measure(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every distinct text: the counts are
    joined to the blocks that hold the pairs, and each block is gone through with its own counts."""
    asked = aligned.select("block", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(counts, "pair").select(F.col("block").alias("of"), "at", "n_docs", "best")

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for keys, payload, pairs in zip(*(blocks.column(c) for c in ("keys", "payload", "pairs")), strict=True):
            pairs = np.asarray(pairs.values)
            n_docs, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            at = told.column("at").to_numpy()
            n_docs[at] = told.column("n_docs").to_numpy()
            best[at] = told.column("best").to_numpy()
            out.append(_measures(keys.as_py(), Block.unpack(payload.as_py()), pairs, n_docs, best))
        return pa.Table.from_batches(out)

    return aligned.select("block", "keys", "payload", "pairs").groupBy("block").cogroup(
        told.groupBy("of")).applyInArrow(run, MEASURES)


def _measures(keys: list[bytes], block: Block, pairs: np.ndarray, n_docs: np.ndarray,
              best: np.ndarray) -> pa.RecordBatch:
    groups, n = block.groups(), len(block.n_a)
    n_links, n_best, count_sum = (np.zeros(n, np.int64) for _ in range(3))
    for unit, pair, times in groups.links(block):
        at = np.searchsorted(pairs, pair)
        first = np.flatnonzero(np.diff(unit, prepend=-1))
        who = unit[first]
        n_best[who] += np.add.reduceat(best[at] * times, first)
        count_sum[who] += np.add.reduceat(n_docs[at] * times, first)
    np.add.at(n_links, groups.unit, groups.x * groups.y)
    numbers = (block.n_a, block.n_b, np.bincount(groups.unit, minlength=n), n_links, n_best, count_sum)
    texts, shas, at = unit_texts(block, groups), [], _starts(block.n_units).tolist()
    for a, b in zip(at, at[1:], strict=False):
        text = b"".join([texts[u] for u in block.unit_of[a:b].tolist()])
        shas.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
    return _batch(MEASURES, keys, *map(block.per_text, numbers), shas)


def unit_texts(block: Block, groups: Groups) -> list[bytes]:
    """The groups of every distinct unit as ``a1,a2|b1;a3|b2,b3;``."""
    ids = np.empty(len(block.a) + len(block.b), np.int64)
    sep = np.full(len(ids), ord(","), np.uint8)
    at_a = np.arange(len(block.a)) + np.repeat(groups.b_from, groups.x)
    at_b = np.arange(len(block.b)) + np.repeat(groups.a_from + groups.x, groups.y)
    ids[at_a], ids[at_b] = block.a, block.b
    sep[at_a[block.last_a]], sep[at_b[block.last_b]] = ord("|"), ord(";")
    digits, size = _decimals(1 << int(ids.max(initial=1)).bit_length())
    size = size[ids]
    chars = np.empty((len(ids), digits.shape[1] + 1), np.uint8)
    chars[:, :-1] = digits[ids]
    chars[np.arange(len(ids)), size] = sep
    text = chars[np.arange(chars.shape[1]) <= size[:, None]].tobytes()
    cuts = _starts(size + 1)[_starts(block.n_a + block.n_b)].tolist()
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    width = len(str(n - 1))
    texts = np.char.ljust(np.arange(n).astype(f"S{width}"), width, b" ")
    size = np.char.str_len(np.arange(n).astype(f"S{width}"))
    return np.frombuffer(texts.tobytes(), np.uint8).reshape(n, width), size


# -- documents ---------------------------------------------------------------------

def text_groups(aligned: DataFrame) -> DataFrame:
    """(key, position, a_ids, b_ids): the groups of every distinct text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, payload in zip(batch.column(0), batch.column(1), strict=True):
                block, at = Block.unpack(payload.as_py()), 0
                g = block.groups()
                first = np.searchsorted(g.unit, np.arange(len(block.n_a) + 1))
                for key, n in zip(keys.as_py(), block.n_units.tolist(), strict=True):
                    units = block.unit_of[at:at + n]
                    at += n
                    m = np.diff(first)[units]
                    mine = np.repeat(first[units] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    for lo in range(0, len(mine), 1 << 14):
                        some = mine[lo:lo + (1 << 14)]
                        yield _batch(GROUPS, [key] * len(some), np.arange(lo, lo + len(some)),
                                     [block.a[f:f + k] for f, k in zip(g.a_from[some], g.x[some], strict=True)],
                                     [block.b[f:f + k] for f, k in zip(g.b_from[some], g.y[some], strict=True)])

    return aligned.select("keys", "payload").mapInArrow(run, GROUPS)


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    Null and empty texts, and texts whose tokens do not spell the space and the text, have zeros and an empty
    ``groups_sha256``. Repeated rows and equal texts are aligned once and counted as often as they stand; null ids
    are carried. A very long text is a block of its own, and a group of very many links is handled by its distinct
    pairs. An empty table gives no rows. Extra columns, whatever their names, are ignored."""
    aligned = align_texts(docs, text_col, paths)
    measures = measure(aligned, pair_counts(aligned))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    full = rows.filter("text <> ''").select("doc_id", _key(F.col("text"))).join(measures, "key").drop("key")
    none = rows.filter("text is null or text = ''").select(
        "doc_id", *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS], F.lit("").alias("groups_sha256"))
    return full.select("doc_id", *_COUNTS, "groups_sha256").union(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read_table(spark, sf_dir, "documents"))
