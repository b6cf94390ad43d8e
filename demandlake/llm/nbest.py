"""SentencePiece encoding and decoding with exact n-best segmentations.

All segmentations of a text into pieces of a public model form a lattice whose edges
carry the model's piece scores. A forward Viterbi pass gives the best score from the
start to every position; a backward A-star search from the end uses these scores as
exact heuristics and pops the segmentations in order of score.

No piece of the model contains certain pairs of adjacent characters (such as a letter
before a space mark), so the lattice is a chain of independent parts cut at these
pairs. The parts of a text repeat a lot: their best segmentation and its lead over the
second best are kept in a bounded memo, and only the parts of least lead are searched
for the n best segmentations of the whole text. This is exact: a segmentation among
the n best departs from the best in parts of the n - 1 smallest leads only.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import add
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm.memo import Memo
from demandlake.llm.shared import read_table

SPACE = "▁"
#: A character without a piece is its UTF-8 bytes, scored below every piece by this much.
FALLBACK_PENALTY = 10.0
MEMO_LIMIT = 300_000
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")


class Pieces:
    """The piece lattice of one SentencePiece model with byte fallback, identity
    normalization and a dummy space before the text (as public 32k models have)."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score: dict[str, tuple[float, int]] = {}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.decoded: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.decoded.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.decoded.append(b"")
            else:
                self.decoded.append(piece.replace(SPACE, " ").encode())
                self.score[piece] = (model.get_score(i), i)
        #: character -> (characters that follow in a piece, score and ids of the piece that ends here or None)
        self.trie: dict[str, tuple] = {}
        for p, (v, i) in sorted(self.score.items()):  # a piece comes before the pieces that it begins
            after = self.trie
            for c in p[:-1]:
                after = after.setdefault(c, ({}, None))[0]
            after[p[-1]] = ({}, (v, (i,)))
        self.pairs = {p[k:k + 2] for p in self.score for k in range(len(p) - 1)}
        letters = "abcdefghijklmnopqrstuvwxyz"
        rare = {c: "".join(d for d in letters if c + d not in self.pairs) for c in letters}
        self.start = {c for c in letters if SPACE + c in self.pairs}
        self.letters = re.compile("[a-z]+").fullmatch
        #: pairs of small letters that no piece contains
        self.cut = re.compile("|".join(f"{c}[{ds}]" for c, ds in rare.items() if ds) or "(?!)").search
        self.fallback = min(s for s, _ in self.score.values() if s > -1e8) - FALLBACK_PENALTY
        self.parts = Memo(self.solve, MEMO_LIMIT)
        self.units = Memo(self.solve_unit, MEMO_LIMIT)
        self.options = Memo(lambda key: self.nbest_part(*key), MEMO_LIMIT // 10)

    def edges(self, part: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position the edges (start, score, ids), longest first."""
        ending: list[list] = [[] for _ in range(len(part) + 1)]
        for i, first in enumerate(part):
            after, edge = self.trie.get(first) or ({}, None)
            ending[i + 1].append((i, *(edge or self.as_bytes(first))))
            for j in range(i + 1, len(part)):
                node = after.get(part[j])
                if node is None:
                    break
                after, edge = node
                if edge:
                    ending[j + 1].append((i, *edge))
        return ending

    def as_bytes(self, char: str) -> tuple[float, tuple[int, ...]]:
        """The edge of a character that is no piece."""
        return self.fallback, tuple(self.byte_ids[b] for b in char.encode("utf-8", "replace"))

    def forward(self, ending) -> tuple[list[float], list]:
        """Best score from the start to each position and the last edge of that path.
        Of equal scores the one of the longer last piece wins."""
        best, back = [0.0], [None]
        for e in ending[1:]:
            top, edge = -1e300, None
            for x in e:
                v = best[x[0]] + x[1]
                if v > top:
                    top, edge = v, x
            best.append(top)
            back.append(edge)
        return best, back

    def solve(self, part: str) -> tuple[bytes, float, float]:
        """(ids of the best segmentation as unsigned 32-bit integers, its score, lead over the second best),
        by a forward pass that keeps the two best scores of every position."""
        n, trie = len(part), self.trie
        best, second, start, back = [0.0] + [-1e300] * n, [-1e300] * (n + 1), [0] * (n + 1), [()] * (n + 1)
        for i, first in enumerate(part):  # all edges that end at i are known: its scores are final
            here, next_best = best[i], second[i]
            j = i + 1
            after, edge = trie.get(first) or ({}, None)
            if edge is None:
                edge = self.as_bytes(first)
            while True:
                if edge:
                    score, ids = edge
                    v = here + score
                    top = best[j]
                    if v > top:  # of equal scores the one of the longer last piece, which starts first, stays
                        best[j], start[j], back[j] = v, i, ids
                        v = next_best + score
                        second[j] = top if top > v else v
                    elif v > second[j]:
                        second[j] = v
                if j == n or part[j] not in after:
                    break
                after, edge = after[part[j]]
                j += 1
        path: list[int] = []
        j = n
        while j:
            path[:0] = back[j]
            j = start[j]
        return pack(f"<{len(path)}I", *path), best[n], best[n] - second[n] if second[n] > -1e299 else float("inf")

    def split(self, unit: str) -> list[str]:
        """Parts between which no piece can lie."""
        pairs = self.pairs
        cuts = [k for k, pair in enumerate(map(add, unit, unit[1:]), 1) if pair not in pairs]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)] if cuts else [unit]

    def solve_unit(self, word: str) -> tuple[bytes, float, float]:
        """The same for a word after its space mark; a word that starts with a mark brings all of its own."""
        if word and word[0] in self.start and self.letters(word) and not self.cut(word):
            return self.solve(SPACE + word)
        parts = self.split(word if word.startswith(SPACE) else SPACE + word)
        if len(parts) == 1:
            return self.solve(parts[0])
        # the first part is a word of its own after its space mark, if it has letters
        first = self.units[parts[0][1:]] if len(parts[0]) > 1 and parts[0][1] != SPACE else self.parts[parts[0]]
        found = [first, *map(self.parts.__getitem__, parts[1:])]
        return b"".join(x[0] for x in found), sum(x[1] for x in found), min(x[2] for x in found)

    def nbest_part(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, ids), by backward A-star."""
        ending = self.edges(part)
        best, _ = self.forward(ending)
        # of equal priorities the one nearest to the start goes on: ties cannot spread
        heap = [(-best[-1], len(part), 0, 0.0, None)]
        out, count = [], 0
        while heap and len(out) < n:
            _, j, _, tail, rest = heapq.heappop(heap)
            if j == 0:
                ids: list[int] = []
                while rest:
                    ids += rest[0]
                    rest = rest[1]
                out.append((tail, tuple(ids)))
                continue
            for i, v, k in ending[j]:
                count += 1
                heapq.heappush(heap, (-(best[i] + v + tail), i, count, v + tail, (k, rest)))
        return out

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        words = text.split(" ")
        if SPACE in text or "" in words:
            units = _UNITS.findall(SPACE + text.replace(" ", SPACE))
            words = [u if u.startswith(SPACE * 2) or len(u) == 1 else u[1:] for u in units]
        return words

    def encode(self, text: str, n: int) -> tuple[bytes, list[float], list[dict[tuple[int, int], tuple[int, ...]]]]:
        """(ids of the best segmentation, the n best scores, changes): change k maps (word, part) numbers to the ids that
        differ in segmentation k. Fewer than n where the lattice has fewer paths; empty text has the one of no piece."""
        coded, scores, changes = self.search(self.words(text), n)
        return b"".join(coded), scores, changes

    def search(self, words: list[str], n: int) -> tuple[list[bytes], list[float], list[dict[tuple[int, int], tuple[int, ...]]]]:
        """``encode`` of a text's ``words``, with the ids of each word."""
        units = self.units
        found = list(map(units.__getitem__, words))
        coded = [x[0] for x in found]
        lists = [(float(sum([x[1] for x in found])), {})]
        if n > 1 and words:
            leads = np.array([x[2] for x in found])
            m = min(n - 1, len(leads))
            # every word whose lead ties with the (n-1)-th smallest would do as well; the first are taken
            near = np.argpartition(leads, m - 1)[:m] if m < len(leads) else np.arange(len(leads))
            bound = leads[near].max()
            pick = np.concatenate((np.flatnonzero(leads < bound), np.flatnonzero(leads == bound)))[:m]
            for w in sorted(int(x) for x in pick if np.isfinite(leads[x])):
                word = words[w]
                for p, part in enumerate(self.split_word(word)):
                    options = self.options[part, n]
                    top = options[0][0]
                    lists = heapq.nsmallest(n, [
                        (score + s - top, change | ({(w, p): k} if r else {}))
                        for score, change in lists for r, (s, k) in enumerate(options)], key=lambda x: -x[0])
        return coded, [s for s, _ in lists], [c for _, c in lists]

    def split_word(self, word: str) -> list[str]:
        """Parts of a word of ``words``."""
        return self.split(word if word.startswith(SPACE) else SPACE + word)

    def encode_edits(self, text: str, n: int) -> tuple[bytes, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """(ids of the best segmentation, the n best scores, edits): edit list k - 1 has (from, to, ids) in order, the pieces of
        the best segmentation that segmentation k replaces and what it has there."""
        words = self.words(text)
        coded, scores, changes = self.search(words, n)
        edits: list[list] = [[] for _ in changes[1:]]
        if any(changes):
            ends = np.cumsum([0, *map(len, coded)]) // 4
            spans = {}
            for w, p in {k for c in changes for k in c}:
                sizes = [len(self.parts[part][0]) // 4 for part in self.split_word(words[w])[:p + 1]]
                spans[w, p] = int(ends[w]) + sum(sizes[:p]), int(ends[w]) + sum(sizes)
            edits = [[(*spans[k], change[k]) for k in sorted(change)] for change in changes[1:]]
        return b"".join(coded), scores, edits

    def segmentations(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text, with their ids."""
        ids, scores, changes = self.encode(text, n)
        words, out = self.words(text), []
        for score, change in zip(scores, changes, strict=True):
            row: list[int] = []
            for w, word in enumerate(words):
                for p, part in enumerate(self.split_word(word)):
                    row += change.get((w, p)) or np.frombuffer(self.parts[part][0], "<u4").tolist()
            out.append((score, row))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation, without the dummy space."""
        return b"".join(map(self.decoded.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(model_path: str) -> Pieces:
    """One lattice per Python worker: its memo serves all tasks."""
    return Pieces(model_path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


EDIT = ("from_piece", "to_piece", "ids")
OTHERS_TYPE = "array<array<struct<from_piece: int, to_piece: int, ids: array<int>>>>"
OTHERS = pa.list_(pa.list_(pa.struct(list(zip(EDIT, (pa.int32(), pa.int32(), pa.list_(pa.int32())), strict=True)))))


def encode_documents(docs: DataFrame, model_path: str | None = None, n: int = 4, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, ids: array<int> of the best segmentation, others: for each of segmentations 2 .. n, best first, the pieces
    ``ids[from_piece:to_piece]`` that it replaces, in order, and the ids it has there (``segmentation`` makes it whole), n_pieces, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), scores: the n best, best first; restored: whether decoding gives the text back), one
    row per row. Without ``with_ids`` the ids and others stay in the tasks. Null counts as empty: no ids, one score of 0.
    A text with U+2581 is not restored: the model spells a space that way. Repeated rows and null ids are kept;
    an empty table gives no rows; extra columns are ignored."""
    model_path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pieces(model_path)
        for batch in batches:
            lo = 0
            texts = batch.column(1)
            while lo < len(texts):
                rows, size, hi = [], 0, lo
                while hi < len(texts) and size < 1 << 20:
                    text = texts[hi].as_py() or ""
                    ids, scores, edits = lattice.encode_edits(text, n)
                    flat = np.frombuffer(ids, "<u4")
                    rows.append((flat, scores, lattice.decode(flat) == text, zlib.crc32(ids), edits))
                    size += len(text)
                    hi += 1
                counts = [len(r[0]) for r in rows]
                columns = {"doc_id": batch.column(0)[lo:hi]}
                if with_ids:
                    flat = np.concatenate([r[0] for r in rows]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat))
                    columns["others"] = pa.array([[[dict(zip(EDIT, e, strict=True)) for e in change] for change in r[4]]
                                                  for r in rows], OTHERS)
                columns |= {"n_pieces": pa.array(counts, pa.int64()), "ids_crc32": pa.array([r[3] for r in rows], pa.int64()),
                            "scores": pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                            "restored": pa.array([r[2] for r in rows])}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                lattice.units.trim()
                lattice.parts.trim()
                lattice.options.trim()
                lo = hi

    schema = (f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + f"ids array<int>, others {OTHERS_TYPE}, " * with_ids
              + "n_pieces bigint, ids_crc32 bigint, scores array<double>, restored boolean")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def segmentation(k: int, ids: str = "ids", others: str = "others") -> Column:
    """The ids of the k-th best segmentation (from 1) in rows of ``encode_documents``; null where there are fewer."""
    if k == 1:
        return F.col(ids)
    edits = F.get(F.col(others), k - 2)
    put = lambda row, e: F.concat(F.slice(row, F.lit(1), e["from_piece"]), e["ids"],
                                  F.slice(row, e["to_piece"] + 1, F.size(row)))
    return F.when(edits.isNotNull(), F.aggregate(F.reverse(edits), F.col(ids), put))


def decode_documents(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id",
                     ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of piece ids, such as those of ``encode_documents`` (``segmentation`` for the others), one row per row.
    Null ids give a null text, no ids the empty one; an empty table gives no rows; extra columns are ignored."""
    model_path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pieces(model_path)
        for batch in batches:
            ids = batch.column(1)
            texts = [lattice.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    schema = f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string"
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))
