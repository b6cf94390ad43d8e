"""Words of Arrow string arrays as numpy arrays.

A batch of texts is cut into chunks of whole documents (about ``CHUNK`` bytes;
one longer document is a chunk of its own). Every word gets a 64-bit hash of
its bytes; no Python object is made per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _byte_codes() -> np.ndarray:
    """A random odd 64-bit code for each byte; 0 for separators. Letters, digits
    and all bytes of non-ASCII characters are word bytes."""
    codes = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in range(128):
        if not chr(b).isalnum():
            codes[b] = 0
    return codes


_CODES = _byte_codes()
_POWERS = np.cumprod(np.full(1 << 12, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(1 << int(n).bit_length(), _POWERS[0]), dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of the documents ``first .. first + len(bounds) - 2`` of a batch;
    document k has the words ``bounds[k]:bounds[k + 1]``. ``start`` and ``end``
    are byte offsets in the document's lower-cased text."""

    first: int
    bounds: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: sentence ends (. ! ? or a line end) before each word, counted through the chunk
    sentence: np.ndarray
    #: hashes of the first bytes of each word, for each length asked for
    prefixes: tuple[np.ndarray, ...] = ()

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def normalized(texts: pa.Array) -> pa.Array:
    """Null becomes the empty text; letters become lower case."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def word_chunks(lower: pa.Array, prefixes: tuple[int, ...] = ()) -> Iterator[Words]:
    """Chunks of the words (runs of letters and digits) of ``normalized`` texts, with hashes of
    their first ``prefixes`` bytes."""
    n = len(lower)
    offsets = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset:lower.offset + n + 1]
    data = np.frombuffer(lower.buffers()[2], dtype=np.uint8) if lower.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        cuts = offsets[lo:hi + 1] - offsets[lo]
        yield _words(data[offsets[lo]:offsets[hi]], cuts, lo, prefixes)
        lo = hi


def _words(data: np.ndarray, cuts: np.ndarray, first: int, lengths: tuple[int, ...]) -> Words:
    code = _CODES[data]
    is_word = code != 0
    brk = np.zeros(len(data) + 1, bool)  # a word cannot run over a document's edge
    brk[cuts] = True
    prev = np.concatenate(([False], is_word[:-1])) & ~brk[:-1]
    starts = np.flatnonzero(is_word & ~prev)
    nxt = np.concatenate((is_word[1:], [False])) & ~brk[1:] if len(data) else is_word
    ends = np.flatnonzero(is_word & ~nxt) + 1
    if len(starts):
        at = np.arange(starts[0], len(data), dtype=np.int64)
        at -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        powers = _powers(int((ends - starts).max()))
        code = code[starts[0]:] * powers[np.minimum(at, len(powers) - 1)]
        hashes = mix(np.add.reduceat(code, starts - starts[0]))
        prefixes = tuple(mix(np.add.reduceat(np.where(at < k, code, np.uint64(0)), starts - starts[0]) ^ np.uint64(k))
                         for k in lengths)
    else:
        hashes = np.zeros(0, np.uint64)
        prefixes = (hashes,) * len(lengths)
    bounds = np.searchsorted(starts, cuts)
    base = np.repeat(cuts[:-1], np.diff(bounds))
    sentence = np.cumsum(_STOPS[data], dtype=np.int32)[starts]
    return Words(first, bounds, hashes, starts - base, ends - base, sentence, prefixes)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (``len(h) - n + 1`` of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[k:len(h) - n + 1 + k]
    return mix(out)


def gram_rows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of all n-grams that lie within one document."""
    g = grams(w.hash, n)
    doc = w.doc_of()
    whole = doc[:len(g)] == doc[n - 1:] if len(g) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    return g[at], at
