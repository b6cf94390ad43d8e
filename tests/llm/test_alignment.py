"""op11 against a plain alignment of every document, with odd rows and copies."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from demandlake.llm import alignment
from tests.llm.cases import DDL, odd_rows, prose, row


def byte_letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {}, 0
    for b in range(256):
        if b in shown:
            names[chr(b)] = b
        else:
            names[chr(256 + extra)] = b
            extra += 1
    return names


class Plain:
    def __init__(self):
        path_a, path_b = alignment.default_paths()
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.letters = byte_letters()

    def groups(self, text):
        want = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        out, lo = [], 0
        for hi in cuts:
            out.append(([i for i, e in zip(a, ends_a) if lo < e <= hi], [i for i, e in zip(b, ends_b) if lo < e <= hi]))
            lo = hi
        return out


def brute(rows):
    plain = Plain()
    cache = {t: plain.groups(t) for t in {x[1] or "" for x in rows}}
    count = Counter()
    for x in rows:
        count.update({(a, b) for g in cache[x[1] or ""] for a in g[0] for b in g[1]})
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for x in rows:
        groups = cache[x[1] or ""]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        links = Counter((a, b) for g in groups for a in g[0] for b in g[1])
        out.append((x[0], sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups),
                    sum(links.values()), sum(m for p, m in links.items() if count[p] == top[p[0]]),
                    sum(m * count[p] for p, m in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


STRANGE = ["<|endoftext|> a", "a<|endoftext|>", "<s> x </s>", "<0x41>", "▁x", "x▁", "  two  spaces ", "\n\n\t",
           "é́ naïve ﬁ", "漢字かな交じり文", "😀😀 👩‍👩‍👧", "\u0000x", "a b c", "İstanbul ſ K", "﻿x", "'s 'S don't",
           "1234567890", "x" * 3000, "=" * 700 + "-" * 333, "​​"]


@pytest.mark.parametrize("block_chars,links", [(1 << 21, 1 << 20), (400, 3)])
def test_alignment_equals_brute_force(spark, monkeypatch, block_chars, links):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block_chars)
    monkeypatch.setattr(alignment, "LINKS", links)
    odd = [x for x in odd_rows() if len(x[1] or "") < 60_000]
    rows = [row(100 + i, t) for i, t in enumerate(STRANGE * 2)] + [row(300 + i, prose(30, i % 9)) for i in range(40)] + odd
    df = spark.createDataFrame(rows, DDL).repartition(5)
    got = alignment.align_documents(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_groups_and_pair_counts(spark):
    texts = ["the weather <|endoftext|>", "", "naïve 漢字", "the weather <|endoftext|>"]
    aligned = alignment.align_texts(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = Plain()
    found = {}
    for x in alignment.text_groups(aligned).orderBy("position").collect():
        found.setdefault(bytes(x.key), []).append((x.a_ids, x.b_ids))
    assert found == {hashlib.sha256(t.encode()).digest(): plain.groups(t) for t in texts if t}
    counts = {x.pair: x.n_docs for x in alignment.pair_counts(aligned).collect()}
    a, b = (ids[0] for ids in plain.groups(texts[0])[0])
    assert counts[a << alignment.ID_BITS | b] == 2


def test_units_end_where_both_tokenizers_end():
    plain, tok = Plain(), alignment.tokenizers(*alignment.default_paths())
    r = np.random.default_rng(3)
    letters = list("ab,.'1 \n\té\u00a0\u3000ß漢😀\u0301▁ ") + ["  ", " the", " le", "<s>", "'s"]
    texts = ["".join(r.choice(letters, r.integers(1, 30))) for _ in range(1500)]
    block = alignment.align(texts, tok)
    text_groups = alignment.unit_texts(block, block.groups())
    at = np.concatenate(([0], np.cumsum(block.n_units)))
    for t, lo, hi in zip(texts, at, at[1:]):
        want = "".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";" for a, b in plain.groups(t))
        assert b"".join(text_groups[u] for u in block.unit_of[lo:hi]).decode() == want, repr(t)
    again = alignment.Block.unpack(block.pack(tok.bytes_a.kind, tok.bytes_b.kind))
    assert all((getattr(again, f) == getattr(block, f)).all() for f in ("n_units", "unit_of", "n_a", "a", "b", "last_a", "last_b"))


def test_one_very_large_group_is_counted_whole():
    a, b = np.arange(5000) % 7, np.arange(4000) % 3
    last_a, last_b = np.arange(5000) == 4999, np.arange(4000) == 3999
    block = alignment.Block(np.array([1]), np.array([0]), np.array([5000]), np.array([4000]), a, b, last_a, last_b)
    parts = list(block.groups().links(block))
    assert sum(int(np.sum(np.broadcast_to(t, p.shape))) for _, p, t in parts) == 5000 * 4000
    pairs, n = alignment.distinct_pairs(block, np.array([3]))
    assert len(pairs) == 21 and set(n.tolist()) == {3}


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], DDL)).collect() == []
