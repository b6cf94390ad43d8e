"""op12 against a brute-force trie, with odd rows, copies and many ranges."""

import hashlib
import random
import zlib

import pytest

from demandlake.llm import prefixtrie

DDL = "conv_id bigint, turn bigint, role string, text string, depth int, n string, low string, ids string, part int"


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role, tie, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], ([], []))[0].append(c)
        nodes[seq][1].append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves, saved = int(p not in kids), (len(nodes[p][0]) - 1) * (len(p[-1][1]) if p else 0)
        for q in kids.get(p, []):
            leaves, saved = leaves + below[q][0], saved + below[q][1]
        below[p] = leaves, saved
    return sorted([min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), len(kids.get(p, [])), *below[p],
                   hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()] for p, (m, e) in nodes.items())


def table(n, seed, letters="ab", copies=0):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(n * 2), n):
        for t in range(r.choice([1, 2, 5, 6, 7, 9])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(letters) * r.randint(0, 2)))
    rows += [(10_000 + c, t, "user", "same") for c in range(copies) for t in range(8)]
    return rows


def odd():
    return [(None, 1, "user", "lost"), (700, None, "user", "first"), (700, 2, None, "x"), (700, 2, "user", None),
            (700, 2, "user", None), (701, 1, "user", "first"), (702, 0, "a", "bc"), (703, 0, "ab", "c"),
            (704, 0, "user", "é😀" * 20_000), (None, None, None, None)] + [(705, t, "user", "long") for t in range(900)]


@pytest.mark.parametrize("rows", [table(300, 1), table(150, 2, "abcdefgh", 60) + odd(), odd(), [(5, 1, "user", "one")]])
@pytest.mark.parametrize("range_turns", [60, 200_000])
def test_trie_equals_brute_force(spark, monkeypatch, rows, range_turns):
    monkeypatch.setattr(prefixtrie, "RANGE_TURNS", range_turns)
    monkeypatch.setattr(prefixtrie, "ENDS_TOGETHER", 7)
    df = spark.createDataFrame([(*r, 1, "n", "l", "i", 2) for r in rows], DDL).repartition(4)
    out = prefixtrie.conversation_trie(df)
    assert tuple(out.columns) == prefixtrie.COLUMNS
    got = [list(x) for x in out.collect()]
    key = lambda x: (x[0], x[1], -1 if x[2] is None else x[2], *x[3:])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_trie_of_an_empty_table(spark):
    assert prefixtrie.conversation_trie(spark.createDataFrame([], DDL)).collect() == []


def test_forest_of_ranges_adds_up():
    """Cutting the sorted sequences anywhere gives the same nodes after adding up those named alike."""
    r = random.Random(5)
    ids = sorted({tuple(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in range(60)})
    sizes, n, low = [[ord(x) - 90 for x in s] for s in ids], [r.randint(1, 4) for _ in ids], r.sample(range(999), len(ids))
    names = ["".join(s) for s in ids]

    def merged(cuts):
        inside, shared = [], {}
        for a, b in zip(cuts, cuts[1:]):
            left = prefixtrie.common_prefix(ids[a - 1], ids[a]) if a else -1
            right = prefixtrie.common_prefix(ids[b - 1], ids[b]) if b < len(ids) else -1
            for node in prefixtrie.forest(ids[a:b], sizes[a:b], n[a:b], low[a:b], names[a:b], left, right):
                if node[8] is None:
                    inside.append((node[0], node[1], *node[3:8]))
                else:
                    x = shared.setdefault(node[8], [node[0], node[1], 0, 0, 0, 0, None])
                    x[0] = min(x[0], node[0])
                    x[2:6] = [p + q for p, q in zip(x[2:6], node[3:7])]
                    x[6] = node[7] if x[6] is None else x[6]
        return sorted(map(str, inside + [tuple(x) for x in shared.values()]))

    whole = merged([0, len(ids)])
    for k in (1, 2, 3, 7):
        assert merged([*range(0, len(ids), k), len(ids)]) == whole
