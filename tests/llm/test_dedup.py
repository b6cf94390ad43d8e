"""op1 and op2 against brute force, with odd rows and hot groups."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from demandlake.llm import chaining, simhash
from demandlake.llm.components import connected_components
from tests.llm.cases import DDL, odd_rows, prose, row, words


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=2):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= distance:
            parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint_matches_spark_hash_and_brute_force(spark):
    texts = ["A b C d", "a  b\tc d e", "ÀÉ x y z", "one", "", None, prose(400, 1), "a b\x1cc d e\x0bf"]
    assert [simhash.simhash(t, 3) for t in texts] == [brute_fingerprint(t) for t in texts]
    one = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.simhash("one two three", 3) == one % 2**64
    many = prose(70_000, 4)
    assert simhash.simhash(many, 3) == brute_fingerprint(many)


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(2)
    base = [prose(60, s) for s in range(12)]
    rows = [row(i, t) for i, t in enumerate(base * 3)]
    for i in range(120):  # edits of one word of a long text move few bits
        w = prose(400, i % 6).split()
        w[r.randrange(len(w))] = "edit%d" % i
        rows.append(row(100 + i, " ".join(w)))
    rows += odd_rows()
    df = spark.createDataFrame(rows, DDL).repartition(5)
    got = simhash.near_duplicates(df).collect()
    fps = {x.row_id: x.fp % 2**64 for x in got}
    assert len(got) == len(rows) and sorted(fps.values()) == sorted(brute_fingerprint(x[1]) for x in rows)
    comp = brute_components(list(fps.values()))
    low = {}
    for x in got:
        c = comp[x.fp % 2**64]
        low[c] = min(low.get(c, 10**18), x.doc_id if x.doc_id is not None else 10**18)
    assert all(x.component_id == (None if (c := low[comp[x.fp % 2**64]]) == 10**18 else c) for x in got)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(set(comp.values()))
    assert {10**18 if x.doc_id is None else x.doc_id for x in kept.collect()} == set(low.values())


def test_ball_links_chain_and_distance(spark):
    fps = [0, 0b11, 0b1111, 0b111111, 1 << 63, (1 << 63) | (1 << 62), 0x5555555555555555]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    edges = [(a % 2**64, b % 2**64) for a, b in simhash.ball_links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    comp = brute_components(fps)
    parent = {f: f for f in fps}
    for _ in fps:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert len(set(parent.values())) == len(set(comp.values())) == 2
    with pytest.raises(ValueError):
        simhash.ball_links(df, 3)


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    df = spark.createDataFrame(path + star + [(5, 5)], "a bigint, b bigint")
    got = {x.node: x.component for x in connected_components(df).collect()}
    assert len(got) == 301 + 400 and len({got[i] for i in range(301)}) == 1
    assert len({got[1000 + i] for i in range(400)}) == 1 and len(set(got.values())) == 2
    assert connected_components(df.limit(0)).count() == 0


def test_simhash_of_an_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    assert simhash.near_duplicates(df).count() == 0 and simhash.drop_near_duplicates(df).count() == 0


def test_passages_are_found_and_clean_documents_left_alone(spark):
    r = random.Random(1)
    shared, fuzzy = words(60, 1000), words(80, 1001)
    edited = fuzzy.copy()
    for i in (20, 41, 63):
        edited[i] = "changed"
    edited.insert(50, "extra")
    rows = [row(i, " ".join(words(150, 9000 + i))) for i in range(40)]  # clean
    rows += [row(100 + i, " ".join(words(r.randint(0, 90), 200 + i) + shared + words(r.randint(0, 90), 300 + i)))
             for i in range(30)]  # a hot passage
    rows += [row(200, " ".join(words(40, 7000) + fuzzy + words(40, 7001))),
             row(201, " ".join(words(70, 7002) + edited + words(10, 7003)))]
    rows += [row(300 + i, prose(70, 50)) for i in range(20)]  # exact copies
    rows += odd_rows()
    df = spark.createDataFrame(rows, DDL).repartition(6)
    got = chaining.repeated_passages(df).collect()
    hit = {x.doc_id for x in got} | {f for x in got for f in x.first_ids}
    assert set(range(100, 130)) | {200, 201} | set(range(300, 320)) <= hit
    assert not hit & (set(range(40)) | {5, 6, 8})
    spans = {x.doc_id: x for x in got}
    assert set(range(101, 130)) <= set(spans) and spans[115].first_ids == [100] and spans[115].n_words == 60
    assert 78 <= spans[201].n_words <= 84 and spans[201].first_ids == [200] and spans[201].identity < 1
    again = chaining.repeated_passages(df.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))  # not dependent on partitions


def planted(n: int, spots, seed: int) -> tuple[list[str], list[str]]:
    """A passage of n words and its copy with the words at ``spots`` changed."""
    old = words(n, seed)
    return old, ["edit%d" % i if i in spots else w for i, w in enumerate(old)]


def test_edited_passages_are_found(spark):
    r = random.Random(4)
    cases = [(f"{n} every {gap}", n, lambda n=n, gap=gap: set(range(gap - 1, n, gap)))
             for n in (60, 80) for gap in (8, 10)]
    cases += [(f"80 random {share}", 80, lambda share=share: set(r.sample(range(80), round(80 * (1 - share)))))
              for share in (0.8, 0.85, 0.9, 0.95)]
    rows, want, doc = [], {}, 0
    for name, n, spots in cases:
        for _ in range(40):
            old, new = planted(n, spots(), 20_000 + doc)
            for text in (old, new):
                rows.append(row(doc, " ".join(words(50, 40_000 + doc) + text + words(50, 60_000 + doc))))
                doc += 1
            want[doc - 1] = name
    found = {x.doc_id: x for x in chaining.repeated_passages(spark.createDataFrame(rows, DDL).repartition(6)).collect()}
    assert set(found) <= set(want) and all(x.first_ids == [x.doc_id - 1] for x in found.values())
    recall = {name: sum(d in found for d, x in want.items() if x == name) / 40 for name, *_ in cases}
    print(recall)
    assert all(share == 1 for name, share in recall.items() if "every" in name)
    assert all(recall[f"80 random {share}"] >= least for share, least in ((0.8, 0.8), (0.85, 0.9), (0.9, 1), (0.95, 1)))
    assert all(x.from_word >= 48 and x.to_word <= 132 for x in found.values())


def test_passages_of_phrases_that_stand_first_elsewhere(spark):
    stock = words(54, 80)
    rows = [row(k, " ".join(words(60, 810 + k) + stock[7 * k:7 * k + 12] + words(60, 820 + k))) for k in range(7)]
    rows += [row(k, " ".join(words(20, 830 + k) + stock + words(20, 840 + k))) for k in (10, 11)]
    rows.append(row(12, " ".join(words(50, 850) + stock[:12] + words(50, 851))))  # one short phrase is no passage
    got = chaining.repeated_passages(spark.createDataFrame(rows, DDL).repartition(3)).collect()
    assert sorted((x.doc_id, x.from_word, x.to_word, x.first_ids) for x in got) == [
        (k, 20, 74, list(range(7))) for k in (10, 11)]


def test_extension_of_many_rows_equals_one_by_one():
    r = np.random.default_rng(5)
    b, a = r.integers(0, 3, 4000).astype(np.uint32), r.integers(0, 3, 4000).astype(np.uint32)
    b[1000:3000] = a[1003:3003]
    b[r.integers(0, 4000, 300)] = 9
    at, n = r.integers(40, 3900, (2, 500)), r.integers(0, chaining.MARGIN + 1, (2, 500))
    at[1] = np.where(np.arange(500) % 2, at[0] + 3, at[1])
    for way in (1, -1):
        got = np.stack(chaining.extend_rows(b, at[0], n[0], a, at[1], n[1], way)).T.tolist()
        cut = lambda w, s, k: w[s:s + k] if way > 0 else w[s - k + 1:s + 1][::-1]
        assert got == [list(chaining.extend(cut(b, s, k), cut(a, t, m))) for s, t, k, m in zip(*at, *n, strict=True)]


def test_chain_equals_quadratic_dynamic_program():
    r = random.Random(8)
    for _ in range(60):
        seg = [(x, x + n, y, y + n) for x, y, n in
               ((r.randrange(80), r.randrange(80), r.randint(6, 12)) for _ in range(r.randint(1, 14)))]
        seg.sort()
        x0, x1, y0, y1 = (list(c) for c in zip(*seg, strict=True))
        best = [0.0] * len(seg)
        for j in range(len(seg)):
            best[j] = x1[j] - x0[j] + max([0.0] + [
                best[i] - chaining.GAP_COST * (x0[j] - x1[i] + y0[j] - y1[i])
                for i in range(len(seg)) if x1[i] <= x0[j] and y1[i] <= y0[j]])
        top = chaining.chain(x0, x1, y0, y1)[0]
        score = float(x1[top[0]] - x0[top[0]])
        for i, j in zip(top, top[1:], strict=False):
            assert x1[i] <= x0[j] and y1[i] <= y0[j]
            score += x1[j] - x0[j] - chaining.GAP_COST * (x0[j] - x1[i] + y0[j] - y1[i])
        assert abs(score - max(best)) < 1e-9


def test_winnowing_chooses_in_every_window():
    g = np.random.default_rng(3).integers(0, 50, 400).astype(np.uint64)
    doc = np.repeat([0, 1, 2, 4], [180, 3, 120, 97])
    pick = set(chaining.winnow(g, doc).tolist())
    for d in (0, 1, 2, 4):
        at = np.flatnonzero(doc == d)
        for i in range(max(1, len(at) - chaining.WINDOW + 1)):
            assert pick & set(at[i:i + chaining.WINDOW].tolist())


def test_passages_of_an_empty_table(spark):
    assert chaining.repeated_passages(spark.createDataFrame([], DDL)).count() == 0


def test_only_ids_of_several_rows_have_versions(spark, monkeypatch):
    text = prose(120, 21)
    rows = [row(1, text), row(2, prose(90, 22) + " " + text), row(3, prose(150, 23)), row(4, text), row(4, prose(70, 24) + " " + text),
            row(None, text + " " + prose(80, 25)), row(None, text + " " + prose(40, 26)), row(5, prose(30, 27)), row(5, None), row(6, None)]
    df = spark.createDataFrame(rows, DDL)
    docs = df.select(F.coalesce("doc_id", F.lit(chaining.NO_ID)).alias("id"), "text")
    key = lambda x: str(x)
    seen = {(x.id, x.text): x.v for x in chaining.versioned(docs).collect()}
    assert {i for (i, _), v in seen.items() if v} == {4, 5, chaining.NO_ID} and len(set(seen.values())) == 6  # a null text's is 0 too
    assert [x.v for x in chaining.versioned(docs.where("id < 4 and id > 0")).collect()] == [0, 0, 0]
    some = sorted((tuple(x) for x in chaining.repeated_passages(df).collect()), key=key)
    monkeypatch.setattr(chaining, "MAX_REPEATED", 0)  # a version for every text
    assert all(x.v for x in chaining.versioned(docs.where("text is not null")).collect())
    assert some and some == sorted((tuple(x) for x in chaining.repeated_passages(df).collect()), key=key)
