"""op4 to op7: rollups, codes, segmentations and the toxicity model."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demandlake.llm import dac, nbest, tokencounts, toxicity
from demandlake.llm.memo import Memo
from demandlake.llm.shared import work_path
from tests.llm.cases import DDL, odd_rows, prose, row, words


# -- op4 ---------------------------------------------------------------------------

def changes(spark, rows):
    return spark.createDataFrame(rows, tokencounts.CHANGES)


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_rollup_batches(spark):
    r = tokencounts.Rollup(spark, work_path(spark, "t"))
    assert totals(r) == {}
    first = changes(spark, [(1, "insert", "a", "en", "w", 10), (2, "insert", "a", "en", "w", 5), (2, "insert", "a", "en", "c", 50),
                            (3, "insert", None, None, "w", None), (None, "insert", "a", "en", "w", 7),
                            (1, "insert", "a", "en", "w", 10)])  # a repeated row counts once
    assert r.commit(1, first) and not r.commit(1, first)
    assert totals(r) == {("a", "en", "w"): (3, 22), ("a", "en", "c"): (1, 50), (None, None, "w"): (1, 0)}
    second = changes(spark, [(1, "revise", "b", "de", "w", 12), (2, "delete", None, None, None, None),
                             (99, "delete", None, None, None, None), (3, "delete", None, None, "w", 0)])
    assert r.commit(2, second)
    assert totals(r) == {("b", "de", "w"): (1, 12), ("a", "en", "w"): (1, 7)}
    assert not r.commit(2, second) and not r.commit(1, first)
    assert r.commit(3, changes(spark, [])) and totals(r) == {("b", "de", "w"): (1, 12), ("a", "en", "w"): (1, 7)}
    assert r.commit(4, changes(spark, [(2, "insert", "a", "en", "w", 4)]))
    assert totals(r)[("a", "en", "w")] == (2, 11)


def test_rollup_counts_rows_without_a_tokenizer(spark):
    r = tokencounts.Rollup(spark, work_path(spark, "t"))
    r.commit(1, changes(spark, [(1, "insert", "a", "en", None, 10), (2, "insert", "a", "en", "w", 5)]))
    assert totals(r) == {("a", "en", None): (1, 10), ("a", "en", "w"): (1, 5)}
    r.commit(2, changes(spark, [(1, "revise", "a", "en", None, 4), (2, "delete", None, None, None, None)]))
    assert totals(r) == {("a", "en", None): (1, 4)}


def test_rollup_ignores_attempts_that_were_not_committed(spark):
    folder = work_path(spark, "t")
    r = tokencounts.Rollup(spark, folder)
    r.commit(1, changes(spark, [(1, "insert", "a", "en", "w", 10)]))
    spark.createDataFrame([("a", "en", "w", 5, 500)], "source string, lang string, tokenizer string, n_docs bigint, "
                          "n_tokens bigint").write.parquet(f"{folder}/deltas/batch=2-dead")
    assert totals(tokencounts.Rollup(spark, folder)) == {("a", "en", "w"): (1, 10)}


def test_rollup_equals_recount_of_random_batches(spark):
    rnd, state = random.Random(5), {}
    r = tokencounts.Rollup(spark, work_path(spark, "t"))
    for b in range(4):
        rows = []
        for d in rnd.sample(range(30), 12):
            if rnd.random() < 0.3:
                rows.append((d, "delete", None, None, None, None))
                state.pop(d, None)
            else:
                v = (rnd.choice("ab"), rnd.choice(["en", "de"]), rnd.randint(0, 9))
                rows.append((d, "insert" if d not in state else "revise", v[0], v[1], "w", v[2]))
                state[d] = v
        r.commit(b, changes(spark, rows))
    want = {}
    for s, lang, n in state.values():
        docs, total = want.get((s, lang, "w"), (0, 0))
        want[(s, lang, "w")] = (docs + 1, total + n)
    assert totals(r) == want


def test_rollup_query_equals_sql(spark, tmp_path):
    rows = [x[:5] for x in odd_rows() if x[0] is not None]
    rows = [x for k, x in enumerate(rows) if x[0] != 7 or k == 5] + [(20, prose(80, 6), "en", "s", 1), (21, "a, b | c.", None, "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(6, 0, 1), (6, 0, 0), (8, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    # a null text matches no pattern: count it as no token
    want = con.execute(tokencounts.SQL.replace("sum(n)", "coalesce(sum(n), 0)")).fetchall()
    got = [tuple(x) for x in tokencounts.query(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# -- op5 ---------------------------------------------------------------------------

def test_codes_round_trip_and_random_access():
    rnd = random.Random(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.array([rnd.choice([0, 1, 255, 256, 49407, 65536, 2**24 + 7, 2**32 - 1]) for _ in range(n)], "<u4")
        seg = dac.Segment(dac.pack([None, 5], [n // 2, n - n // 2], ids))
        assert seg.doc_ids == [None, 5] and seg.counts.sum() == n and (seg.all_tokens() == ids).all()
        for i in rnd.sample(range(n), min(n, 300)):
            assert seg.token(i) == ids[i]
        with pytest.raises(IndexError):
            seg.token(n)
    with pytest.raises(ValueError):
        dac.Segment(b"12345678" + bytes(24))


def test_word_encoder_equals_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, enc = Tokenizer.from_file(path), dac.WordEncoder(path)
    rnd = random.Random(2)
    texts = ["İstanbul É. ΑΣ don't 's x'll_a <|endoftext|> <|ENDOFTEXT|>x", "a b\u0085c\x0b é. ́x ́.", "", " \t",
             "word.… w.é x!́ ٣. ²! 漢字。 😀!", prose(3000, 3)]
    texts += ["".join(rnd.choice("aAéÉİſ'.,!_ \n\t12٣²́क़ß<|>Σ😀 st") for _ in range(rnd.randint(0, 25))) for _ in range(2000)]
    enc.words.limit = 200  # the memo is dropped again and again
    for lo in range(0, len(texts), 100):
        part = texts[lo:lo + 100]
        for t, got in zip(part, enc.encode(part), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_TOKENS", 300)
    rows = [row(i, prose(40 + i, i)) for i in range(40)] + odd_rows()
    df = spark.createDataFrame(rows, DDL).repartition(5)
    path = work_path(spark, "tokens")
    dac.write_tokens(df, path)
    tok = Tokenizer.from_file(dac.default_tokenizer())
    got = dac.read_documents(spark, path).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted((x[0] for x in rows), key=lambda d: (d is not None, d or 0))
    texts = {}
    for x in rows:
        texts.setdefault(x[0], []).append(np.array(tok.encode(x[1] or "", add_special_tokens=False).ids + [2], "<u4"))
    at, stream = 0, []
    for x in got:
        assert x.start == at
        match = next(i for i, t in enumerate(texts[x.doc_id])
                     if (len(t), zlib.crc32(t.tobytes())) == (x.n_tokens, x.ids_crc32))
        stream.append(texts[x.doc_id].pop(match))
        at += x.n_tokens
    stream = np.concatenate(stream)
    ask = spark.createDataFrame([(i,) for i in [0, 1, 299, 300, 301, at - 1, at, -1, 777, 777, None]], "position bigint")
    found = {x.position: x.token for x in dac.read_tokens(spark, path, ask).collect()}
    assert found == {i: int(stream[i]) for i in (0, 1, 299, 300, 301, 777, at - 1)}


def test_files_of_an_empty_table(spark):
    path = work_path(spark, "tokens")
    dac.write_tokens(spark.createDataFrame([], DDL), path)
    assert dac.read_documents(spark, path).count() == 0


# -- op6 ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def lattice():
    return nbest.Pieces(nbest.default_model())


def brute_segmentations(lattice, text):
    s, out = nbest.SPACE + text.replace(" ", nbest.SPACE), []

    def go(i, v, ids):
        if i == len(s):
            out.append((v, ids))
            return
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in lattice.score:
                go(j, v + lattice.score[s[i:j]][0], ids + (lattice.score[s[i:j]][1],))
        if s[i] not in lattice.score:
            go(i + 1, v + lattice.fallback, ids + tuple(lattice.byte_ids[b] for b in s[i].encode()))

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_nbest_equals_enumeration(lattice):
    rnd = random.Random(4)
    for _ in range(150):
        text = "".join(rnd.choice("thean inqg  é漢\n.,▁T") for _ in range(rnd.randint(1, 11)))
        want = brute_segmentations(lattice, text)
        for n in (1, 4):
            got = lattice.segmentations(text, n)
            assert [s for s, _ in got] == [s for s, _ in want[:n]], repr(text)
            assert len({tuple(i) for _, i in got}) == len(got) and all((s, tuple(i)) in want for s, i in got)


def test_long_runs_of_one_letter_end(lattice):
    ids, scores, _ = lattice.encode("x" * 20_000, 4)
    assert len(scores) == 4 and scores == sorted(scores, reverse=True) and lattice.decode(np.frombuffer(ids, "<u4")) == "x" * 20_000


def test_memo_is_bounded_and_right():
    calls = []
    memo = Memo(lambda k: calls.append(k) or k * 2, 10)
    for k in list(range(50)) * 2:
        assert memo[k] == 2 * k
        memo.trim()
        assert len(memo) + len(memo.older) <= 24


def test_documents_are_restored(spark):
    rows = odd_rows() + [row(30, "a  b \n c\td 漢 😀 é"), row(31, "sp▁ce")]
    got = nbest.encode_documents(spark.createDataFrame(rows, DDL).repartition(3), n=3).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.restored == (x.doc_id != 31) and len(x.scores) <= 3 and x.scores == sorted(x.scores, reverse=True)
        if x.doc_id in (1, 2):
            assert (x.ids, x.scores) == ([], [0.0])
        assert (x.n_pieces, x.ids_crc32) == (len(x.ids), zlib.crc32(np.array(x.ids, "<u4").tobytes()))
    short = nbest.encode_documents(spark.createDataFrame(rows, DDL), n=3, with_ids=False)
    assert "ids" not in short.columns
    assert sorted(x.ids_crc32 for x in short.collect()) == sorted(x.ids_crc32 for x in got)
    assert nbest.encode_documents(spark.createDataFrame([], DDL)).count() == 0


def test_all_segmentations_are_in_the_table_and_decode(spark, lattice, tmp_path):
    rows = odd_rows() + [row(30, "a  b \n c\td 漢 😀 é"), row(32, "the antitheses were unbelievable, thean inqg")]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    got = nbest.encode_documents(df, n=4).withColumns({f"seg{k}": nbest.segmentation(k) for k in range(1, 5)})
    texts = {x[0]: x[1] for x in rows if x[0] is not None and x[0] != 7}
    for x in got.filter(F.col("doc_id").isin(list(texts))).collect():
        want = lattice.segmentations(texts[x.doc_id] or "", 4)
        assert [x[f"seg{k}"] for k in range(1, 5)] == [i for _, i in want] + [None] * (4 - len(want))
    for k in (1, 3):
        part = got.filter(f"seg{k} is not null")
        back = nbest.decode_documents(part, ids_col=f"seg{k}").collect()
        assert len(back) == part.count() and all(x.text == (texts[x.doc_id] or "") for x in back if x.doc_id in texts)
    assert nbest.decode_documents(got.select("doc_id", F.lit(None).alias("ids"))).filter("text is null").count() == len(rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {"ids", "others"} <= set(nbest.query(spark, str(tmp_path)).columns)


# -- op7 ---------------------------------------------------------------------------

def toxic_rows(n=500):
    rnd, rows, labels = random.Random(7), [], []
    for i in range(n):
        s = [" ".join(words(8, 10 * i + k)) for k in range(rnd.randint(1, 12))]
        bad = rnd.random() < 0.3
        if bad:
            s[rnd.randrange(len(s))] += rnd.choice([" vilefulness", " vilefully", " nastyword"]) + " " + words(1, i)[0]
        rows.append(row(1000 + i, ". ".join(s)))
        labels.append((1000 + i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_rows()
    df = spark.createDataFrame(rows + odd_rows()[:3] + [(None,) * 13], DDL).repartition(4)
    lab = spark.createDataFrame(labels + [(None, 1), (1, None), (5000, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(df, lab)
    got = {x.doc_id: x for x in toxicity.score_documents(df, model).collect()}
    known = dict(labels)
    held = [d for d in known if got[d].held_out]
    assert held == [d for d in known if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(got[d].predicted == known[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    bad = {(x.doc_id, x.sentence) for x in toxicity.offending_sentences(df, model).collect()}
    text = {x[0]: x[1] for x in rows}
    import re
    marks = {(d, s) for d, t in text.items() for s, part in enumerate(re.split("[.!?\n]", t)) if "vileful" in part or "nastyword" in part}
    assert len(bad & marks) >= 0.9 * len(marks) and len(bad - marks) <= 0.05 * len(marks)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = toxic_rows(200)
    df = spark.createDataFrame(rows, DDL)
    flip = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    a, b = (toxicity.train(df, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (labels, flip))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_toxicity_without_labels_or_rows(spark):
    df = spark.createDataFrame(odd_rows(), DDL)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(df, none)
    got = toxicity.score_documents(df, model).collect()
    assert len(got) == len(odd_rows()) and all(x.predicted == 0 for x in got)
    assert toxicity.score_documents(df.limit(0), model).count() == 0
    assert df.select(toxicity.held_out(F.lit(None).cast("bigint")).alias("h")).first().h is False


def test_a_word_before_a_mark_is_solved_once():
    lattice = nbest.Pieces(nbest.default_model())
    word = next(w for w in ("zebra", "quizzing", "harbours") if len(lattice.split(nbest.SPACE + w + ")")) == 2)
    ids, score, _ = lattice.units[word + ")"]
    assert word in lattice.units and nbest.SPACE + word not in lattice.parts
    assert (ids, score) == (lattice.units[word][0] + lattice.parts[")"][0], lattice.units[word][1] + lattice.parts[")"][1])
    for part in (nbest.SPACE + word, "☃x", ")"):
        (best, found), *rest = lattice.nbest_part(part, 2)
        got = lattice.solve(part)
        assert np.frombuffer(got[0], "<u4").tolist() == list(found) and abs(got[1] - best) < 1e-9
        assert not rest or abs(got[2] - (best - rest[0][0])) < 1e-6
