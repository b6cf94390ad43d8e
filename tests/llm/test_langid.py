"""op13: codewords, n-grams against brute force, held-out accuracy, odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandlake.llm import langid
from tests.llm.cases import DDL, odd_rows, row

SYLLABLES = {"en": "the ing er on an re th and", "fr": "le la que eau ou ç è tion", "de": "der sch ung ich ein ß ö be",
             "es": "el los ado ñ ció por ra ar", "el": "και το της ου να ος ία με"}


def text(lang, n, r):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_codewords():
    for n in range(2, 60):
        code = langid.codewords(n)
        assert code.shape[0] == n and not code.all(axis=0).any() and code.any(axis=0).all()
        assert len({tuple(c) for c in code}) == n
        assert langid.least_distance(code) >= (2 ** (n - 2) if n <= langid.EXHAUSTIVE else 2 * np.log2(n))
    assert langid.codewords(0).shape == (0, 0) and langid.codewords(1).shape == (1, 0)


def test_windows_equal_plain_ngrams(monkeypatch):
    texts = ["Ab, c1d!", None, "", "  é\n\nÉ ", "x", "12 34", "ab" * 30]
    monkeypatch.setattr(langid, "WINDOW", 11)
    grams = langid.Grams(pa.array(texts))
    got = [Counter() for _ in texts]
    for who, starts, bucket in grams.windows():
        for t, a, b in zip(who, starts, [*starts[1:], len(bucket)]):
            got[t].update(x for x in bucket[a:b].tolist() if x != langid.NOTHING)
    assert grams.totals().tolist() == [sum(c.values()) for c in got]
    for t, seen in zip(texts, got):
        raw, folded = (t or "").lower().encode(), b""
        for b in raw:
            b = b if b > 127 or chr(b).isalpha() else 32
            if b != 32 or not folded.endswith(b" "):
                folded += bytes([b])
        want = Counter()
        for k in langid.LENGTHS:
            for i in range(len(folded) - k + 1):
                code = int.from_bytes(folded[i:i + k], "big") + k * 0x3C6EF372
                want[code * 0x9E3779B1 % 2**32 >> 32 - langid.BITS] += 1
        assert seen == want, t


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    rows = [row(i, text(lang, r.randint(2, 60), r), lang) for i, lang in enumerate(r.choices(list(SYLLABLES), k=900))]
    return spark.createDataFrame(rows, DDL).repartition(6).cache()


def test_held_out_languages_are_found(spark, corpus):
    model = langid.train(corpus)
    assert model.langs == sorted(SYLLABLES) and model.code.shape == (5, 15)
    assert np.allclose(model.trust.sum(axis=1), 1)
    truth = {x.doc_id: x.lang for x in corpus.collect()}
    got = langid.identify(corpus, model).collect()
    assert len(got) == len(truth) and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    test = [x for x in got if x.held_out]
    assert sum(x.lang_pred == truth[x.doc_id] for x in test) >= 0.98 * len(test)
    assert all(0 < x.score <= 1 and x.runner_up != x.lang_pred for x in got)
    # weights equal the log ratio of the mean distributions, counted plainly
    counts = {lang: np.full(langid.BUCKETS, langid.SMOOTHING) for lang in model.langs}
    texts = {x.doc_id: x.text for x in corpus.select("doc_id", "text").collect()}
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 5:
            for _, _, bucket in langid.Grams(pa.array([t])).windows():
                counts[truth[d]] += np.bincount(bucket, minlength=langid.BUCKETS + 1)[:-1]
    p = np.stack([counts[lang] / counts[lang].sum() for lang in model.langs])
    for j in range(model.code.shape[1]):
        ones = model.code[:, j] > 0
        assert np.allclose(model.weights[j], np.log(p[ones].mean(axis=0) / p[~ones].mean(axis=0)), atol=1e-4)


def test_a_flipped_classifier_is_corrected_and_mixtures_are_ambiguous(spark, corpus):
    model = langid.train(corpus)
    r = random.Random(8)
    df = spark.createDataFrame([row(i, text("de", 60, r), "de") for i in range(20)], DDL)
    model.weights[3] *= -1  # one wrong bit of fifteen
    assert {x.lang_pred for x in langid.identify(df, model).collect()} == {"de"}
    model.weights[3] *= -1
    model.weights = model.weights * 0
    x = langid.identify(df, model).first()
    assert x.ambiguous and x.lang_pred == model.langs[0]
    clear = langid.identify(df, langid.train(corpus)).collect()
    assert not any(x.ambiguous for x in clear)


def test_held_out_rows_and_other_columns_do_not_matter(spark, corpus):
    changed = corpus.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    model, again = langid.train(corpus), langid.train(changed.withColumn("source", F.lit("other")))
    assert again.langs == model.langs and (again.weights == model.weights).all()


def test_odd_rows_and_small_models(spark, corpus):
    odd = spark.createDataFrame(odd_rows() + [row(20, "123 ... !"), row(21, "١٢"), row(22, "é"), row(23, "字")], DDL)
    got = langid.identify(odd, langid.train(corpus)).collect()
    assert len(got) == 16
    by_id = {x.doc_id: x for x in got}
    for d in (1, 2, 3, 20, 21):
        assert (by_id[d].lang_pred, by_id[d].score, by_id[d].ambiguous) == ("und", 0.0, False)
    assert by_id[22].lang_pred in SYLLABLES and by_id[23].lang_pred in SYLLABLES
    for df, langs in ((odd.limit(0), []), (odd.filter("lang is not null"), ["en"])):
        model = langid.train(df)
        assert model.langs == langs
        assert {x.lang_pred for x in langid.identify(odd, model).collect()} == {"und", *langs}
    assert langid.identify(odd.limit(0), langid.train(corpus)).collect() == []
