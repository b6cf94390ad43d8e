"""Quality rules with adaptive thresholds: mergeable quantile sketches per language
and source replace fixed cutoffs. DataFrame and SQL functions only.

The sketch is a histogram over integer values with relative bucket width 1/32
(exact below 32): bucket counts add up, so sketches merge exactly and the result
does not depend on how rows are partitioned. A group's upper fence is
``q75 + SPREADS * max(q75 - q25, least spread)``, its lower fence the mirror image.
A group of fewer than ``MIN_GROUP`` documents takes the merged sketch of its
language, a language of fewer that of the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.llm.shared import stage

WORD_GAP = "[\\x20\\x09-\\x0D]+"
WHITE = " \t\n\u000b\u000c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 200
SPREADS = 3
#: metric -> (least spread, whether low values fail too). Per-word rates are per 1000.
METRICS = {"word_len": (30, True), "symbol_rate": (10, False), "dup_line_rate": (150, False),
           "repeat_rate": (100, False), "upper_rate": (30, False)}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def covered(at: Column) -> Column:  # at: ascending positions of such windows
        def step(p: Column, k: Column) -> Column:
            return F.coalesce(F.least(F.lit(3), F.get(at, k + 1) - p), F.lit(3))

        return F.aggregate(F.transform(at, step), F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:  # s: (hash, position) in order
        def twin(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(s, k - 1)["h"] == x["h"]).otherwise(F.lit(False))
            return before | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    heavy = _let(_let(pairs, repeated), covered)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(heavy)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus one struct column ``measured`` (which must not exist yet) of
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper,
    base_failed and the integer metrics. Null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        windows = F.when(n >= 3, F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(
                F.array().cast("array<bigint>"))
        return F.struct(n.cast("bigint").alias("n_words"), _let(windows, _repeat_words).cast("bigint").alias("rep"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"),
                        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))

    length = lambda c: F.length(c).cast("bigint")
    counted = docs.withColumn("measured", F.struct(
        _let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"),
        length(F.regexp_replace(text, WORD_GAP, "")).alias("chars"),
        length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).alias("symbols"),
        length(F.regexp_replace(text, "[^A-Z]+", "")).alias("upper")))
    m = F.col("measured")
    n, chars, rep = m["w"]["n_words"], m["chars"], m["w"]["rep"]
    rate = lambda x, per, scale=1000: F.floor(x * scale / F.greatest(per, F.lit(1)))
    return counted.withColumn("measured", F.struct(
        n.alias("n_words"), chars.alias("word_chars"), m["symbols"].alias("n_symbols"),
        m["l"]["dup"].alias("n_dup_lines"), rep.alias("n_repeat_words"), m["l"]["n_lines"].alias("n_lines"),
        m["upper"].alias("n_upper"),
        ((n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        rate(chars, n, 100).alias("word_len"), rate(m["symbols"], n).alias("symbol_rate"),
        rate(m["l"]["dup"], m["l"]["n_lines"]).alias("dup_line_rate"), rate(rep, n).alias("repeat_rate"),
        rate(m["upper"], chars).alias("upper_rate")))


def bucket(x: Column) -> Column:
    """Lower edge of the sketch bucket of a non-negative long: the six leading bits."""
    shift = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def sketches(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Bucket counts (lang, source, metric, bucket, n) of all documents that pass the base rules.
    Null language or source counts as the empty string. The counts are summed before the
    shuffle, so a hot source sends one row per bucket and task."""
    values = F.array(*[F.struct(F.lit(k).alias("metric"), F.col("measured")[k].alias("x")) for k in METRICS])
    rows = measured.filter(~F.col("measured")["base_failed"]).select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.explode(values).alias("v"))
    return rows.groupBy("lang", "source", F.col("v")["metric"].alias("metric"), bucket(F.col("v")["x"]).alias("bucket")
                        ).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups, by adding bucket counts."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, q25_<metric>, q75_<metric>): the first buckets that reach a
    quarter and three quarters of the documents."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys, "metric")
    run = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("total", F.sum("n").over(by))
    aggs = [F.min(F.when((F.col("metric") == k) & (F.col("upto") * 4 >= F.col("total") * q), F.col("bucket"))
                  ).alias(f"q{25 * q}_{k}") for k in METRICS for q in (1, 3)]
    return run.groupBy(*keys).agg(F.max("total").alias("total"), *aggs)


def fit_fences(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, low_<metric>, high_<metric>) for each pair that has a document which
    passes the base rules."""
    sketch = stage(sketches(measured, lang_col, source_col), "sketches")
    quart = [f"q{q}_{k}" for k in METRICS for q in (25, 75)]
    pairs = quartiles(sketch, "lang", "source")
    langs = quartiles(merge(sketch, "lang"), "lang")
    whole = quartiles(merge(sketch)).select(F.struct(*quart)).scalar()  # one row: a scalar subquery
    joined = pairs.join(langs.select(
        "lang", F.col("total").alias("total_l"), *[F.col(c).alias(f"{c}_l") for c in quart]), "lang")
    joined = joined.withColumn("whole", whole)
    pick = lambda c: F.when(F.col("total") >= MIN_GROUP, F.col(c)).when(
        F.col("total_l") >= MIN_GROUP, F.col(f"{c}_l")).otherwise(F.col("whole")[c])
    out = []
    for k, (least, low) in METRICS.items():
        q1, q3 = pick(f"q25_{k}"), pick(f"q75_{k}")
        reach = SPREADS * F.greatest(q3 - q1, F.lit(least))
        out += [(q3 + reach).alias(f"high_{k}"), ((q1 - reach) if low else F.lit(-1)).cast("bigint").alias(f"low_{k}")]
    return joined.select("lang", "source", *out)


def judge(measured: DataFrame, fences: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``measured`` plus ``kept`` (boolean, must not exist yet): false if ``base_failed``, else
    whether every metric lies within the fences of the row's language and source."""
    fence = F.struct(*[F.col(c) for c in fences.columns if c not in ("lang", "source")])
    table = fences.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"),
                          fence.alias("fence"))
    on = (F.coalesce(F.col(lang_col), F.lit("")) == F.col("fence_lang")) & (
        F.coalesce(F.col(source_col), F.lit("")) == F.col("fence_source"))
    m, f = F.col("measured"), F.col("fence")
    ok = F.lit(True)
    for k in METRICS:
        ok = ok & (bucket(m[k]) <= f[f"high_{k}"]) & (bucket(m[k]) >= f[f"low_{k}"])
    verdict = ~m["base_failed"] & F.coalesce(ok, F.lit(True))
    return measured.join(table, on, "left").withColumn("kept", verdict).drop("fence_lang", "fence_source", "fence")


def apply_rules(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> DataFrame:
    """(whole: struct of the columns ``keep``, measured, kept), one row per input row.

    The measured rows are staged once; sketches and verdicts read them from there.
    Null and empty texts have no words and fail the base rules, whatever the
    thresholds; repeated rows are judged alike; an empty table gives no rows; any
    extra columns are allowed."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("whole"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    rows = stage(measure(rows).drop("text"), "measured")
    return judge(rows, fit_fences(rows)).select("whole", "measured", "kept")


def drop_low_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source") -> DataFrame:
    """``docs`` without the rows that the rules reject; columns unchanged, whatever their names. Null and empty
    texts have no words and go; null languages and sources are groups like any other; repeated rows are judged
    alike; very long texts are measured whole; an empty table stays empty."""
    return apply_rules(docs, docs.columns, text_col, lang_col, source_col).filter("kept").select("whole.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = apply_rules(docs, ["doc_id"])
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select("whole.doc_id", *[F.col("measured")[c].alias(c) for c in base], "kept")


def verdict_sql(table: str = "documents") -> str:
    """DuckDB SQL of (rid, *columns of ``table``, base columns, kept), one row per row of ``table``."""
    ws = r"[^\x20\x09-\x0D]+"
    metrics = ", ".join(f"('{k}', {k})" for k in METRICS)

    def pivot(key: str, tag: str) -> str:
        cols = ", ".join(f"min(CASE WHEN metric = '{k}' AND upto * 4 >= total * {q // 25} THEN bucket END) AS q{q}_{k}"
                         for k in METRICS for q in (25, 75))
        keys = f"{key}, " if key else ""
        part = f"PARTITION BY {keys}metric"
        return (f"{tag} AS (SELECT {keys}max(total) AS total, {cols} FROM (SELECT {keys}metric, bucket, "
                f"sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS total FROM (SELECT {keys}metric, "
                f"bucket, sum(n) AS n FROM sketch GROUP BY {keys}metric, bucket))" + (f" GROUP BY {key}" if key else "") + ")")

    def pick(c: str) -> str:
        return (f"(CASE WHEN p.total >= {MIN_GROUP} THEN p.{c} WHEN l.total >= {MIN_GROUP} THEN l.{c} ELSE w.{c} END)")

    fences, tests = [], []
    for k, (least, low) in METRICS.items():
        q1, q3 = pick(f"q25_{k}"), pick(f"q75_{k}")
        reach = f"{SPREADS} * greatest({q3} - {q1}, {least})"
        fences += [f"{q3} + {reach} AS high_{k}", (f"{q1} - {reach}" if low else "-1") + f" AS low_{k}"]
        tests.append(f"b_{k} <= high_{k} AND b_{k} >= low_{k}")
    edge = lambda c: f"(({c} >> greatest(length(bin({c})) - 6, 0)) << greatest(length(bin({c})) - 6, 0))"
    buckets = ", ".join(f"{edge(k)} AS b_{k}" for k in METRICS)
    values = " UNION ALL ".join(f"SELECT lang0, source0, '{k}' AS metric, b_{k} AS bucket FROM judged WHERE NOT base_failed"
                                for k in METRICS)
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS rid, * FROM {table}),
texts AS (SELECT rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{ws}') AS w FROM numbered),
wins AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
         FROM texts, unnest(generate_series(1, len(w) - 2)) AS u(i) WHERE len(w) >= 3),
twins AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) WHERE c > 1),
reps AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM twins, unnest([0, 1, 2]) AS v(k)) GROUP BY rid),
counts AS (
  SELECT x.rid, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len([y for y in string_split(t, chr(10)) if regexp_matches(y, '{ws}')]) AS BIGINT) AS n_lines,
    CAST(len(list_distinct([y for y in string_split(t, chr(10)) if regexp_matches(y, '{ws}')])) AS BIGINT) AS n_diff,
    coalesce(reps.n, 0) AS n_repeat_words
  FROM texts x LEFT JOIN reps ON reps.rid = x.rid),
rated AS (
  SELECT rid, n_words, word_chars, n_symbols, n_lines - n_diff AS n_dup_lines, n_repeat_words,
    (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
    word_chars * 100 // greatest(n_words, 1) AS word_len, n_symbols * 1000 // greatest(n_words, 1) AS symbol_rate,
    (n_lines - n_diff) * 1000 // greatest(n_lines, 1) AS dup_line_rate,
    n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, n_upper * 1000 // greatest(word_chars, 1) AS upper_rate
  FROM counts),
judged AS (SELECT n.*, r.* EXCLUDE (rid), coalesce(n.lang, '') AS lang0, coalesce(n.source, '') AS source0, {buckets}
           FROM numbered n JOIN rated r ON r.rid = n.rid),
sketch AS (SELECT lang0, source0, metric, bucket, count(*) AS n FROM ({values}) GROUP BY ALL),
{pivot("lang0, source0", "p0")},
{pivot("lang0", "l0")},
{pivot("", "w0")},
fences AS (SELECT p.lang0, p.source0, {", ".join(fences)} FROM p0 p JOIN l0 l ON l.lang0 = p.lang0 CROSS JOIN w0 w)
SELECT j.*, (NOT base_failed AND coalesce({" AND ".join(tests)}, true)) AS kept
FROM judged j LEFT JOIN fences f ON f.lang0 = j.lang0 AND f.source0 = j.source0
"""


SQL = f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
FROM ({verdict_sql()})"""
