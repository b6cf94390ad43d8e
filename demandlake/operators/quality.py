"""Data quality.

Each row rule is one boolean Column; a report is one aggregation pass over
those columns (``count_if`` per rule). Table rules (duplicates, continuity)
are grouped aggregates, never a window over a possibly hot key. Row-level
results carry a ``reasons`` array so bad rows can be quarantined instead of
failing a job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.schema import (
    BUSINESS_TYPES,
    REQUIRED_SALES_COLUMNS,
    REQUIRED_UPLOAD_COLUMNS,
    WEATHER_VALUES,
)

#: column of unreadable cells that ``sources.sales.read_sales`` can add
BAD_CELLS = "bad_cells"
QUANTITY_COLS = ["quantity_available", "quantity_sold", "customer_demand", "waste_quantity"]


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


#: pseudo rule that carries row count and date range to the summary
TOTALS = "_totals"


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns absent from the schema (metadata only)."""
    return [c for c in required if c not in df.columns]


def any_null(cols: Sequence[str]) -> Column:
    out = F.lit(False)
    for x in cols:
        out = out | F.col(f"`{x}`").isNull()
    return out


def parse_date(c: str | Column) -> Column:
    """ISO date or null. Dates already typed pass through."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_date(F.trim(col.cast("string")), "yyyy-MM-dd")


def sales_row_rules(df: DataFrame, date_col: str = "date") -> list[tuple[str, str, Column]]:
    """(rule, level, failed-predicate) per row rule Q2-Q7, Q10, Q11 that
    applies to the columns present. A failed predicate is never null."""
    c = F.col
    rules: list[tuple[str, str, Column]] = []
    if _has(df, date_col):
        bad_date = c(date_col).isNotNull() & parse_date(date_col).isNull()
        if _has(df, BAD_CELLS):
            bad_date = bad_date | F.array_contains(BAD_CELLS, date_col)
        rules.append(("date_unparseable", "issue", bad_date))
    if _has(df, BAD_CELLS):
        rules.append(("cell_unreadable", "issue", F.exists(BAD_CELLS, lambda x: x != date_col)))
    rules.append(("has_null", "issue", any_null([x for x in df.columns if x != BAD_CELLS])))
    for q in QUANTITY_COLS:
        if _has(df, q):
            rules.append((f"negative_{q}", "issue", F.coalesce(c(q) < 0, F.lit(False))))
    if _has(df, "quantity_sold", "quantity_available"):
        rules.append(("sold_gt_available", "issue",
                      F.coalesce(c("quantity_sold") > c("quantity_available"), F.lit(False))))
    if _has(df, "quantity_sold", "customer_demand"):
        rules.append(("sold_gt_demand", "issue",
                      F.coalesce(c("quantity_sold") > c("customer_demand"), F.lit(False))))
    if _has(df, "waste_quantity", "quantity_available", "quantity_sold"):
        left = c("quantity_available") - c("quantity_sold")
        calc = F.when(left.isNotNull(), F.greatest(left, F.lit(0)))  # greatest alone would skip a null
        # A null on either side counts as wrong (NaN != NaN).
        rules.append(("waste_mismatch", "issue",
                      c("waste_quantity").isNull() | calc.isNull() | (c("waste_quantity") != calc)))
    if _has(df, "price"):
        rules.append(("price_not_positive", "issue", F.coalesce(c("price") <= 0, F.lit(False))))
    if _has(df, "shelf_life_hours"):
        rules.append(("shelf_life_negative", "issue", F.coalesce(c("shelf_life_hours") < 0, F.lit(False))))
    if _has(df, "weather_condition"):
        rules.append(("weather_invalid", "issue",
                      ~F.coalesce(c("weather_condition").isin(WEATHER_VALUES), F.lit(False))))
    if _has(df, "holiday_flag"):
        rules.append(("holiday_invalid", "issue", ~F.coalesce(c("holiday_flag").isin([0, 1]), F.lit(False))))
    return rules


def quality_checks(df: DataFrame, dup_keys: Sequence[str] = ("date", "item_name"),
                   date_col: str = "date", with_totals: bool = False, malformed: DataFrame | None = None,
                   ) -> DataFrame:
    """Q1-Q11 as a long table (rule, level, n_failed), one aggregation pass
    for the row rules plus one grouped aggregate for duplicates. ``with_totals``
    adds the row ``TOTALS`` (level: date range, n_failed: row count). ``malformed``, the
    quarantine of ``sources.uploads``, adds the rule malformed_line."""
    spark = df.sparkSession
    rules = sales_row_rules(df, date_col)
    counts = [F.count_if(pred).cast("bigint").alias(f"r{i}") for i, (_, _, pred) in enumerate(rules)]
    counts.append(F.count(F.lit(1)).cast("bigint").alias("_rows"))
    if _has(df, date_col, "item_name"):
        # counted by item first, so that the number of items needs no second copy of the rows
        d = parse_date(date_col)
        by_item = df.groupBy(F.col("item_name").alias("_item")).agg(*counts, F.min(d).alias("_dmin"), F.max(d).alias("_dmax"))
        total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)
        one = by_item.agg(*[total(f"r{i}") for i in range(len(rules))], total("_rows"), F.min("_dmin").alias("_dmin"),
                          F.max("_dmax").alias("_dmax"), F.count("_item").cast("bigint").alias("_items"))
    else:
        one = df.agg(*counts)
    stack_parts = []
    for i, (name, level, _) in enumerate(rules):
        stack_parts += [f"'{name}'", f"'{level}'", f"r{i}"]
    if _has(df, date_col, "item_name"):
        expected = (F.datediff("_dmax", "_dmin") + 1).cast("bigint") * F.col("_items")
        one = one.withColumn("_cont", F.abs(F.coalesce(expected, F.lit(0)) - F.col("_rows")).cast("bigint"))
        stack_parts += ["'continuity'", "'warning'", "_cont"]
    n = len(stack_parts) // 3
    long = one.selectExpr(f"stack({n}, {', '.join(stack_parts)}) as (rule, level, n_failed)")
    missing = missing_columns(df, REQUIRED_SALES_COLUMNS)
    extra = [("missing_columns", "issue", len(missing))]
    if _has(df, *dup_keys):
        dups = (df.groupBy(*dup_keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
                .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_failed"))
                .select(F.lit("duplicate_keys").alias("rule"), F.lit("issue").alias("level"), "n_failed"))
        long = long.unionByName(dups)
    meta = spark.createDataFrame(extra, "rule string, level string, n_failed bigint")
    out = long.unionByName(meta)
    if malformed is not None:
        out = out.unionByName(malformed.agg(F.count(F.lit(1)).alias("n_failed")).select(
            F.lit("malformed_line").alias("rule"), F.lit("issue").alias("level"), "n_failed"))
    if not with_totals:
        return out
    span = (F.concat_ws(" to ", F.col("_dmin").cast("string"), F.col("_dmax").cast("string"))
            if _has(df, date_col, "item_name") else F.lit(""))
    totals = one.select(F.lit(TOTALS).alias("rule"), span.alias("level"), F.col("_rows").alias("n_failed"))
    return out.unionByName(totals)


@dataclass
class QualityResult:
    summary: DataFrame
    checks: DataFrame
    rows: DataFrame


def quality_summary(df: DataFrame, name: str, checks: DataFrame | None = None,
                    date_col: str = "date") -> DataFrame:
    """One row (dataset, valid, n_issues, n_warnings, total_rows,
    date_range, issues) built from the checks table (one with totals)."""
    checks = checks if checks is not None else quality_checks(df, date_col=date_col, with_totals=True)
    total = F.col("rule") == TOTALS
    failed = ~total & (F.col("n_failed") > 0)
    s = checks.agg(
        F.count_if(failed & (F.col("level") == "issue")).cast("bigint").alias("n_issues"),
        F.count_if(failed & (F.col("level") == "warning")).cast("bigint").alias("n_warnings"),
        F.max(F.when(total, F.col("n_failed"))).alias("total_rows"),
        F.max(F.when(total, F.col("level"))).alias("date_range"),
        F.array_sort(F.collect_list(F.when(failed, F.concat_ws(": ", "rule", F.col("n_failed").cast("string"))))
                     ).alias("issues"),
    )
    return s.select(
        F.lit(name).alias("dataset"), (F.col("n_issues") == 0).alias("valid"),
        "n_issues", "n_warnings", "total_rows", "date_range", F.array_join("issues", "; ").alias("issues"))


def row_reasons(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Per-row ``reasons`` array of failed rule names."""
    arr = F.array_compact(F.array(*[F.when(pred, F.lit(name)) for name, _, pred in rules]))
    return df.withColumn("reasons", arr)


def check_sales(df: DataFrame, name: str = "sales", malformed: DataFrame | None = None) -> QualityResult:
    """Q1-Q12 together: summary row, checks table, rows with reasons. ``malformed`` as in
    ``quality_checks``."""
    checks = quality_checks(df, with_totals=True, malformed=malformed)
    return QualityResult(quality_summary(df, name, checks), checks.where(F.col("rule") != TOTALS),
                         row_reasons(df, sales_row_rules(df)))


# ---------------------------------------------------------------------------
# Upload gate
# ---------------------------------------------------------------------------


def upload_rules(df: DataFrame) -> list[tuple[str, str, Column]]:
    c = F.col
    rules: list[tuple[str, str, Column]] = []
    if _has(df, "date"):
        rules.append(("date_invalid", "error", c("date").isNotNull() & parse_date("date").isNull()))
    if _has(df, "quantity_sold"):
        rules.append(("negative_quantity_sold", "error", F.coalesce(c("quantity_sold") < 0, F.lit(False))))
    if _has(df, "quantity_sold", "quantity_available"):
        rules.append(("sold_gt_available", "error",
                      F.coalesce(c("quantity_sold") > c("quantity_available"), F.lit(False))))
    rules.append(("has_null", "warning", any_null(df.columns)))
    return rules


def check_upload(df: DataFrame, strict: bool = False) -> DataFrame:
    """One row (valid, n_errors, n_warnings, rows, columns, errors,
    warnings); the warnings name each column with nulls and their number.

    ``strict=True`` also requires every column retraining reads."""
    required = list(REQUIRED_UPLOAD_COLUMNS) + ([c for c in REQUIRED_SALES_COLUMNS if c not in REQUIRED_UPLOAD_COLUMNS]
                                                if strict else [])
    missing = missing_columns(df, required)
    rules = upload_rules(df)
    one = df.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                 *[F.count_if(p).cast("bigint").alias(f"u{i}") for i, (_, _, p) in enumerate(rules)],
                 *[F.count_if(F.col(f"`{x}`").isNull()).cast("bigint").alias(f"n{i}") for i, x in enumerate(df.columns)])
    errs = [F.when(F.col(f"u{i}") > 0, F.concat(F.lit(f"{n}: "), F.col(f"u{i}").cast("string")))
            for i, (n, lv, _) in enumerate(rules) if lv == "error"]
    warns = [F.when(F.col(f"n{i}") > 0, F.concat(F.lit(f"nulls in {x}: "), F.col(f"n{i}").cast("string")))
             for i, x in enumerate(df.columns)]
    if missing:
        errs.insert(0, F.lit("missing_columns: " + ",".join(missing)))
    err_arr = F.array_compact(F.array(*errs)) if errs else F.array().cast("array<string>")
    warn_arr = F.array_compact(F.array(*warns)) if warns else F.array().cast("array<string>")
    return one.select(
        (F.size(err_arr) == 0).alias("valid"),
        F.size(err_arr).cast("bigint").alias("n_errors"),
        F.size(warn_arr).cast("bigint").alias("n_warnings"),
        "rows",
        F.lit(",".join(df.columns)).alias("columns"),
        F.array_join(err_arr, "; ").alias("errors"),
        F.array_join(warn_arr, "; ").alias("warnings"),
    )


def split_valid(df: DataFrame, rules: list[tuple[str, str, Column]],
                levels: Sequence[str] = ("issue", "error", "reject")) -> tuple[DataFrame, DataFrame]:
    """Rows failing any rule of the given levels go to quarantine with their
    ``reasons``; the rest are valid. One pass computes the reasons; both
    outputs are filters of it."""
    use = [r for r in rules if r[1] in levels]
    tagged = row_reasons(df, use)
    return (tagged.where(F.size("reasons") == 0).drop("reasons"),
            tagged.where(F.size("reasons") > 0))


# ---------------------------------------------------------------------------
# Request validation (R1-R5), re-aimed as table rules
# ---------------------------------------------------------------------------


def week_request_rules(df: DataFrame) -> list[tuple[str, str, Column]]:
    c = F.col
    rules = [
        ("item_name_empty", "reject", F.coalesce(F.length(F.trim(c("item_name"))) == 0, F.lit(True))),
        ("business_type_invalid", "reject", ~F.coalesce(c("business_type").isin(BUSINESS_TYPES), F.lit(False))),
        ("price_not_positive", "reject", ~F.coalesce(c("price") > 0, F.lit(False))),
        ("shelf_life_not_positive", "reject", ~F.coalesce(c("shelf_life_hours") > 0, F.lit(False))),
        ("starting_date_invalid", "reject", parse_date("starting_date").isNull()),
        ("weather_not_7", "reject", ~F.coalesce(F.size("weather_forecast") == 7, F.lit(False))),
        ("weather_invalid", "reject",
         ~F.coalesce(F.forall("weather_forecast", lambda x: F.coalesce(x.isin(WEATHER_VALUES), F.lit(False))), F.lit(False))),
        ("holidays_not_7", "reject", ~F.coalesce(F.size("holiday_flags") == 7, F.lit(False))),
        ("holiday_invalid", "reject",
         ~F.coalesce(F.forall("holiday_flags", lambda x: F.coalesce(x.isin(0, 1), F.lit(False))), F.lit(False))),
    ]
    return rules


def day_request_rules(df: DataFrame) -> list[tuple[str, str, Column]]:
    """R1-R3, R5 for single-day requests: name, business domain, positive
    price and shelf life, ISO date, weather in the closed domain (missing =
    'Clear'), holiday flag 0/1 (missing = 0)."""
    c = F.col
    return [
        ("item_name_empty", "reject", F.coalesce(F.length(F.trim(c("item_name"))) == 0, F.lit(True))),
        ("business_type_invalid", "reject", ~F.coalesce(c("business_type").isin(BUSINESS_TYPES), F.lit(False))),
        ("price_not_positive", "reject", ~F.coalesce(c("price") > 0, F.lit(False))),
        ("shelf_life_not_positive", "reject", ~F.coalesce(c("shelf_life_hours") > 0, F.lit(False))),
        ("date_invalid", "reject", parse_date("date").isNull()),
        ("weather_invalid", "reject", ~F.coalesce(F.coalesce(c("weather"), F.lit("Clear")).isin(WEATHER_VALUES), F.lit(False))),
        ("holiday_invalid", "reject", ~F.coalesce(F.coalesce(c("is_holiday"), F.lit(0)).isin(0, 1), F.lit(False))),
    ]


def validate_day_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single-day requests: (valid with trimmed name and defaults applied,
    rejected with reasons)."""
    ok, bad = split_valid(df, day_request_rules(df))
    return ok.withColumns({
        "item_name": F.trim("item_name"),
        "weather": F.coalesce(F.col("weather"), F.lit("Clear")),
        "is_holiday": F.coalesce(F.col("is_holiday"), F.lit(0)).cast("int"),
    }), bad


def plan_rules(df: DataFrame, pred: str = "predicted_demand", planned: str = "planned_quantity") -> list:
    """Predicted and planned quantities are present and non-negative."""
    c = F.col
    return [
        (f"{pred}_negative", "reject", ~F.coalesce(c(pred) >= 0, F.lit(False))),
        (f"{planned}_negative", "reject", ~F.coalesce(c(planned) >= 0, F.lit(False))),
    ]


def validate_plans(df: DataFrame, pred: str = "predicted_demand",
                   planned: str = "planned_quantity") -> tuple[DataFrame, DataFrame]:
    """Plan requests as (valid, rejected with reasons)."""
    return split_valid(df, plan_rules(df, pred, planned))


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R1-R5 over a week-request table: (valid with trimmed item_name,
    rejected with reasons)."""
    ok, bad = split_valid(df, week_request_rules(df))
    return ok.withColumn("item_name", F.trim("item_name")), bad
