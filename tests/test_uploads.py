"""Uploads by column name: shuffled, extra and missing columns, ragged lines, line numbers."""

import pytest
from pyspark.sql import functions as F

from demandlake.operators import quality as qa
from demandlake.sources import sales as io
from demandlake.sources import uploads as up

COLUMNS = ["item_name", "date", "quantity_sold", "quantity_available"]


def write(folder, **files):
    out = []
    for name, lines in files.items():
        path = folder / f"{name}.csv"
        path.write_bytes("\n".join(lines).encode())
        out.append(str(path))
    return out


def by_file(df, *cols):
    found = {}
    for r in df.collect():
        found.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append(tuple(r[c] for c in cols))
    return {k: sorted(v, key=str) for k, v in found.items()}


@pytest.fixture
def files(tmp_path):
    return write(
        tmp_path,
        a=["quantity_available,quantity_sold,item_name,date", "50,40,Latte,2025-06-01", "5,4,Tea"],
        b=["quantity_sold,quantity_available,date,item_name,note", "", "40,50,2025-06-02,Tea,x", "1,2,2025-06-03,Tea,x,y",
           "7,8,2025-06-04,\"Meat, Pie\",\"a \"\"b\"\"\"", "7,8,2025-06-05,\"open,z", "   "],
        c=["﻿\"date\", item_name ,date", "2025-06-06,Rye,2025-01-01"],
        d=["item_name,date"],
        e=["a,b,c,d", ",,,"],
        f=[])


@pytest.mark.parametrize("split", ["128m", "40b"])
def test_files_are_read_by_their_own_headers(spark, files, tmp_path, split):
    """Also when a file is cut into many blocks."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = up.read_uploads(spark, files, COLUMNS)
        rows = by_file(got.rows, "line", *COLUMNS)
        bad = by_file(got.quarantine, "line", "text", "n_expected")
        report = by_file(got.files, "n_rows", "n_malformed", "missing", "unknown")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {
        "a": [(2, "Latte", "2025-06-01", "40", "50")],
        "b": [(3, "Tea", "2025-06-02", "40", "50"), (5, "Meat, Pie", "2025-06-04", "7", "8")],
        "c": [(2, "Rye", "2025-06-06", None, None)],
        "e": [(2, None, None, None, None)]}
    assert bad == {"a": [(3, "5,4,Tea", 4)], "b": [(4, "1,2,2025-06-03,Tea,x,y", 5), (6, "7,8,2025-06-05,\"open,z", 5)]}
    assert report == {
        "a": [(1, 1, "", "")], "b": [(2, 2, "", "note")], "c": [(1, 0, "quantity_available,quantity_sold", "")],
        "d": [(0, 0, "quantity_available,quantity_sold", "")],
        "e": [(1, 0, "date,item_name,quantity_available,quantity_sold", "a,b,c,d")]}


def test_line_numbers_of_a_file_in_many_blocks(spark, tmp_path):
    lines = ["item_name,date"] + [f"x{i},2025-06-01" + (",z" if i % 7 == 0 else "") for i in range(2, 3000)]
    path = write(tmp_path, long=lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1kb")
    try:
        got = up.read_uploads(spark, path, ["item_name"])
        assert got.rows.where(F.col("item_name") != F.concat(F.lit("x"), "line")).count() == 0
        assert got.rows.count() + got.quarantine.count() == 2998
        assert got.quarantine.where((F.col("line") % 7 != 0) | (F.col("text") != F.concat(
            F.lit("x"), "line", F.lit(",2025-06-01,z")))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_swapped_columns_of_two_sales_files(spark, tmp_path):
    head = ["business_type", "item_name", "date", "price", "shelf_life_hours", "quantity_available", "quantity_sold",
            "customer_demand", "waste_quantity", "weather_condition", "holiday_flag"]
    swap = head[:5] + ["quantity_sold", "quantity_available"] + head[7:]
    a = "Cafe,Latte,2025-06-01,20,1,50,40,40,10,Clear,0"
    b = "Cafe,Latte,2025-06-02,20,1,40,50,40,10,Clear,0"
    paths = write(tmp_path, a=[",".join(head), a], b=[",".join(swap), b, b + ",9", "Cafe,Latte"])
    got = io.read_sales_uploads(spark, paths, qa.BAD_CELLS)
    assert sorted((r.quantity_available, r.quantity_sold) for r in got.rows.collect()) == [(50, 40), (50, 40)]
    checks = {r.rule: r.n_failed for r in qa.check_sales(got.rows, malformed=got.quarantine).checks.collect()}
    assert checks["malformed_line"] == 2 and checks["has_null"] == checks["sold_gt_available"] == 0
    summary = qa.check_sales(got.rows, "x", malformed=got.quarantine).summary.first()
    assert not summary.valid and "malformed_line: 2" in summary.issues


def test_a_line_is_split_once_for_its_width_and_placed_by_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\n4,5\n")
    (tmp_path / "b.csv").write_text("z,note\n7,n\n\"8,o\n")
    landed = up.land_lines(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    parsed = up.parse_lines(landed, ["z", "x", "w"])
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 2  # one for each width, not one for each cell
    assert plan.count("array_position(") <= 3  # in the table of blocks, not for every line
    rows = {(r.text, r.n_expected, r.malformed, r.z, r.x, r.w) for r in parsed.collect()}
    assert {r[:3] for r in rows} == {("1,2,3", 3, False), ("4,5", 3, True), ("7,n", 2, False), ('"8,o', 2, True)}
    assert ("1,2,3", 3, False, "3", "1", None) in rows and ("7,n", 2, False, "7", None, None) in rows
