"""Item lookup, unknown-item guess and label encodings."""

from pyspark.sql import functions as F

from demandlake.functions.items import encode_business, encode_category, guess_item, is_known_item, item_features, item_struct


def _feats(spark, rows, keywords=True):
    df = spark.createDataFrame(rows, "name string, price double, shelf double")
    cat, cx = item_features("name", "price", "shelf", keywords)
    return {r.name: (r.cat, r.cx) for r in df.select("name", cat.alias("cat"), cx.alias("cx")).collect()}


def test_known_items(spark):
    got = _feats(spark, [("Jollof Rice", 50.0, 4.0), ("Espresso", 25.0, 0.5), ("Cake Slice", 1.0, 100.0)])
    assert got == {"Jollof Rice": ("main_meal", 3), "Espresso": ("beverage", 1), "Cake Slice": ("dessert", 5)}


def test_guess_shelf_and_price_stage(spark):
    got = _feats(spark, [("Fufu", 45.0, 3.0), ("A", 45.0, 1.0), ("B", 45.0, 30.0), ("C", 45.0, 20.0),
                         ("D", 10.0, 5.0), ("E", 10.0, None), ("F", None, 5.0)])
    assert got["Fufu"] == ("main_meal", 2)
    assert got["A"] == ("beverage", 1)
    assert got["B"] == ("bakery", 3)
    assert got["C"] == ("dessert", 3)
    assert got["D"] == ("side_dish", 1)
    # null comparisons are false, as with NaN in pandas
    assert got["E"] == ("side_dish", 1)
    assert got["F"] == ("main_meal", 2)


def test_guess_keywords_are_substrings(spark):
    got = _feats(spark, [("Steak", 60.0, 5.0), ("Iced Tea", 60.0, 5.0), ("Meat Pie", 60.0, 5.0),
                         ("Spring Roll", 60.0, 5.0), ("Banana Bread", 10.0, 1.0), ("Blueberry Muffin", 60.0, 5.0)])
    assert got["Steak"] == ("beverage", 1)  # 'steak' contains 'tea'
    assert got["Iced Tea"] == ("beverage", 1)
    assert got["Meat Pie"] == ("dessert", 3)
    assert got["Spring Roll"] == ("light_meal", 2)
    assert got["Banana Bread"] == ("bakery", 4)  # keywords win over shelf life
    assert got["Blueberry Muffin"] == ("dessert", 3)


def test_guess_without_keywords(spark):
    df = spark.createDataFrame([("Spring Roll", 60.0, 5.0)], "name string, price double, shelf double")
    cat, cx = guess_item("name", "price", "shelf", keywords=False)
    r = df.select(cat.alias("c"), cx.alias("x")).first()
    assert (r.c, r.x) == ("main_meal", 2)


def test_label_codes(spark):
    cats = ["bakery", "beverage", "dessert", "light_meal", "main_meal", "pastry", "side_dish"]
    df = spark.createDataFrame([(c,) for c in cats], "c string")
    got = {r.c: r.code for r in df.select("c", encode_category("c").alias("code")).collect()}
    assert got == {c: i for i, c in enumerate(cats)}
    b = spark.createDataFrame([("Bakery",), ("Cafe",), ("Restaurant",), ("Diner",)], "b string")
    got = {r.b: r.code for r in b.select("b", encode_business("b", strict=False).alias("code")).collect()}
    assert got == {"Bakery": 0, "Cafe": 1, "Restaurant": 2, "Diner": None}


def test_unseen_label_raises_when_strict(spark):
    import pytest

    b = spark.createDataFrame([("Diner",)], "b string")
    with pytest.raises(Exception):
        b.select(encode_business("b")).collect()


def test_is_known(spark):
    df = spark.createDataFrame([("Latte",), ("Fufu",), (None,)], "n string")
    got = [r.k for r in df.select(is_known_item("n").alias("k")).collect()]
    assert got == [True, False, False]
    assert df.where(F.col("n").isNull()).count() == 1


def test_struct_of_both_equals_the_two_columns(spark):
    names = ["Jollof Rice", "Steak", "Iced Tea 3", "Rye Bread", "Meat Pie", "Wrap", "Dish 7", "", None]
    rows = [(n, p, s) for n in names for p in (10.0, 30.0, None) for s in (1.0, 5.0, 13.0, 30.0, None)]
    df = spark.createDataFrame(rows, "name string, price double, shelf double")
    for keywords in (True, False):
        cat, cx = item_features("name", "price", "shelf", keywords)
        both = df.select(F.struct(cat.alias("category"), cx.alias("complexity")).alias("a"),
                         item_struct("name", "price", "shelf", keywords).alias("b"))
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
