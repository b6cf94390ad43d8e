"""Item characteristics: known-item lookup, guess for unknown items, label
encodings. All are Column expressions: the fixed 15-item dictionary is a
literal map, so the lookup needs neither a join nor a broadcast."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlake.schema import (
    BUSINESS_TYPES,
    CATEGORIES,
    GUESS_DEFAULT,
    GUESS_KEYWORD_GROUPS,
    GUESS_SHELF_PRICE_RULES,
    KNOWN_ITEMS,
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _known_map(pos: int) -> Column:
    return F.create_map(
        *chain.from_iterable((F.lit(k), F.lit(v[pos])) for k, v in KNOWN_ITEMS.items())
    )


def known_category(name: str | Column) -> Column:
    return _known_map(0)[_c(name)]


def known_complexity(name: str | Column) -> Column:
    return _known_map(1)[_c(name)]


def is_known_item(name: str | Column) -> Column:
    return F.coalesce(_c(name).isin(list(KNOWN_ITEMS)), F.lit(False))


def guess_item(
    name: str | Column,
    price: str | Column,
    shelf_life: str | Column,
    keywords: bool = True,
) -> tuple[Column, Column]:
    """(category, complexity) guessed from shelf life and price,
    then (when ``keywords``) from lower-case substrings of the name, which
    win over the first stage. Comparisons with a null shelf life or price
    are false, as in pandas."""
    shelf, pr = _c(shelf_life), _c(price)
    stage_cat = F.lit(GUESS_DEFAULT[0])
    stage_cx = F.lit(GUESS_DEFAULT[1])
    # Build the first stage from the last rule backwards so the first rule wins.
    for kind, thr, cat, cx in reversed(GUESS_SHELF_PRICE_RULES):
        cond = {
            "shelf_lt": shelf < thr,
            "shelf_gt": shelf > thr,
            "price_lt": pr < thr,
        }[kind]
        cond = F.coalesce(cond, F.lit(False))
        stage_cat = F.when(cond, F.lit(cat)).otherwise(stage_cat)
        stage_cx = F.when(cond, F.lit(cx)).otherwise(stage_cx)
    if not keywords:
        return stage_cat, stage_cx
    low = F.lower(_c(name))
    cat_out, cx_out = stage_cat, stage_cx
    for words, cat, cx in reversed(GUESS_KEYWORD_GROUPS):
        # One regex find per group ("a|b|c" matches anywhere, i.e. the same
        # as any substring test) keeps the generated code small enough to
        # be JIT-compiled; the words are plain letters, so no escaping.
        assert all(w.isalpha() for w in words)
        hit = F.coalesce(low.rlike("|".join(words)), F.lit(False))
        cat_out = F.when(hit, F.lit(cat)).otherwise(cat_out)
        cx_out = F.when(hit, F.lit(cx)).otherwise(cx_out)
    return cat_out, cx_out


def item_struct(name: str | Column, price: str | Column, shelf_life: str | Column, keywords: bool = True) -> Column:
    """P6 + P7 as one struct (category, complexity): the name is looked up and searched once for both."""
    known = F.create_map(*chain.from_iterable(
        (F.lit(k), _pair(v[0], v[1])) for k, v in KNOWN_ITEMS.items()))[_c(name)]
    shelf, pr = _c(shelf_life), _c(price)
    guess = _pair(*GUESS_DEFAULT)
    for kind, thr, cat, cx in reversed(GUESS_SHELF_PRICE_RULES):
        cond = {"shelf_lt": shelf < thr, "shelf_gt": shelf > thr, "price_lt": pr < thr}[kind]
        guess = F.when(F.coalesce(cond, F.lit(False)), _pair(cat, cx)).otherwise(guess)
    for words, cat, cx in reversed(GUESS_KEYWORD_GROUPS) if keywords else ():
        hit = F.coalesce(F.lower(_c(name)).rlike("|".join(words)), F.lit(False))
        guess = F.when(hit, _pair(cat, cx)).otherwise(guess)
    return F.coalesce(known, guess)


def _pair(category: str, complexity: int) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(complexity).cast("int").alias("complexity"))


def item_features(
    name: str | Column,
    price: str | Column,
    shelf_life: str | Column,
    keywords: bool = True,
) -> tuple[Column, Column]:
    """P6 + P7: known lookup first, guess otherwise."""
    g_cat, g_cx = guess_item(name, price, shelf_life, keywords)
    return (
        F.coalesce(known_category(name), g_cat),
        F.coalesce(known_complexity(name), g_cx).cast("int"),
    )


def _label_index(col: Column, labels: list[str], what: str, strict: bool) -> Column:
    """Alphabetical label index; unseen labels raise (strict) or give null."""
    ordered = sorted(labels)
    idx = F.array_position(F.array(*[F.lit(x) for x in ordered]), col).cast("int") - 1
    if not strict:
        return F.when(idx >= 0, idx)
    return F.when(idx >= 0, idx).otherwise(
        F.raise_error(F.concat(F.lit(f"unseen {what} label: "), F.coalesce(col, F.lit("null"))))
    ).cast("int")


def encode_category(category: str | Column, strict: bool = True) -> Column:
    """Bakery 0, beverage 1, dessert 2, light_meal 3, main_meal 4,
    pastry 5, side_dish 6."""
    return _label_index(_c(category), CATEGORIES, "category", strict)


def encode_business(business: str | Column, strict: bool = True,
                     labels: list[str] | None = None) -> Column:
    """Bakery 0, Cafe 1, Restaurant 2 (alphabetical over the domain)."""
    return _label_index(_c(business), labels or BUSINESS_TYPES, "business_type", strict)
