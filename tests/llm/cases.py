"""Shared fixtures: documents with the odd rows every operator must take."""

import random

DDL = ("doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, row_id int, whole string, "
       "kept string, measured string, redacted string, id int, v int")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(2, 8))) for _ in range(n)]


def prose(n: int, seed: int) -> str:
    w = words(n, seed)
    return ". ".join(" ".join(w[i:i + 9]).capitalize() for i in range(0, n, 9))


def row(doc_id, text, lang="en", source="s"):
    """Extra columns clash with names that operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), "fp", 1, "w", "k", "m", "r", 2, 3)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    long = prose(30_000, 99)
    return [row(1, None), row(2, ""), row(3, " \n\t "), row(None, prose(80, 5)), row(5, prose(80, 6), None, None),
            row(6, long), row(7, prose(80, 7)), row(7, prose(80, 7)), row(7, prose(90, 8)), row(8, "one two"),
            row(9, "x" * 50_000), (None,) * 13]
