"""Small frames with the awkward cases every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, size long, score double, key string, id string, part int, end long, row long, last int, cuts string, start long, n int, v string, hash string, component long, grp long, label int, letter int"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); further columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 7, 0.5, "k", "x", 3, 9, 1, 2, "c", 4, 5, "v", "h", 6, 7, 8, 9) for i, t, g, s in rows], SCHEMA)


def prose(rng: random.Random, n: int, words=("alpha", "Beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa")) -> str:
    return " ".join(rng.choice(words) + rng.choice(("", "", "", "s", "ing", ".")) for _ in range(n))


def awkward(rng: random.Random) -> list[tuple]:
    base = prose(rng, 80)
    near = base.split(" ")
    near[40] = "changed"
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, "   \t\n ", None, "b"), (4, "one two", "en", "b"),
        (5, base, "en", "a"), (6, base, "en", "a"), (6, base, "en", "a"), (7, " ".join(near), "en", "c"),
        (8, prose(rng, 20_000), "en", "a"), (None, "no id at all here, five words", "en", "a"), (9, "中文 テキスト ÀÉÎ ßig", "de", "é"),
        (10, "x" * 50_000, None, "a"), (11, base.upper(), "en", "b"), (12, "1234 5678 !!", "en", None),
    ]
