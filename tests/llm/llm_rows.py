"""Rows of documents with every kind of oddity."""

from __future__ import annotations

import random

WORDS = ["ab", "cd", "Éa", "xyz", "the", "of", "q###", "a|b"]


def make_rows(seed: int, n: int = 120) -> list[tuple]:
    """(doc_id, text): nulls, empty and long texts, copies, near copies, repeated and null ids."""
    draw = random.Random(seed)
    base = [" ".join(draw.choice(WORDS) + draw.choice(["", "", ".", "\n", "  "]) for _ in range(draw.randint(0, 90))) for _ in range(15)]
    rows: list[tuple] = []
    for i in range(n):
        a, b = draw.choice(base), draw.choice(base)
        cut = draw.randint(0, len(a))
        text = draw.choice([a, a, a[:cut] + b[cut:], a[:cut] + "Z" + a[cut:], None, "", "   ", "a" * draw.randint(0, 300), draw.choice(WORDS)])
        rows.append((draw.choice([i, i, i, i, 7, None]), text))
    rows.append((10_000, " ".join(draw.choice(WORDS) + str(draw.randint(0, 9)) for _ in range(6_000))))
    return rows + rows[20:23]
