"""Brute-force statements that the operators are compared with."""

from __future__ import annotations

import re

ODD_TEXTS = [
    (1, "a b c d e f g h i j"), (2, "A  B\tc d e f g h i\nj"), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "ONE two"),
    (8, "x" * 5000), (9, " ".join(f"w{i}" for i in range(3000))), (10, " ".join(f"w{i}" for i in range(3000)) + " tail"),
    (11, "é É ß ſ K"), (12, "é É ß ſ k"),
]


def words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words(text)
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def smallest_reachable(ids, links) -> dict:
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}
