"""Edit distances of many texts to one by bit vectors (Myers, Hyyrö): a word holds 64 rows of a table, numpy a column of it for every text."""

from __future__ import annotations

import numpy as np

#: Texts whose tables are held at once.
TEXTS = 1 << 13
_ONE, _TOP = np.uint64(1), np.uint64(63)


def columns(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters (a row for each place, a column for each text), sizes and numbers of the texts, longest first."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat, starts, order = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    letters = np.zeros((sizes.max(initial=0), len(texts)), np.intp)
    for j, n in enumerate(np.searchsorted(-sizes, -np.arange(len(letters)))):
        letters[j, :n] = flat[starts[:n] + j]
    return letters, sizes, order


def distances(letters: np.ndarray, sizes: np.ndarray, text: str) -> np.ndarray:
    """The distance of each column, longest first, to a text that is not empty."""
    same = 0  # what all of them begin with adds nothing
    while same < min(len(text) - 1, sizes.min(initial=len(text))) and (letters[same] == ord(text[same])).all():
        same += 1
    letters, sizes, text = letters[same:], sizes - same, text[same:]
    words = -(-len(text) // 64)
    at = np.zeros((words, max(letters.max(initial=0), *map(ord, text)) + 1), np.uint64)
    for i, c in enumerate(text):
        at[i // 64, ord(c)] |= _ONE << np.uint64(i % 64)
    # Bits of the rows at which a column of the table rises or falls.
    rises, falls = np.full((words, len(sizes)), ~np.uint64(0)), np.zeros((words, len(sizes)), np.uint64)
    for j, n in enumerate(np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)))):
        up, down = _ONE, np.uint64(0)  # from the word above; above the first, a column is one more than that before
        for w in range(words):
            equal, p, m = at[w].take(letters[j, :n]), rises[w, :n], falls[w, :n]
            v = equal | m
            if w:
                equal |= down
            h = (((equal & p) + p) ^ p) | equal
            plus, minus, above, below = m | ~(h | p), p & h, up, down
            if w < words - 1:
                up, down = plus >> _TOP, minus >> _TOP
            plus = plus << _ONE | above
            rises[w, :n], falls[w, :n] = minus << _ONE | below | ~(v | plus), plus & v
    last = ~np.uint64(0) >> np.uint64(64 * words - len(text))
    rises[-1] &= last
    falls[-1] &= last
    return sizes + np.bitwise_count(rises).sum(0, np.int64) - np.bitwise_count(falls).sum(0, np.int64)


def first_near(texts: list[str], leaders: list[str], threshold: float) -> np.ndarray:
    """For each text the number of the first leader whose similarity, 1 - distance / greater length, reaches the threshold; -1 if none does."""
    out = np.full(len(texts), -1, np.int32)
    for start in range(0, len(texts), TEXTS):
        letters, sizes, order = columns(texts[start : start + TEXTS])
        for k, leader in enumerate(leaders):
            most = np.maximum(sizes, len(leader))
            fit = np.flatnonzero(np.abs(sizes - len(leader)) <= most * (1 - threshold) + 1e-9)
            if not len(fit):
                continue
            some = slice(fit[0], fit[-1] + 1)
            near = np.zeros(len(sizes), bool)
            near[some] = 1.0 - distances(letters[:, some], sizes[some], leader) / most[some] >= threshold
            out[start + order[near]] = k
            letters, sizes, order = letters[:, ~near], sizes[~near], order[~near]
    return out


def first_leaders(texts: list[str], threshold: float, few: int, longest: int) -> tuple[list[int], int]:
    """Numbers of the texts that lead, if each joins the first leader before it that it is similar to, and how many join one: the first few leaders, up to one that is longer."""
    left, out = list(range(len(texts))), []
    while left and len(out) < few and len(texts[left[0]]) <= longest:
        first, *left = left
        out.append(first)
        near = first_near([texts[i] for i in left], [texts[first]], threshold)
        left = [i for i, k in zip(left, near, strict=True) if k < 0]
    return out, len(texts) - len(out) - len(left)
