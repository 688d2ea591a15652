"""Stretches that two texts share, found by sets of hashed windows: time in proportion to both texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V
from .batches import slices

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD)


def window_hashes(text: str, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` characters from each place on, put together from hashes of powers of two."""
    one = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) * _MIX
    one ^= one >> np.uint64(29)
    n = len(one) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, done, power, width = np.zeros(n, np.uint64), 0, one, 1
    while width <= size:
        if size & width:  # this part of the window comes behind what is there
            out = out * np.uint64(pow(_BASE, width, 1 << 64)) + power[done : done + n]
            done += width
        power = power[: len(power) - width] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:] if width * 2 <= size else power
        width *= 2
    return out


def is_significant(chunk: str) -> bool:
    """Over nine ASCII letters and digits are left when words of code are taken out in order."""
    left = "".join(c for c in chunk if c.isascii() and c.isalnum())
    for word in V.CODE_WORDS:
        left = left.replace(word, "")
    return len(left) >= V.LEAK_SIGNIFICANT


def first_shared(prompt: str, response: str, size: int = V.LEAK_WINDOW) -> str | None:
    """The first window of the prompt that the response has and that is significant. Windows that share a hash are compared."""
    asked, said = window_hashes(prompt, size), window_hashes(response, size)
    known, where = np.unique(said, return_index=True)
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    hits = np.flatnonzero(known[at] == asked) if len(known) else at[:0]
    judged: dict[str, bool] = {}
    for i, j in zip(hits.tolist(), where[at[hits]].tolist(), strict=True):
        chunk = prompt[i : i + size]
        if chunk not in judged:
            judged[chunk] = (response[j : j + size] == chunk or chunk in response) and is_significant(chunk)
        if judged[chunk]:
            return chunk
    return None


def leak(prompt: str | None, response: str | None) -> str | None:
    """The first stretch of the lower-cased prompt that the response repeats; short prompts and responses have none."""
    if prompt is None or response is None:
        return None
    low, said = prompt.lower(), response.lower()
    return first_shared(low, said) if len(low.encode()) >= V.LEAK_PROMPT and len(said.encode()) >= V.LEAK_WINDOW else None


@F.arrow_udf(T.StringType())
def _leaks(prompt: pa.Array, response: pa.Array) -> pa.Array:
    return pa.array((leak(p, r) for p, r in slices(prompt, response)), pa.string())


def leaked(prompt: Column, response: Column) -> Column:
    return _leaks(prompt, response)
