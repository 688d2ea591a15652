"""Texts on their way through Python: no longer than can matter, and a few rows of a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

#: Rows of an Arrow batch that are Python objects at once.
SLICE = 256


def judgeable(raw: Column | str) -> Column:
    """A text of which no more is sent than shows that it is too long: of so many characters over MAX_BYTES are left when line ends
    of two become one. Any other text is whole."""
    return F.substring(raw, 1, 2 * (V.MAX_BYTES + 1))


def slices(*columns: pa.Array) -> Iterator[tuple]:
    """The rows of a batch, SLICE of them as Python objects at once."""
    for at in range(0, len(columns[0]), SLICE):
        yield from zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)


def structs(raw: pa.Array, one: Callable[[str | None], tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """one(text) of each text as structs."""
    kind, parts = pa.struct(fields), []
    for at in range(0, len(raw), SLICE):
        columns = zip(*(one(x) for x in raw.slice(at, SLICE).to_pylist()), strict=True)
        parts.append(pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], fields=list(kind)))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
