"""Python steps over Arrow columns that hold one value at a time, so a worker's memory is that of the batch as it comes and goes, not of its values as objects."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

PIECE = 1 << 18  # signs of texts that are objects at once


def pieces(values: Iterable, kind: pa.DataType, size=len) -> Iterator[pa.Array]:
    """Arrow arrays of the values in order; each is built from some PIECE of size."""
    own, held = [], 0
    for v in values:
        own.append(v)
        held += 16 + (0 if v is None else size(v))
        if held >= PIECE:
            yield pa.array(own, kind)
            own, held = [], 0
    if own:
        yield pa.array(own, kind)


def each(column: pa.Array) -> Iterator:
    """The values as objects, one after the other."""
    return (v.as_py() for v in column)


def texts(values: Iterable[str | None]) -> pa.StringArray:
    """The values as one Arrow array, written as they come."""
    data, ends, valid, n = bytearray(), array("i", [0]), bytearray(), 0
    for v in values:
        if v is not None:
            data += v.encode()
        ends.append(len(data))
        valid.append(v is not None)
        n += 1
    nulls = pa.array(memoryview(valid), pa.uint8()).cast(pa.bool_()).buffers()[1] if 0 in valid else None
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(data), nulls)


def mapped(step, kind: pa.DataType = pa.string(), size=len):  # noqa: B008
    """A column function of step, a function of as many values as it is given columns; null where one of them is null."""

    def run(*columns: pa.Array) -> pa.Array:
        values = (None if any(v is None for v in vs) else step(*vs) for vs in zip(*map(each, columns), strict=True))
        if kind == pa.string():
            return texts(values)
        done = list(pieces(values, kind, size))
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return F.arrow_udf(run, from_arrow_type(kind))
