"""Vector expressions on arrays of numbers, evaluated in the JVM, and products with small matrices, evaluated by Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision; null if either array is null or their lengths differ."""
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_norm(a: str | Column) -> Column:
    """Euclidean norm in double precision."""
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def l2_normalise(a: str | Column) -> Column:
    """Unit vector; the norm is floored at 1e-12, so a zero vector stays zero."""
    n = F.greatest(l2_norm(a), F.lit(EPS))
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays of any norm."""
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(EPS)) * F.greatest(l2_norm(b), F.lit(EPS)))


def rows_of(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """float64 rows of a list column without nulls, all of one length."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(a), -1) if len(a) else flat.reshape(0, 0)


def products(df: DataFrame, ids: list[str], vec: str, bank: np.ndarray, out: str = "cos") -> DataFrame:
    """ids and `out`, the inner products of each row's vector with all rows of bank, as an array: one matrix product a batch, the
    bank sent once. Rows whose vector is null are left out."""
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(bank.T, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = rows_of(b.column(len(ids))) @ shared.value
                offsets = pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(ids)], pa.ListArray.from_arrays(offsets, pa.array(c.ravel()))], names=[*ids, out])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ids)
    return df.where(F.col(vec).isNotNull()).select(*ids, vec).mapInArrow(run, f"{kinds}, {out} array<double>")
