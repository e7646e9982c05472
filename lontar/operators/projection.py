"""Linear projections of vectors: block-wise products, and matrices fitted from sums over partitions.

A matrix is as large as the dimensions of its two sides, whatever the number of rows: it is broadcast, and each Arrow batch of
vectors is one product. What a fit needs of the rows are sums of products (a Gram matrix and cross products): each task adds
up its own and sends one row a dimension, which are added by dimension; the driver sees the sum alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest matrix, in numbers, that is broadcast or summed: 512 MB.
MOST = 1 << 26


def _rows(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of the vectors of the right size without nulls, their places)."""
    at = [i for i, x in enumerate(column.to_pylist()) if x is not None and len(x) == size and None not in x]
    flat = column.take(pa.array(at, pa.int64())).flatten().to_numpy(zero_copy_only=False) if at else np.zeros(0)
    return np.asarray(flat, np.float64).reshape(len(at), size), np.array(at, np.int64)


def projected(df: DataFrame, vector: str, matrix, bias=None, name: str = "proyeksi") -> DataFrame:
    """df with `name`, vector times matrix (rows: its dimensions) plus bias; null for a null vector, one of another size, or with nulls."""
    m = np.asarray(matrix, np.float64)
    b = np.zeros(m.shape[1]) if bias is None else np.asarray(bias, np.float64)
    if m.size > MOST:
        raise ValueError(f"a matrix of {m.size} numbers is too large to broadcast")
    sent = df.sparkSession.sparkContext.broadcast((m, b))
    schema = df.withColumn(name, F.lit(None).cast("array<double>")).schema
    kept = [c for c in df.columns if c != name]

    def run(batches):
        m, b = sent.value
        for batch in batches:
            x, at = _rows(batch.column(vector), m.shape[0])
            y = x @ m + b
            size = np.zeros(batch.num_rows, np.int32)
            size[at] = m.shape[1]
            some = np.zeros(batch.num_rows, bool)
            some[at] = True
            out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(y.ravel()), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], out], [*kept, name])

    return df.select(*kept).mapInArrow(run, schema)


def products(df: DataFrame, x: str, size: int, y: str | None = None, y_size: int = 0) -> DataFrame:
    """(i, s): of each dimension i of x, with a constant 1 behind its last, the sums of its products with x, the 1 and y.

    Rows count where x (and y) have the given sizes and no nulls. size + 1 rows of size + 1 + y_size sums.
    """
    if (size + 1) * (size + 1 + y_size) > MOST:
        raise ValueError("too many dimensions")

    def parts(batches):
        total = np.zeros((size + 1, size + 1 + y_size))
        for b in batches:
            v, at = _rows(b.column(x), size)
            v = np.c_[v, np.ones(len(v))]
            if y:
                w, also = _rows(b.column(y), y_size)
                both = np.intersect1d(at, also)
                v, w = v[np.searchsorted(at, both)], w[np.searchsorted(also, both)]
                total += v.T @ np.c_[v, w]
            else:
                total += v.T @ v
        for i in range(0, size + 1, 64):
            some = total[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(some)), pa.int32()), pa.array(list(some), pa.list_(pa.float64()))], ["i", "s"])

    def added(batches):
        total: dict = {}
        for b in batches:
            for i, s in zip(b.column("i").to_pylist(), b.column("s")):
                s = s.values.to_numpy()
                total[i] = total[i] + s if i in total else s.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "s"])

    schema = "i int, s array<double>"
    return df.select(x, *([y] if y else [])).mapInArrow(parts, schema).repartition("i").mapInArrow(added, schema)


def _matrix(rows: DataFrame, shape: tuple) -> np.ndarray:
    out = np.zeros(shape)
    for r in rows.collect():  # a row a dimension
        out[r.i] = r.s
    return out


def fitted(df: DataFrame, x: str, size: int, y: str, y_size: int, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, bias) of the linear map from x to y with least squared error, by ridge regression; zeros where there are no rows."""
    s = _matrix(products(df, x, size, y, y_size), (size + 1, size + 1 + y_size))
    a = s[:, : size + 1] + ridge * np.diag([1.0] * size + [0.0 if s[size, size] else 1.0])
    w = np.linalg.solve(a, s[:, size + 1 :])
    return w[:size], w[size]


def principal(df: DataFrame, x: str, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, bias) of the projection on the k directions of largest variance, of the centred vectors; a direction's largest entry is positive."""
    s = _matrix(products(df, x, size), (size + 1, size + 1))
    n = max(s[size, size], 1.0)
    mean = s[:size, size] / n
    _, vectors = np.linalg.eigh(s[:size, :size] / n - np.outer(mean, mean))
    m = vectors[:, ::-1][:, :k]
    m = m * np.sign(m[np.abs(m).argmax(0), range(m.shape[1])])
    return m, -mean @ m
