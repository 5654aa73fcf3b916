"""Vector arithmetic: native expressions for single vectors, one Arrow matrix product for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.coalesce(x.cast("double") / F.nullif(n, F.lit(0.0)), F.lit(0.0)))


def similarities(df: DataFrame, id_col: str, vec_col: str, queries: Sequence[Sequence[float]], *, keep: bool = False) -> DataFrame:
    """(id, sims): the cosine of each row's vector to every query, in one pass; rows without a vector of that size are left out.
    With `keep` also v, the vector itself.

    The queries are a caller's handful of interests, so the closure carries them; the table is never shuffled.
    """
    q = np.asarray(queries, np.float64).reshape(len(queries), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    dim = q.shape[1]
    names = ["id", "sims", "v"] if keep else ["id", "sims"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(0)) == dim)
            x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            n = np.linalg.norm(x, axis=1)
            ok = np.isfinite(n) & (n > 0)
            sims = (x[ok] @ q.T) / n[ok, None]
            flat = pa.array(sims.ravel(), pa.float64())
            offsets = pa.array(np.arange(0, sims.size + 1, len(q) or 1, dtype=np.int32)) if len(sims) else pa.array([0], pa.int32())
            out = [b.column(0).take(pa.array(at[ok])).cast(pa.int64()), pa.ListArray.from_arrays(offsets, flat)]
            if keep:
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, x[ok].size + 1, dim, dtype=np.int32)), pa.array(x[ok].ravel())))
            yield pa.RecordBatch.from_arrays(out, names)

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL").mapInArrow(run, "id bigint, sims array<double>" + (", v array<double>" if keep else ""))
