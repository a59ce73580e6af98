"""What the vector operators share: rows with whole vectors, as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 64
#: Components of floor(256 * x) within this keep every squared distance of up to 64 components in a long.
MOST = 1 << 27


def whole(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly `dims` components, none of them null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, finite), F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component; one beyond MOST is an error, as its distances fit no long."""
    one = lambda x: F.floor(x.cast("double") * 256)
    kept = lambda v: F.when(F.abs(v) <= MOST, v.cast("int")).otherwise(F.raise_error(F.lit("a vector's component is too large")).cast("int"))
    return F.transform(F.transform(vector, one), kept)


def kept(table: DataFrame, *names: str, dims: int = DIMS) -> DataFrame:
    """(names..., v): the rows whose vectors are whole, v their integers."""
    return table.where(whole(F.col("embedding"), dims)).select(*names, integers(F.col("embedding")).alias("v"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """The rows of an Arrow list array as a matrix of 64-bit integers."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
