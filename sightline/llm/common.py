"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so other columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def by_rows(
    df: DataFrame, fn: Callable[[Iterator[list]], Iterator[tuple]], schema: str, rows: int | None = None
) -> DataFrame:
    """Map the rows of each partition in Arrow batches: ``fn`` gets lists of columns, yields tuples of columns.

    ``rows`` is the most rows that are Python objects at once.
    """
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        parts = (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)) if rows else batches
        for columns in fn([c.to_pylist() for c in b.columns] for b in parts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, struct)


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null value counts as empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, seed: int, bound: int) -> DataFrame:
    """About ``bound`` rows chosen by a hash of ``key``; all of them where there are fewer.

    The choice depends on the keys alone, so reruns agree.
    """
    rows = df.count()
    if rows <= bound:
        return df
    buckets = 1_000_000
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)) < int(buckets * bound / rows))


def logistic_fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression; the intercept is the last weight."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
