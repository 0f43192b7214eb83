"""Adding columns to a DataFrame by functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .textnum import column_bytes


BATCH_BYTES = 4_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """Holds the Arrow batches of `df`'s session to BATCH_BYTES (or to one longer text), as whole
    texts are sent in them; a lower setting stays. Spark has this as a setting of the session only,
    read when a plan runs, so it is left in place."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(conf.get(key)).rstrip("b")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def free(df: DataFrame, *names: str) -> None:
    """Raises where an added column's name is already taken."""
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the way; choose another prefix")


def add_columns(df: DataFrame, text_col: str, make: Callable[[], Callable[[np.ndarray, np.ndarray], Sequence]], fields: list[T.StructField], keep: Sequence[str] | None = None) -> DataFrame:
    """`df` (its columns `keep`, all by default) with `fields` computed from the text column.

    make() runs once in each task and gives a function of a batch's UTF-8 bytes and offsets that
    returns one array or list for each field.
    """
    keep = list(df.columns if keep is None else keep)
    free(df.select(*[F.col(f"`{c}`") for c in keep]), *[f.name for f in fields])
    small_batches(df)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*keep, *[f.name for f in fields]]
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            columns = batch.columns
            made = function(*column_bytes(columns[-1]))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*columns[:-1], *arrays], names=[*[f"k{i}" for i in range(len(keep))], *[f"n{i}" for i in range(len(arrays))]])

    schema = T.StructType(
        [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)]
    )
    return source.mapInArrow(run, schema).toDF(*names)


def counted(df: DataFrame, text_col: str, make: Callable[[], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(k long, n long): the sums by k of what a function of each batch's texts gives as (keys, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            keys, counts = function(*column_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["k", "n"])

    parts = small_batches(df).select(F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "k long, n long")
    return parts.groupBy("k").agg(F.sum("n").alias("n"))


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def sampled(df: DataFrame, keep: int, total: int, *by: Column, seed: int = 1) -> DataFrame:
    """About `keep` of `total` rows (all of them where there are no more), the same in each run."""
    if total <= keep:
        return df
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11) * F.lit(2.0**-53)
    return df.filter(share < keep / total)
