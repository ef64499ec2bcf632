"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpoint, release  # noqa: F401  for the operators

#: ASCII white space of the exact-duplicate contract: space and 0x09-0x0D.
WHITE = b" \t\n\x0b\x0c\r"


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator needs, under fixed names; null text counts as empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Python strings one at a time, so that a batch is never held twice."""
    for value in batch.column(column):
        yield value.as_py() or ""


_OWNER: list = [None, None]


def give_back() -> None:
    """What this worker no longer uses goes back to the machine: an idle worker shares it with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps the memory for itself


def sole(owner: str, release=None) -> None:
    """Called as a task begins: what another operator remembers in this worker is released, and the memory given back."""
    if _OWNER[0] != owner:
        if _OWNER[1]:
            _OWNER[1]()
        _OWNER[:] = [owner, release]
        give_back()


#: A key of at least one row in so many is hot: there are at most so many of them, which is what makes them broadcast.
HOT = 1_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], c: str, total: int) -> DataFrame:
    """Inner join of rows with the one row that counted has for a key, where c says how many of the rows have it.

    total is at least the number of rows (or of distinct ones, if c counts these). Rows of hot keys never meet in one
    task: their side of the join, of at most HOT rows by the pigeonhole principle, is broadcast.
    """
    hot = counted.where(F.col(c) * HOT > total)
    cold = counted.where(F.col(c) * HOT <= total)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)
