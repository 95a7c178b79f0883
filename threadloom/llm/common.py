"""Batches of bounded bytes, row keys, and column names that cannot clash."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import BROADCAST_BYTES, payload, shared_dir, size_checked, stored

__all__ = ["BROADCAST_BYTES", "WORD", "arrow_map", "beside", "let", "payload", "row_key", "scan", "shared_dir", "size_checked", "stored"]

#: Bytes of an Arrow batch, unless one row has more: a batch is held twice on either side.
BATCH_BYTES = 2 * 1024 * 1024

#: One word: a run of characters that are none of space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, in workers that give memory back.

    The session's Arrow batches are held to BATCH_BYTES from now on, as Spark reads the
    setting when the query runs; a session that asks for smaller batches keeps its own.
    Workers live on between stages, so Arrow takes its memory from the system, which gets
    it back after each task.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < asked <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row that has no better one: its id and the hash of its text.

    Rows that agree in both are the same document, and get the same result.
    """
    return F.md5(F.concat_ws("\x1f", F.coalesce(doc_id.cast("string"), F.lit("~")), F.coalesce(F.md5(text.cast("binary")), F.lit("~"))))


def beside(docs: DataFrame, result: str, row: str = "row") -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, to stand beside a result column.

    One rule for clashes: an input column that has the result's name is replaced by it.
    """
    return [F.col(row).getField(c).alias(c) for c in docs.columns if c.lower() != result.lower()]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for each row.

    A column that a lambda refers to may be put into its body by the optimiser and be
    computed again for each element; what is bound to a lambda's variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """States of a fold over an array, one before each element: ``step(state, x)`` gives the next.

    States are whole numbers. A fold that grows its list at each element copies it each
    time; here lists grow by blocks of the root of the array's size, so hundreds of
    thousands of elements take a few seconds.
    """
    done, blocks = "array<int>", "array<array<int>>"

    def folded(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")

        def one(acc: Column, x: Column) -> Column:
            return F.struct(step(acc["state"], x).cast("int").alias("state"), F.concat(acc["done"], F.array(acc["state"])).alias("done"))

        def block(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(xs, i * size + 1, size), F.struct(acc["state"].alias("state"), F.array().cast(done).alias("done")), one)
            return let(inner, lambda b: F.struct(b["state"].alias("state"), F.concat(acc["done"], F.array(b["done"])).alias("done")))

        begin = F.struct(start.cast("int").alias("state"), F.array().cast(blocks).alias("done"))
        whole = F.aggregate(F.sequence(F.lit(0), F.ceil(F.size(xs) / size).cast("int") - 1), begin, block, lambda acc: F.flatten(acc["done"]))
        return F.when(F.size(xs) > 0, whole).otherwise(F.array().cast(done))

    return let(values, folded)
