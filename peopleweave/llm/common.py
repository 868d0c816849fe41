"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, BinaryType, BooleanType, ArrayType, StructField, StructType

from ..session import ensure_checkpoint_dir

SPARK_TYPES = {"long": (LongType(), pa.int64()), "int": (IntegerType(), pa.int32()), "double": (DoubleType(), pa.float64()),
               "string": (StringType(), pa.string()), "binary": (BinaryType(), pa.binary()), "boolean": (BooleanType(), pa.bool_()),
               "longs": (ArrayType(LongType()), pa.list_(pa.int64())), "binaries": (ArrayType(BinaryType()), pa.list_(pa.binary())), "strings": (ArrayType(StringType()), pa.list_(pa.string()))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither repeat its work nor depend on executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit("").cast("binary"))


def fold(name: str, parts: int) -> Column:
    """crc32 of a key's text modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % parts


def with_results(df: DataFrame, inputs: dict[str, Column], start: Callable, results: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """Append result columns computed batch by batch in Python.

    ``start()`` is called once per task and returns a function from the input columns of a batch (lists, by name) to
    a list of result columns. The kept columns pass through as Arrow data. A kept column with the name of a
    result column is replaced by the result. Batches are kept small, so that long texts do not add up.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    kept = [c for c in (df.columns if keep is None else keep) if c not in results]
    names = [f"__in{i}__" for i in range(len(inputs))]
    frame = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in zip(names, inputs.values())])
    schema = StructType([*frame.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *[StructField(k, SPARK_TYPES[v][0]) for k, v in results.items()]])
    kinds = [SPARK_TYPES[v][1] for v in results.values()]
    keys, width, outs = list(inputs), len(kept), list(results)

    def run(batches):
        work = start()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = work({k: batch.column(width + i).to_pylist() for i, k in enumerate(keys)})
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=[*kept, *outs])

    return frame.mapInArrow(run, schema)


def broadcast_if_small(table: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A stored table with a broadcast hint if it has at most ``most_rows`` rows; larger ones are left to a shuffle join."""
    return F.broadcast(table) if table.count() <= most_rows else table
