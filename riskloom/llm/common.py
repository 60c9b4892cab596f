"""What the operators share: reading tables, the train/held-out split, Arrow batches in and out."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
         "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

#: Bytes of text that one step inside a task works on at a time.
STEP_BYTES = 1 << 20
#: Bytes of a record batch, where the session has Spark's default of 64 MB: a worker holds a batch several times over.
BATCH_BYTES, DEFAULT_BATCH_BYTES = 4 << 20, 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def divisible(key: str | Column, modulus: int) -> Column:
    """True where crc32 of the key as text leaves no remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % modulus == 0, F.lit(False))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: dict[str, str]) -> DataFrame:
    """``fn`` turns a record batch into columns. Spark bounds a batch by rows and by bytes, so a task never holds its partition."""
    return map_partitions(df, lambda batches: (fn(b) for b in batches if b.num_rows), schema)


def map_partitions(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: dict[str, str]) -> DataFrame:
    """As ``map_batches``, for work that keeps bounded state between the batches of a task."""
    small_batches(df.sparkSession)
    fields = pa.schema([(k, ARROW[v]) for k, v in schema.items()])

    def run(batches):
        try:
            yield from made(batches)
        finally:
            give_back()  # a worker waits for its next task without them

    def made(batches):
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip((out[f.name] for f in fields), fields)], schema=fields)

    return df.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in schema.items()))


def give_back() -> None:
    """Returns memory that is free to the system: Arrow's buffers, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def keep_rows(df: DataFrame, text_col: str, fn: Callable[[list], list[bool]]) -> DataFrame:
    """The rows, whole, whose texts ``fn`` keeps. Columns stay Arrow arrays throughout; what a task took is given back at its end."""
    small_batches(df.sparkSession)
    width = len(df.columns)

    def run(batches):
        for batch in batches:
            kept = batch.filter(pa.array(fn(batch.column(width).to_pylist()), pa.bool_())).select(range(width))
            del batch
            yield kept
            del kept
        give_back()

    return df.select("*", F.col(text_col).cast("string").alias("text of the row")).mapInArrow(run, df.schema)


def small_batches(spark: SparkSession) -> None:
    """Lowers Spark's default size of record batches; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(DEFAULT_BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def type_of(df: DataFrame, column: str) -> str:
    """Type of an id column that is handed through Python."""
    kind = df.schema[column].dataType.simpleString()
    return {"bigint": "long", "int": "int", "string": "string"}.get(kind) or _refuse(column, kind)


def _refuse(column: str, kind: str) -> str:
    raise TypeError(f"{column} is {kind}; ids are whole numbers or strings")


def steps(texts: list, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` (bytes) of about ``most`` bytes each; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
