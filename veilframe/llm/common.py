"""What the training-data operators share."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names, or one of our own where none is set and
    driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or "/tmp/checkpoints")
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, tuple[Column, ...]]:
    """The table with its columns named by number, so that no name of a caller's clashes with one made here, and the named ones of them."""
    found = df.toDF(*(f"#{i}" for i in range(len(df.columns))))
    return found, tuple(F.col(f"#{df.columns.index(n)}") for n in names)


def restored(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Undoes ``numbered``; further columns replace those of their names."""
    return df.select(*(F.col(f"#{i}").alias(n) for i, n in enumerate(names) if n not in more), *more)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def text_key(text: Column) -> Column:
    """Identity of a text for grouping; null and empty texts differ."""
    return F.xxhash64(text, F.length(text))


def in_training(doc_id: Column) -> Column:
    """Three quarters of the rows may be learned from; the rest are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


#: Up to so many rows a counted table of two numbers is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Up to so many bytes, by its rows' measured widths, any table is.
BROADCAST_BYTES = 32 << 20


def width(field: T.StructField) -> Column:
    """Bytes of a value, about."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) + 8
    if isinstance(field.dataType, T.ArrayType):
        return 8 * F.greatest(F.size(F.col(f"`{field.name}`")), F.lit(0)) + 8
    return F.lit(8 * len(field.dataType.fields) + 8 if isinstance(field.dataType, T.StructType) else 8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A materialised table with a broadcast hint if it has few rows and bytes."""
    each = sum((width(f) for f in df.schema.fields), F.lit(16))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(each.cast("long")), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and found["size"] <= size else df


def first_of(df: DataFrame, group: str, h: Column, ties: list[Column], most: int) -> DataFrame:
    """The ``most`` rows of every group that are first by a 64-bit hash. Of a group of n rows only those whose hash lies in the first
    2 * most / n of its range and a little more are ranked: that many and no fewer, whatever the group's size."""
    sizes = small(materialize(df.groupBy(F.col(group).alias("#g")).agg(F.count(F.lit(1)).alias("#n"))))
    near = df.join(sizes, F.col(group) == F.col("#g")).where((h.cast("double") / 2.0**64 + 0.5) * F.col("#n") <= 2 * most + 50)
    ranked = near.withColumn("#k", F.row_number().over(Window.partitionBy(group).orderBy(h, *ties)))
    return ranked.where(F.col("#k") <= most).drop("#k", "#g", "#n")


def passages(text: Column, chars: int) -> Column:
    """The whole text as an array of (at, passage)."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)), lambda x, i: F.struct(i.alias("at"), x.alias("passage")))


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over long texts: batches of fewer rows than Spark's default of 10,000, so that neither the JVM's buffers nor
    the Python worker hold tens of megabytes at once. A session's own smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its tasks, and would hold on to what the largest one used."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


BATCH_ROWS = 1000
