"""What the operators of this subpackage share: tables, shared storage and byte buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of letters, digits and everything beyond ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only on one machine where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, most: int = 1 << 22) -> Iterator[None]:
    """Tables written meanwhile hand rows to Python in batches of about ``most`` bytes (one row at least), not 10,000 rows of any length.

    A batch stands in the JVM, outside its heap and in buffers that double as they grow, and in the Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def join_counted(rows: DataFrame, values: DataFrame, key: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``values``, which has a row for each key with the number ``c`` of its rows, of ``total`` in all.

    Keys with more than a thousandth of all rows, fewer than a thousand keys, are broadcast; so no task gets all rows of one.
    """
    hot = F.broadcast(values.where(F.col("c") * 1000 > total))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(values.where(F.col("c") * 1000 <= total), key))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores after it as no column has (names are equal whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def text_source(carry: tuple[str, ...]) -> list[Column]:
    """Columns that bring each row's text and the columns of ``carry`` to a task, the text once: it is in ``carried`` if it is carried."""
    carried = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    return carried if "text" in carry else [*carried, text_bytes().alias("text")]


def texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """UTF-8 bytes of the texts of a batch of ``text_source``, null as empty."""
    column = batch["text"] if "text" in batch.schema.names else batch["carried"].field(batch["carried"].type.get_field_index("text"))
    for t in column:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def ascii_lower(column: str | Column) -> Column:
    """Lower-case A-Z only, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows: one number, for sizing blocks."""
    return int(df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def byte_chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most ``limit`` bytes (one row at least): first row, end row, bytes, offsets from 0."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) of uint64 values."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
