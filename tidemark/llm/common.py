"""What the corpus operators share: table access, shared-folder tables, hashing in numpy."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the size and shingle contracts, and its complement.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of up to so many bytes are dealt out where their files are fewer than the cores.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a small table in one file of one row group would be one task's work. Larger tables stay as
    they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local one is set if all runs on one machine."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = f"/tmp/tidemark-checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete the tables that :func:`settle` wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: nothing is left to ask
            return


atexit.register(release)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, lost executors cost nothing
    of it, and later readers prune its columns. The files go with :func:`release` or at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """``path`` goes with the settled tables."""
    _written.append((spark, path))


#: Keys that are joined by broadcast at most, and the rows that a key has then at least.
HOT_KEYS, HOT_ROWS = 10_000, 1024


def join_counted(rows: DataFrame, per: DataFrame, key: str, count: str = "c") -> DataFrame:
    """rows joined with per, which has one row a key and, as ``count``, how many rows have it. Keys of many rows are
    joined where these are: they have more than a HOT_KEYS-th of all rows, so there are at most HOT_KEYS of them. No task
    of the shuffled rest gets more rows of one key. Both tables are read twice."""
    total, top = per.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    most = max(total // HOT_KEYS, HOT_ROWS)
    if top <= most:
        return rows.join(per, key)
    hot = per.where(F.col(count) > most)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per.where(F.col(count) <= most), key)
    return rows.join(F.broadcast(hot), key).unionAll(cold)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of an Arrow string or binary array; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, size = (np.int64, 8) if wide else (np.int32, 4)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind, len(column) + 1, column.offset * size).astype(np.int64) if at is not None else np.zeros(len(column) + 1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
