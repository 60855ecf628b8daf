"""The shared folder, written tables and row keys of the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_A_FILE = 100_000

_own: dict[str, str | None] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of its own, on a single machine only."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = _own.get("folder") or tempfile.mkdtemp(prefix="meridia-")
        _own["folder"] = have
    return have.rstrip("/")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts lineage and survives lost executors.

    rows, if known, is a bound on its rows: a file is then made for each ROWS_A_FILE of them, however
    many partitions there are.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Remove written tables whose rows no later plan needs."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held(df: DataFrame) -> DataFrame:
    """df kept on executors' disks while one step reads it several times; lost parts are computed again.

    For what hangs on written tables by a plan or two, and is released by unpersist() soon.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most that many rows at once to Python, so long texts take bounded memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, rows)


def give_back() -> None:
    """Give memory that this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, but a worker that has finished a partition gives its freed memory back."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidy


def few_files(df: DataFrame, source: DataFrame, bytes_a_task: int = 1 << 25) -> DataFrame:
    """df in as few partitions as the size of its source fills, and no fewer than there are cores.

    For maps over rows: small partitions are merged, so a table of many small files doesn't stay one;
    large ones stay.
    """
    size = str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-int(size) // bytes_a_task))
    return df.coalesce(n) if n < 1 << 20 else df


def sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """At most n rows, those whose key hashes lowest.

    A bound on the hash, from the number of rows, leaves little more than n rows before any are
    sorted, so no task gathers n rows of every partition.
    """
    total = df.count()
    space = 1 << 40
    bound = space if total <= 2 * n else int(space * min(1.0, (1.2 * n + 50) / total))
    h = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(space))
    return df.withColumn("_hash", h).where(F.col("_hash") < bound).orderBy("_hash", *key).limit(n).drop("_hash")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 128-bit binary key of id and text: equal rows share it; null and empty text differ."""
    parts = (F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text_col).isNull(), F.col(text_col))
    digits = [F.lpad(F.hex(F.xxhash64(*salt, *parts)), 16, "0") for salt in ((), (F.lit("row"),))]
    return F.unhex(F.concat(*digits))


def short_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit key of id and text, where tasks hold many keys as numbers."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text_col).isNull(), F.col(text_col))


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores after it until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """One of the tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
