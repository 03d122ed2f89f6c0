"""Small helpers the text operators share."""

from __future__ import annotations

import ctypes
import functools
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D, nothing else.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
_LIBC = ctypes.CDLL(None)
#: Rows that broadcast() may be told to carry; anything larger is joined by shuffle.
BROADCAST_ROWS = 400_000


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name.

    Extra columns go, also those that differ from a wanted name in case only; of columns with the same name the first is taken.
    """
    at = df.columns
    flat = df.toDF(*(f"_{i}" for i in range(len(at))))
    return flat.select(*(F.col(f"_{at.index(n)}").alias(n) for n in names))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most ``rows`` rows, else df as it is.

    Call it on written tables, where the count reads Parquet footers only.
    """
    return F.broadcast(df) if df.count() <= rows else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows: what a worker holds as Python strings is a slice of a batch, not all of it."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def gives_back(run):
    """A batch function whose worker hands unused memory back to the system when a task is done.

    Python workers live on from task to task; without this each keeps the most that any of its tasks ever took.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped


#: The temporary folder of each local session that names none.
_LOCAL: dict[str, str | None] = {}


class Scratch:
    """Tables written to the folder that driver and executors share, to cut lineage.

    The folder is the session's spark.checkpoint.dir. Only a local session that has none gets a temporary one.
    A lost executor costs nothing that was written: later jobs read the files again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = _LOCAL.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="tessella-")
            _LOCAL[spark.sparkContext.applicationId] = base
        self.path = f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"
        self._count = itertools.count()

    def serial(self) -> int:
        """A number for a table name that was not given out before."""
        return next(self._count)

    def table(self, df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        """Write df and read it back."""
        df.write.mode(mode).parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def bucketed(self, df: DataFrame, name: str, key: str, **options) -> DataFrame:
        """Write df in buckets of ``key``, as many as shuffle partitions: grouping or joining by it does not shuffle these rows again."""
        table = self._catalog_name(name)
        df.write.options(**options).bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", f"{self.path}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def drop_bucketed(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._catalog_name(name)}")
        self.drop(name)

    def _catalog_name(self, name: str) -> str:
        return f"{self.path.rsplit('/', 1)[1]}_{name}".replace("-", "_")

    def _folder(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, name: str) -> None:
        path, files = self._folder(name)
        files.delete(path, True)

    def drop_all_but(self, *names: str) -> None:
        """What the result is read from stays; a session's own folder keeps no other table of a finished operator."""
        path, files = self._folder()
        for status in files.listStatus(path):
            if status.getPath().getName() not in names:
                files.delete(status.getPath(), True)
