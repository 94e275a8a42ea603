"""Shared by the operators of this subpackage: durable intermediate tables, word splitting, stable model seeds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, as characters and as a Java character class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Tasks that the rows of one key are dealt to in a join with few rows a key.
SALTS = 16


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a folder of our own only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="notewright-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder: executors may be lost, lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries built and run inside give back their shuffle files as soon as they end, by Spark's own setting."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` has not, in any spelling: for columns added on the way."""
    taken = {c.lower() for c in df.columns}
    out: list[str] = []
    i = 0
    while len(out) < n:
        name, i = f"__k{i}", i + 1
        if name not in taken:
            out.append(name)
    return out


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, read back, for as long as the block lasts."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """``many`` joined with ``few`` on ``keys``, the rows of ``many`` with one key dealt to SALTS tasks by a hash of
    ``salt``; ``few`` is copied to each."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    right = few.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return left.join(right, [*keys, "salt"]).drop("salt")


def words_of(text: Column) -> Column:
    """Words of a text as an array: runs of anything but the six ASCII white-space characters; null gives none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def one_blas_thread() -> None:
    """Keeps numpy's bundled OpenBLAS to one thread on the driver, where small products only lose by more."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/libscipy_openblas64_*.so"):
        setter = getattr(ctypes.CDLL(str(path)), "scipy_openblas_set_num_threads64_", None)
        if setter is not None:
            setter(1)
