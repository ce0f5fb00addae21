"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read

#: Separator class of the word rule used by every operator here: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; a table of fewer splits than cores (so a small one) is dealt over the cores."""
    df = read(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows are whole texts of any length: few of them go to a Python worker at once. A setting of the session, made by
    the queries and the pipeline's stages, not by the operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is set, on one machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither repeat the work nor depend on
    executors that may be lost. The rows are then fixed, whatever happens to the tasks that made them.

    The table stays, as what is returned is read from it whenever it is used; see `steps` for those of one run."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def steps(spark: SparkSession, name: str, generations: int = 0) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A `cut` for the steps of one run: their tables lie in one folder, which is deleted at the end. What is to outlive the
    run is cut outside of it, before. With `generations`, only so many tables of the same step are held while the next is
    written, and one fewer after it."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    written: dict[str, list[str]] = {}

    def delete(place: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def cut_step(df: DataFrame, step: str) -> DataFrame:
        path = f"{folder}/{step}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        written.setdefault(step, []).append(path)
        if generations and len(written[step]) >= generations:
            delete(written[step].pop(0))
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield cut_step
    finally:
        delete(folder)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text: maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))
