"""What the text operators share: inputs, tables in the shared folder, word patterns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytally.session import shared_folder, tune

#: a word is a run of characters other than ASCII white space
WORD = "[^\\x20\\x09-\\x0D]+"
#: runs of ASCII white space
BLANK = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows are whole texts: keep what a Python worker holds at once to some megabytes, or one text
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return tune(spark).read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The table cuts the lineage: losing an executor costs its running tasks
    only. Each call has a folder of its own, deleted when the driver ends. The
    session's default codec is used: zstd holds native memory per open column,
    which put small executors over their limit when many small files are read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/daytally-llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place.getParent())
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete stored tables whose last reader is done."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """A stored table of the given columns with a row number `rid`.

    The number tells apart rows with a repeated or missing doc_id. It is fixed
    by the writing; recomputing a lost task of a later job reads the same.
    """
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), *columns), "rows")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


#: what operators keep in a worker from task to task, under their names: how to let go of it
KEPT: dict[str, Callable[[], None]] = {}


def begun(owner: str = "") -> None:
    """Let go of what the tasks of other operators have left in this worker."""
    for name, drop in KEPT.items():
        if name != owner:
            drop()


def released() -> None:
    """Give back what a task no longer needs: Python workers stay for the tasks of later stages,
    and an executor has as many of them as its stages ever ran at once."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def each(one, columns: dict[str, pa.DataType], owner: str = ""):
    """A mapInArrow function from one(batch) -> one list or array for each output column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(owner)
        for batch in batches:
            if batch.num_rows:
                made = one(batch)
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, columns.values(), strict=True)],
                    list(columns),
                )
        released()

    return run


#: bits of the filter of hashes met twice: 16 MB, whatever the input
FILTER_BITS = 1 << 27


def met_twice(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter, with one bit a hash, of the hashes (column h, long) that
    two or more rows of the table have.

    What comes to the driver is the filter's words with a bit set, at most
    bits / 64 rows of 16 bytes. The filter errs towards "met twice"; with more
    repeated hashes than bits it lets everything through, which costs time and
    loses nothing.
    """
    return filter_of(hashes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), bits)


def filter_of(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter, with one bit a hash, of the hashes (column h, long)."""
    words = hashes.select(F.pmod("h", F.lit(bits)).alias("at"))
    words = words.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the signed hashes fall on a bit that is set."""
    at = hashes.view(np.int64) & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def components(links: DataFrame, node: str = "binary") -> DataFrame:
    """node, component for every node that a link (a, b) names; the component is
    its smallest node. Large-star and small-star in turn: each joins nodes to the
    smallest neighbour, found by grouping before the shuffle, so a node with
    very many links is one row in a group and a join side that can be split. Every
    step is stored, and the steps number about the logarithm of the longest path.
    """
    links = stored(links.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "links")
    last = None
    while True:
        # large star: neighbours above a node go to the smallest in its neighbourhood
        both = links.unionAll(links.selectExpr("b AS a", "a AS b"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS u", "least(a, m) AS m"), "least")
        large = both.join(least, F.expr("a = u")).filter("b > a").selectExpr("b AS a", "m AS b").filter("a <> b").distinct()
        large = stored(large, "large")
        discard(links, least)
        # small star: a node and its neighbours below it go to the smallest of them
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS u", "m"), "least")
        small = large.join(least, F.expr("a = u")).selectExpr("b AS a", "m AS b").unionAll(least.selectExpr("u AS a", "m AS b"))
        links = stored(small.filter("a <> b").distinct(), "links")
        discard(large, least)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return links.selectExpr("a AS node", "b AS component").unionAll(links.selectExpr("b AS node", "b AS component").distinct())
        last = now
