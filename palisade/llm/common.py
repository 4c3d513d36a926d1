"""What the operators share: reading tables, shared storage, word and batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may do without one (tests): there a
    temporary folder is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder, and a cluster needs one")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="palisade-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder as Parquet and read back: later steps neither repeat its
    work nor depend on an executor's disk, so shuffle files may go as soon as it is written. Small row groups: writers
    hold one in memory."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(table: DataFrame) -> None:
    """A stored table that nothing reads any more goes from the shared folder."""
    spark = table.sparkSession
    for path in {x.rpartition("/")[0] for x in table.inputFiles()}:
        if not path.rpartition("/")[2].startswith("stored-"):
            raise ValueError(f"{path} is no stored table")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Bytes of a stored row group, and of an Arrow batch that goes to Python.
ROW_GROUP = 32 << 20
BATCH = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, as texts may be long. It only ever lowers the session's setting and is
    not taken back, so operators that run at once don't disturb each other."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).lower().removesuffix("b")) > BATCH:
        spark.conf.set(name, str(BATCH))


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the columns an operator works on, under the operator's own names, so that further
    columns of the input cannot clash with them. What goes to Python goes in small batches."""
    small_batches(df.sparkSession)
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in named.items()))


def batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """One output batch for each input batch; make() runs once in each task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in parts:
            work = work or make()
            yield work(batch)

    return df.mapInArrow(run, schema)


#: Bits of the bitmap that turns rows away before a join: its fixed size, as a power of two.
BITMAP_BITS = 24


def likely(df: DataFrame, key: str, wanted: DataFrame, rest: bool = False) -> DataFrame:
    """df's rows whose key is likely in wanted's one column; with rest all rows, and a column `likely`.

    A bitmap of fixed size (2 MB) over the keys' hashes is broadcast, so that rows which surely find nothing
    need no shuffle. Rows that it lets through for nothing are for the join to sort out. Only hashes go to Python."""
    size = F.lit(1 << BITMAP_BITS)
    marks = wanted.select(F.pmod(F.xxhash64(wanted.columns[0]), size).alias("p")).groupBy(F.expr("p div 64").alias("block"))
    marks = marks.agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("mask")).toArrow()
    table = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    table[marks.column("block").to_numpy()] = marks.column("mask").to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def marked(places: pa.Array) -> pa.Array:
        p = places.to_numpy()
        return pa.array((sent.value[p >> 6] >> (p & 63)) & 1 == 1)

    hit = marked(F.pmod(F.xxhash64(key), size))
    return df.withColumn("likely", hit) if rest else df.where(hit)


#: Bytes of text that batch work looks at together.
SLICE = 1 << 18


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[list[bytes]]:
    """Neighbouring texts as UTF-8 (null: empty), some `size` bytes together, so that what is made of them
    stays small however large a batch is."""
    held, n = [], 0
    for x in texts.cast(pa.binary()):
        held.append(x.as_py() or b"")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def most_frequent(counts: DataFrame, n: str, limit: int) -> Column:
    """A condition on counts' column n that at most `limit` rows meet, those with the largest numbers: what may be
    sent to every task. Found from a histogram with a row for each small number and each power of two."""
    small = 1 << 10
    level = F.when(F.col(n) < small, F.col(n)).otherwise(F.floor(F.log2(n)) + small).cast("long")
    total, least = 0, None
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        total += row["rows"]
        if total > limit:
            break
        least = row["level"]
    if least is None:
        return F.lit(False)
    return F.col(n) >= (least if least < small else 1 << (least - small))
