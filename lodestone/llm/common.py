"""Shared helpers: column selection, scratch tables on shared storage, Arrow passes, bounded Bloom filters."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.catalog import shared_folder

#: Least and largest Bloom filter that is sent to executors, in bits: 128 KB to 32 MB, whatever the data.
BLOOM_LEAST, BLOOM_MOST = 1 << 20, 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan for a pass that costs far more than a shuffle of its rows: dealt out to all cores if its files make fewer tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name first and else without regard to case; other columns may clash in any way."""
    cols = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(cols))])
    at = []
    for name in names:
        same = [i for i, c in enumerate(cols) if c == name] or [i for i, c in enumerate(cols) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name!r} among {cols}")
        at.append(same[0])
    return flat.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def packed(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns as the struct `row`, and the text beside it: what passes through a Python pass untouched."""
    cols = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(cols))])
    at = next(i for i, c in enumerate(cols) if c == text) if text in cols else [c.lower() for c in cols].index(text.lower())
    return flat.select(F.struct(*[F.col(f"c{i}") for i in range(len(cols))]).alias("row"), F.col(f"c{at}").cast("string").alias("text"))


def unpacked(df: DataFrame, cols: list[str], **replaced: str) -> DataFrame:
    """The columns of `row` again, under the names they had; replaced: column name to expression."""
    return df.select(*[(F.expr(replaced[c]) if c in replaced else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(cols)])


#: Rows of an Arrow batch while a scratch table is written: a few MB of documents, held by the JVM and by Python.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hold_small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB from here on in this session, for passes that run after their caller has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors. What results still read stays until `release` or the program's end."""

    kept: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
        if not Scratch.kept:
            atexit.register(release)
        Scratch.kept.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _delete(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, name: str) -> None:
        self._delete(name)

    def keep_only(self, *names: str) -> None:
        """Gives back the room of all tables but these, which results still read."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(root):
            self._delete(*[x for found in fs.listStatus(root) if (x := found.getPath().getName()) not in names])


def release() -> None:
    """Deletes the scratch tables of this program. Results that read them must have been written or read."""
    while Scratch.kept:
        with suppress(Exception):  # the session may have ended
            Scratch.kept.pop()._delete("")


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """fn over the Arrow batches of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return df.mapInArrow(run, schema)


def with_row(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema of a pass that keeps `row` and adds fields."""
    return T.StructType([df.schema["row"], *[T.StructField(n, t) for n, t in fields]])


def kind_of(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def text_key(text: bytes) -> int:
    """Tells apart texts under one doc_id."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def bloom(df: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """A Bloom filter of two bits a value over a bigint column of well mixed hashes; df is a scratch table.

    16 to 32 bits a value within the bounds above. A filter that is too full lets more pass and still drops nothing: what passes
    is joined exactly. Bits are gathered in pages of 4 KB by a native, partially aggregated sum; the driver receives bits / 8 bytes at most.
    """
    bits = bits or min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (16 * df.count()).bit_length()))
    h = F.col(column)
    place = F.explode(F.array(h.bitwiseAND(bits - 1) + 1, F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1) + 1))
    pages = (
        df.where(h.isNotNull()).select(place.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    )
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for page, part in pages.collect():
        out[page - 1] = np.frombuffer(part, np.uint8)
    return out.ravel()


def parted(df: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df cut in two, in the JVM: rows whose key may be among `wanted` (key), a scratch table, with the key as `key_`, to join by; and those whose key certainly isn't.

    A row's bit is looked up in a bitmap of 16 to 32 bits a wanted key, broadcast in pages of 4 KB: BLOOM_MOST bits or 32 MB at most. So only rows that
    may meet need to be shuffled to meet. A bitmap that is too full lets more pass, and changes nothing.
    """
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (16 * wanted.count()).bit_length()))
    place = F.col("key").bitwiseAND(bits - 1) + 1
    pages = wanted.where("key is not null").select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("page_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits_"))
    at = F.col("key_").bitwiseAND(bits - 1)
    byte = F.conv(F.hex(F.substring("bits_", (F.shiftright(at.bitwiseAND(32767), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    flagged = df.withColumn("key_", key).withColumn("page_", F.shiftright(at, 15) + 1).join(F.broadcast(pages), "page_", "left")
    flagged = flagged.withColumn("may_", F.col("bits_").isNotNull() & (F.call_function("getbit", byte, at.bitwiseAND(7).cast("int")) == 1))
    # A key that comes from the bitmap keeps Catalyst from moving a later semi or anti join below the look-up.
    may = flagged.where("may_").withColumn("key_", F.when(F.col("may_"), F.col("key_")))
    return may.drop("page_", "bits_", "may_"), flagged.where(~F.coalesce("may_", F.lit(False))).drop("key_", "page_", "bits_", "may_")


def bloom_has(bloomed: np.ndarray, values: np.ndarray) -> np.ndarray:
    v, last, out = values.view(np.uint64), np.uint64(len(bloomed) * 8 - 1), True
    for at in (v & last, (v >> np.uint64(32)) & last):
        out = out & ((bloomed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def list_array(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """values in lists of counts elements each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
