"""What the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.session import load, materialize, release_shuffles, remove, scratch_path, ship_code  # noqa: F401

#: Rows of an Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS = 500
#: Bits of a sieve for each key, and the least and most bits (8 MB) it has.
SIEVE_BITS, SIEVE_LEAST, SIEVE_MOST = 16, 1 << 16, 1 << 26
NATIVE_MOST = 1 << 24


def prepare(spark: SparkSession) -> None:
    """Ship the code and bound the Arrow batches of the session: these two
    settings of the caller's session change and stay so."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is the empty text."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, name: str, row_id: str = "row_id") -> tuple[DataFrame, str]:
    """`df` with a number for each row, written once: ids that are computed anew
    in each scan could name other rows after an executor was lost."""
    return materialize(df.withColumn(row_id, F.monotonically_increasing_id()), name)


def plain_scan(df: DataFrame) -> bool:
    """Whether `df` is a file's rows, filtered or projected: nothing that could
    repeat a row."""
    nodes = [df._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().split()[0] not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation", "Relation"):
            return False
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return True


def with_row_ids(df: DataFrame, name: str, row_id: str = "row_id") -> DataFrame:
    """`df` with a number for each row that is the same in every scan: the file's
    number and the place in it, for the rows of Parquet files. All else is written."""
    if plain_scan(df):
        try:
            located = df.select("*", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_index"))
        except AnalysisException:  # files without such a column
            return numbered(df, name, row_id)[0]
        # the driver holds a list of these files already
        files, _ = numbered(located.select("row_file").distinct(), f"{name}-files", "file")
        place = F.shiftleft(F.dense_rank().over(Window.orderBy("file")).cast("long"), 40)
        files, _ = materialize(files.select("row_file", place.alias("place")), f"{name}-places")
        return located.join(F.broadcast(files), "row_file").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("place") + F.col("row_index")).alias(row_id))
    return numbered(df, name, row_id)[0]


def sieve(keys: DataFrame) -> Broadcast:
    """A Bloom filter of the one long column of `keys`, added up by Spark. Its
    bits grow with the keys to SIEVE_MOST; beyond that it lets more through."""
    (name,) = keys.columns
    bits = SIEVE_LEAST
    while bits < min(SIEVE_MOST, SIEVE_BITS * keys.count()):
        bits *= 2
    h = F.xxhash64(name)
    probe = F.explode(F.array(h, F.shiftright(h, 32))).alias("p")
    at = keys.select(probe).select(F.col("p").bitwiseAND(F.lit(bits - 1)).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("set"))
    found = words.toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(out)


def sieve_hash(key: str) -> Column:
    return F.xxhash64(key)


def passing(h: np.ndarray, bits: np.ndarray, keep: bool = True) -> np.ndarray:
    """Which of the hashes the sieve lets through; with keep=False the others."""
    ok = np.ones(len(h), bool)
    for p in (h, h >> 32):
        p = p & np.int64(64 * len(bits) - 1)
        ok &= (bits[p >> 6] >> (p & 63)) & 1 == 1
    return ok == keep


def sifted(df: DataFrame, key: str, bits: Broadcast, keep: bool = True) -> DataFrame:
    """The rows of `df` that the sieve lets through, among them all whose `key`
    is in it; with keep=False the others. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = passing(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), bits.value, keep)
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(ok))

    return map_arrow(df.withColumn("sieve_hash", sieve_hash(key)), run, df.schema)


def natively_split(df: DataFrame, key: str, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` whose `key` may be among those of `keys`, and the others,
    which have none of them, in DataFrame operations only. The bits of a filter
    stand in a table of at most NATIVE_MOST / 64 rows, so it can be broadcast."""
    bits = SIEVE_LEAST
    while bits < min(NATIVE_MOST, 2 * SIEVE_BITS * keys.count()):
        bits *= 2
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    shift = lambda f, x, n: F.call_function(f, x, n.bitwiseAND(F.lit(63)).cast("int"))
    at = keys.select(place(key).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("sieve_word")).agg(F.bit_or(shift("shiftleft", F.lit(1).cast("long"), F.col("p"))).alias("sieve_set"))
    words, _ = materialize(words, name)
    asked = df.withColumn("sieve_word", F.shiftright(place(key), 6)).join(F.broadcast(words), "sieve_word", "left")
    hit = F.coalesce(shift("shiftright", F.col("sieve_set"), place(key)).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return asked.where(hit).select(*df.columns), asked.where(~hit).select(*df.columns)


def let(expr: Column, body: Callable[[Column], Column]) -> Column:
    """`body(expr)` with `expr` evaluated once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(expr), body), 1)
