"""Helpers shared by the training-data operators.

Heavy per-document work runs in ``mapInArrow`` tasks. What such a task passes on is often packed:
one row per target bucket with whole numpy arrays in binary cells, so that a shuffle moves a few
large cells instead of one row per hash or position.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiwake.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Parquet looks at the size of a page or row group only after 100 rows unless told otherwise, and a reader
# unpacks a row group at once.
_LARGE_ROWS = {"parquet.block.row.count.limit": 4, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


class Steps:
    """The stored steps of one job, in one folder below ``spark.checkpoint.dir``.

    A stored step cuts the lineage: when executors are lost, later stages read files again
    instead of repeating everything before.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.folder}/{self._count}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None, large_rows: bool = False) -> DataFrame:
        """``large_rows``: rows of megabytes, of which Parquet shall never hold many at a time, writing or reading."""
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        if large_rows:
            writer = writer.options(**_LARGE_ROWS)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored._step_path = path
        return stored

    def drop(self, *stored: DataFrame) -> None:
        """Remove steps that nothing reads any more."""
        for df in stored:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._step_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket_count(df: DataFrame) -> int:
    """How many buckets to deal packed rows to: grows with the input's partitions."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nulls_last: bool = False, carry: bool = False) -> DataFrame:
    """(``id``, ``key``, ``text``): ``key`` is a unique long that follows the order of the ids.

    Nearly always the id itself. Only where ids repeat or are missing, rows are numbered by id (missing
    ones first, or last), then the first 64 characters of the text, then a hash of it; equal rows then
    are separate documents. ``carry`` adds the whole input row as ``row``.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                        *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []))
    more = ["row"] if carry else []
    odd = plain.groupBy("id").count().where((F.col("count") > 1) | F.col("id").isNull()).limit(1)
    if not odd.take(1):
        return plain.select("id", F.col("id").alias("key"), F.coalesce("text", F.lit("")).alias("text"), *more)
    steps = Steps(spark, "keyed")
    by_id = F.col("id").asc_nulls_last() if nulls_last else F.col("id").asc_nulls_first()
    order = [by_id, "_head", "_hash"]
    ordered = steps.save(
        plain.withColumns({"_head": F.substring("text", 1, 64), "_hash": F.xxhash64("text")})
        .repartitionByRange(*order).sortWithinPartitions(*order, "text")
        .withColumn("_m", F.monotonically_increasing_id()), "ordered",
    )
    # The high bits of the counter are the range partition, so counts per partition give offsets.
    part = F.shiftright("_m", 33)
    sizes = ordered.groupBy(part.alias("_p")).count()
    offsets = sizes.withColumn("_o", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).select("_p", "_o")
    return (
        ordered.withColumn("_p", part).join(offsets, "_p")
        .select("id", (F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("key"), F.coalesce("text", F.lit("")).alias("text"), *more)
    )


def batches_of(frames: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Python lists of the named columns, batch by batch."""
    for batch in frames:
        yield tuple(batch.column(name).to_pylist() for name in columns)


def rows_out(schema: pa.Schema, rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def in_chunks(schema: pa.Schema, rows: Iterable[tuple], size: int = 2048, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length and size from a stream of rows."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or weight >= most_bytes:
            yield rows_out(schema, held)
            held, weight = [], 0
    if held:
        yield rows_out(schema, held)


def arrow_rows(df: DataFrame, columns: list[str], fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each partition as a stream of tuples; it yields output tuples."""
    out = pa.schema([(f.name, _arrow_type(f.dataType)) for f in T._parse_datatype_string(schema)])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for lists in batches_of(frames, *columns):
                yield from zip(*lists)

        yield from in_chunks(out, fn(stream()))

    return df.select(*columns).mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "string": pa.string(),
              "binary": pa.binary(), "boolean": pa.bool_()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return simple[kind.typeName()]


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER_NO_PUNCTUATION = bytes(32 if c in _PUNCTUATION else LOWER[c] for c in range(256))


class WordHashes(dict):
    """64-bit hashes of words, remembered for frequent use; the memory is emptied when full."""

    def __init__(self, most: int = 1 << 19):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter text is one run, no words give none."""
    if not words.size:
        return words
    width = min(width, words.size)
    count = words.size - width + 1
    total = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        # An odd factor before each addition keeps the order of words in the hash.
        total = (total + words[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return mixed(total)


def pack_planes(array: np.ndarray) -> bytes:
    """Bytes of a 64-bit array by significance, so that high zero bytes compress away."""
    return array.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def bucket_of(keys: np.ndarray, count: int) -> np.ndarray:
    """The bucket of each 64-bit key."""
    return (mixed(keys.astype(np.int64).view(np.uint64)) % np.uint64(count)).astype(np.int64)


def split_by(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, array, ...) for each bucket that has rows."""
    if not bucket.size:
        return
    order = np.argsort(bucket, kind="stable")
    values, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], bucket.size)
    sorted_arrays = [a[order] for a in arrays]
    for value, a, b in zip(values.tolist(), starts.tolist(), ends.tolist()):
        yield (value, *(x[a:b] for x in sorted_arrays))


def pmod(column: Column, n: int) -> Column:
    return F.pmod(column, F.lit(n))
