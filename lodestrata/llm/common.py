"""What the operators of this subpackage share: shared storage, row keys, text kernels."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as code points: space, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a local master gets a folder
    of its own; any other master is refused, as its executors would not see that folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to shared storage and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables in one shared folder; a table is dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_dir(spark)
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.names: list[str] = []

    def _path(self, name: str) -> str:
        return f"{self.folder}/{len(self.paths)}-{uuid.uuid4().hex[:8]}-{name}"

    def table(self, df: DataFrame, name: str = "part") -> DataFrame:
        """As ``materialise``, to be dropped later."""
        path = self._path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def bucketed(self, df: DataFrame, key: str, size: int, name: str = "buckets") -> DataFrame:
        """A row of ``df`` for each ``key``, dealt by it into ``size`` buckets, so that joins on the key don't move it again."""
        path, table = self._path(name), f"scratch_{uuid.uuid4().hex}"
        df.repartition(size, key).dropDuplicates([key]).write.option("compression", "zstd").option("path", path).bucketBy(size, key).saveAsTable(table)
        out = self.spark.table(table)
        self.names.append(table)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if id(df) in self.paths:
                _, path = self.paths.pop(id(df))
                remove(self.spark, path)

    def clear(self, *but: DataFrame) -> None:
        """Drop all tables except these."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
        self.drop(*[df for df, _ in list(self.paths.values()) if not any(df is x for x in but)])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def buckets_for(spark: SparkSession, size: int, each: int = 1 << 25) -> int:
    """How many buckets hold ``size`` bytes: as many as there are shuffle partitions at least, and no more than Spark allows."""
    most, least = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(least, math.ceil(size / each))))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


#: Rows of a few dozen bytes that may be broadcast: some 50 MB.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of short rows, marked for broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def digest(name: str = "text") -> Column:
    """SHA-256 of the UTF-8 text (null: empty), as 32 bytes."""
    return F.unhex(F.sha2(text_or_empty(name).cast("binary"), 256))


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once and bound to x."""
    return F.transform(F.array(value), body)[0]


def beside(rows: DataFrame, keyed: DataFrame, condition: Column, salts: int = 64) -> DataFrame:
    """``rows`` joined to ``keyed``, a written table with a row for each key.

    A table of up to ``BROADCAST_ROWS`` is broadcast. A larger one is repeated for ``salts``
    salts, so the rows of a hot key meet it in as many tasks.
    """
    if keyed.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), condition)
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    spread = keyed.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, condition & (F.col("_salt") == F.col("_salted"))).drop("_salt", "_salted")


#: Rows that ask for one key beyond which its answer is sent to them.
OFTEN = 100_000


def looked_up(rows: DataFrame, key: str, keyed: DataFrame, on: str, asked: str, often: int = OFTEN) -> DataFrame:
    """``rows`` joined to ``keyed``, a written table with a row for each key ``on``, without its column ``asked``.

    ``asked`` says how many of ``rows`` have that key. Keys of more than ``often`` rows, which are
    few for that reason, go to the rows by ``beside``; the others meet theirs by a shuffle that no
    key can fill.
    """
    same, answer = F.col(key) == F.col(on), keyed.drop(asked)
    hot = keyed.filter(F.col(asked) > often).drop(asked)
    if is_empty(hot):
        return rows.join(answer, same).drop(on)
    rest = rows.join(small(hot.select(on)), same, "left_anti")
    return beside(rows, hot, same).drop(on).unionByName(rest.join(keyed.filter(F.col(asked) <= often).drop(asked), same).drop(on))


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those in ``gone(_id, _digest, _stay)``; texts move only if ``gone`` is large.

    Of the rows that agree in id and text with a row of ``gone`` as many stay as its ``_stay``
    says, mostly none. Ids match null to null. Columns of ``docs`` come back unchanged, whatever
    their names.
    """
    gone = materialise(gone.select(F.col("_id").alias("_j"), F.col("_digest").alias("_h"), F.col("_stay").cast("int").alias("_stay")), "gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_i"), digest(text_col).alias("_g"))
    same = F.col("_i").eqNullSafe(F.col("_j")) & (F.col("_g") == F.col("_h"))
    kept = packed.join(small(gone), same, "left_anti").select("_row")
    partly = gone.filter("_stay > 0")  # rows that stand in the table more than once
    if not is_empty(partly):
        both = packed.join(small(partly), same)
        nth = F.row_number().over(Window.partitionBy("_j", "_h").orderBy(F.lit(0)))
        kept = kept.union(both.withColumn("_n", nth).filter("_n <= _stay").select("_row"))
    return kept.select("_row.*")


# ---------------------------------------------------------------- kernels over Arrow text


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each row starts (n + 1 offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix64(np.arange(256, dtype=np.uint64))
_POWER = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
SEGMENT = 1 << 21


def _words_of(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word in ``data``; ``first``: positions where a row starts."""
    blank = _BLANK[data]
    opens = np.empty(len(data), bool)
    opens[0] = True
    opens[1:] = blank[:-1]
    opens[first] = True
    opens &= ~blank
    start = np.flatnonzero(opens)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    run = np.zeros(len(data), np.int32)
    run[start] = np.diff(start, prepend=0)
    place = np.arange(len(data), dtype=np.int32) - np.cumsum(run, dtype=np.int32)
    value = _BYTE[data] * _POWER[place & 1023] + place.astype(np.uint64)
    far = np.flatnonzero(place > 1023)
    if len(far):  # weights don't come again in long words
        value[far] *= mix64((place[far] >> 10).astype(np.uint64)) | np.uint64(1)
    value[blank] = 0
    return start, mix64(np.add.reduceat(value, start))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and 64-bit hash of every word, in order.

    Works on a few MB at a time, so one very long text doesn't need many times its size.
    """
    rows, hashes, low, n = [], [], 0, len(data)
    while low < n:
        high = min(n, low + SEGMENT)
        while high < n and not _BLANK[data[high]]:  # never inside a word
            ahead = np.flatnonzero(_BLANK[data[high : high + SEGMENT]])
            high = high + int(ahead[0]) if len(ahead) else min(n, high + SEGMENT)
        inside = at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low
        start, value = _words_of(data[low:high], inside)
        rows.append(np.searchsorted(at, start + low, side="right") - 1)
        hashes.append(value)
        low = high
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


def shingles(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of every distinct shingle of ``size`` words, sorted by row and hash.

    A text of 1 to ``size - 1`` words has one shingle of all its words; one without words, none.
    """
    row, word = words(data, at)
    if not len(row):
        return row, word, np.zeros(0, np.int64)
    count = np.bincount(row, minlength=len(at) - 1)
    begin = np.cumsum(count) - count
    total, left = np.zeros(len(word), np.uint64), count[row] - (np.arange(len(row)) - begin[row])
    for k in range(min(size, len(word))):
        part = mix64(word + np.uint64(k + 1))
        total[: len(word) - k] += np.where(left[: len(word) - k] > k, part[k:], np.uint64(0))
    whole = (left >= size) | ((left == count[row]) & (count[row] < size))
    row, total = row[whole], mix64(total[whole])
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    begin = np.flatnonzero(new)
    return row[begin], total[begin], np.diff(np.append(begin, len(row)))


def slices(batch: pa.RecordBatch, column: str, most: int = SEGMENT):
    """The batch in parts whose texts add up to about ``most`` bytes (one row at least)."""
    _, at = text_bytes(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
