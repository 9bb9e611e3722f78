"""Shared tools: shared-folder tables, document views, vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch; long texts make Spark's default of 10,000 heavy on executors.
BATCH_ROWS = 1000

_MADE: dict[int, tuple[SparkSession, str]] = {}
_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and all of Spark runs in this process, as in
    tests, a folder of this machine serves; on a cluster the setting must be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ledgerloom-"))


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_ROWS inside, unless the user has set another number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        if before == "10000":
            spark.conf.set(name, str(BATCH_ROWS))
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage; the table survives the loss of any executor. It stays
    until ``drop`` or the end of the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _MADE[id(out)] = (spark, path)
    _HELD[id(out)] = out
    return out


#: Keeps the frames of tables that exist, so that their ids stay theirs.
_HELD: dict[int, DataFrame] = {}


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        if (made := _MADE.pop(id(df), None)) is not None:
            del _HELD[id(df)]
            _delete(*made)


def written_alone(make, name: str) -> DataFrame:
    """The frame that ``make()`` returns, written; tables written on the way are deleted."""
    before = set(_MADE)
    out = written(make(), name)
    drop(*[_HELD[k] for k in set(_MADE) - before - {id(out)}])
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE.values():
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session ended first; the cluster's own cleaner has the folder
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_hash(*cols, seed: int):
    """A seeded 64-bit hash of columns, the same on every run."""
    return F.xxhash64(F.lit(seed), *cols)


def place_of_null(id_col: str):
    """A row's place where its id is null, else null; hashed beside the id, it spreads rows that have none.

    To be written with the table: a place read twice from a plan need not be the same.
    """
    return F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())


# ---- vectorised hashing --------------------------------------------------

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_NEAR = 64
_TABLE = mix(np.arange(256 * _NEAR, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019))


def word_hashes(data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of a UTF-8 buffer (uint8 array).

    A word's hash is a sum of one table entry for each (byte, place) followed by
    a finaliser that takes in the length; places beyond the table are mixed on
    the fly, so words of any length are hashed whole.
    """
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    size = end - start
    base = np.zeros(len(data), np.int32)
    base[start] = np.diff(start, prepend=0)
    place = np.arange(len(data), dtype=np.int32) - np.cumsum(base, dtype=np.int32)
    value = _TABLE[data.astype(np.int32) + 256 * np.minimum(place, _NEAR - 1)]
    if size.max() > _NEAR:
        far = place >= _NEAR
        value[far] = mix(data[far].astype(np.uint64) + _U(256) * place[far].astype(np.uint64) + _U(0xA0761D6478BD642F))
    value[~inside] = 0
    total = np.add.reduceat(value, start)
    return start, end, mix(total + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U((seed * 0x9E3779B97F4A7C15) % 2**64))


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` values; position-dependent, by doubling."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, size, at = None, 0, 1, words
    left = k
    while left:
        if left & size:
            piece = at[done : done + n]
            out = piece.copy() if out is None else mix(out * _U(0x9FB21C651E98DF25) + piece)
            done += size
            left -= size
        if left:
            m = len(at) - size
            if m > 0:
                at = mix(at[:m] * _U(0xC2B2AE3D27D4EB4F) + at[size : size + m])
            size *= 2
    return out


def release() -> None:
    """Give freed memory back: workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


#: What a worker keeps from one task to the next of the same operator.
KEPT: dict[str, object] = {}


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20, keeping: str | None = None):
    """(first row, number of rows) of runs of a batch of about ``most`` bytes of text.

    A single longer text is a run of its own. Of ``KEPT``, only the entry named
    by ``keeping`` stays: what another operator left in this worker goes.
    """
    for name in KEPT.keys() - {keeping}:
        del KEPT[name]
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    first = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and size + n > most:
            yield first, i - first
            first, size = i, 0
        size += n
    if len(sizes):
        yield first, len(sizes) - first
    release()


def byte_batches(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20):
    """The runs of ``slices``: (first row, texts as bytes). A null text comes out as None."""
    array = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    for first, n in slices(batch, column, most):
        yield first, array.slice(first, n).to_pylist()


def joined_words(texts: list[bytes | None], seed: int = 0):
    """Word hashes of many texts at once.

    Returns (buffer, word start, word end, word hash, first word of each text):
    the last has one entry more than ``texts``.
    """
    whole = b"\n".join(t or b"" for t in texts)
    data = np.frombuffer(whole, np.uint8)
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts)) + 1
    begin = np.concatenate(([0], np.cumsum(sizes)))
    start, end, words = word_hashes(data, seed) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return whole, start, end, words, np.searchsorted(start, begin)


# ---- a filter of fixed size ----------------------------------------------

SIEVE_BITS = 25


class Sieve:
    """A Bloom filter of 2**25 bits (4 MB) whatever the input, for map-side pruning.

    It only spares a shuffle: rows that pass are joined exactly afterwards. When
    it fills up, more rows pass and results stay the same. The filter is one row
    with one array, broadcast and tested on the JVM.
    """

    def __init__(self, ids: DataFrame, column: str):
        bits = ids.select(F.explode(F.array(*self._places(column))).alias("h"))
        words = bits.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
        # One row, whatever the input: 2**19 words in order.
        every = ids.sparkSession.range(1 << (SIEVE_BITS - 6)).join(words, F.col("id") == F.col("w"), "left")
        parts = every.groupBy(F.shiftright("id", 9).alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("x"))
        one = parts.agg(F.array_sort(F.collect_list(F.struct("part", F.transform("x", lambda x: x["bits"]).alias("bits")))).alias("x"))
        self.bits = written(one.select(F.flatten(F.transform("x", lambda x: x["bits"])).alias("_sieve")), "sieve")

    @staticmethod
    def _places(column: str) -> list:
        return [F.pmod(F.xxhash64(F.lit(k), F.col(column)), F.lit(1 << SIEVE_BITS)) for k in (1, 2)]

    def prune(self, docs: DataFrame, column: str, others: bool = False) -> DataFrame:
        """Rows of ``docs`` that may be among the ids, or with ``others`` those that are surely not."""
        test = F.lit(True)
        for h in self._places(column):
            word = F.get("_sieve", F.shiftright(h, 6).cast("int"))
            test &= F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return docs.join(F.broadcast(self.bits), test, "left_anti" if others else "left_semi")


def without(docs: DataFrame, gone: DataFrame, id_col: str, mark, one: str, two: str) -> DataFrame:
    """Rows of ``docs`` but those whose id and mark are in ``gone`` (columns ``one`` and ``two``).

    Rows whose id is surely not among the gone stay where they are; the others are joined.
    """
    sieve = Sieve(gone, one)
    ids = docs.select(F.col(id_col).cast(gone.schema[one].dataType).alias(one), "*")
    sure = sieve.prune(ids, one, others=True).drop(one)
    maybe = sieve.prune(ids, one).drop(one).join(gone, F.col(id_col).eqNullSafe(F.col(one)) & (mark == F.col(two)), "left_anti")
    return sure.unionAll(maybe)
