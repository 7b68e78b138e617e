"""What several operators of this package share: scratch tables in the shared
folder, vectorised word hashing over Arrow text columns, and small SQL pieces.

Words are always maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; those
bytes never occur inside a multi-byte UTF-8 character, so the split is the same
on bytes and on characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.store import shared_folder as scratch

#: Rows and bytes that Spark hands to a Python task at once: whole texts are long, and Spark's defaults fill an executor.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this lasts, Arrow batches hold at most BATCH_ROWS rows and about BATCH_BYTES bytes;
    afterwards the session's own settings are back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, most in wanted.items():
            spark.conf.set(k, str(most))
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame, name: str = "cut", dictionary: bool = True) -> DataFrame:
    """``df`` written to the shared folder, in small batches, and read back: later stages start
    from the files, so a lost executor costs no more than its own tasks."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_hashes(df: DataFrame, name: str) -> DataFrame:
    """``cut`` where most columns are hashes, which no dictionary shortens."""
    return cut(df, name, dictionary=False)


def to_arrow(df: DataFrame) -> pa.Table:
    """A result of bounded size on the driver, made in small batches."""
    with small_batches(df.sparkSession):
        return df.toArrow()


def join_on(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) where some keys may hold a large share of the
    ``total`` rows: ``weight`` is the number of rows with the table's key. The keys that hold more
    than a thousandth each, fewer than 1,000 by arithmetic, are broadcast; the others are shuffled."""
    heavy = F.col(weight) * 1000 > total
    hot = table.where(heavy).drop(weight)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~heavy).drop(weight), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def own_columns(docs: DataFrame, **wanted: Column) -> DataFrame:
    """Only the named columns. Reading input columns first keeps any extra columns, whatever
    they are called, out of the operators."""
    return docs.select(*[c.alias(n) for n, c in wanted.items()])


def id_text(col: Column) -> Column:
    """A document id as text; a null id counts as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def split_words(text: Column) -> Column:
    """The words of a text, as SQL: an array of strings without empty ones (null text: empty)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def bind(value: Column, then) -> Column:
    """``then(x)`` with x evaluated once: an expression inside a lambda body would otherwise
    be computed again for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def global_index(df: DataFrame, *order: Column, name: str = "index") -> DataFrame:
    """``df`` with its 0-based place in the order, without sorting in one task: range
    partitions, numbered each by itself, plus the count of rows before each (one row a
    partition on the driver)."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranged")
    before, offsets = 0, []
    for pid, n in sorted((r[0], r[1]) for r in ranged.groupBy("_pid").count().collect()):
        offsets.append((pid, before))
        before += n
    start = F.create_map(*[F.lit(x) for pair in offsets for x in pair])[F.col("_pid")] if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return ranged.withColumn(name, (place + start).cast("long")).drop("_pid")


#: Documents that the target of a quality model has at most: a bounded sample of labelled rows.
LABELLED = 20_000


def target_ids(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """The ids of at most ``most`` documents of quality 1, those with the least hash of the id."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


# --- word hashing over Arrow buffers ---------------------------------------------------------

#: Bytes of text handled at once inside a task; a single longer text is handled alone, whole.
CHUNK = 2 << 20
#: Bytes where many numbers are made of each byte: in the pipeline two workers share an executor with a heap that is full.
SMALL_CHUNK = 1 << 19
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SOLID = ~_SPACE
#: Longer words are hashed by a digest.
DIGEST = 64
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def looked_up(table: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``table[b]`` for a table of 256 bytes or flags, in a fraction of the time; read-only."""
    return np.frombuffer(b.tobytes().translate(table.tobytes()), table.dtype)


class Text:
    """The texts of one chunk: ``bytes`` (uint8), ``off`` (n + 1 offsets)."""

    def __init__(self, column: pa.Array, lower: bool) -> None:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.bytes = looked_up(_LOWER, raw) if lower else raw
        self.n = len(column)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the index of its first word (n + 1)."""
        solid = looked_up(_SOLID, self.bytes)
        some = self.off[:-1] < self.off[1:]
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        at = self.off[:-1][some]
        start[at] = solid[at]
        at = self.off[1:][some] - 1
        end[at] = solid[at]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        return s, e, np.searchsorted(s, self.off)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each word, and for each text the index of its first word (n + 1)."""
        s, e, first = self.words()
        return self.hash_runs(s, e), first

    def hash_runs(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run of bytes from s to e: eight bytes after eight are mixed in, the
        few very long runs by a digest of the whole."""
        n = e - s
        h = mix64(n.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        if not len(s):
            return h
        padded = np.concatenate([self.bytes, np.zeros(8, np.uint8)])
        lanes = np.ndarray(len(self.bytes) + 1, "<u8", padded, strides=(1,))
        some = slice(None)
        for k in range(0, DIGEST, 8):
            left = n[some] - k
            x = lanes[s[some] + k] & _LANE[np.minimum(left, 8)]
            h[some] = mix64((h[some] ^ x) * np.uint64(0xD6E8FEB86659FD93))
            some = np.flatnonzero(n > k + 8)
            if not len(some):
                return h
        for i in some.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.bytes[s[i] : e[i]], digest_size=8).digest(), "little")
        return h


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    begin, total = 0, 0
    for i, n in enumerate(size):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about ``size`` bytes of text: what a task works out once
    for each distinct word pays over more of it."""
    waiting, total = [], 0
    for batch in batches:
        for part in chunks(batch, column):
            waiting.append(part)
            total += part.column(column).nbytes
            if total >= size:
                yield pa.concat_batches(waiting)
                waiting, total = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


class Tally:
    """Counts of 64-bit keys inside a task, in bounded memory: what outgrows ``most`` distinct keys is
    handed on, to be summed by Spark."""

    def __init__(self, most: int = 1 << 21) -> None:
        self.most, self.keys, self.sums = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.waiting.append(keys)
        self.n += len(keys)
        if self.n > 1 << 20:
            self._merge()
            if len(self.keys) > self.most:
                yield from self.rest()

    def _merge(self) -> None:
        if self.n:
            new, c = np.unique(np.concatenate(self.waiting), return_counts=True)
            both, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
            self.sums = np.bincount(at, np.concatenate([self.sums, c]), len(both)).astype(np.int64)
            self.keys, self.n = both, 0
            self.waiting.clear()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All that is left, in parts; the tally is empty afterwards."""
        self._merge()
        keys, sums, self.keys, self.sums = self.keys, self.sums, self.keys[:0], self.sums[:0]
        for i in range(0, len(keys), 1 << 17):
            yield keys[i : i + (1 << 17)], sums[i : i + (1 << 17)]


def windows(h: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie in one text, and the index of each text's first (n + 1)."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    starts = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=starts[1:])
    if starts[-1] == 0:
        return np.zeros(0, np.uint64), starts
    m = len(h) - k + 1
    acc = np.full(m, np.uint64(seed * 0x5851F42D4C957F2D + k & 0xFFFFFFFFFFFFFFFF))
    for j in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[j : j + m]
    inside = np.repeat(first[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    return mix64(acc[inside]), starts


def from_signed(col: pa.Array) -> np.ndarray:
    return np.asarray(col).view(np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values))


# --- fixed-size membership filters -----------------------------------------------------------


def bitmap(keys: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A filter of 2**bits bits over a column of 64-bit keys, built with bit_or by word: at
    most 2**bits / 64 rows reach the driver whatever the input. It lets through every key and
    some others (which an exact join removes later), the more the fuller it is."""
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = (
        keys.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = rows.toArrow()
    if got.num_rows:
        out[np.asarray(got.column("w").combine_chunks())] = np.asarray(got.column("b").combine_chunks()).view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
