"""Helpers shared by the operators: table access, word hashing, Arrow batches."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from budgetlens.session import scratch_path

#: Odd multiplier of the polynomial window hash (64-bit golden ratio).
BASE = 0x9E3779B97F4A7C15
#: Multiplier of the word hash; 3 modulo 4, so that its powers differ in low bits.
BYTE_BASE = 0x9E6C63D0676A9A9B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the
    lineage ends there, so a lost executor repeats a read and not the work.
    Shuffle files of finished steps are released on the way."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let the driver drop references to finished shuffles, whose files Spark
    then deletes on the executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of a bounded Arrow batch, where the session has Spark's own limit.
BATCH_BYTES = 8 << 20


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, so that neither side holds
    many long texts at once: a session with Spark's default for
    ``spark.sql.execution.arrow.maxBytesPerBatch`` gets ``BATCH_BYTES``, another
    value is kept. A task gives unused memory back when it ends."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, str(BATCH_BYTES))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict],
                schema: str, bounded: bool = False) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one batch into columns (a dict of
    column name to array), or yields several such dicts; ``bounded``: through
    ``in_arrow``."""
    target = to_arrow_schema(_struct(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                for cols in ([made] if isinstance(made, dict) else made):
                    arrays = [_array(cols[f.name], f.type) for f in target]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return in_arrow(df, run, schema) if bounded else df.mapInArrow(run, schema)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def per_worker(key: str, make: Callable[[], object]):
    """What ``make`` gives, made once in each Python worker and kept for its
    later tasks (functions shipped by value have no globals that last)."""
    kept = sys.modules.setdefault("budgetlens_worker", types.ModuleType("budgetlens_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def each_text(batch: pa.RecordBatch, name: str = "text", rows: int = 64) -> Iterator[str]:
    """The same strings one by one, of which only ``rows`` exist at a time."""
    column = batch.column(name)
    for k in range(0, len(column), rows):
        for t in column.slice(k, rows).to_pylist():
            yield t or ""


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of word hashes order like random numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: Bytes that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are hashed at once.
BLOCK_BYTES = 1 << 20


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words in a buffer."""
    edge = np.diff(BLANK[buf].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]


class WordHashes:
    """64-bit hashes of all words of many texts by array arithmetic.

    A word's hash is a polynomial over pseudo-random values of its bytes,
    modulo 2**64, from differences of running sums; so it does not depend on
    where the word stands.
    """

    def __init__(self) -> None:
        self.value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.power = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.full(n, BYTE_BASE, np.uint64)
            self.inverse = np.full(n, pow(BYTE_BASE, -1, 1 << 64), np.uint64)
            self.power[0] = self.inverse[0] = 1
            np.multiply.accumulate(self.power, out=self.power)
            np.multiply.accumulate(self.inverse, out=self.inverse)

    def of_bytes(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first bytes) of the words in ``raw``."""
        buf = np.frombuffer(raw, np.uint8)
        first, end = spans(buf)
        return self.of_spans(buf, first, end), first

    def of_spans(self, buf: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the given runs of bytes, which are in order and do not overlap."""
        out = np.empty(len(first), np.uint64)
        at = 0
        while at < len(first):
            a = int(first[at])
            upto = max(at + 1, int(np.searchsorted(end, a + BLOCK_BYTES, side="right")))
            n = int(end[upto - 1]) - a
            self._powers(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.value[buf[a:a + n]] * self.power[:n], out=sums[1:])
            f, e = first[at:upto] - a, end[at:upto] - a
            out[at:upto] = (sums[e] - sums[f]) * self.inverse[f]
            at = upto
        return mixed(out)

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, where each text's words begin, and the end)."""
        h, first = self.of_bytes(b"\n".join(texts))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return h, np.searchsorted(first, begins)

    def of_word(self, word: bytes) -> int:
        return int(self.of_bytes(word)[0][0])


def chunks(texts: Iterable[str], change=None, size: int = 1 << 22):
    """Runs of encoded texts of about ``size`` bytes: (number of the first, list)."""
    run, begin, n = [], 0, 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        run.append(change(raw) if change else raw)
        n += len(raw)
        if n >= size:
            yield begin, run
            run, begin, n = [], i + 1, 0
    if run:
        yield begin, run


def window_hashes(h: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (empty if fewer)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= np.uint64(base)
        out += h[j:j + n]
    return mixed(out)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def doc_bucket(column, modulus: int):
    """crc32 of the id as text modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))),
                  F.lit(modulus))
