"""Shared helpers: scratch tables in the cluster's shared folder, and vectorised text hashing.

A long span's 64-bit hash is cut from its BLAKE2b digest, computed once for each distinct span of a batch;
fingerprints of sequences mix those of their parts. Hashes are the same on every executor.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_SEED = U(0x9E3779B97F4A7C15)
#: The bytes of a little-endian number that belong to a span of so many bytes.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(8)], U)
#: ASCII white space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

# ---- scratch tables ----------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a local temporary
    folder in local mode and the warehouse on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to the shared folder to cut lineage; each is Parquet, so it survives lost
    executors. `drop` deletes one that no later step reads. Arrow batches of texts are kept to some
    megabytes: the session's rows per batch are lowered where they are still at Spark's default."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        if spark.conf.get(ROWS_PER_BATCH) == "10000":  # Spark's default suits numbers, not texts
            spark.conf.set(ROWS_PER_BATCH, "1200")

    def save(self, df: DataFrame) -> DataFrame:
        """`df`, written and read again. Shuffle files of tables that nothing refers to any more are let go
        first."""
        return self.save_with(df)[0]

    def save_with(self, df: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
        """The same, and sums over its rows that are taken as they are written, without a further job; of a
        table without rows they are None. A task that runs again may count its rows again."""
        self.tidy()
        self.n += 1
        path, seen = f"{self.root}/{self.n}", Observation()
        out = df.observe(seen, *[F.sum(c).alias(k) for k, c in sums.items()]) if sums else df
        out.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out, seen.get if sums else {}

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Let Spark's cleaner drop the shuffle files of finished jobs. Spark's event queue refers to the
        last query until another one ends, so a query without a job goes first."""
        gc.collect()
        self.spark.sql("SELECT 1").collect()
        self.spark._jvm.System.gc()
        release_driver(self.spark)


def release_driver(spark: SparkSession) -> None:
    """Give memory that the driver's Python and its JVM have freed back to the system. The C library keeps what the
    JVM's compiler and other threads took outside the heap, hundreds of MB after some hundred queries."""
    release()
    jvm = spark._jvm
    try:
        # by the interface: the server's own class is not open to callers
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        command = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        command[0], command[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), command)
    except Py4JError:  # a JVM without that command, or not on the GNU C library
        pass


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bare(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as long and the named columns only: extra columns can't clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in columns])


def text_volume(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of the column text: sets numbers of buckets, never results."""
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return rows, size or 0


def remainder(divisor: int):
    """crc32(doc_id as text) mod divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


# ---- Arrow batches -----------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in a row, and n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give memory that arrays no longer use back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def pieces(batches: Iterable[pa.RecordBatch], limit: int = 1 << 21, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text, or one row: memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
            release()


# ---- hashing -----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others are spread."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def letters(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on (and from the end on) as one number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans data[starts[i]:ends[i]] (in order, none overlap). Spans of at most 7 bytes go
    into 64 bits with their length, so theirs differ if they do; of longer ones it is 64 bits of their BLAKE2b
    digest. Equal ones are found by their bytes first, so each is hashed once a call. No strings with equal
    hashes can be written down on purpose, as could be for a hash with an inverse."""
    size = ends - starts
    out = mix((letters(data)[starts] & _FIRST[np.minimum(size, 7)]) | (size.astype(U) << U(56)))
    long = np.flatnonzero(size > 7)
    if len(long):
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[long]] += 1  # no two spans start, or end, at one place
        step[ends[long]] -= 1
        inside = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
        offsets = np.zeros(len(long) + 1, np.int64)
        np.cumsum(size[long], out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(long), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(inside))]).dictionary_encode()
        digests = b"".join([blake2b(w, digest_size=8).digest() for w in words.dictionary.to_pylist()])
        out[long] = np.frombuffer(digests, "<u8")[words.indices.to_numpy()]
    return out


def row_hashes(table: np.ndarray, first: int, end: int, seed: int = 0) -> np.ndarray:
    """Hashes of columns first to end of each row of a byte matrix, eight columns at a time; another
    seed gives independent ones."""
    size = -(-(end - first) // 8) * 8
    part = np.zeros((len(table), size), np.uint8)
    part[:, : end - first] = table[:, first:end]
    out = np.full(len(table), mix(np.array([seed], U) + _SEED)[0], U)
    for column in part.view("<u8").T:
        out = mix(out ^ column)
    return out


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a row: starts, ends, and each row's first run."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+: starts, ends, and n + 1 offsets into them by row."""
    return spans_of(~SPACE[data], offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of every n consecutive hashes (rows not regarded): len(hashes) - n + 1 values.
    Built by doubling, so the number of steps is logarithmic in n."""
    if len(hashes) < n:
        return np.zeros(0, U)
    out, have = None, 0
    block, size, m = hashes, 1, 0x2545F4914F6CDD1D
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, have = block, size
            else:
                k = len(hashes) - have - size + 1
                out = mix(out[:k] * U(m) + block[have : have + k])
                have += size
        rest >>= 1
        if rest:
            block = mix(block[: len(block) - size] * U(m) + block[size:])
            size *= 2
            m = (m * 0xD1342543DE82EF95 + 2) % (1 << 64)
    return out[: len(hashes) - n + 1]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for keys that occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
