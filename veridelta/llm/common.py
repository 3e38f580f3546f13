"""What the operators of this subpackage share: tables in the shared folder, Arrow batches, words and their hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a task holds in its numpy arrays at once; a longer document is a step of its own.
STEP_BYTES = 4 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 48  # bytes; longer words are hashed one by one


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is named, a local session gets one of its own; a cluster must name one, as its machines share no temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="veridelta-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veridelta/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there and lost executors cost nothing.

    What the job shuffled is not needed any more; collecting the driver's garbage lets Spark's cleaner delete it."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing lazy reads any more."""
    for t in tables:
        jvm, at = t.sparkSession.sparkContext._jvm, t.stored_at
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free() -> None:
    """Gives a worker's unused memory back: workers live on between tasks, several of them beside one executor's heap."""
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()  # modules and the like, else looked through each time
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def lean(run):
    """A function of batches for mapInArrow whose worker gives its memory back at the task's end."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            free()

    return wrapped


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets how many rows of whole texts go to a Python worker at once: the default of 10,000 takes hundreds of megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def space_bytes() -> np.ndarray:
    """Bytes of words: all but space and \\t to \\r."""
    keep = np.ones(256, dtype=bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def alnum_bytes() -> np.ndarray:
    """Bytes of words: digits, letters (either case) and everything outside ASCII."""
    keep = np.zeros(256, dtype=bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = True
    keep[0x80:] = True
    return keep


def text_steps(column: pa.Array, limit: int = STEP_BYTES):
    """(first row, rows, bytes, offsets) of consecutive rows with at most limit bytes, or of one longer row. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j - i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def find_words(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words of all rows, and the first word of each row (with the end as the last)."""
    inside = keep[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z taken as a-z."""
    low = _BYTE[_LOWER]
    h = np.full(len(starts), 0x9E3779B97F4A7C15, dtype=np.uint64)
    # the shortest first, so that the words with a k-th byte are one slice
    short = np.flatnonzero(lens <= _LONG)
    short = short[np.argsort(lens[short].astype(np.uint8), kind="stable")]
    at, own = starts[short], h[short]
    for k, i in enumerate(np.searchsorted(lens[short], np.arange(_LONG), side="right")):
        if i == len(short):
            break
        own[i:] ^= low[raw[at[i:] + k]]
        own[i:] *= np.uint64(0x100000001B3)
        own[i:] += np.uint64(0x632BE59BD9B4E019)
    h[short] = own
    for i in np.flatnonzero(lens > _LONG):
        word = _LOWER[raw[starts[i] : starts[i] + lens[i]]].tobytes()
        h[i] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), dtype=np.uint64)[0]
    return mix(h)


def hash_text_words(text: str | None, keep: np.ndarray) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    starts, lens, _ = find_words(raw, np.array([0, len(raw)]), keep)
    return hash_words(raw, starts, lens)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all rows in order, and each row's first. A row of fewer words, but not none, has its whole sequence as one."""
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(count, out=first[1:])
    at = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], count)
    width = np.repeat(np.minimum(n, size), count)
    out = width.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        has = width > k
        if has.all():
            out = mix(out ^ words[at + k]) + np.uint64(k + 1)
        else:
            sub = np.flatnonzero(has)
            out[sub] = mix(out[sub] ^ words[at[sub] + k]) + np.uint64(k + 1)
    return mix(out), first


def ragged(values_first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices values_first[i] .. values_first[i] + counts[i] - 1 of all i, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(values_first, counts)


def fresh(name: str, columns) -> str:
    """The name, with underscores until no column has it (in either case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_vector(name: str) -> str:
    """SQL: the array has components and none of them is null or non-finite."""
    return f"{name} IS NOT NULL AND size({name}) > 0 AND forall({name}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"


def vector_block(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of number lists as a matrix of the given width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width or (column.value_lengths().to_numpy(zero_copy_only=False) != width).any():
        raise ValueError(f"vectors of one length are needed, {width} here")
    return flat.reshape(len(column), width)


def join_totals(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over all rows of an equal key, nulls being one key.

    Keys of more than a thousandth of the rows, so fewer than a thousand keys, are broadcast and their rows stay where
    they are; only the rest, no key of which is large, is shuffled."""
    each = stored(rows.groupBy(key).agg(F.sum(value).alias(name), F.count("*").alias("n__")), "totals")
    least = (each.agg(F.sum("n__")).first()[0] or 0) / 1000
    hot, cold = each.where(F.col("n__") > least), each.where(F.col("n__") <= least).drop("n__")
    marked = rows.alias("r").join(F.broadcast(hot.withColumnRenamed(key, "k__")), F.col(f"r.{key}").eqNullSafe(F.col("k__")), "left")
    near = marked.where("n__ IS NOT NULL").select("r.*", name)
    far = marked.where("n__ IS NULL").select("r.*").alias("r").join(cold.withColumnRenamed(key, "k__"), F.col(f"r.{key}").eqNullSafe(F.col("k__"))).select("r.*", name)
    return near.unionByName(far)
