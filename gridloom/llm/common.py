"""Shared pieces of the training-data operators.

Blocks and parts.  Several operators need a fact about every n-gram of every
document ("does it occur elsewhere?") but must not ship every n-gram.  They use
one pattern: documents are dealt once by hash into *blocks* of a few MB; a block
sorts its fingerprints and sends one message per *part* of the fingerprint space
(`part = high bits`); the part answers in message order, usually with one bit per
fingerprint; the block reads the answer beside its texts.  Texts move once, hot
keys are pre-aggregated in their block, and no group is larger than a block or a
part whatever the skew.  The counts of blocks and parts follow the input size.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import shared_dir

BLOCK_BYTES = 8 << 20
PART_BYTES = 32 << 20
#: Shuffle partitions at the most; beyond it, a partition holds several blocks, which stay groups of their own.
MOST_PARTITIONS = 8192
NO_ID = np.iinfo(np.int64).max


def scratch(df: DataFrame, tag: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, runs once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int, tag: str = "t") -> DataFrame:
    """Like scratch, in n buckets by key: later groupings by that key need no shuffle of this table."""
    spark = df.sparkSession
    name = f"gridloom_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(name)
    _remove_later(spark, path)
    return spark.table(name)


def _remove_later(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before us; nothing is left to ask
            return

    atexit.register(remove)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in as many partitions as there are cores at least: a table of few row groups would keep most of them
    idle in operators without a shuffle of their own."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs._jdf.queryExecution().toRdd().getNumPartitions() >= cores else docs.repartition(cores)


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"])


def blocked(docs: DataFrame, total: int | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, doc_id, text) dealt by hash into blocks of about block_bytes, and the number of parts to use.

    The hash takes id and text, so rows without an id spread too; extra columns are dropped.
    """
    total = text_bytes(docs) if total is None else total
    n_blocks = max(4, -(-total // block_bytes))
    n_parts = max(4, -(-total // PART_BYTES))
    d = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return d.repartition(min(n_blocks, MOST_PARTITIONS), "block"), n_parts


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHash(dict):
    """64-bit hash of a word by seed, remembered; the memory is emptied at its bound."""

    limit = 1 << 18
    #: All memories of this process.
    every: weakref.WeakSet[WordHash] = weakref.WeakSet()
    __hash__ = object.__hash__
    __eq__ = object.__eq__

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed
        self.every.add(self)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


def release() -> None:
    """Gives back what earlier stages' tasks left in a worker that is used again: remembered words and free memory."""
    for memo in WordHash.every:
        memo.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        return


def word_hashes(words: list[bytes], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def rolling(a: np.ndarray, m: int, base: int) -> np.ndarray:
    """Mixed polynomial hash of every m consecutive items (modulo 2**64); empty if there are fewer."""
    n = len(a) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    b = np.uint64(base)
    for k in range(m):
        h *= b
        h += a[k : k + n]
    return mix(h)


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    have, cur = 1, h
    while have * 2 <= w:
        cur = np.minimum(cur[: len(cur) - have], cur[have:])
        have *= 2
    return np.minimum(cur[:n], cur[w - have : w - have + n])


def parts_of(h: np.ndarray, n_parts: int) -> np.ndarray:
    """Part of each hash by its high half; ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def part_slices(sorted_hashes: np.ndarray, n_parts: int):
    """(part, start, end) of the parts that occur among sorted hashes."""
    if not len(sorted_hashes):
        return
    p = parts_of(sorted_hashes, n_parts)
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(p)]):
        yield int(p[s]), int(s), int(e)


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """doc_id as int64; a null id becomes NO_ID, which is smaller than nothing."""
    return column.fill_null(NO_ID).to_numpy().astype(np.int64, copy=False)


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def pack_bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def group_ids(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal keys, and each item's run number."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    return np.flatnonzero(new), np.cumsum(new) - 1


def bounded_broadcast_bytes(n_bytes: int, bound: int, what: str) -> None:
    if n_bytes > bound:
        raise ValueError(f"{what}: {n_bytes} bytes to broadcast, the bound is {bound}")


#: Tasks over which the edges of one node are dealt at the most.
STAR_CUTS = 1024


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of their u; a u with many edges is cut by v, so no task holds all of them."""
    cut = F.pmod(F.xxhash64("v"), F.lit(STAR_CUTS)).cast("int")
    e = edges.withColumn("cut", cut)
    least = e.groupBy("u", "cut").agg(F.min("v").alias("m"))
    low = least.groupBy("u").agg(F.min("m").alias("m"))
    return e.join(least.select("u", "cut").join(low, "u"), ["u", "cut"]).select("u", "v", "m")


def connected(edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): (node, component), component the smallest node.

    Alternating large-star and small-star over tables in the shared folder; every round keeps at most as many
    edges as there were, a star's edges are cut over tasks, and nothing reaches the driver but two sums.  Both
    halves of a round are written: a plan of both would have each three times over, which the driver has to hold.
    """
    e = scratch(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag
    )
    last = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = scratch(large.where("u <> v").distinct(), tag)
        small = _with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u <> v").distinct()
        e = scratch(small, tag)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now[0] == 0 or tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    found = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return found.union(found.select("component", "component").distinct())
