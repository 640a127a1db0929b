"""What several operators share: words, tables, checkpoints, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
BLANK_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RE), "")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only where it is unset and all runs on this machine (tests)
    a local one is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="millrace-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Returns what Arrow and the C library keep of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, giving back freed memory when its task ends: Spark keeps workers for later tasks and stages, and an
    executor's JVM grows meanwhile."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


#: A key is hot with more than this part of the rows, and with HOT_ROWS rows at least; so there are never more than HOT_SHARE.
HOT_SHARE, HOT_ROWS, HOT_SALTS = 256, 1000, 32


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", extra: tuple[str, ...] = ()) -> DataFrame:
    """left.join(right, [key, *extra], how), inner or left, for a left side that is materialised and a right side of one row a key, or few.
    Rows of hot keys are dealt over HOT_SALTS groups in turn, each of which gets the key's right rows."""
    total = left.count()
    if total <= HOT_ROWS:
        return left.join(right, [key, *extra], how)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"))
    hot = [r[0] for r in counts.where(F.col("_c") > max(HOT_ROWS, total // HOT_SHARE)).select(key).collect()]
    if not hot:
        return left.join(right, [key, *extra], how)
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SALTS)).cast("int")).otherwise(0)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", F.explode(salts)), [key, *extra, "_salt"], how).drop("_salt")


def crc_bucket(doc_id: object, modulus: int) -> int:
    """crc32 of the id as text, modulo; a null id counts as the text 'null'."""
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % modulus


def crc_bucket_col(doc_id: Column, modulus: int) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus).cast("int")


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A multiplier for each byte; A-Z have those of a-z, and white space has none.
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64)
BYTES[65:91] = BYTES[97:123]
BYTES[BLANK] = 0
#: Texts are hashed in runs of about so many bytes, or one text where that is longer.
RUN_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def text_runs(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in slices of about RUN_BYTES bytes; nulls become empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + 1 : texts.offset + len(texts) + 1]
    at, base = 0, int(ends[0]) - len(texts[0].as_py().encode())
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, base + RUN_BYTES, "right")))
        yield texts.slice(at, stop - at)
        at, base = stop, int(ends[stop - 1])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a run of text_runs, A-Z taken as a-z, and the number of words of each text.

    The hash of a word is the sum of its bytes' multipliers times multipliers of their places in it, mixed."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(off[-1] - off[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw, off = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]
    blank = BLANK[raw]
    before = np.r_[True, blank[:-1]]
    before[off[:-1][off[:-1] < size]] = True
    start = np.flatnonzero(before & ~blank)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    length = np.diff(np.append(start, size))
    place = mixed(np.arange(1, int(length.max()) + 1, dtype=np.uint64) * M2) | np.uint64(1)
    part = BYTES[raw[start[0] :]] * place[np.arange(start[0], size) - np.repeat(start, length)]
    return mixed(np.add.reduceat(part, start - start[0])), np.diff(np.searchsorted(start, off))


#: Up to so many different edges are joined by one task, which saves the rounds' many shuffles; more go through the rounds.
SMALL_EDGES = 200_000


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all the edges (u, v) of a task, by union and find; a root is the least node."""
    up: dict = {}

    def root(x: object) -> object:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for b in batches:
        kind = b.column(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            up.setdefault(u, u), up.setdefault(v, v)
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], ["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: of up to SMALL_EDGES edges in one task, beyond by alternating large-star and small-star passes
    over a distributed edge list.  Both give the same.

    edges(a, b): any comparable type, either direction, loops and repeats allowed.  Returns (node, root): root is the
    smallest node that links reach.  Nodes without an edge to another node do not appear.  Each pass is checkpointed,
    so the plan stays short and lost executors cost one pass.  A node's neighbours are only ever aggregated with
    min(), never gathered.  Each join is followed by a shuffle on other keys, so a hub's rows may be split at run time.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    e = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() <= SMALL_EDGES:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(joined_up, f"node {kind}, root {kind}")
    before = None
    for _ in range(max_rounds):
        # large star: each larger neighbour of u is linked to the least of u and its neighbours
        sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: each smaller neighbour of u, and u, is linked to the least of them
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
