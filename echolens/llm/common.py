"""Shared plumbing: scratch tables in the cluster's shared folder, document blocks, and the
exchange of hashed keys between blocks.

The exchange is what keeps the corpus-wide operators bounded. Documents are dealt into blocks of a
few MB. Each block sends its *distinct* keys, sorted and cut by key range, as one binary row for
each range ("bucket"); whatever a key's frequency, a block sends it once. The bucket's owner merges
the blocks' runs and answers each block with flags or counts in the block's own key order. A block
then recomputes its keys and applies the answers. No task ever holds all rows of a key.

There is a message for each block and bucket, so their number grows with the product: blocks are
small (they hold texts), buckets are larger (they hold keys). Beyond some TB, raise both sizes with
the executors' memory (``n_blocks``).
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are compared: a null id counts as larger than any other.
NULL_ID = (1 << 63) - 1
RID = "__rid"


def scratch_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: spark.checkpoint.dir, or our own where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):  # one machine
        base = "file://" + tempfile.mkdtemp(prefix="scratch-")
    elif not base:  # the warehouse is shared as well
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone by now; the folder is the cluster's to clean
        pass


def materialise(df: DataFrame, name: str = "t", compression: str = "zstd") -> DataFrame:
    """Write df to the shared scratch folder and read it back: any executor may be lost afterwards."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


_PLAIN = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "DataSourceV2Relation", "LocalRelation", "LogicalRDD"}


def stored(df: DataFrame, name: str = "input") -> DataFrame:
    """df if it is a scan with projections and filters, which gives the same rows in the same order each
    time; else a stored copy, so that row numbers of several scans agree."""
    nodes = [df._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in _PLAIN and not node.nodeName().startswith("Relation"):
            return materialise(df, name)
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return df


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a scan; only used to choose how many blocks to cut."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_blocks(df: DataFrame, mb: float = 4.0) -> int:
    """Blocks of about ``mb`` MB of stored input, and no fewer than the shuffle partitions. Where
    Catalyst knows no size (rows from the driver or an RDD), as many as the input has partitions."""
    size = input_bytes(df)
    least = shuffle_partitions(df.sparkSession)
    return max(least, math.ceil(size / (mb * 1e6)) if size < 1 << 57 else df.rdd.getNumPartitions())


def col_of(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def with_rid(df: DataFrame) -> DataFrame:
    """A row number that is the same each time the same files are scanned. Operators that scan their
    input more than once rely on it, so the input must be a stored table, not a computed frame."""
    return df.withColumn(RID, F.monotonically_increasing_id())


def to_blocks(docs: DataFrame, id_col: str, text_col: str, blocks: int, *more: Column) -> DataFrame:
    """(block, __rid, id, id_null, text, ...), dealt by row number, so that neither a hot source
    nor copies nor a repeated id gather in one block. Null texts are empty."""
    src = with_rid(docs.select(col_of(docs, id_col).cast("long").alias("i"), col_of(docs, text_col).cast("string").alias("t"), *more))
    names = [c for c in src.columns if c not in ("i", "t", RID)]
    return src.select(
        F.pmod(F.hash(RID), F.lit(blocks)).cast("long").alias("block"),
        RID,
        F.coalesce("i", F.lit(NULL_ID)).alias("id"),
        F.coalesce("t", F.lit("")).alias("text"),
        *names,
    ).repartition(blocks, "block")


def restore_id(name: str = "id") -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def in_sample(col: str, rows: int, total: int) -> Column:
    """True for about ``rows`` of ``total`` rows, chosen by the value's hash: every executor decides
    alone, and nothing is sorted or gathered."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, total)))


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


# ---- arrays in binary columns ------------------------------------------------------------------
def dump(*arrays) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def load(data: bytes) -> tuple:
    return pickle.loads(data)  # noqa: S301  only what dump() of the same job wrote


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def narrow(x: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds x (x >= 0)."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def split48(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit keys as their top 48 bits: 16 (which compress to nothing) and 32."""
    return (keys >> np.uint64(48)).astype(np.uint16), (keys >> np.uint64(16)).astype(np.uint32)


def join48(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (hi.astype(np.uint64) << np.uint64(32)) | lo.astype(np.uint64)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted 64-bit keys; buckets + 1 positions."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64)) // buckets
    inner = np.searchsorted(keys, np.array([int(e) for e in edges], dtype=np.uint64))
    return np.concatenate([[0], inner, [len(keys)]]).astype(np.int64)


EMIT = "kind int, bucket int, block long, data binary"
ANSWER = "block long, kind int, bucket int, data binary"


def exchange(blocks: DataFrame, emit: Callable[[pd.DataFrame], Iterator[tuple[int, int, bytes]]], merge: Callable[[int, list[tuple]], list[bytes]]) -> DataFrame:
    """Rows (block, kind, bucket, data): the owners' answers to what ``emit`` sent from each block.

    emit(documents of a block) gives (kind, bucket, data); merge(kind, the blocks' loaded data)
    gives one answer for each block, in the same order.
    """

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, b, int(pdf["block"].iloc[0]), d) for k, b, d in emit(pdf)]
        trim()
        return pd.DataFrame(rows, columns=["kind", "bucket", "block", "data"])

    def owner(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(pdf["kind"].iloc[0])
        out = merge(kind, [load(d) for d in pdf["data"]])
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "kind": pdf["kind"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "data": out})

    sent = blocks.groupBy("block").applyInPandas(send, EMIT)
    return sent.groupBy("kind", "bucket").applyInPandas(owner, ANSWER)


def answers(pdf: pd.DataFrame) -> dict[int, list[tuple]]:
    """A block's answers by kind, in bucket order."""
    out: dict[int, list[tuple]] = {}
    for kind, g in pdf.sort_values(["kind", "bucket"]).groupby("kind"):
        out[int(kind)] = [load(d) for d in g["data"]]
    return out


def runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For several sorted key arrays laid end to end: group number of each entry, number of groups, cut points."""
    at = np.cumsum([0] + [len(k) for k in keys])
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    group = np.empty(len(ranked), np.int64)
    group[order] = np.cumsum(first) - 1
    return group, int(first.sum()), at


# ---- graph components --------------------------------------------------------------------------
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node of each connected component, for nodes that have an edge.

    Alternating large-star and small-star steps; every step is a min by node (combined before the
    shuffle) and a join, and its edges are written to the shared folder. Converges in a logarithmic
    number of steps, or raises; it ends when a step leaves every edge as it was, by number and two
    64-bit sums of hashes. Nothing but these reaches the driver.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = () if e.isEmpty() else None
    for _ in range(rounds):
        if seen == ():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).union(low.select("u", "m")).toDF("u", "v")
        e = materialise(small.where("u <> v").distinct(), "edges")
        mark = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(20,0)"))
        now = tuple(e.agg(F.count("*"), mark(1), mark(2)).first())
        seen = () if seen == now else now
    if seen != ():
        raise RuntimeError(f"components have not converged in {rounds} steps")
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
