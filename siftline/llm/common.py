"""Helpers the corpus operators share: storage between stages, hot keys, hashes over text bytes."""

import contextlib
import gc
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPREAD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a scratch one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="spark-siftline-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, executors may go.

    With names in ``by`` rows lie in a folder for each value, so that a filter on it reads no others.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"siftline-{uuid.uuid4().hex}")
    for frames in _noted:
        frames.append(path)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_noted: list[list] = []


@contextlib.contextmanager
def noting():
    """A list that gets the folder of every frame stored in this block."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def delete_folders(spark: SparkSession, folders) -> None:
    """Delete folders of stored frames, and the shuffle files of finished steps.

    Spark drops those when the driver collects its garbage, which a driver that only plans does
    too seldom.
    """
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def discard(*frames: DataFrame, part: str = "") -> None:
    """Delete the folders of stored frames that no later step reads.

    ``part``, as ``name=value``, names the one folder that goes of a frame stored with ``by``.
    """
    found = {os.path.dirname(name) for df in frames for name in df.inputFiles()}
    delete_folders(frames[0].sparkSession, [
        x for x in found if re.search(r"/siftline-[0-9a-f]{32}(/|$)", x)
        and part in ("", os.path.basename(x))])


def spread_join(left: DataFrame, right: DataFrame, key: list, by, how: str = "inner",
                ways: int = SPREAD) -> DataFrame:
    """Join a frame that may have hot keys to one with a row per key.

    Rows of one key are dealt over ``ways`` salts taken from ``by``. The right side gets a row only
    for each (key, salt) that occurs, so no task sees more than a key's share of one salt and
    nothing is multiplied blindly.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    cells = salted.select(*key, "_salt").distinct().join(right, key)
    return salted.join(cells, [*key, "_salt"], how).drop("_salt")


def spread_rank(df: DataFrame, key: list, order: list, by, name: str = "rank",
                ways: int = SPREAD, weight=None) -> DataFrame:
    """Rank from 0 (or sum of ``weight`` before the row) within ``key``, hot keys in many tasks.

    Rows of a key are dealt over ``ways`` parts by ``by``; ranks count within a part and start
    where the smaller parts end. The order is total: part, then ``order``.
    """
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64(by), F.lit(ways)).cast("int")
    parted = df.withColumn("_part", part)
    one = F.lit(1) if weight is None else weight
    sums = parted.groupBy(*key, "_part").agg(F.sum(one.cast("long")).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*key, "_part").orderBy(*order)
    inner = (F.row_number().over(within) - 1 if weight is None else
             F.coalesce(F.sum(one.cast("long")).over(
                 within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (parted.withColumn("_in", inner.cast("long")).join(starts, [*key, "_part"])
            .withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start"))


def _to_smallest(links: DataFrame) -> DataFrame:
    """Links (u, v), u above v: a node and its other smaller neighbours go to its smallest one."""
    from pyspark.sql import Window

    rows = links.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return rows.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                       F.col("m").alias("v")).distinct()


def _unsettled(links: DataFrame) -> DataFrame:
    """(node, m, inner), stored: nodes of several smaller neighbours, or of smaller and larger ones.

    ``m`` is the smallest neighbour, ``inner`` tells that there are larger ones. Hubs are met by
    aggregation. Links without such a node are stars.
    """
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("m")).union(
        links.select("v", F.lit(None).cast("long")))
    nodes = ends.groupBy("node").agg(F.min("m").alias("m"), F.max("m").alias("most"),
                                     (F.count("*") > F.count("m")).alias("inner"))
    return stored(nodes.filter("m is not null and (inner or m < most)").drop("most"))


def _round(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links to an inner node go two steps down its smallest neighbours, then each node's to its
    smallest one."""
    inner = nodes.filter("inner")
    step = inner.select(F.col("node").alias("m"), F.col("m").alias("next"))
    jumps = inner.join(step, "m", "left").select(F.col("node").alias("v"),
                                                 F.coalesce("next", "m").alias("m"))
    far = spread_join(links, jumps, ["v"], F.col("u"), "left")
    return stored(_to_smallest(far.select("u", F.coalesce("m", "v").alias("v"))))


def _links(edges: DataFrame) -> DataFrame:
    return stored(_to_smallest(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))


def _settled(links: DataFrame) -> DataFrame:
    while (nodes := _unsettled(links)).count():
        links = _round(links, nodes)
    return links.select(F.col("u").alias("node"), F.col("v").alias("label"))


def stars(edges: DataFrame) -> DataFrame:
    """(node, label) of edges (a, b), stored: a node and its component's smallest one, which itself
    has no row.

    Alternating stars: a node's larger neighbours are linked to its smallest one, then its smaller
    ones. Paths shorten to a third each round, and each round is stored, so plans stay short. Only
    nodes between a smaller and a larger neighbour change a link, so rounds go on while there are
    any, or a node has two smaller neighbours; edges that are stars already take no round.
    """
    return _settled(_links(edges))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of edges (a, b).

    As ``stars``, after one round that any edges but stars need, and with a row for the smallest
    nodes too. Nodes without an edge to another node are absent.
    """
    links = _links(edges)
    found = _settled(_round(links, _unsettled(links)))
    return found.union(found.select("label", "label").distinct())


# ---- text bytes inside a task ---------------------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 1 << 20), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums P of a polynomial hash; ``span_hash`` turns them into hashes of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * _power("up", len(data)), out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever they stand."""
    down = _power("down", len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def text_slices(column: pa.Array, limit: int = 1 << 20):
    """(first row, last row, bytes, offsets) over whole texts, about ``limit`` bytes at a time.

    A longer text stands alone. Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the maximal runs of member bytes; runs never cross texts."""
    n = len(member)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], member[:-1])) if n else member
    after = np.concatenate((member[1:], [False])) if n else member
    start = np.flatnonzero(member & (~before | edge[:n]))
    end = np.flatnonzero(member & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1
