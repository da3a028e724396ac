"""Approximate nearest neighbours by a hash-prefix forest.

Every tree hashes a vector to a long bit string, one bit for the side of each of its hyperplanes,
and keeps the strings sorted. A query descends each tree to its longest matching prefix, then all
trees ascend one level at a time, together, until the subtrees hold enough candidates; those are
compared with the query exactly.

The forest lies in blocks of vectors, each with its piece of every tree. A subtree of the whole
forest is the union of its pieces, so counts of a level add up over blocks and the ascent is that of
one forest, whatever the number of blocks. Queries meet blocks in chunks of bounded size.
Equal vectors are one entry that keeps its smallest ids, so copies cost nothing.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import spread_join, stored

TREES, DEPTH = 48, 32
BLOCK_ROWS, CHUNK_ROWS = 8192, 4096


def planes(dim: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, TREES * DEPTH)).astype(np.float32)


def strings(vectors: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Trees x rows: ``DEPTH`` bits of each tree, the first plane's bit highest."""
    bits = (vectors.astype(np.float32) @ normals > 0).reshape(len(vectors), TREES, DEPTH)
    weight = np.left_shift(np.int64(1), np.arange(DEPTH - 1, -1, -1, dtype=np.int64))
    return (bits @ weight).T


def _level_ranges(tree: np.ndarray, code: np.ndarray, level: int):
    """Where a sorted tree holds the codes that share the first ``level`` bits of ``code``."""
    low = (code >> (DEPTH - level)) << (DEPTH - level)
    return (np.searchsorted(tree, low, "left"),
            np.searchsorted(tree, low + (np.int64(1) << (DEPTH - level)), "left"))


def level_counts(index: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Queries x levels 0..DEPTH: rows in the matching subtrees of all trees."""
    out = np.zeros((queries.shape[1], DEPTH + 1), np.int64)
    for tree, code in zip(np.sort(index, axis=1), queries, strict=True):
        for level in range(DEPTH + 1):
            lo, hi = _level_ranges(tree, code, level)
            out[:, level] += hi - lo
            if not (hi > lo).any():
                break
    return out


def candidates(index: np.ndarray, code: np.ndarray, level: int, order: np.ndarray,
               trees: np.ndarray) -> np.ndarray:
    """Rows in the subtrees of ``level`` that match one query, each once."""
    seen = np.zeros(index.shape[1], bool)
    for t in range(TREES):
        lo, hi = _level_ranges(trees[t], code[t], level)
        seen[order[t, lo:hi]] = True
    return np.flatnonzero(seen)


def _valid(vector) -> F.Column:
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return usable & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 20, share: float = 0.9,
                       least: int = 2000, id_col: str = "vec_id",
                       vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k nearest found by inner product, ties to the smaller id.

    Vectors null, zero or with null or non-finite components take no part; those of another length
    than most neither. A query meets every row but its own. The ascent goes on until the matching
    subtrees of all trees hold ``least`` rows and ``share`` times the number of distinct vectors,
    counted with repeats: isotropic vectors, whose neighbours are hardly nearer than the rest, need
    that for a recall of 0.9; give 0 for vectors with structure. Rows that repeat an id and vector
    are rows of their own; a query id stands for one query. Empty input gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>")
                          .alias("vector"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(_valid(F.col("vector")), F.lit(False)))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(
        F.desc("count"), "d").limit(1).collect()
    dim = lengths[0][0] if lengths else 1
    rows = rows.filter(F.size("vector") == dim).withColumn("key", F.xxhash64("vector"))
    rows = stored(rows)
    # A query's own row may be among the smallest ids of its vector, so k + 1 are kept.
    place = Window.partitionBy("key", "vector").orderBy("id")
    first = (rows.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k + 1)
             .groupBy("key", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    entries = stored(first.withColumn("entry", F.xxhash64("vector", F.col("ids")[0])))
    asked = stored(rows.filter("asks").select("id", "key", "vector").dropDuplicates(["id"]))
    total = entries.count()
    blocks, wanted = max(1, -(-total // BLOCK_ROWS)), max(least, int(share * total))
    lookup = entries.select("key", "entry", "vector")
    points = asked.select("key", "vector").distinct().join(lookup, ["key", "vector"])
    chunks = max(1, -(-points.count() // CHUNK_ROWS))
    deal = F.pmod(F.xxhash64("entry", F.lit(3)), F.lit(blocks)).cast("int")
    index = entries.withColumn("block", deal).select(
        "block", "entry", "vector", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    points = stored(points.select("entry", "vector", F.pmod(F.xxhash64("entry", F.lit(5)), F.lit(
        chunks)).cast("int").alias("chunk")))
    every = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def counts(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if held.empty or asks.empty:
            return pd.DataFrame({"entry": [], "counts": []})
        normals = planes(dim)
        found = level_counts(strings(_matrix(held["vector"]), normals),
                             strings(_matrix(asks["vector"]), normals))
        return pd.DataFrame({"entry": asks["entry"], "counts": list(found)})

    def search(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if held.empty or asks.empty:
            return pd.DataFrame({"entry": [], "found": [], "score": []})
        normals = planes(dim)
        x, q = _matrix(held["vector"]), _matrix(asks["vector"])
        index, codes = strings(x, normals), strings(q, normals)
        order = np.argsort(index, axis=1, kind="stable")
        trees = np.take_along_axis(index, order, 1)
        names, out = held["entry"].to_numpy(), []
        for i, (entry, level) in enumerate(zip(asks["entry"], asks["level"], strict=True)):
            near = candidates(index, codes[:, i], int(level), order, trees)
            score = (x[near] * q[i]).sum(axis=1)
            if len(near) > k + 1:
                # Ties at the border stay: ids decide them later.
                edge = np.partition(score, len(near) - k - 1)[len(near) - k - 1]
                near, score = near[score >= edge], score[score >= edge]
            out.append(pd.DataFrame({"entry": entry, "found": names[near], "score": score}))
        return pd.concat(out)

    grid = index.groupBy("block", "chunk")
    levels = (grid.cogroup(every.groupBy("block", "chunk"))
              .applyInPandas(counts, "entry long, counts array<long>")
              .groupBy("entry").agg(*[F.sum(F.get("counts", F.lit(i))).alias(f"n{i}")
                                      for i in range(DEPTH + 1)]))
    # Counts fall with the level: the deepest level that still holds enough.
    held = sum((F.col(f"n{i}") >= wanted).cast("int") for i in range(1, DEPTH + 1))
    deep = levels.select("entry", held.alias("level"))
    leveled = stored(points.join(deep, "entry"))
    every = leveled.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = grid.cogroup(every.groupBy("block", "chunk")).applyInPandas(
        search, "entry long, found long, score double")
    # Each entry found brings its smallest ids; the best k + 1 serve every query of the vector.
    spread = found.join(entries.select(F.col("entry").alias("found"), "ids"), "found").select(
        "entry", "score", F.explode("ids").alias("hit"))
    best = Window.partitionBy("entry").orderBy(F.desc("score"), "hit")
    lists = (spread.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
             .groupBy("entry").agg(F.sort_array(F.collect_list(F.struct(
                 F.col("r"), "hit", "score"))).alias("hits")))
    lists = lookup.join(lists, "entry").select("key", "vector", "hits")
    answered = spread_join(asked, lists, ["key", "vector"], F.col("id"))
    others = F.slice(F.filter("hits", lambda h: h["hit"] != F.col("id")), 1, k)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "h")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("h.hit").alias("id"),
        F.col("h.score").alias("score"))
