"""Exact deduplication: a static filter per immutable snapshot screens the digests of a batch.

A snapshot never changes, so its digests go once into binary-fuse filters, one per digest bucket.
A batch first groups its own duplicates. The digests left meet the filters; the few that pass join
the snapshot's rows of their bucket, and a copy is called so only when the bytes agree.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import BYTE, SPACE, mix, spread_join, stored

BUCKET_DIGESTS = 50_000
_SEEDS = 64


# ---- the filter -----------------------------------------------------------------------------

def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray:
    """Three slots of each key in neighbouring segments."""
    h = mix(keys + BYTE[seed % 256] * np.uint64(seed + 1))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    low = np.uint64(segment - 1)
    return np.stack([(first + np.uint64(k)) * np.uint64(segment) + ((h >> np.uint64(18 * k)) & low)
                     for k in range(3)]).astype(np.int64)


def _print8(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, seed + 77, np.uint64))) & np.uint64(0xFF)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> dict:
    """Binary-fuse filter of distinct 64-bit keys: 8 bits a slot, about 1.2 slots a key.

    Slots that hold one key only are peeled in whole rounds; the reverse order of the rounds lets
    every key set a slot that no later key needs.
    """
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(np.log2(max(n, 2)) / 1.7 + 1))
    spare = 1.15 + 0.5 * max(0.0, 1 - np.log(max(n, 2)) / np.log(1e6)) + 8 / max(n, 1)
    segments = max(1, int(np.ceil(n * spare / segment)))
    size = (segments + 2) * segment
    for seed in range(_SEEDS):
        at = _places(keys, seed, segment, segments)
        count = np.bincount(at.ravel(), minlength=size)
        total = np.zeros(size, np.int64)
        for row in at:
            np.add.at(total, row, np.arange(n))
        left, rounds = n, []
        while left:
            free = np.flatnonzero(count == 1)
            if not len(free):
                break
            who, where = np.unique(total[free], return_index=True)
            rounds.append((who, free[where]))
            for row in at[:, who]:
                np.subtract.at(count, row, 1)
                np.subtract.at(total, row, who)
            left -= len(who)
        if not left:
            slots, mark = np.zeros(size, np.uint8), _print8(keys, seed)
            for who, free in reversed(rounds):
                a, b, c = at[:, who]
                slots[free] = 0
                slots[free] = mark[who] ^ slots[a] ^ slots[b] ^ slots[c]
            return {"seed": seed, "segment": segment, "segments": segments,
                    "slots": slots.tobytes()}
    raise ValueError(f"no filter for {n} keys after {_SEEDS} seeds")


def fuse_has(f: dict, keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one other key in 256."""
    keys = np.asarray(keys, np.uint64)
    slots = np.frombuffer(f["slots"], np.uint8)
    a, b, c = _places(keys, f["seed"], f["segment"], f["segments"])
    return slots[a] ^ slots[b] ^ slots[c] == _print8(keys, f["seed"])


# ---- snapshots ------------------------------------------------------------------------------

def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chars, sha): slim rows; sha is the digest of the text without white space."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("chars"),
                       F.sha2(normalised(text), 256).alias("sha"))


def _groups(rows: DataFrame) -> DataFrame:
    """(sha, best, n): copies within one batch; partial sums leave each task, never the copies."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("void"),
                          F.col("id"))).alias("best")
    return rows.groupBy("sha").agg(best, F.count("*").alias("n"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    key = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    return groups.withColumn("key", key).withColumn("bucket", F.pmod("key", F.lit(buckets)))


def build_filters(groups: DataFrame) -> DataFrame:
    """(bucket, seed, segment, segments, slots): one filter for each bucket of a snapshot.

    ``groups`` carries (key, bucket) with distinct digests, so a bucket's size follows the number
    of buckets and copies cannot swell it.
    """
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fuse_build(pdf["key"].to_numpy().astype(np.uint64))
        return pd.DataFrame([{"bucket": int(pdf["bucket"].iloc[0])} | f])

    return groups.select("bucket", "key").groupBy("bucket").applyInPandas(
        build, "bucket long, seed int, segment int, segments int, slots binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Incoming rows (bucket, key, ...) that some filter of their bucket may know."""
    schema = incoming.schema

    def keep(key, rows: pd.DataFrame, filter_rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or filter_rows.empty:
            return rows.iloc[:0]
        return rows[fuse_has(filter_rows.iloc[0].to_dict(),
                             rows["key"].to_numpy().astype(np.uint64))]

    return (incoming.groupBy("bucket").cogroup(filters.groupBy("bucket"))
            .applyInPandas(keep, schema))


def buckets_for(groups: DataFrame, digests: int = BUCKET_DIGESTS) -> int:
    return max(1, -(-groups.count() // digests))


def exact_duplicates(docs: DataFrame, snapshot: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", digests: int = BUCKET_DIGESTS) -> DataFrame:
    """One row per row of ``snapshot`` and ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after removing white space. Of equal texts the row with the
    most code points stays, then the smallest id; a null id comes last. Null texts count as empty
    and equal. Rows that repeat an id with the same text all count in ``group_size`` and share one
    fate. Empty inputs give empty results; other columns are not read.

    ``snapshot`` is the immutable part, already accepted; ``docs`` the batch that comes in.
    """
    old = digested(snapshot, id_col, text_col)
    new = digested(docs, id_col, text_col)
    rows = stored(old.withColumn("is_new", F.lit(False)).union(
        new.withColumn("is_new", F.lit(True))))
    known, batch = _groups(rows.filter(~F.col("is_new"))), _groups(rows.filter("is_new"))
    # A task holds a bucket of either side, so the larger one decides.
    known, batch = stored(known), stored(batch)
    buckets = max(buckets_for(known, digests), buckets_for(batch, digests))
    known, batch = stored(_bucketed(known, buckets)), _bucketed(batch, buckets)
    hits = screen(batch.select("bucket", "key", "sha", F.col("best.id").alias("id")),
                  build_filters(known))
    pairs = stored(hits.join(known.select("bucket", "sha", F.col("best.id").alias("old_id")),
                             ["bucket", "sha"]).select("sha", "id", "old_id"))
    equal = stored(_byte_equal(pairs, docs, snapshot, id_col, text_col))
    batch = batch.join(equal.withColumn("same", F.lit(True)), "sha", "left")
    sides = known.select("sha", "best", "n", F.lit(False).alias("is_new"), F.lit(True).alias("same")
                         ).union(batch.select("sha", "best", "n", F.lit(True), "same"))
    name = F.when(F.coalesce("same", F.lit(False)), F.col("sha")).otherwise(F.concat("sha", F.lit("+")))
    groups = (sides.groupBy(name.alias("name"))
              .agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.min("sha").alias("sha"),
                   F.collect_set("is_new").alias("sides"))
              .select("sha", F.explode("sides").alias("is_new"), "best", "n"))
    return _decided(rows, groups)


def _byte_equal(pairs: DataFrame, docs: DataFrame, snapshot: DataFrame, id_col, text_col):
    """Digests whose incoming and known representative have the same bytes."""
    def bodies(df, name, key):
        texts = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias(name))
        # Sorted on both sides at every size: the pairs grow with the input.
        return (texts.join(pairs.select("sha", key).hint("merge"), F.col("_id").eqNullSafe(F.col(key)))
                .filter(F.sha2(name, 256) == F.col("sha")).groupBy("sha")
                .agg(F.min(name).alias(name)))

    return (bodies(docs, "a", "id").join(bodies(snapshot, "b", "old_id"), "sha")
            .filter("a = b").select("sha"))


def _decided(rows: DataFrame, groups: DataFrame) -> DataFrame:
    wide = groups.filter("n > 1").select("sha", "is_new", F.col("best.id").alias("keep_id"),
                                         F.col("n").alias("size"))
    out = spread_join(rows, wide, ["sha", "is_new"], F.struct("id", "chars"), "left")
    lone = F.col("size").isNull()
    keep = F.when(lone, F.col("id")).otherwise(F.col("keep_id"))
    return out.select("id", keep.alias("keep_id"),
                      F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                      (lone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                      F.col("sha").alias("text_sha256"))


def reference_digest(text: str | None) -> str:
    """The digest in plain Python, for tests."""
    kept = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
    return hashlib.sha256(kept.encode()).hexdigest()
