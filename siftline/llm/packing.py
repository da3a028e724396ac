"""Packing token sequences by minimum bin slack.

A bin is filled by the combination of available lengths that fits it fullest, found by dynamic
programming over subset sums as bits of one integer, and those lengths are then removed. Only the
histogram of lengths, at most one row per length, decides the plan; a combination repeats as often
as its lengths last, so the plan is bounded too. Documents then take their places by rank.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import spread_rank, stored

CAPACITY = 1024


class Encoder:
    """Ids of the byte-level vocabulary, as the ``tokenizers`` library gives them by default."""

    def __init__(self, ranks_file: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # The one special token of the vocabulary, found in text as the library finds it.
        special = {"<|endoftext|>": len(ranks)}
        self.encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")


def tokenized(docs: DataFrame, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id",
              text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32[, ids]) of every whole text and ``end_id``.

    Texts beyond ``capacity`` ids are cut; the first piece takes what the full ones leave. A null
    text is empty: one piece that holds the end id alone.
    """
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (
        ", ids array<int>" if with_ids else "")

    def run(batches):
        encoder = Encoder(ranks, pattern)
        end = np.array([end_id], "<u4")
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 512):
                out = []
                for i in range(at, min(at + 512, batch.num_rows)):
                    ids = np.concatenate((encoder.ids(texts[i].as_py() or "").astype("<u4"), end))
                    cuts = list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity))
                    if len(ids) < capacity:
                        cuts = [len(ids)]
                    for piece, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
                        part = ids[a:b]
                        out.append((i, piece, a, b - a, zlib.crc32(part.tobytes()), part))
                columns = [pa.array([x[k] for x in out], kind) for k, kind in (
                    (1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x[5].astype(np.int32) for x in out],
                                            pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array([x[0] for x in out], pa.int64())), *columns],
                    names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, schema)


def fullest(counts: dict, capacity: int) -> list:
    """The combination that fills a bin best: the largest length left, then lengths of the fullest
    feasible sum of the rest, larger lengths first."""
    lengths = sorted((k for k, n in counts.items() if n > 0), reverse=True)
    first = lengths[0]
    room = capacity - first
    mask, sums, layers = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length] - (length == first), room // length)):
            grown = (sums | (sums << length)) & mask
            if grown == sums:
                break
            layers.append((length, sums))
            sums = grown
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, [first]
    for length, before in reversed(layers):
        if not before >> at & 1:
            chosen.append(length)
            at -= length
    return chosen


def plan_bins(counts: dict, capacity: int = CAPACITY) -> list:
    """(times, lengths): each combination and how many bins in a row repeat it."""
    counts, plan = {k: n for k, n in counts.items() if n > 0}, []
    while counts:
        chosen = Counter(fullest(counts, capacity))
        times = min(counts[k] // m for k, m in chosen.items())
        plan.append((times, sorted(chosen.elements(), reverse=True)))
        for k, m in chosen.items():
            counts[k] -= times * m
            if not counts[k]:
                del counts[k]
    return plan


def placements(spark: SparkSession, plan: list) -> DataFrame:
    """(length, from_rank, to_rank, bin, times, per_bin, offset): where ranks of a length go."""
    rows, used, first = [], Counter(), 0
    for times, lengths in plan:
        offset = 0
        for length, m in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, used[length], used[length] + times * m, first, m, offset))
            used[length] += times * m
            offset += length * m
        first += times
    return spark.createDataFrame(rows, "length long, from_rank long, to_rank long, bin long, "
                                       "per_bin long, offset_in long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` up to ``capacity``.

    Offsets in a sequence are gapless from 0. Pieces of equal length are alike, so ties and
    repeated rows only decide which of them stands where. No pieces give no rows.
    """
    pieces = stored(pieces)
    # At most ``capacity`` rows.
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    spots = placements(pieces.sparkSession, plan_bins(counts, capacity))
    ranked = spread_rank(pieces, ["length"], ["id", "piece"], F.struct("id", "piece"), "rank")
    # One row for each length of each combination: bounded by the capacity, not by the input.
    ranges = (spots.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("from_rank", "to_rank", "bin", "per_bin", "offset_in"))).alias("spots")))
    spot = F.element_at(F.filter("spots", lambda s: s["from_rank"] <= F.col("rank")), -1)
    rows = ranked.join(F.broadcast(ranges), "length").withColumn("spot", spot)
    inside = F.col("rank") - F.col("spot.from_rank")
    return (rows.withColumn("sequence_id", F.col("spot.bin") + F.floor(
        inside / F.col("spot.per_bin")).cast("long"))
        .withColumn("offset", F.col("spot.offset_in") + F.pmod(inside, F.col("spot.per_bin"))
                    * F.col("length")).drop("rank", "spots", "spot"))
