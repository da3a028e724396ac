"""Shards by balanced label propagation.

Documents that share a text are linked. From an even start, rounds of joins move a group's
documents to the shard that holds most of their neighbours: in exchange for as many documents that
wish to go the other way, and within the room that unlinked documents leave there. Then the
unlinked ones fill every shard to its exact number of rows.

The documents of a group are alike, so the rounds work on cells (group, shard, count), at most one
a shard and group, and documents take the final labels by rank. A cell moves only where the group
has more documents than in the cell, so the cut shrinks with every move and the rounds end.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import spread_join, spread_rank, stored


def _quota(shard, rows, shards: int) -> F.Column:
    return F.floor(rows / F.lit(shards)) + F.when(shard < rows % F.lit(shards), 1).otherwise(0)


def _moved(cells: DataFrame, moves: DataFrame) -> tuple[DataFrame, int]:
    """The cells after stored moves (group, shard, goal, go), and how many documents moved."""
    moved = moves.agg(F.sum("go")).first()[0] or 0
    after = (cells.union(moves.select("group", "shard", -F.col("go")))
             .union(moves.select("group", "goal", "go")).groupBy("group", "shard")
             .agg(F.sum("n").alias("n")).filter("n > 0"))
    return stored(after), moved


def _swap(cells: DataFrame, quotas: DataFrame) -> tuple[DataFrame, int]:
    """Exchange documents between shards, count for count; the new cells and how many moved.

    A group wishes all its cells into its largest one that does not fill its shard. Of groups with
    two equal cells every other one goes the other way, so wishes of a pair of shards meet. A wish
    that no other one answers stays open: groups may be left in two shards or more.
    """
    part = cells.join(F.broadcast(quotas), "shard").filter("n < quota").drop("quota")
    goal = part.groupBy("group").agg(
        F.max(F.struct("n", F.xxhash64("group", "shard"), "shard")).alias("top"),
        F.count("*").alias("cells")).select(
        "group", F.col("top.shard").alias("goal"), F.col("top.n").alias("most"), "cells")
    wish = part.join(goal, "group").filter(F.col("goal") != F.col("shard"))
    even = (F.col("cells") == 2) & (F.col("n") == F.col("most"))
    low, high = F.least("shard", "goal"), F.greatest("shard", "goal")
    pairs = spread_rank(wish.filter(even).select("group", "n", low.alias("low"), high.alias("high")),
                        ["low", "high"], [F.desc("n"), "group"], F.col("group"))
    first = F.col("rank") % 2 == 0
    wish = stored(wish.filter(~even).select("group", "shard", "goal", "n").union(pairs.select(
        "group", F.when(first, F.col("low")).otherwise(F.col("high")),
        F.when(first, F.col("high")).otherwise(F.col("low")), "n")))
    # One row for two shards.
    there = wish.groupBy("shard", "goal").agg(F.sum("n").alias("there"))
    back = there.select(F.col("shard").alias("goal"), F.col("goal").alias("shard"),
                        F.col("there").alias("back"))
    room = there.join(back, ["shard", "goal"]).select(
        "shard", "goal", F.least("there", "back").alias("room"))
    queue = spread_rank(wish, ["shard", "goal"], [F.desc("n"), "group"], F.col("group"), "before",
                        weight=F.col("n"))
    go = F.least(F.col("n"), F.col("room") - F.col("before"))
    return _moved(cells, stored(queue.join(F.broadcast(room), ["shard", "goal"]).withColumn(
        "go", go).filter("go > 0").select("group", "shard", "goal", "go")))


def _round(cells: DataFrame, quotas: DataFrame) -> tuple[DataFrame, int]:
    """Move cells under the room of each shard; the new cells and how many documents moved."""
    used = cells.groupBy("shard").agg(F.sum("n").alias("used"))
    # One row a shard.
    room = quotas.join(used, "shard", "left").select(
        "shard", (F.col("quota") - F.coalesce("used", F.lit(0))).alias("room"))
    open_cells = cells.join(F.broadcast(room.filter("room > 0")), "shard")
    goal = open_cells.groupBy("group").agg(F.max(F.struct(
        "n", (-F.col("shard")).alias("back"))).alias("top")).select(
        "group", (-F.col("top.back")).alias("goal"), F.col("top.n").alias("most"))
    better = (F.col("most") > F.col("n")) | ((F.col("most") == F.col("n")) & (
        F.col("goal") < F.col("shard")))
    wish = cells.join(goal, "group").filter((F.col("goal") != F.col("shard")) & better)
    queue = spread_rank(wish, ["goal"], [F.desc("most"), "group", "shard"], F.col("group"),
                        "before", weight=F.col("n"))
    go = F.least(F.col("n"), F.col("room") - F.col("before"))
    moves = stored(queue.join(F.broadcast(room.withColumnRenamed("shard", "goal")), "goal")
                   .withColumn("go", go).filter("go > 0").select("group", "shard", "goal", "go"))
    return _moved(cells, moves)


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot, group_size.

    Row counts of shards differ by one at most. Size is the text's UTF-8 bytes and 8. A null text
    has no bytes and checksum 0 and counts as equal to other empty texts. Repeated rows are rows of
    their own. Slots are gapless from 0. Groups beyond a shard's room fill several shards.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("group"))
    slim = slim.withColumn("mark", F.xxhash64("id", "group"))
    rows = stored(spread_rank(slim, [], ["mark", "id"], F.col("mark"), "row"))
    total = rows.count()
    quotas = docs.sparkSession.range(shards).select(
        F.col("id").cast("int").alias("shard"),
        _quota(F.col("id"), F.lit(total), shards).cast("long").alias("quota"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    rows = stored(spread_join(rows, sizes, ["group"], F.col("row"), "left"))
    linked = rows.filter("group_size > 1")
    start = F.pmod("row", F.lit(shards)).cast("int")
    cells = stored(linked.groupBy("group", start.alias("shard")).agg(F.count("*").alias("n")))
    moved = 1
    while moved:
        # Room first: whole groups have no wish left, so few rounds exchange.
        cells, moved = _round(cells, quotas)
        if not moved:
            cells, moved = _swap(cells, quotas)

    along = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (cells.withColumn("from", F.coalesce(F.sum("n").over(along), F.lit(0)))
              .groupBy("group").agg(F.sort_array(F.collect_list(F.struct("from", "shard")))
                                    .alias("spots")))
    inner = spread_rank(linked, ["group"], ["row"], F.col("row"), "rank")
    spot = F.element_at(F.filter("spots", lambda s: s["from"] <= F.col("rank")), -1)["shard"]
    placed = spread_join(inner, ranges, ["group"], F.col("row")).withColumn("shard", spot)
    columns = ["id", "size", "text_crc32", "group_size", "row", "shard"]

    # One number a shard.
    used = {r[0]: r[1] for r in cells.groupBy("shard").agg(F.sum("n")).collect()}
    at, left = 0, []
    for r in sorted(quotas.collect()):
        left.append((at, r[0]))
        at += r[1] - used.get(r[0], 0)
    starts = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(s).alias("shard")) for a, s in left])
    lone = spread_rank(rows.filter("group_size is null"), [], ["row"], F.col("row"), "rank")
    lone = lone.withColumn("shard", F.element_at(F.filter(
        starts, lambda s: s["from"] <= F.col("rank")), -1)["shard"])
    every = placed.select(columns).union(lone.select(columns))
    slotted = spread_rank(every, ["shard"], ["row"], F.col("row"), "slot")
    return slotted.select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                          F.col("slot").cast("long").alias("slot"),
                          F.coalesce("group_size", F.lit(1)).alias("group_size"))
