"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over the run, a piecewise linear curve. Integrating the shares
gives a source's cumulative token demand; inverting that demand at a document's place within its
source gives the training position, and documents are range-sorted by position.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import WORD, spread_join, spread_rank, stored

STEPS = 64


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_sizes(sized: DataFrame) -> DataFrame:
    """(source, place, source_size): place counts from 0 by code point, null last.

    A source's place is the number of rows on smaller slices of the sorted sources plus its own
    place in the slice, so even very many sources are ranked in parallel.
    """
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"))
                  .repartitionByRange(F.col("source").asc_nulls_last())
                  .withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice: bounded by the number of shuffle partitions.
    starts = (sums.groupBy("slice").agg(F.count("*").alias("rows"))
              .select("slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("slice").orderBy(F.col("source").asc_nulls_last())
    return (sums.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(starts), "slice")
            .select("source", (F.col("start") + F.col("at")).alias("place"), "source_size"))


def water_fill(sources: DataFrame, total: float, most: float) -> DataFrame:
    """Add ``target``: ``total`` shared by ``weight``, none above ``most`` times its source's size.

    What a capped source can't take goes to the others by weight, again and again until none is
    above. The driver sees three numbers a round, and a round caps at least one more source.
    """
    cap = F.col("source_size") * F.lit(float(most))
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= cap if level else F.lit(False)
        held, weight, n = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(
                F.col("weight"))), F.sum(full.cast("long"))).first()
        if n == capped or not weight:
            break
        capped, level = n, (total - held) / weight
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(full | (share > cap), cap).otherwise(share))


def _demand(sources: DataFrame, schedule: DataFrame) -> DataFrame:
    """(source, step, demand): the part of a source's target due by each of ``STEPS`` steps.

    ``schedule``: (source, step, share), its weight at the steps 0 to STEPS. The curve between two
    steps is a trapezoid of the share among all sources.
    """
    total = schedule.groupBy("step").agg(F.sum("share").alias("all"))
    rows = schedule.join(total, "step").withColumn(
        "y", F.when(F.col("all") > 0, F.col("share") / F.col("all")).otherwise(0.0))
    along = Window.partitionBy("source").orderBy("step")
    area = (F.col("y") + F.lag("y").over(along)) / 2
    rows = rows.withColumn("area", F.coalesce(area, F.lit(0.0))).withColumn(
        "sum", F.sum("area").over(along))
    whole = F.sum("area").over(Window.partitionBy("source"))
    part = F.when(whole > 0, F.col("sum") / whole).otherwise(F.col("step") / F.lit(float(STEPS)))
    return rows.withColumn("part", part).join(
        sources.select(F.col("source").alias("_s"), "target"),
        F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "step", (F.col("part") * F.col("target")).alias("demand"))


def curriculum(docs: DataFrame, weights, total_share: float = 1.5, most: float = 2.0,
               schedule=None, id_col: str = "doc_id", source_col: str = "source",
               text_col: str = "text", by_pass: bool = False, hash_col: str = None) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, position.

    ``by_pass`` gives a row for every pass over a document instead, with ``pass`` (from 0), the
    words it takes and its own position. ``hash_col`` gives the hash order (default: the id).

    ``weights`` maps the frame (source, place, source_size) to one with ``weight``; ``schedule``
    maps a column of the time 0..1 and the weight to the weight at that time (default: constant).
    ``taken`` counts words with repeats: full passes of a source, then one more pass over its rows
    in hash order that ends, mid-document, at the rounded target. No row passes ``most`` times its
    size. ``position`` (0 to 1) is when the row's first words are due, null where none are taken.

    A null source is a source, sorted last; a null text has size 0 and takes nothing. Repeated
    rows are rows of their own in a fixed order; empty input gives an empty result.
    """
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               word_count(F.col(text_col)).alias("size"),
                               F.md5(F.col(hash_col or id_col).cast("string")).alias("mark")))
    sources = stored(weights(source_sizes(sized)))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = stored(water_fill(sources, total_share * total, most))
    curve = schedule or (lambda time, weight: weight)
    steps = sources.select("source", "weight", F.explode(F.sequence(F.lit(0), F.lit(STEPS)))
                           .alias("step"))
    steps = steps.select("source", "step", curve(F.col("step") / F.lit(float(STEPS)),
                                                 F.col("weight")).cast("double").alias("share"))
    due = (_demand(sources, steps).groupBy("source")
           .agg(F.sort_array(F.collect_list(F.struct("step", "demand")))["demand"].alias("due")))
    # One row a source, stored so that the plan over the documents is not planned with its own.
    plan = stored(sources.join(due.withColumnRenamed("source", "_s"),
                               F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
                  .withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
                  .withColumn("words", F.round("target").cast("long")).select(
                      "key", "source_size", "target", "words", "due"))
    keyed = sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
    placed = spread_rank(keyed, ["key"], ["mark", "id", "size"], F.substring("mark", 1, 4),
                         "before", weight=F.col("size"))
    rows = spread_join(placed, plan, ["key"], F.col("mark"))
    passes = F.when(F.col("source_size") > 0,
                    F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("words") - passes * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    rows = rows.withColumn("taken", (passes * F.col("size") + last).cast("long"))
    if by_pass:
        every = F.when(F.col("taken") > 0, F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col(
            "size")).cast("int") - 1))
        rows = rows.withColumn("pass", F.explode(every)).withColumn(
            "taken", F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size")))
        rows = rows.withColumn("before", F.col("before") + F.col("pass") * F.col("source_size"))
    # The step of the due curve first, once a row: the words due by it are at most those before.
    due = F.col("due")
    rows = rows.withColumn("step", F.greatest(F.lit(1), F.aggregate(
        due, F.lit(0), lambda n, d: n + (d <= F.col("before").cast("double")).cast("int"))))
    rows = rows.select(*[c for c in rows.columns if c != "due"], F.element_at(due, F.col("step"))
                       .alias("low"), F.get(due, F.col("step")).alias("high"))
    inside = F.when(F.col("high") > F.col("low"), (F.col("before") - F.col("low")) / (
        F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    at = F.least(F.lit(1.0), (F.col("step") - 1 + inside) / F.lit(float(STEPS)))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, at))
    return rows.select("id", "source", "size", "source_size", "target", "taken", "position",
                       *(["pass"] if by_pass else []))


def in_order(rows: DataFrame) -> DataFrame:
    """Range-sorted by training position; ties by id."""
    return rows.repartitionByRange("position", "id").sortWithinPartitions("position", "id")


def ramp(time, weight):
    """All sources alike at the start, each at its weight in the end."""
    return 1 + (weight - 1) * time


def cycle(values):
    """Weights that repeat along the sources' places."""
    def add(sources: DataFrame) -> DataFrame:
        pick = F.array(*[F.lit(float(v)) for v in values])
        return sources.withColumn("weight", F.get(pick, (F.col("place") % len(values)).cast("int")))
    return add
