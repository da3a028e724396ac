"""Joins and running sums that hold when one key, or one slice of an order, has most of the rows.

Nothing here knows which keys are hot beforehand: salts and grids follow from counts, so a table
without hot keys is not multiplied and one with them spreads. All dealing is by hash of columns, so
a task that runs again deals alike.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.session import cut_lineage

SALTS = 64
BLOCK = 2000


def _dealt(by: list, ways):
    return F.pmod(F.xxhash64(*by), ways).cast("int")


def spread_join(left: DataFrame, right: DataFrame, key: list, by: list, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join to a frame with one row per key; a key's left rows are dealt over ``salts`` by ``by``.

    The right row is copied only to the (key, salt) cells that occur. ``how`` is inner or left.
    """
    salted = left.withColumn("_salt", _dealt(by, F.lit(salts)))
    cells = salted.select(*key, "_salt").distinct().join(right, key)
    return salted.join(cells, [*key, "_salt"], how).drop("_salt")


def grid_join(left: DataFrame, right: DataFrame, key: str, left_by: list, right_by: list,
              block: int = BLOCK) -> DataFrame:
    """Inner join on a key that may be hot on both sides; every pair of rows meets exactly once.

    The rows of a key lie in a grid of cells of about ``block`` rows a side: a left row goes to one
    line of the grid and all its columns, a right row to one column and all its lines. So a task
    makes at most some ``block`` squared pairs of one cell, and rows are copied once a ``block`` of
    the other side. A key with fewer rows has one cell and its rows are not copied. A hot key that
    the other side lacks leaves before the join, where its rows would all lie in one cell.
    """
    sizes = (left.groupBy(key).agg(F.count(F.lit(1)).alias("_nl"))
             .join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_nr")), key, "full"))
    none = F.lit(0)
    hot = sizes.select(key, F.ceil(F.coalesce("_nl", none) / block).cast("int").alias("_lines"),
                       F.ceil(F.coalesce("_nr", none) / block).cast("int").alias("_columns")
                       ).filter("_lines > 1 OR _columns > 1")
    one = F.lit(1)
    # Only keys above the block are in ``hot``: at most one for every ``block`` rows.
    left = spread_join(left, hot, [key], left_by, "left").filter(
        F.coalesce("_columns", one) > 0).select(
        *left.columns, _dealt(left_by, F.coalesce("_lines", one)).alias("_line"),
        F.explode(F.sequence(F.lit(0), F.coalesce("_columns", one) - 1)).alias("_column"))
    right = spread_join(right, hot, [key], right_by, "left").filter(
        F.coalesce("_lines", one) > 0).select(
        *right.columns, _dealt(right_by, F.coalesce("_columns", one)).alias("_column"),
        F.explode(F.sequence(F.lit(0), F.coalesce("_lines", one) - 1)).alias("_line"))
    return left.join(right, [key, "_line", "_column"]).drop("_line", "_column")


def running_sum(df: DataFrame, order: list, weight, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows up to this one in a total order.

    A range sort gives each task a slice; a row's sum is what lies in earlier slices, one row a
    slice, plus the running sum inside its own. No task sees all rows. Slices are stored first: a
    second range sort could cut elsewhere.
    """
    ranged = cut_lineage(df.withColumn("_weight", weight).sort(*order)
                         .withColumn("_slice", F.spark_partition_id()))
    total = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = (ranged.groupBy("_slice").agg(F.sum("_weight").alias("_sum"))
              .select("_slice", F.coalesce(F.sum("_sum").over(total), F.lit(0)).alias("_before")))
    inside = W.partitionBy("_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (ranged.withColumn("_inside", F.sum("_weight").over(inside)).join(before, "_slice")
            .withColumn(out, F.col("_before") + F.col("_inside"))
            .drop("_slice", "_weight", "_before", "_inside"))
