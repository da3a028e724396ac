"""Incremental state as mergeable partial aggregates, compacted between batches.

Each micro-batch writes its own partials to ``deltas/batch_id=N`` and overwrites that folder on
replay, so a retried batch is harmless and no batch rewrites the whole store. From time to time the
partials so far are folded, one row a key, into a new base. Which base counts, and up to which batch
it reaches, stands in a manifest: each compaction writes its base in full and then commits one more
manifest row. Readers take the latest row, its base and the deltas after it. A crash before the
commit leaves a base that nobody reads, a crash after it leaves deltas that nobody reads; the next
compaction sweeps both away.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import delete_folder, folders, path_exists


def write_delta(partials: DataFrame, batch_id: int, path: str) -> None:
    partials.write.mode("overwrite").parquet(f"{path}/deltas/batch_id={batch_id}")


def manifest(spark: SparkSession, path: str) -> tuple[int, str, int]:
    """(version, base folder, last batch in it); (0, "", -1) before the first compaction."""
    if not path_exists(spark, f"{path}/manifest"):
        return 0, "", -1
    rows = spark.read.schema("version long, base string, upto long").json(f"{path}/manifest")
    last = rows.orderBy(F.desc("version")).limit(1).collect()
    return tuple(last[0]) if last else (0, "", -1)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """The base and all partials after it; one row a key and later batch."""
    _, base, upto = manifest(spark, path)
    late = (spark.read.option("basePath", f"{path}/deltas").parquet(f"{path}/deltas")
            .filter(F.col("batch_id") > upto).drop("batch_id"))
    return spark.read.parquet(f"{path}/{base}").unionByName(late) if base else late


def write_base(spark: SparkSession, path: str, upto: int,
               merge: Callable[[DataFrame], DataFrame]) -> str:
    """Fold base and deltas up to a batch into a new base folder that nobody reads yet."""
    _, base, before = manifest(spark, path)
    part = (spark.read.option("basePath", f"{path}/deltas").parquet(f"{path}/deltas")
            .filter(F.col("batch_id").between(before + 1, upto)).drop("batch_id"))
    if base:
        part = spark.read.parquet(f"{path}/{base}").unionByName(part)
    name = f"bases/{uuid.uuid4().hex}"
    merge(part).write.parquet(f"{path}/{name}")
    return name


def commit_base(spark: SparkSession, path: str, name: str, upto: int) -> None:
    """Make a base count. One row in one file, which the committer renames into place at once."""
    version = manifest(spark, path)[0] + 1
    spark.createDataFrame([(version, name, upto)], "version long, base string, upto long").coalesce(
        1).write.mode("append").json(f"{path}/manifest")


def sweep(spark: SparkSession, path: str) -> None:
    """Delete bases that do not count and deltas that the base holds; the newest of them stays, so
    that the folder keeps its schema."""
    _, base, upto = manifest(spark, path)
    for folder in folders(spark, f"{path}/bases"):
        if f"bases/{folder}" != base:
            delete_folder(spark, f"{path}/bases/{folder}")
    for folder in folders(spark, f"{path}/deltas"):
        if folder.startswith("batch_id=") and int(folder.split("=")[1]) < upto:
            delete_folder(spark, f"{path}/deltas/{folder}")


def compact(spark: SparkSession, path: str, upto: int,
            merge: Callable[[DataFrame], DataFrame]) -> None:
    """Fold all partials up to a batch; ``merge`` takes partials to partials, one row a key.

    One compaction at a time: the stream's own batches call it, readers may go on beside it until
    the sweep, which spares what the last manifest names.
    """
    if upto > manifest(spark, path)[2]:
        commit_base(spark, path, write_base(spark, path, upto, merge), upto)
        sweep(spark, path)
