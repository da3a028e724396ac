"""Session helpers: lineage cuts, folders of any file system, the spread of small inputs."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a scratch folder only on a local master."""
    context = spark.sparkContext
    known = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not known:
        known = tempfile.mkdtemp(prefix="spark-siftline-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to reliable storage and go on from there; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _located(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _located(spark, path)
    return files.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    files, place = _located(spark, path)
    if not files.exists(place):
        return []
    return [x.getPath().getName() for x in files.listStatus(place) if x.isDirectory()]


def delete_folder(spark: SparkSession, path: str) -> None:
    files, place = _located(spark, path)
    files.delete(place, True)


def spread(df: DataFrame, task: int = 4 * 1024 * 1024) -> DataFrame:
    """Rows over tasks of at most some ``task`` bytes of the files, two a core at least.

    A row group is read by one task however many splits its file gets, and text work on it would
    run in that task. So rows are dealt out first: a task's share stays the same when the input
    grows, and its text is moved once, which costs little beside the work on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(2 * cores, -(-size // task)))
