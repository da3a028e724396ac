"""Documents to packed training sequences, one corpus operator a stage.

Each stage reads what the one before has kept and returns the columns of documents; the last one
returns the packed pieces. Stages are written as Parquet and read again.
"""

import functools
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import exact, language, mixing, near, packing
from siftline.llm.common import delete_folders, noting, shared_dir, stored, table
from siftline.llm.queries import part_of


# Folders that earlier stages have stored, each with a mark of the session they belong to.
_left: list[tuple[str, str]] = []


def _stage(fn):
    """A stage deletes what earlier ones have stored: their output lies in Parquet of its own by then.

    Folders that its own input still reads, as when stages are chained without being written, stay.
    """
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session = spark.sparkContext.applicationId
        read = {os.path.basename(os.path.dirname(name)) for name in docs.inputFiles()}
        gone = [x for x in _left if x[0] != session or os.path.basename(x[1]) not in read]
        delete_folders(spark, [path for owner, path in gone if owner == session])
        _left[:] = [x for x in _left if x not in gone]
        with noting() as folders:
            out = fn(spark, docs, sf_dir)
        _left.extend((session, path) for path in folders)
        return out
    return run_stage


@_stage
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are too far from every language, or without a letter."""
    model = language.fit(docs.select("text", "lang"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").alias("body"))
    found = language.predict(rows, model, text="body", keep=("doc",))
    return found.filter("not rejected").select("doc.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a stored key ``_row`` of their own: in the order of ids, null ids last."""
    order = [F.col("doc_id").isNull(), "doc_id", "_row"]
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_row", F.monotonically_increasing_id()))


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    gone = decided.filter("not kept").select(F.col("id").alias("_gone"))
    return docs.join(gone, F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group stays, whatever ids repeat or are null."""
    docs, known = _keyed(docs), F.coalesce(part_of(2) == 0, F.lit(True))
    return _without(docs, exact.exact_duplicates(docs.filter(~known), docs.filter(known), "_row"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each class stays, whatever ids repeat or are null."""
    docs = _keyed(docs)
    return _without(docs, near.near_duplicates(docs, "_row"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document by its passes and sort by training position.

    The last pass of a source ends within a document; that one goes in whole if at least half of
    its words are due.
    """
    docs = _keyed(docs)
    passes = mixing.curriculum(docs, mixing.cycle((3, 1, 2)), schedule=mixing.ramp, id_col="_row",
                               hash_col="doc_id", by_pass=True)
    due = (passes.filter("2 * taken >= size").dropDuplicates(["id", "pass"])
           .select(F.col("id").alias("_id"), F.col("position").alias("_position")))
    mixed = docs.join(due, F.col("_row") == F.col("_id")).drop("_id", "_row")
    return (mixed.repartitionByRange("_position", "doc_id")
            .sortWithinPartitions("_position", "doc_id").drop("_position"))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenized(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("curriculum_mix", mix_sources),
    ("min_slack_packing", pack_sequences),
]

# Trained centroids and a tokenizer's ids have no SQL form; tests hold the rows of run() against
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folders(spark, [before])
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
