"""The registered mix follows a curriculum: weights move, totals stay, rows come by position."""

from pyspark.sql import functions as F

from siftline.llm import mixing
from siftline.llm.queries import op4

SMALL = "/root/testdata/sf0.001"


def test_weights_move_along_the_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    flat = {r.id: r for r in mixing.curriculum(docs, mixing.cycle((3, 1, 2))).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    names = sorted({s for s in source.values() if s is not None})
    shift = {s: [] for s in names}
    for r in op4(spark, SMALL).collect():
        assert (r.taken, r.target) == (flat[r.doc_id].taken, flat[r.doc_id].target)
        if r.taken and source[r.doc_id] in shift:
            shift[source[r.doc_id]].append(r.position - flat[r.doc_id].position)
    # Sources of the most weight come later than under constant weights, those of the least earlier.
    for i, s in enumerate(names):
        if i % 3 < 2:
            assert (sum(shift[s]) > 0) == (i % 3 == 0) and abs(sum(shift[s])) > 0.01 * len(shift[s])


def test_rows_come_by_position(spark):
    rows = op4(spark, SMALL).withColumn("at", F.monotonically_increasing_id()).collect()
    order = [(r.position is not None, r.position or 0.0, r.doc_id)
             for r in sorted(rows, key=lambda r: r["at"])]
    assert order == sorted(order)
