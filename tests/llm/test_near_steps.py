"""Near-duplicate classes in few steps: every stored frame costs a task and a file a partition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import common, near


def test_classes_take_few_stored_frames(docs, monkeypatch):
    frames, write = [], common.stored
    for module in (common, near):
        monkeypatch.setattr(module, "stored", lambda df, *by: frames.append(1) or write(df, *by))
    assert near.near_duplicates(docs).count() == docs.count()
    assert len(frames) <= 14


def test_stars_take_no_round(spark, monkeypatch):
    monkeypatch.setattr(common, "_round", lambda *a: pytest.fail("a round on stars"))
    edges = spark.createDataFrame([(1, k) for k in range(2, 9)] + [(11, 10), (5, 5)], "a long, b long")
    got = {tuple(r) for r in common.stars(edges).collect()}
    assert got == {(k, 1) for k in range(2, 9)} | {(11, 10)}


def test_paths_settle_in_few_rounds(spark, monkeypatch):
    rounds, plain = [], common._round
    monkeypatch.setattr(common, "_round", lambda *a: rounds.append(1) or plain(*a))
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {tuple(r) for r in common.stars(edges).collect()} == {(k, 0) for k in range(1, 41)}
    assert len(rounds) <= 4


@pytest.mark.parametrize("marks", [6, 24])
def test_full_sets_need_no_shuffle_of_texts(spark, docs, monkeypatch, marks):
    """With a full filter, or with repeated and null ids, only the wanted nodes are left."""
    monkeypatch.setattr(near, "MARKS", marks)
    every = near.sketch(docs, "doc_id", "text").filter("n > 0")
    wanted = every.filter("id is null or id % 3 = 0").select("node", "id")
    sets = near._full_sets(docs, "doc_id", "text", wanted.union(wanted))
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[plan.index("MapInArrow"):].split("Aggregate")[0]
    got = {r.node: len(np.unique(r.grams)) for r in sets.collect()}
    want = {r.node: r.n for r in every.join(wanted.select("node"), "node", "left_semi").collect()}
    assert got == want and len(sets.filter(F.size("grams") != F.col("n")).collect()) == 0
