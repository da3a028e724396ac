"""Plans stay short: the driver holds, prints and plans each anew after every shuffle of it."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from siftline.llm import common, exact, mixing, near


@pytest.fixture
def sizes(monkeypatch):
    """Operators of each stored frame's plan, in the order they are written."""
    found, write = [], common.stored

    def noted(df, *by):
        found.append(plan_size(df))
        return write(df, *by)

    for module in (common, exact, mixing, near):
        monkeypatch.setattr(module, "stored", noted)
    return found


def plan_size(df) -> int:
    return len(df._jdf.queryExecution().optimizedPlan().treeString().strip().split("\n"))


def test_plans_of_the_pipeline_steps_are_short(docs, sizes):
    outs = [near.near_duplicates(docs),
            exact.exact_duplicates(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")),
            mixing.curriculum(docs, mixing.cycle((3, 1, 2)), schedule=mixing.ramp, by_pass=True)]
    assert max(sizes + [plan_size(x) for x in outs]) <= 60


def test_stars_take_one_round(spark, monkeypatch):
    rounds, join = [], common.spread_join
    monkeypatch.setattr(common, "spread_join", lambda *a: rounds.append(1) or join(*a))
    stars = spark.createDataFrame([(1, k) for k in range(2, 9)] + [(10, 11)], "a long, b long")
    got = {tuple(r) for r in common.components(stars).collect()}
    assert got == {(k, 1) for k in range(1, 9)} | {(10, 10), (11, 10)}
    assert len(rounds) == 1


def test_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(139, 50), (7, 7)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(21)} | {k: 50 for k in [50, *range(100, 140)]}


def test_rows_outside_the_largest_class_meet_all(spark, monkeypatch):
    monkeypatch.setattr(near, "CELL", 4)
    rows = [(key, node, 5, label, bytearray(b"x")) for key, classes in
            {1: [9] * 11 + [8] * 6 + [7], 2: [5, 5], 3: [4, 6], 4: [3] * 9 + [2]}.items()
            for node, label in enumerate(classes, 100 * key)]
    rows = spark.createDataFrame(rows, "key long, node long, n long, label long, packed binary")
    cells = near._later_cells(rows, near._wide(rows)).select("cell", "node")
    held = {}
    for r in cells.collect():
        held.setdefault(r.cell, []).append(r.node)
    assert all(len(x) == len(set(x)) for x in held.values())
    met = {p for x in held.values() for p in product(x, x)}
    label = {r.node: (r.key, r.label) for r in rows.collect()}
    for a, b in product(label, label):
        if label[a][0] == label[b][0] and label[a] != label[b]:
            assert (a, b) in met
    assert not any(label[x][0] == 2 for x in label if (x, x) in met)
    assert cells.filter(F.col("cell").isNull()).count() == 0
