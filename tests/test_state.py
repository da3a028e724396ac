"""State of streams: compaction, crashes between its steps, earliest arrivals; big stores."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from siftline.sources.stores import ALERT_ENTRY, SEEN_ENTRY, read_big_store, read_store
from siftline.streaming import jobs
from siftline.streaming.deltas import (commit_base, compact, manifest, read_deltas, sweep,
                                       write_base, write_delta)


def _sightings(spark, batch):
    r = random.Random(batch)
    rows = [(f"k{r.randint(0, 9)}", f"2024-01-{r.randint(10, 28)}", f"2024-02-{r.randint(10, 28)}",
             100 * batch + i, f"n{batch}", "T", "t", "c") for i in range(20)]
    return spark.createDataFrame(rows, "key string, first_alerted string, seen_on string, seq int, "
                                       "alert_name string, track string, title string, company string")


def _store(spark, path):
    return sorted(tuple(x) for x in jobs.merge_alert_partials(read_deltas(spark, path)).collect())


def _write(spark, path, batch):
    write_delta(jobs.alert_partials(_sightings(spark, batch)), batch, path)


def test_compaction_keeps_the_state_at_every_step(spark, tmp_path):
    path, plain = f"{tmp_path}/state", f"{tmp_path}/plain"
    for batch in range(6):
        for p in (path, plain):
            _write(spark, p, batch)
        if batch in (2, 4):
            before = _store(spark, path)
            # A crash after the base is written, before it counts.
            lost = write_base(spark, path, batch, jobs.fold_alert_partials)
            assert _store(spark, path) == before
            # A crash after it counts, before the sweep.
            name = write_base(spark, path, batch, jobs.fold_alert_partials)
            commit_base(spark, path, name, batch)
            assert _store(spark, path) == before and manifest(spark, path)[1:] == (name, batch)
            sweep(spark, path)
            assert _store(spark, path) == before
            assert not (tmp_path / "state" / lost).exists()
            # The batch comes again after its compaction.
            _write(spark, path, batch)
            assert _store(spark, path) == before
    assert _store(spark, path) == _store(spark, plain)
    assert read_deltas(spark, path).count() <= 10 + 10
    compact(spark, path, 5, jobs.fold_alert_partials)
    compact(spark, path, 5, jobs.fold_alert_partials)
    assert read_deltas(spark, path).count() == len(_store(spark, plain)) <= 10
    assert _store(spark, path) == _store(spark, plain)


def test_a_stream_compacts_between_batches(spark, tmp_path):
    source = tmp_path / "in"
    for batch in range(5):
        _sightings(spark, batch).coalesce(1).write.mode("append").json(str(source))
    stream = (spark.readStream.schema(_sightings(spark, 0).schema)
              .option("maxFilesPerTrigger", 1).json(str(source)))
    path = f"{tmp_path}/state"
    jobs.alert_intake(stream, path, f"{tmp_path}/check", every=2).awaitTermination()
    assert manifest(spark, path)[0] == 2 and manifest(spark, path)[2] == 3
    everything = spark.read.schema(_sightings(spark, 0).schema).json(str(source))
    assert _store(spark, path) == sorted(tuple(x) for x in jobs.merge_alert_partials(
        jobs.alert_partials(everything)).collect())


def test_the_earliest_posting_stays(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1, 12)

    def row(key, hours, name):
        return f"https://x.example/{key}?n={name}", "c", name, t0 + datetime.timedelta(hours=hours)

    batches = [[row("a", 5, "late"), row("a", 6, "copy"), row("b", 0, "b1"), row("b", 30, "b2")],
               [row("a", 2, "early"), row("b", 31, "b3"), row("c", 40, "c1")],
               [row("d", 500, "end")]]
    source, schema = tmp_path / "in", "url string, company string, title string, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{k}")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(source)))
    out = jobs.earliest_postings(stream)
    (out.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True)
     .format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination())
    got = sorted(x.title for x in spark.read.parquet(f"{tmp_path}/out").collect())
    # The last one is still held: an earlier one could come.
    assert got == ["b1", "b2", "c1", "early"]


@pytest.mark.parametrize("under", [None, "seen"])
def test_a_big_store_is_read_by_lines(spark, tmp_path, under):
    r = random.Random(4)
    entries = {f'key "{i}", é\\{{': {"status": "ranked", "rank_score": r.random(), "url": "u\n}{",
                                     "first_alerted": None if i % 5 else "2024-01-01"}
               for i in range(3000)}
    entries["odd"] = "no object"
    entries["empty"] = {}
    content = {"version": {"a": 1}, "seen": entries, "last": {"x": {"status": "not seen"}}} if under else entries
    path = tmp_path / "store.json"
    path.write_text(json.dumps(content, indent=2, ensure_ascii=False), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64 * 1024)
    try:
        schema = SEEN_ENTRY if under else ALERT_ENTRY
        got = read_big_store(spark, str(path), schema, under)
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 1
        want = read_store(spark, str(path), schema, under)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert got.count() == len(entries)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
