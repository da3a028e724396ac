"""Operators on documents against brute force: odd rows, copies, ties, extra columns, no rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import exact, mixing, near, packing, repeats, sharding


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_exact_duplicates(docs, no_docs):
    got = collected(exact.exact_duplicates(docs.filter("doc_id % 2 = 0 or doc_id is null"),
                                           docs.filter("doc_id % 2 = 1")))
    groups = defaultdict(list)
    for r in docs.collect():
        groups[exact.reference_digest(r.text)].append((-len(r.text or ""), r.doc_id is None,
                                                       r.doc_id or 0, r.doc_id))
    want = Counter()
    for sha, members in groups.items():
        keep = min(members)[3]
        for m in members:
            want[(m[3], keep, len(members), m[3] == keep, sha)] += 1
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
                   for r in got) == want
    assert exact.exact_duplicates(no_docs, no_docs).count() == 0
    assert exact.exact_duplicates(docs, no_docs).count() == docs.count()


def test_large_batch_meets_small_snapshot_in_many_buckets(docs, no_docs, monkeypatch):
    most, plain = [], exact.screen
    monkeypatch.setattr(exact, "screen", lambda incoming, filters: (
        most.append(incoming.groupBy("bucket").count().agg({"count": "max"}).first()[0]),
        plain(incoming, filters))[1])
    for snapshot in (no_docs, docs.filter("doc_id = 9")):
        got = exact.exact_duplicates(docs, snapshot, digests=4).count()
        assert got == docs.count() + snapshot.count()
    assert max(most) <= 12


@given(st.sets(st.integers(0, 2**63 - 1), max_size=3000))
@settings(max_examples=25, deadline=None)
def test_fuse_filter_knows_all_its_keys(keys):
    keys = np.array(sorted(keys), np.uint64)
    f = exact.fuse_build(keys)
    assert exact.fuse_has(f, keys).all()
    assert exact.fuse_has(f, keys + np.uint64(1 << 63)).mean() < 0.05 if len(keys) > 500 else True


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs, no_docs):
    table = [(r.doc_id, sets_of(r.text)) for r in docs.collect()]
    label = list(range(len(table)))
    for _ in table:
        for i, (_, a) in enumerate(table):
            for j, (_, b) in enumerate(table):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (d, _), c in zip(table, label, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    want = Counter((d, len(s), least.get(c) if s else d) for (d, s), c in
                   zip(table, label, strict=True))
    got = collected(near.near_duplicates(docs))
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)
    assert near.near_duplicates(no_docs).count() == 0


def test_agreement_estimates_similarity():
    grams = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = grams[:3000], grams[600:3600]
    x, y = near._pack(near._minima(a)), near._pack(near._minima(b))
    assert abs(near.agreement(x, y) - 2400 / 3600) < 0.16
    assert near.agreement(x, x) == 1


def test_forest_spans_all_likely_pairs():
    score = np.full((30, 30), -1.0, np.float32)
    for i in range(29):
        score[i, i + 1] = score[i + 1, i] = 0.8
    assert len(near._forest(score)) == 29


def test_repeats(docs, no_docs):
    for length, seed in ((200, 32), (40, 16)):
        got = collected(repeats.remove_repeats(docs, length, seed, with_text=True))
        texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
        seen = Counter(b[i:i + length] for _, b in texts for i in range(len(b) - length + 1))
        want = Counter()
        for d, b in texts:
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - length + 1):
                if seen[b[i:i + length]] > 1:
                    gone[i:i + length] = True
            left = np.frombuffer(b, np.uint8)[~gone].tobytes()
            spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
            want[(d, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left)] += 1
        assert Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"],
                        bytes(r["kept"])) for r in got) == want
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_of_very_many_kinds(docs, monkeypatch):
    plain = sorted(map(tuple, repeats.remove_repeats(docs).collect()), key=str)
    monkeypatch.setattr(repeats, "WIDE", 1)
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect()), key=str) == plain


def test_shards(docs, no_docs):
    for shards in (24, 3):
        got = collected(sharding.shard(docs, shards))
        assert len(got) == docs.count()
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        sizes = [len(by[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        texts = {(r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8)
                 for r in docs.collect()}
        assert {(r["id"], r["text_crc32"], r["size"]) for r in got} == texts
    homes = defaultdict(set)
    for r in got:
        if r["group_size"] > 1:
            homes[r["text_crc32"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard(no_docs).count() == 0


def test_hot_group_fills_whole_shards(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(240)],
                               "doc_id long, text string")
    got = collected(sharding.shard(df, 8))
    held = Counter(r["shard"] for r in got if r["group_size"] > 1)
    assert Counter(r["shard"] for r in got) == {s: 30 for s in range(8)}
    assert sum(n == 30 for n in held.values()) == 5 and len(held) == 6


def test_copies_meet_where_no_row_is_unlinked(spark):
    """Each text twice, and in groups of five: without room, shards exchange documents."""
    for copies, shards, cut in ((2, 4, 0.1), (5, 6, 0.35)):
        df = spark.createDataFrame([(i, f"text {i // copies}") for i in range(600)],
                                   "doc_id long, text string")
        got = collected(sharding.shard(df, shards))
        assert Counter(r["shard"] for r in got) == {s: 600 // shards for s in range(shards)}
        homes = defaultdict(set)
        for r in got:
            homes[r["text_crc32"]].add(r["shard"])
        assert sum(len(h) > 1 for h in homes.values()) <= cut * len(homes)


def test_mixing(docs, no_docs):
    got = collected(mixing.curriculum(docs, mixing.cycle((3, 1, 2))))
    assert len(got) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["id"], r["size"]) for r in got) == Counter(
        (r.doc_id, size(r.text)) for r in docs.collect())
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, total, target = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: weight[s] * level for s in left}
        left = left - over if over else set()
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.curriculum(no_docs, mixing.cycle((3, 1, 2))).count() == 0


def test_schedule_moves_positions(spark):
    df = spark.createDataFrame([(i, "w " * 10, "early" if i % 2 else "late") for i in range(400)],
                               "doc_id long, text string, source string")
    import pyspark.sql.functions as F

    def rising(time, weight):
        return F.when(weight == 1, 2 * (1 - time)).otherwise(2 * time)

    def weights(s):
        return s.withColumn("weight", F.when(F.col("source") == "early", 1.0).otherwise(1.0000001))

    got = collected(mixing.curriculum(df, weights, 1.0, 1.0, rising))
    place = {s: np.mean([r["position"] for r in got if r["source"] == s]) for s in ("early", "late")}
    assert abs(place["early"] - 1 / 3) < 0.05 and abs(place["late"] - 2 / 3) < 0.05
    again = collected(mixing.curriculum(df, weights, 1.0, 1.0, rising))
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_packing(docs, no_docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = collected(packing.pack(packing.tokenized(docs, with_ids=True)))
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        cut = len(ids) % 1024 or min(len(ids), 1024)
        at, piece = 0, 0
        while at < len(ids):
            end = cut if not piece else at + 1024
            want[(r.doc_id, piece, at, tuple(ids[at:end]))] += 1
            at, piece = end, piece + 1
    assert Counter((r["id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.tokenized(no_docs)).count() == 0


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_tokenizer(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    cache = test_ids_are_those_of_the_tokenizer.__dict__
    if "pair" not in cache:
        cache["pair"] = (Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.Encoder(
            P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    tok, own = cache["pair"]
    assert list(own.ids(text)) == tok.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_bins_hold_all_items_and_fill_fullest_first(lengths):
    plan = packing.plan_bins(Counter(lengths), 40)
    packed = Counter()
    for times, chosen in plan:
        assert sum(chosen) <= 40
        for k in chosen:
            packed[k] += times
    assert packed == Counter(lengths)
    sums = {0}
    rest = sorted(lengths)[:-1]
    for k in rest:
        sums |= {s + k for s in sums if s + k + max(lengths) <= 40}
    assert sum(plan[0][1]) == max(lengths) + max(sums)


def test_links_between_classes_of_a_cell():
    grams = [np.arange(k, k + 40, dtype=np.int64) for k in range(0, 60, 3)]
    rows = {"grams": np.array([*grams, grams[0]][:-1] + [None], object)[:-1],
            "label": np.arange(20), "node": np.arange(100, 120)}
    found = near._links(rows, 75)
    assert len(found) == 19 and all(b - a == 1 for a, b in found)
    assert near._links(rows | {"label": np.zeros(20, int)}, 75) == []
