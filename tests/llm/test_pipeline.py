"""The pipeline, stage by stage and whole, against brute force."""

import re
from collections import Counter, defaultdict

from conftest import words
from test_documents import sets_of

import corpus_pipeline
from siftline.llm import exact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark, docs, tmp_path):
    table = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select(COLUMNS)
    sf = str(tmp_path)
    table.write.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "exact_dedup", "minhash_near_dedup", "curriculum_mix",
                           "min_slack_packing"]
    read = lambda: spark.read.parquet(f"{sf}/documents.parquet")

    def kept(name, before):
        out = stage[name](spark, before, sf)
        assert out.columns == COLUMNS
        out.write.parquet(f"{sf}/{name}")
        return spark.read.parquet(f"{sf}/{name}")

    first = kept("language_id", read())
    gone = {r.doc_id for r in read().collect()} - {r.doc_id for r in first.collect()}
    assert all(len((r.text or "").split()) < 20 for r in read().collect() if r.doc_id in gone)
    assert all(r.doc_id in gone for r in read().collect() if not (r.text or "").strip())

    second = kept("exact_dedup", first)
    groups = defaultdict(list)
    for r in first.collect():
        groups[exact.reference_digest(r.text)].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in second.collect()} == {min(g)[1] for g in groups.values()}

    third = kept("minhash_near_dedup", second)
    rows = [(r.doc_id, sets_of(r.text)) for r in second.collect()]
    label = {d: d for d, _ in rows}
    for _ in rows:
        for d, a in rows:
            for e, b in rows:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[d] = label[e] = min(label[d], label[e])
    assert {r.doc_id for r in third.collect()} == {d for d, c in label.items() if d == c}

    fourth = kept("curriculum_mix", third)
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in third.collect()}
    source = {r.doc_id: r.source for r in third.collect()}
    taken, whole = Counter(), Counter()
    for r in fourth.collect():
        taken[r.source] += size[r.doc_id]
    for d, n in size.items():
        whole[source[d]] += n
    names = sorted(whole, key=lambda s: (s is None, s or ""))
    assert max(Counter(r.doc_id for r in fourth.collect()).values()) <= 2
    assert all(taken[s] <= 2 * whole[s] for s in names)
    assert abs(sum(taken.values()) - 1.5 * sum(whole.values())) <= sum(
        max(size[d] for d in size if source[d] == s) for s in names)

    packed = stage["min_slack_packing"](spark, fourth, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(
        r.doc_id for r in fourth.collect())
    whole_run = corpus_pipeline.run(spark, sf).collect()
    pick = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(pick, whole_run)) == Counter(map(pick, packed))


def test_copies_go_by_row_where_ids_repeat_or_are_null(spark, docs, tmp_path):
    """Of each class of texts one row stays, and no class is lost."""
    base = [words(300 + i, 80) for i in range(5)]
    near = [b + " tail" for b in base]
    odd = [(5, base[0]), (3, base[1]), (5, base[1] + "\n"), (None, base[2]), (None, base[2]),
           (7, base[3]), (7, base[3]), (None, base[4]), (8, base[4]),
           (2, near[0]), (9, near[3]), (None, near[2]), (5, words(400, 80))]
    extra = spark.createDataFrame([(i, t, "aa", "s1", len(t)) for i, t in odd],
                                  docs.select(COLUMNS).schema)
    docs.select(COLUMNS).union(extra).write.parquet(f"{tmp_path}/documents")
    before, stage = spark.read.parquet(f"{tmp_path}/documents"), dict(corpus_pipeline.STAGES)
    second = stage["exact_dedup"](spark, before, "").collect()
    digests = Counter(exact.reference_digest(r.text) for r in second)
    assert digests == Counter({exact.reference_digest(r.text) for r in before.collect()})
    stage["exact_dedup"](spark, before, "").write.parquet(f"{tmp_path}/second")
    rows = [sets_of(r.text) for r in second]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    classes = {r.text: c for r, c in zip(second, label, strict=True)}
    third = stage["minhash_near_dedup"](spark, spark.read.parquet(f"{tmp_path}/second"), "")
    assert Counter(classes[r.text] for r in third.collect()) == Counter(set(label))
    third.write.parquet(f"{tmp_path}/third")
    mixed = stage["curriculum_mix"](spark, spark.read.parquet(f"{tmp_path}/third"), "")
    assert mixed.columns == COLUMNS
    assert max(Counter((r.doc_id, r.text) for r in mixed.collect()).values()) <= 2


def test_no_documents(spark, no_docs, tmp_path):
    no_docs.select(COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
