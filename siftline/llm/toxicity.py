"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A text is its counts of all its words (hashed) and, as extra weight, of telling features: words and
word beginnings that labelled toxic texts hold far more often than others. Every sampled example of
either label stands in an index: its frequent features as a dense matrix, the others as postings.
All cosines of a query are computed, so the neighbours are exact. Their votes, weighted by cosine,
give a calibrated score and evidence.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import (IS_LETTER, LOWER, mix, prefix_hash, runs, span_hash, stored,
                                 text_slices)

PREFIXES = (4, 5, 6)
DIMENSIONS = 1 << 18
BOOST = 6.0
DENSE = 512
QUERIES_AT_ONCE = 64
NEIGHBOURS = 15
_KIND = mix(np.arange(4001, 4001 + 16, dtype=np.uint64))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of letters and of its beginnings of 4 to 6 bytes."""
    data = LOWER[data]
    start, end, text = runs(IS_LETTER[data], offsets)
    prefix = prefix_hash(data)
    hashes, owners = [span_hash(prefix, start, end)], [text]
    for k in PREFIXES:
        long = end - start > k
        hashes.append(span_hash(prefix, start[long], start[long] + k) ^ _KIND[k])
        owners.append(text[long])
    return np.concatenate(hashes).view(np.int64), np.concatenate(owners)


def _distinct(batches):
    """Distinct features of each whole text, for the choice of the telling ones."""
    for batch in batches:
        for at, to, data, offsets in text_slices(batch.column("text")):
            hashes, owners = features(data, offsets)
            rows = [np.unique(hashes[owners == i]) for i in range(to - at)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").slice(at, to - at), pa.array(rows, pa.list_(pa.int64()))],
                names=["toxic", "found"])


def telling(examples: DataFrame, support: int = 3, lift: float = 20.0,
            limit: int = 4096) -> np.ndarray:
    """Sorted hashes of the ``limit`` features that speak most for toxic texts.

    A feature needs ``support`` toxic examples and a share among them ``lift`` times that among the
    others, and a log-likelihood ratio that chance alone would not reach among as many features.
    """
    totals = {r[0]: r[1] for r in examples.groupBy("toxic").count().collect()}
    bad, good = max(totals.get(1, 0), 1), max(totals.get(0, 0), 1)
    counts = stored(
        examples.mapInArrow(_distinct, "toxic int, found array<long>")
        .select("toxic", F.explode("found").alias("feature")).groupBy("feature")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .filter(F.col("t") >= support))
    both, rate = F.col("t") + F.col("c"), bad / (bad + good)
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (both * rate)) + F.when(
        F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - rate)))).otherwise(0.0))
    share = (F.col("t") / F.lit(bad)) / ((F.col("c") + 0.5) / F.lit(good))
    least = 2 * float(np.log(max(counts.count(), 1))) + 4
    best = (counts.withColumn("ratio", ratio).filter((share >= lift) & (F.col("ratio") >= least))
            .orderBy(F.desc("ratio"), "feature").limit(limit))
    return np.sort(np.array([r[0] for r in best.select("feature").collect()], np.int64))


def sparse_counts(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> list:
    """(slots, counts) of each whole text: words by hash, then telling features as further slots."""
    data = LOWER[data]
    start, end, text = runs(IS_LETTER[data], offsets)
    prefix = prefix_hash(data)
    word = span_hash(prefix, start, end)
    slots, owners = [(word >> np.uint64(46)).astype(np.int64)], [text]
    kinds = [(word, text)]
    for k in PREFIXES:
        long = end - start > k
        kinds.append((span_hash(prefix, start[long], start[long] + k) ^ _KIND[k], text[long]))
    for hashes, owner in kinds if len(vocabulary) else []:
        hashes = hashes.view(np.int64)
        place = np.searchsorted(vocabulary, hashes).clip(0, len(vocabulary) - 1)
        hit = vocabulary[place] == hashes
        slots.append(DIMENSIONS + place[hit])
        owners.append(owner[hit])
    size = DIMENSIONS + len(vocabulary)
    pair, n = np.unique(np.concatenate(owners) * size + np.concatenate(slots), return_counts=True)
    first = np.searchsorted(pair, np.arange(len(offsets)) * size)
    return [((pair[a:b] % size).astype(np.int32), n[a:b].astype(np.int32))
            for a, b in zip(first[:-1], first[1:], strict=True)]


def counted(docs: DataFrame, vocabulary: np.ndarray, keep: tuple, text: str = "text") -> DataFrame:
    """The columns ``keep``, slots and counts: all words and telling features of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for batch in batches:
            rows = [x for _, _, data, offsets in text_slices(batch.column("_text"))
                    for x in sparse_counts(data, offsets, shared.value)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep),
                 *(pa.array([x[i] for x in rows], pa.list_(pa.int32())) for i in range(2))],
                names=[*keep, "slots", "counts"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(
        run, f"{kinds}, slots array<int>, counts array<int>")


def text_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of texts, and in how many of them each slot occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = DIMENSIONS + len(vocabulary)

    def run(batches):
        held = np.zeros(size + 1, np.int64)
        for batch in batches:
            held[size] += batch.num_rows
            for _, _, data, offsets in text_slices(batch.column("text")):
                for slots, _ in sparse_counts(data, offsets, shared.value):
                    held[slots] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])],
                                         names=["slot", "n"])

    # Proven bound: a row a slot.
    rows = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(
        F.sum("n").alias("n")).toArrow()
    held = np.zeros(size + 1, np.int64)
    held[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return int(held[size]), held[:size]


# ---- the index ------------------------------------------------------------------------------

@dataclass
class ExampleIndex:
    """Weights of all examples by feature.

    ``dense[:, column[f]]`` has those of a frequent feature f; of another one (column -1),
    ``example`` and ``weight`` hold postings from ``at[f]`` to ``at[f + 1]``.
    """

    column: np.ndarray
    dense: np.ndarray
    at: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    label: np.ndarray


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf
    return w / max(np.linalg.norm(w), 1e-12)


def example_order(rows: list) -> list:
    """Like rows stand together: by slots, then counts."""
    return sorted(range(len(rows)), key=lambda i: (
        np.asarray(rows[i][0]).astype(">u4").tobytes(),
        np.asarray(rows[i][1]).astype(">f8").tobytes()))


def build_index(rows: list, labels: np.ndarray, idf: np.ndarray) -> ExampleIndex:
    """Index of (slots, counts) rows in ``example_order``."""
    order = example_order(rows)
    n = len(order)
    slot = np.concatenate([rows[i][0] for i in order] or [np.zeros(0)]).astype(np.int32)
    weight = np.concatenate([unit(rows[i][1], idf[rows[i][0]]) for i in order]
                            or [np.zeros(0)]).astype(np.float32)
    example = np.repeat(np.arange(n, dtype=np.int32), [len(rows[i][0]) for i in order])
    held = np.bincount(slot, minlength=len(idf))
    often = np.argsort(-held, kind="stable")[:DENSE]
    often = often[held[often] * 32 > n]
    column = np.full(len(idf), -1, np.int32)
    column[often] = np.arange(len(often))
    dense = np.zeros((n, len(often)), np.float32)
    there = column[slot] >= 0
    dense[example[there], column[slot[there]]] = weight[there]
    slot, example, weight = slot[~there], example[~there], weight[~there]
    by = np.argsort(slot, kind="stable")
    at = np.searchsorted(slot[by], np.arange(len(idf) + 1))
    return ExampleIndex(column, dense, at, example[by], weight[by], labels[order])


def cosines(index: ExampleIndex, queries: list):
    """The cosines of each query (slots, weights) with every example."""
    n = len(index.label)
    for first in range(0, len(queries), QUERIES_AT_ONCE):
        part = queries[first:first + QUERIES_AT_ONCE]
        ask = np.zeros((len(part), index.dense.shape[1]), np.float32)
        for i, (slots, weights) in enumerate(part):
            there = index.column[slots] >= 0
            ask[i, index.column[slots[there]]] = weights[there]
        sums = ask @ index.dense.T
        for i, (slots, weights) in enumerate(part):
            begin, size = index.at[slots], index.at[slots + 1] - index.at[slots]
            where = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            yield sums[i] + np.bincount(index.example[where], np.repeat(weights, size)
                                        * index.weight[where], minlength=n)


def _largest(sums: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    if skip >= 0:
        sums[skip] = 0
    least = np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) > k else 0
    found = np.flatnonzero((sums >= least) & (sums > 0))
    found = found[np.lexsort((found, -sums[found]))][:k]
    return found, sums[found]


def nearest(index: ExampleIndex, slots: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS,
            skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(examples, cosines) of the k nearest by exact cosine, ties to the smaller example."""
    return _largest(next(cosines(index, [(slots, weights)])), k, skip)


def vote(labels: np.ndarray, cosines: np.ndarray, prior: float) -> float:
    """Share of toxic neighbours, near ones first (cosine to the fourth), drawn to the prior when
    they are few or far."""
    w = cosines ** 4
    return float((w @ labels + 0.5 * prior) / (w.sum() + 0.5))


def calibrate(votes: np.ndarray, labels: np.ndarray, rates: np.ndarray) -> tuple[float, float]:
    """Slope (0.1 at least) and offset of a logistic curve from votes to chances; ``rates`` weighs
    an example by the labelled rows it stands for."""
    x = np.log(np.clip(votes, 1e-4, 1 - 1e-4) / (1 - np.clip(votes, 1e-4, 1 - 1e-4)))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w, d = rates * p * (1 - p) + 1e-6, rates * (labels - p)
        grad = np.array([d @ x - 0.05 * (a - 1), d.sum()])
        hess = np.array([[w @ (x * x) + 0.05, w @ x], [w @ x, w.sum() + 0.05]])
        step = np.linalg.solve(hess, grad)
        a, b = max(a + step[0], 0.1), b + step[1]
    return float(a), float(b)


def score(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", sample: int = 12_000,
          k: int = NEIGHBOURS) -> DataFrame:
    """One row per row of ``docs``: id, score, predicted, neighbours, evidence.

    ``learn`` is a column over ``docs`` (id) that allows a row's label. At most ``sample`` labelled
    rows, as many of either label, are learnt from; ids label them and nothing else. Every text is
    scored, null and empty ones from the prior; IDF counts all texts. ``evidence`` holds ids of the
    nearest examples. A label row that repeats an id counts once; ids without a text don't count.
    No labels at all give score 0.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                      learn.alias("learn"))
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    slim = own.filter("learn").select("id").distinct().join(marked, "id")
    place = Window.partitionBy("toxic", "deal").orderBy("mark", "id")
    deals = 16
    picked = stored(slim.withColumn("mark", F.xxhash64("id")).withColumn(
        "deal", F.pmod("mark", F.lit(deals))).withColumn("rank", F.row_number().over(place)).filter(
        F.col("rank") <= sample // (2 * deals)).select("id", "toxic"))
    # Proven bound: ``sample`` ids and labels.
    examples = stored(own.select("id", "text").join(F.broadcast(picked), "id")
                      .dropDuplicates(["id"]))
    vocabulary = telling(examples.select("text", "toxic"))
    total, held_by = text_counts(own, vocabulary)
    idf = np.log1p(total / (held_by + 1.0))
    idf[DIMENSIONS:] *= BOOST
    vectors = stored(counted(examples, vocabulary, ("id", "toxic")))
    # Proven bound: the distinct features of ``sample`` texts.
    known = vectors.orderBy("id").toArrow()
    truth = known.column("toxic").to_numpy().astype(float)
    slots, counts = (known.column(c).combine_chunks() for c in ("slots", "counts"))
    ends = slots.offsets.to_numpy() if len(known) else np.zeros(1, int)
    full = np.diff(ends) > 0
    flat, times = slots.flatten().to_numpy(), counts.flatten().to_numpy()
    rows = [(flat[a - ends[0]:b - ends[0]], times[a - ends[0]:b - ends[0]])
            for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a]
    order = example_order(rows)
    index = build_index(rows, truth[full], idf)
    names = np.array(known.column("id").to_pylist(), object)[full][order]
    # Known shares of labels, not of the even sample.
    rates = {r[0]: r[1] for r in slim.groupBy("toxic").count().collect()}
    seen = sum(rates.values())
    bare = {t: (truth[~full] == t).sum() / max((truth == t).sum(), 1) for t in (0, 1)}
    odds = {t: rates.get(t, 0) * bare[t] for t in (0, 1)}
    prior = rates.get(1, 0) / seen if seen else 0.0
    # No labelled text without a word: the prior speaks for such texts.
    empty = float(odds[1] / (odds[0] + odds[1])) if odds[0] + odds[1] else prior
    model = {"index": vars(index), "idf": idf, "names": names, "prior": prior, "empty": empty,
             "curve": (1.0, 0.0), "k": k}
    if rows:
        found = _votes(vectors, model).toArrow()
        votes, said = (found.column(c).to_numpy() for c in ("vote", "toxic"))
        stands = np.array([rates.get(t, 0) / max((truth == t).sum(), 1) for t in (0, 1)])
        stands = stands / max(stands.max(), 1e-12)
        model["curve"] = calibrate(votes, said.astype(float), stands[said])
    return _scored(own.select("id", "text"), vocabulary, model)


def _votes(vectors: DataFrame, model: dict) -> DataFrame:
    """(toxic, vote) of every example with words, by the other examples."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        index, place = ExampleIndex(**m["index"]), {x: i for i, x in enumerate(m["names"])}
        for batch in batches:
            rows = [(place[x], t, np.array(s), np.array(c)) for x, t, s, c in zip(
                *(batch.column(c).to_pylist() for c in ("id", "toxic", "slots", "counts")),
                strict=True) if s]
            sums = cosines(index, [(s, unit(c, m["idf"][s])) for _, _, s, c in rows])
            votes = []
            for row, found in zip(rows, sums, strict=True):
                e, c = _largest(found, m["k"], row[0])
                votes.append(vote(index.label[e], c, m["prior"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array(votes, pa.float64())],
                                             names=["toxic", "vote"])

    return vectors.repartition(64, "id").mapInArrow(run, "toxic int, vote double")


def _scored(docs: DataFrame, vocabulary: np.ndarray, model: dict) -> DataFrame:
    # Proven bound: the index of the sampled examples.
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        vocabulary, m = shared.value
        index = ExampleIndex(**m["index"])
        a, b = m["curve"]
        for batch in batches:
            scores, evidence = [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                rows = sparse_counts(data, offsets, vocabulary)
                for (slots, _), found in zip(rows, cosines(index, [
                        (s, unit(c, m["idf"][s])) for s, c in rows]), strict=True):
                    if not len(slots) or not len(index.label):
                        scores.append(m["empty"])
                        evidence.append([])
                        continue
                    e, c = _largest(found, m["k"], -1)
                    v = min(max(vote(index.label[e], c, m["prior"]), 1e-4), 1 - 1e-4)
                    scores.append(1 / (1 + np.exp(-(a * np.log(v / (1 - v)) + b))))
                    evidence.append([int(x) for x in m["names"][e[:3]]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores, pa.float64()),
                 pa.array([int(x >= 0.5) for x in scores], pa.int32()),
                 pa.array(evidence, pa.list_(pa.int64()))],
                names=["id", "score", "predicted", "evidence"])

    return docs.mapInArrow(run, f"id {kind}, score double, predicted int, evidence array<long>")
