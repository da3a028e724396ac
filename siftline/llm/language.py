"""Language of a text: the nearest of several centroids per language.

A text is the normalised TF-IDF vector of its byte n-grams. Each language has centroids found by
spherical k-means over a bounded sample of labelled rows; the nearest one by cosine names the
language, and a text too far from it, for its length, is rejected.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import IS_LETTER, LOWER, stored, text_slices

UND = "und"
DIMENSIONS = 1 << 12
_PLAIN = np.where(IS_LETTER[LOWER], LOWER, 32).astype(np.uint8)
_SNIPPETS = (8, 16, 32, 64, 128, 256, 512, 1024)


@dataclass
class LanguageModel:
    """``floors[b]``: cosine below which a text of 2^b n-grams is too far from every language."""

    languages: list
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    floors: np.ndarray
    sharpness: float = 24.0


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x dimensions: counts of hashed 1-, 2- and 3-byte grams; all but letters is one blank."""
    n, size = len(offsets) - 1, len(data)
    out = np.zeros(n * DIMENSIONS, np.float32)
    if not size:
        return out.reshape(n, DIMENSIONS)
    plain = _PLAIN[data].astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(offsets))
    gram = np.zeros(size, np.uint32)
    for length in (1, 2, 3):
        last = size - length + 1
        if last < 1:
            break
        gram = gram[:last] * np.uint32(0x01000193) + plain[length - 1:] + np.uint32(length)
        whole = owner[:last] == owner[length - 1:]
        slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(20)
        out += np.bincount(owner[:last][whole] + slot[whole], minlength=n * DIMENSIONS)
    return out.reshape(n, DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def _sampled(docs: DataFrame, label: str, sample: int, languages: int) -> DataFrame:
    """At most ``sample`` labelled texts: as many of each language as fit, chosen by a hash.

    Copies of a text under one label count once; a text with several labels is the smallest's.
    """
    order = F.xxhash64("text")
    slim = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(
        F.col(label).alias("language"), order.alias("mark")).groupBy("mark").agg(
        F.min("language").alias("language"))
    place = Window.partitionBy("language").orderBy("mark")
    each = max(1, sample // languages)
    marks = (slim.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= each)
             .orderBy("rank", "language").limit(sample).select("mark", "language"))
    # Proven bound: at most ``sample`` rows of a number and a label.
    return (docs.filter(F.col("text").isNotNull()).select("text").withColumn("mark", order)
            .join(F.broadcast(marks), "mark").dropDuplicates(["mark"]).select("language", "text"))


def _features(batches):
    """Sparse gram counts of whole sampled texts."""
    for batch in batches:
        for at, to, data, offsets in text_slices(batch.column("text")):
            rows = gram_counts(data, offsets)
            slots = [np.flatnonzero(row).astype(np.int32) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("language").slice(at, to - at), pa.array(slots, pa.list_(pa.int32())),
                 pa.array([row[s] for row, s in zip(rows, slots, strict=True)],
                          pa.list_(pa.float32()))], names=["language", "slots", "counts"])


def _known_cosines(rows: DataFrame, centroids: np.ndarray, idf: np.ndarray) -> DataFrame:
    """(bin, cosine) of sampled texts and of snippets of them, to learn floors by length."""
    shared = rows.sparkSession.sparkContext.broadcast((centroids, idf))

    def run(batches):
        centres, weights = shared.value
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column("text"), 1 << 18):
                pieces = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    start = (int(b - a) * 7919 + 13) % 4096
                    pieces.append(data[a:b])
                    pieces += [data[a + s:a + s + n] for n in _SNIPPETS if n < b - a
                               for s in [start % int(b - a - n)]]
                ends = np.cumsum([0] + [len(p) for p in pieces])
                counts = gram_counts(np.concatenate(pieces), ends)
                best = (vectors(counts, weights) @ centres.T).max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_bin(counts.sum(axis=1)).astype(np.int32)),
                     pa.array(best.astype(np.float64))], names=["bin", "cosine"])

    return rows.mapInArrow(run, "bin int, cosine double")


def _k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by cosine, started from points far from each other; no randomness."""
    chosen = [int(np.argmax(points @ points.mean(axis=0)))]
    near = points @ points[chosen[0]]
    while len(chosen) < min(k, len(points)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, points @ points[chosen[-1]])
    centres = points[chosen].copy()
    for _ in range(rounds):
        owner = np.argmax(points @ centres.T, axis=1)
        for c in range(len(centres)):
            mine = points[owner == c]
            if len(mine):
                mean = mine.mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def _dense(rows: pa.Table) -> np.ndarray:
    out = np.zeros((rows.num_rows, DIMENSIONS), np.float32)
    slots, counts = (rows.column(c).combine_chunks() for c in ("slots", "counts"))
    row = np.repeat(np.arange(rows.num_rows), np.diff(slots.offsets.to_numpy()))
    out[row, slots.flatten().to_numpy()] = counts.flatten().to_numpy()
    return out


def _bin(grams: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(grams, 1)).astype(int).clip(0, 31)


def fit(docs: DataFrame, label: str = "lang", sample: int = 1500, languages: int = 200,
        centroids: int = 8, slack: float = 0.35) -> LanguageModel:
    """Learn from labelled rows (``label``, ``text``).

    ``sample`` bounds the rows that reach the driver (their sparse counts). Rows without label or
    text are left out; of very many languages the ``languages`` most frequent are learnt. ``slack`` times the smallest cosines of known texts of a length is the floor
    under which a text is rejected; texts of under 32 n-grams say too little to be. Nothing labelled gives a model that answers ``und`` only.
    """
    known = [r[0] for r in docs.filter(F.col(label).isNotNull()).groupBy(label).count()
             .orderBy(F.desc("count"), label).limit(languages).select(label).collect()]
    docs = docs.filter(F.col(label).isin(known))
    texts = stored(_sampled(docs, label, sample, max(1, len(known))))
    rows = texts.mapInArrow(
        _features, "language string, slots array<int>, counts array<float>").toArrow()
    counts = _dense(rows)
    df = (counts > 0).sum(axis=0)
    idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
    lettered = counts.any(axis=1)
    points = vectors(counts, idf)
    names = np.array(rows.column("language").to_pylist(), object)
    found, owner, centres = sorted(set(names[lettered])), [], []
    for i, name in enumerate(found):
        c = _k_means(points[lettered & (names == name)], centroids)
        centres.append(c)
        owner += [i] * len(c)
    if not found:
        return LanguageModel([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), idf,
                             np.zeros(32))
    centres = np.concatenate(centres).astype(np.float32)
    # A few rows for each sampled text: bounded like the sample.
    seen = _known_cosines(texts, centres, idf).toArrow()
    size, best = seen.column("bin").to_numpy(), seen.column("cosine").to_numpy()
    floors = np.array([0.0 if b < 5 else slack * np.quantile(best[size == b], 0.002)
                       if (size == b).any() else np.nan for b in range(32)])
    first = np.flatnonzero(~np.isnan(floors))
    if len(first):
        floors[:first[0]] = 0.0
        for b in range(first[0], 32):
            if np.isnan(floors[b]):
                floors[b] = floors[b - 1]
    return LanguageModel(list(found), centres, np.array(owner), idf, np.nan_to_num(floors))


def _with_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with a letter of any script; only those without an ASCII one are decoded."""
    plain = np.concatenate(([0], np.cumsum(IS_LETTER[data] & (data < 128))))
    other = np.concatenate(([0], np.cumsum(data > 127)))
    found = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~found & (other[offsets[1:]] > other[offsets[:-1]])):
        text = data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "ignore")
        found[i] = any(c.isalpha() for c in text)
    return found


def classify(model: LanguageModel, data: np.ndarray, offsets: np.ndarray):
    """(language index or -1, score, cosine, rejected) of whole texts."""
    n = len(offsets) - 1
    counts = gram_counts(data, offsets)
    lettered = _with_letters(data, offsets)
    if not model.languages:
        return np.full(n, -1), np.zeros(n), np.zeros(n), np.ones(n, bool)
    cos = vectors(counts, model.idf) @ model.centroids.T
    best = np.stack([cos[:, model.owner == i].max(axis=1) for i in range(len(model.languages))], 1)
    top = best.max(axis=1)
    share = np.exp(model.sharpness * (best - top[:, None]))
    score = (share.max(axis=1) / share.sum(axis=1)) * np.clip(top, 0, 1) ** 0.25
    rejected = ~lettered | (top < model.floors[_bin(counts.sum(axis=1))])
    return (np.where(lettered, best.argmax(axis=1), -1), np.where(lettered, score, 0.0), top,
            rejected)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple = ()) -> DataFrame:
    """The columns ``keep`` and lang_pred, score, cosine, rejected for every row.

    ``und`` with score 0 for a null text or one without a letter; such texts are rejected. Whole
    texts are read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(model))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add(
        "cosine", "double").add("rejected", "boolean")

    def run(batches):
        m = LanguageModel(**shared.value)
        names = np.array([*m.languages, UND], object)
        for batch in batches:
            found = [classify(m, data, offsets)
                     for _, _, data, offsets in text_slices(batch.column("_text"))]
            lang, score, cos, rejected = (np.concatenate(x) for x in zip(*found, strict=True)) \
                if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(names[np.asarray(lang, int)], pa.string()),
                 pa.array(np.asarray(score, float)), pa.array(np.asarray(cos, float)),
                 pa.array(np.asarray(rejected, bool))],
                names=[*keep, "lang_pred", "score", "cosine", "rejected"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
