"""Near-duplicate classes by b-bit MinHash, confirmed on full shingle sets.

Every text becomes minima of its word shingles. Bands of minima give buckets of candidates; four
low bits of each minimum, packed into words, estimate the similarity of two members by bit counts,
corrected for chance agreement. Likely pairs are confirmed on whole sets, and classes are connected
components. Texts with equal sets are one node from the start, so copies cost one row.

A bucket never yields all its pairs. A first round confirms a maximum spanning forest of its likely
pairs, which joins nearly all that belongs together. A second one brings the full sets of texts
that still have a likely partner in another class to their bucket, tries all such pairs in place and
gives a forest of the links found, so no link is missed and no pair leaves a task in vain. Buckets
beyond ``CELL`` rows are dealt into cells, so no task holds a whole hot bucket.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import (IS_SPACE, LOWER, mix, prefix_hash, runs, span_hash, stars, stored,
                                 text_slices)

WIDTH = 5
HASHES, BANDS, BITS = 128, 32, 4
CELL = 1024
SMALL = 8
MARGIN = 0.2
MARKS = 24
_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64))
_STEP = mix(np.arange(2001, 2001 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list:
    """Sorted distinct 64-bit shingle hashes of each text; a shorter text is one shingle."""
    data = LOWER[data]
    start, end, text = runs(~IS_SPACE[data], offsets)
    words = span_hash(prefix_hash(data), start, end)
    n = len(words)
    grams = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        grams += words[k:n - width + 1 + k] * _STEP[k] if n >= width else 0
    grams = mix(grams)
    first = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            out.append(np.unique(grams[a:b - width + 1]))
        elif b > a:
            short = np.sum(words[a:b] * _STEP[:b - a], dtype=np.uint64, keepdims=True)
            out.append(mix(short + _STEP[width + b - a:][:1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _minima(grams: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        part = grams[None, at:at + 4096] * _A[:, None]
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def _pack(minima: np.ndarray) -> np.ndarray:
    """Low bits of the mixed minima, ``BITS`` each, 64 to a word."""
    low = (mix(minima) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    shift = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(low << shift, axis=1)


def _names(grams: np.ndarray) -> tuple:
    return len(grams), int(grams.sum(dtype=np.uint64).view(np.int64)), int(
        np.bitwise_xor.reduce(mix(grams)).view(np.int64)) if len(grams) else 0


def _node() -> F.Column:
    return F.xxhash64("n", "f1", "f2")


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, node, bands, packed) of every whole text; n is its number of distinct shingles."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, n long, f1 long, f2 long, bands array<long>, packed binary"
    number = mix(np.arange(3001, 3001 + BANDS, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            names, bands, packed = [], [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                for grams in shingle_sets(data, offsets):
                    names.append(_names(grams))
                    if not len(grams):
                        bands.append([])
                        packed.append(b"")
                        continue
                    low = _minima(grams)
                    rows = low.reshape(BANDS, -1)
                    keys = mix((rows * _STEP[:rows.shape[1]]).sum(axis=1, dtype=np.uint64) + number)
                    bands.append(keys.view(np.int64))
                    packed.append(_pack(low).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array([x[k] for x in names], pa.int64())
                                       for k in range(3)),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                names=["id", "n", "f1", "f2", "bands", "packed"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, schema).withColumn("node", _node()).drop("f1", "f2"))


def _marks(ids: DataFrame) -> np.ndarray:
    """Bit filter of fixed size over hashes of ``id``: at most 2^(MARKS - 6) rows reach the driver."""
    bits = np.zeros(1 << (MARKS - 6), np.int64)
    found = (ids.select(_mark(F.col("id")).alias("at"))
             .groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow())
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint64)


def _mark(name: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(name), F.lit(1 << MARKS))


def _full_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, n, grams) of the nodes in ``wanted`` (node, id); rows may repeat.

    Texts stay where they are read: a bit filter of the wanted ids tells which to take. Those that it
    takes wrongly go by their node, so beyond some millions of ids it only prunes less.
    """
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def run(batches):
        bits = marks.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            held = bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            texts = batch.column("text").filter(pa.array(held.astype(bool)))
            if not len(texts):
                continue
            sets = [g for _, _, data, offsets in text_slices(texts)
                    for g in shingle_sets(data, offsets)]
            names = [_names(g) for g in sets]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x[k] for x in names], pa.int64()) for k in range(3)),
                 pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64()))],
                names=["n", "f1", "f2", "grams"])

    found = (docs.select(_mark(F.col(id_col)).alias("at"), F.col(text_col).alias("text"))
             .mapInArrow(run, "n long, f1 long, f2 long, grams array<long>")
             .select(_node().alias("node"), "n", "grams"))
    nodes = wanted.select("node").distinct()
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


# ---- likely pairs of a cell -----------------------------------------------------------------

_NIBBLE = np.uint64(int("1" * 16, 16))


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity estimated from packed signatures along the last axis: of the minima, the share
    that agrees by its low bits, less what agrees by chance."""
    differ = x ^ y
    differ = differ | (differ >> np.uint64(1))
    differ = (differ | (differ >> np.uint64(2))) & _NIBBLE
    share = 1 - np.bitwise_count(differ).sum(axis=-1) / HASHES
    chance = 2.0 ** -BITS
    return (share - chance) / (1 - chance)


def _alike(n: np.ndarray, percent: int):
    """Pairs whose set sizes allow the threshold."""
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    return 100 * low >= percent * high


def _estimates(rows: dict, percent: int) -> np.ndarray:
    """Estimated similarity of all pairs of a cell; -1 where a pair is out of question."""
    packed, n, label = rows["packed"], rows["n"], rows["label"]
    size = len(n)
    score = np.empty((size, size), np.float32)
    for at in range(0, size, 256):
        score[at:at + 256] = agreement(packed[at:at + 256, None, :], packed[None, :, :])
    out = ~_alike(n, percent) | (label[:, None] == label[None, :])
    out |= score < percent / 100 - MARGIN
    score[out] = -1
    return score


def _forest(score: np.ndarray) -> list:
    """Edges of a maximum spanning forest of the pairs with a score above -1."""
    size = len(score)
    best, link = np.full(size, -1.0), np.full(size, -1)
    left, edges = np.ones(size, bool), []
    for _ in range(size):
        i = int(np.argmax(np.where(left, best, -2)))
        left[i] = False
        if link[i] >= 0 and best[i] > -1:
            edges.append((int(link[i]), i))
        better = left & (score[i] > best)
        best[better], link[better] = score[i][better], i
    return edges


def _likely(rows: dict, percent: int) -> list:
    """Node pairs to confirm: a forest of the likely pairs, or all of them in a small cell."""
    score = _estimates(rows, percent)
    if len(score) <= SMALL:
        a, b = np.nonzero(score > -1)
        edges = [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j]
    else:
        edges = _forest(score)
    node = rows["node"]
    return [(min(node[a], node[b]), max(node[a], node[b])) for a, b in edges]


def _doubtful(rows: dict, percent: int) -> list:
    """(cell, node, label) of the rows with a likely partner in another class."""
    found = (_estimates(rows, percent) > -1).any(axis=1)
    return [(rows["cell"][0], x, y) for x, y in zip(rows["node"][found], rows["label"][found],
                                                    strict=True)]


def _links(rows: dict, percent: int) -> list:
    """Label pairs: a forest of the links between classes of a cell, found on full sets."""
    grams, label = rows["grams"], rows["label"]
    size, n = len(label), np.array([len(g) for g in grams])
    names, count = np.unique(label, return_counts=True)
    base = names[np.argmax(count)]
    owner = np.repeat(np.arange(size), n)
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    allowed = _alike(n, percent)
    root = {x: x for x in names.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    edges = []
    for i in np.flatnonzero(label != base):
        lo, hi = np.searchsorted(every, grams[i], "left"), np.searchsorted(every, grams[i], "right")
        width = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(
            width.sum())
        same = np.bincount(owner[at], minlength=size)
        hit = (100 * same >= percent * (n + n[i] - same)) & allowed[i] & (label != label[i])
        for j in np.flatnonzero(hit):
            a, b = find(label[i].item()), find(label[j].item())
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((min(label[i], label[j]), max(label[i], label[j])))
    return edges


def _by_cell(kernel, names: tuple):
    """A walk over rows sorted by cell that hands each cell of two rows or more to a kernel."""
    def flush(held):
        table = pa.Table.from_batches(held)
        columns = {k: table.column(k).to_numpy() for k in table.column_names if k != "packed"}
        if "packed" in table.column_names:
            columns["packed"] = np.frombuffer(b"".join(table.column("packed").to_pylist()),
                                              np.uint64).reshape(table.num_rows, -1)
        cells = columns["cell"]
        cut = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True])))
        found = [x for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1
                 for x in kernel({k: v[a:b] for k, v in columns.items()})]
        found = sorted(set(found))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64())
                                           for k in range(len(names))], names=list(names))

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            change = np.flatnonzero(cells[1:] != cells[:-1]) + 1
            if last is not None and cells[0] != last:
                yield flush(held)
                held = []
            if len(change):
                yield flush([*held, batch.slice(0, int(change[-1]))])
                held = [batch.slice(int(change[-1]))]
            else:
                held.append(batch)
            last = cells[-1]
        if held:
            yield flush(held)

    return run


def _dealt(rows: DataFrame, columns: list, kernel, names: tuple) -> DataFrame:
    return (rows.select("cell", *columns).repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(_by_cell(kernel, names), ", ".join(f"{n} long" for n in names)))


def _first_cells(rows: DataFrame) -> DataFrame:
    ways = F.ceil(F.col("size") / CELL)
    return rows.withColumn("cell", F.xxhash64("key", F.pmod(F.xxhash64("node"), ways)))


def _wide(named: DataFrame) -> DataFrame:
    """(key, base, across, down) of the buckets that span classes; base is the largest class."""
    counts = named.groupBy("key", "label").agg(F.count("*").alias("m"))
    wide = (counts.groupBy("key").agg(F.sum("m").alias("all"), F.count("*").alias("classes"),
                                      F.max(F.struct("m", "label"))["label"].alias("base"),
                                      F.max("m").alias("most")).filter("classes > 1"))
    return wide.select("key", "base", F.ceil(F.col("all") / CELL).alias("across"), F.ceil(
        (F.col("all") - F.col("most")) / CELL).alias("down"))


def _later_cells(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """Cells of buckets that span classes: every row outside a bucket's largest class meets every
    row of the bucket, in cells of at most some ``CELL`` rows from either."""
    rows = rows.join(wide.hint("merge"), "key")
    i, j = F.pmod(F.xxhash64("node"), "across"), F.pmod(F.xxhash64("node", F.lit(1)), "down")
    every = F.transform(F.sequence(F.lit(0), F.col("down") - 1),
                        lambda k: F.xxhash64("key", i, k))
    outside = F.expr("label <> base and (across > 1 or down > 1)")
    more = F.when(outside, F.transform(F.sequence(F.lit(0), F.col("across") - 1),
                                       lambda k: F.xxhash64("key", k, j))).otherwise(
        F.array().cast("array<bigint>"))
    return rows.select(F.explode(F.array_distinct(F.concat(every, more))).alias("cell"), "node", "n",
                       "label", "packed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Texts are linked when their sets of five-word shingles agree by ``percent`` of the union or
    more; a shorter text is one shingle, a text without words (or null) has an empty set and no
    link. ``component_id`` is the smallest id of the class, ``kept`` marks that row. Rows that
    repeat an id are texts of their own in one id; null ids are never the smallest and never kept
    unless nothing else is in the class. Only the two columns are read.
    """
    sketched = stored(sketch(docs, id_col, text_col))
    # Copies are one row from here on, under their smallest id.
    banded = stored(sketched.filter("n > 0").groupBy("node").agg(
        F.min("id").alias("id"), *(F.first(x).alias(x) for x in ("n", "packed", "bands"))))
    keyed = banded.select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    rows = stored(keyed.join(sizes.hint("merge"), "key")
                  .join(banded.select("node", "id", "n", "packed"), "node"))
    sets = stored(_full_sets(docs, id_col, text_col, rows.select("node", "id")))

    columns = ["node", "n", "label", "packed"]
    likely = _dealt(_first_cells(rows.withColumn("label", F.col("node"))), columns,
                    lambda r: _likely(r, percent), ("a", "b")).distinct()
    classes = stars(_confirmed(likely, sets, percent))
    named = _labelled(rows, classes)
    doubtful = _dealt(_later_cells(named, stored(_wide(named))), columns,
                      lambda r: _doubtful(r, percent), ("cell", "node", "label"))
    tried = doubtful.join(sets.select("node", "grams"), "node")
    # From here on a class is one node.
    joined = stars(_dealt(tried, ["label", "grams"], lambda r: _links(r, percent), ("a", "b")))
    firsts = _labelled(banded.select("node", "id"), classes).groupBy("label").agg(
        F.min("id").alias("id"))
    ids = _labelled(firsts.select(F.col("label").alias("node"), "id"), joined)
    least = F.min("id").over(Window.partitionBy("label"))
    ids = stored(ids.select(F.col("node").alias("label"), least.alias("component_id")))
    # Stored sides of one row a key: Spark splits the partitions of hot texts and classes.
    out = _labelled(sketched.select("id", "n", "node"), classes).join(ids, "label", "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.col("id").eqNullSafe(own).alias("kept"))


def _labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows with the label of their node's class: without links, the node itself."""
    return rows.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b): the decision on full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    same = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(left, "a").join(right, "b").withColumn("same", same).filter(
        100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")
