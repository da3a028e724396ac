"""Removal of byte strings of a given length that occur more than once.

Positions are named at growing lengths and drop out once their name is unique, as in prefix
doubling. Sorting every byte's position at every length would move the corpus many times over, so
the first round is thinned: a window of ``LENGTH`` bytes goes by its smallest seed, the 32-byte
string in it with the least hash. Equal windows have equal seeds at equal places, so windows whose
seed occurs once are unique without another look. The windows of one seed are neighbours and
travel as one row, named whole first: if that name repeats, all of them do. What is left is named
at 64, 128, ... bytes and at the full length, within the seed's class.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import mix, prefix_hash, span_hash, spread_join, stored, text_slices

LENGTH, SEED = 200, 32
# Kinds of runs that one task compares at once, some 100 MB; larger classes go one row a window.
WIDE = 1 << 14


def seeds(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """(name, whole, text, first, last) of every run of windows with one smallest seed.

    ``first`` and ``last`` are window starts in the text; ``whole`` names the bytes from the first
    window to the end of the last, and where the seed stands among them.
    """
    n, wide = len(data), length - seed + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return (empty,) * 5
    prefix = prefix_hash(data)
    at = np.arange(n - seed + 1)
    grams = span_hash(prefix, at, at + seed)
    key = (grams & ~np.uint64((1 << 28) - 1)) | at.astype(np.uint64)
    pad = np.full(-len(key) % wide, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((key, pad)).reshape(-1, wide)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    least = np.minimum(tail[starts], head[starts + wide - 1])
    text = np.searchsorted(offsets, starts, "right") - 1
    ok = starts + length <= offsets[text + 1]
    starts, least, text = starts[ok], least[ok], text[ok]
    if not len(starts):
        return (empty,) * 5
    place = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    change = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(np.concatenate(([True], change)))
    last = np.concatenate((first[1:], [len(starts)])) - 1
    place, owner = place[first], text[first]
    a, b = starts[first], starts[last]
    whole = mix(span_hash(prefix, a, b + length) + (place - a).astype(np.uint64))
    return (grams[place].view(np.int64), whole.view(np.int64), owner, a - offsets[owner],
            b - offsets[owner])


def _windows(contexts: list, spans: list, length: int):
    """(prefix, starts, context) of all windows of the contexts' bytes."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(c) for c in contexts])))[:-1]
    count = np.asarray(spans, np.int64)
    owner = np.repeat(np.arange(len(contexts)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return prefix_hash(data), base[owner] + inner, owner, inner


def repeated(contexts: list, spans: list, weights, classes, length: int, seed: int):
    """(context, window) of the windows that occur twice or more among contexts of a class."""
    prefix, starts, owner, inner = _windows(contexts, spans, length)
    weights, classes = np.asarray(weights), np.asarray(classes, np.int64).astype(np.uint64)
    size = 2 * seed
    while len(starts):
        size = min(size, length)
        names = span_hash(prefix, starts, starts + size) ^ mix(classes[owner])
        _, rank = np.unique(names, return_inverse=True)
        twice = np.bincount(rank, weights=weights[owner])[rank] >= 2
        starts, owner, inner = starts[twice], owner[twice], inner[twice]
        if size == length:
            break
        size *= 2
    return owner, inner


def _runs(rows: np.ndarray, starts: np.ndarray) -> list:
    """(row, first, last) of neighbouring starts of a row."""
    if not len(starts):
        return []
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    cut = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (
        starts[1:] > starts[:-1] + 1))))
    end = np.concatenate((cut[1:], [len(starts)])) - 1
    return list(zip(rows[cut].tolist(), starts[cut].tolist(), starts[end].tolist(), strict=True))


def _found(runs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in runs], pa.int64())
                                       for k in range(3)], names=["row", "first", "last"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED,
                   id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept).

    Removes each UTF-8 byte covered by a string of ``length`` bytes that also starts elsewhere in
    any text; overlaps count, matches stay within texts, and strings are judged on the input. A
    null text is empty. Repeated rows repeat each other. ``kept`` holds the bytes that remain.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), body.alias("text"),
                        F.xxhash64(F.col(id_col), body).alias("row"))

    def thin(batches):
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column("text")):
                name, whole, owner, first, last = seeds(data, offsets, length, seed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(owner + at)), pa.array(name),
                     pa.array(whole), pa.array(first), pa.array(last)],
                    names=["row", "name", "whole", "first", "last"])

    runs = stored(texts.select("row", "text").mapInArrow(
        thin, "row long, name long, whole long, first long, last long"))
    alike = runs.groupBy("name", "whole").agg(F.count("*").alias("n"), *[
        F.min(c).alias(c) for c in ("row", "first", "last")])
    classes = alike.groupBy("name").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    kinds = stored(alike.join(classes.filter(F.col("all") > 1), "name"))
    # Runs that repeat whole. The sort-merge join lets a hot kind be split among tasks.
    sure = stored(runs.join(kinds.filter("n > 1").select("name", "whole", "kinds").hint("merge"),
                            ["name", "whole"]))
    twin = F.min(F.struct("row", "first", "last", "kinds")).alias("one")
    twins = sure.filter("kinds > 1").groupBy("name", "whole").agg(twin).select(
        "one.row", "name", "one.kinds", "one.first", "one.last", F.lit(2).alias("weight"))
    open_kinds = kinds.filter("n = 1 and kinds > 1").select(
        "row", "name", "kinds", "first", "last", F.lit(1).alias("weight")).union(twins)
    sure = sure.select("row", "first", "last")

    # Texts that some later step reads; the others are settled by digest alone.
    needed = open_kinds.select("row").union(sure.select("row")).distinct()
    body_of = stored(texts.select("row", "text").join(needed, "row", "left_semi")
                     .dropDuplicates(["row"]))
    cuts = open_kinds.join(body_of, "row").select(
        "row", "name", "kinds", "first", "weight", (F.col("last") - F.col("first") + 1).alias("n"),
        F.substring(F.col("text").cast("binary"), (F.col("first") + 1).cast("int"),
                    (F.col("last") - F.col("first") + length).cast("int")).alias("bytes"))
    cuts = stored(cuts)

    def settle(batches):
        held, last = [], None

        def flush(parts):
            t = pa.Table.from_batches(parts)
            row, first = (t.column(c).to_numpy() for c in ("row", "first"))
            owner, inner = repeated(t.column("bytes").to_pylist(), t.column("n").to_numpy(),
                                    t.column("weight").to_numpy(), t.column("name").to_numpy(),
                                    length, seed)
            return _found(_runs(row[owner], first[owner] + inner))

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("name").to_numpy()
            change = np.flatnonzero(names[1:] != names[:-1]) + 1
            if last is not None and names[0] != last:
                yield flush(held)
                held = []
            if len(change):
                yield flush([*held, batch.slice(0, int(change[-1]))])
                held = [batch.slice(int(change[-1]))]
            else:
                held.append(batch)
            last = names[-1]
        if held:
            yield flush(held)

    small = (cuts.filter(F.col("kinds") <= WIDE).repartition("name").sortWithinPartitions("name")
             .mapInArrow(settle, "row long, first long, last long"))
    found = sure.union(small).union(_wide(cuts.filter(F.col("kinds") > WIDE), length))
    removed = _removed(body_of, found, length, with_text)
    base = texts.select("id", "row", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
                        *([F.col("text").cast("binary").alias("body")] if with_text else []))
    out = spread_join(base, removed, ["row"], F.col("id"), "left")
    return out.select(
        "id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("kept", "body").alias("kept")] if with_text else []))


def _wide(cuts: DataFrame, length: int) -> DataFrame:
    """Starts of repeated windows in classes of very many kinds: one row a window, by name."""
    def name(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                prefix, starts, owner, inner = _windows(
                    part.column("bytes").to_pylist(), part.column("n").to_numpy(), length)
                row, first, weight = (part.column(c).to_numpy() for c in ("row", "first", "weight"))
                names = span_hash(prefix, starts, starts + length).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(row[owner]), pa.array(first[owner] + inner),
                     pa.array(weight[owner].astype(np.int32))],
                    names=["window", "row", "first", "weight"])

    rows = cuts.mapInArrow(name, "window long, row long, first long, weight int")
    twice = rows.groupBy("window").agg(F.sum("weight").alias("w")).filter("w > 1").select("window")
    return spread_join(rows, twice, ["window"], F.col("row")).select(
        "row", "first", F.col("first").alias("last"))


def _removed(body_of: DataFrame, found: DataFrame, length: int, with_text: bool) -> DataFrame:
    """(row, n_removed, n_spans, kept_sha256[, kept]) of the texts with repeated windows."""
    spans = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last")))
                                     .alias("spans"))

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                step = np.zeros(len(data) + 1, np.int64)
                for s in spans.as_py():
                    step[s["first"]] += 1
                    step[s["last"] + length] -= 1
                gone = np.cumsum(step[:-1]) > 0
                starts = gone & ~np.concatenate(([False], gone[:-1]))
                left = data[~gone].tobytes()
                out.append((int(gone.sum()), int(starts.sum()), hashlib.sha256(left).hexdigest(),
                            left))
            arrays = [batch.column("row"), pa.array([x[0] for x in out], pa.int64()),
                      pa.array([x[1] for x in out], pa.int64()),
                      pa.array([x[2] for x in out], pa.string())]
            names = ["row", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array([x[3] for x in out], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return body_of.join(spans, "row").select("row", "text", "spans").mapInArrow(
        cut, "row long, n_removed long, n_spans long, kept_sha256 string"
             + (", kept binary" if with_text else ""))
