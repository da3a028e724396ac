"""Phrase mining by dynamic itemset counting over contiguous words.

The corpus lies in shards that are scanned in a cycle. Words count from the first shard on; a longer
phrase is activated at the first shard before which both phrases one word shorter (without its
last, without its first word) have reached the threshold, and is counted for one full cycle from
there. So lengths interleave in each scan, instead of one pass over everything for each length.

Which phrases have reached the threshold is told to tasks by a bit filter of fixed size. It only ever
gains bits, and a phrase is counted in step t exactly if the filter of t has both parts and the
filter of t minus one cycle has not: every task decides alike, each active phrase gets one whole
cycle, and a part that the filter reports wrongly only makes a phrase be counted that needn't be.

Texts are read once, into rows of about two megabytes: the distinct words and a number for each
occurrence. Scans take numbers, shuffles 96-bit names of phrases; wording comes back at the end, for
frequent phrases, from the one row that each name remembers.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import (LOWER, discard, mix, runs, spread_join, stored, text_slices)

SLICE = 1 << 21
SALTS = 64
LENGTHS = 16
_NO_WORD = np.zeros(256, bool)
_NO_WORD[[32, 9, 10, 11, 12, 13, *b".,;:!?"]] = True
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[10, 11, 12, 13, *b".,;:!?"]] = True
_BLANK = pa.scalar(" ", pa.large_string())
_PAIR = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

# A slice of the corpus: ``words`` are the distinct words joined by line breaks; ``places`` has, for
# each occurrence, twice the word's number, plus 1 if the next word stands in the same piece.
_SLICES = "shard int, src long, lang string, size long, words binary, places binary"


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[int, bytes, bytes]:
    """(occurrences, words, places) of texts, lower-cased (A-Z)."""
    data = LOWER[data]
    member = ~_NO_WORD[data]
    start, end, text = runs(member, offsets)
    if not len(start):
        return 0, b"", b""
    ends = np.concatenate(([0], np.cumsum(_PIECE_END[data], dtype=np.int64)))[start]
    linked = np.zeros(len(start), np.int32)
    linked[:-1] = (text[1:] == text[:-1]) & (ends[1:] == ends[:-1])
    at = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[member])])
    words = words.dictionary_encode()
    places = np.asarray(words.indices).astype(np.int32) * 2 + linked
    return len(start), b"\n".join(words.dictionary.to_pylist()), places.tobytes()


def _slices(texts: DataFrame, shards: int, limit: int) -> DataFrame:
    def step(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs):
                rows = batch.filter(pc.equal(langs, lang)).column("text")
                for _, _, data, offsets in text_slices(rows, limit):
                    size, words, places = encoded(data, offsets)
                    if size:
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array([(part + k) % shards], pa.int32()),
                            "src": pa.array([part << 24 | k]), "lang": pa.array([lang.as_py()]),
                            "size": pa.array([size]), "words": pa.array([words]),
                            "places": pa.array([places])})
                        k += 1

    return texts.mapInArrow(step, _SLICES)


class Reached:
    """Which phrases have reached the threshold: three bits of 2^``log`` for each."""

    def __init__(self, log: int, bits: np.ndarray = None):
        self.log = log
        self.bits = np.zeros(1 << (log - 6), np.uint64) if bits is None else bits

    @classmethod
    def sent(cls, bits):
        """The filter whose bits were broadcast, if any; tasks get plain arrays."""
        return None if bits is None else cls(len(bits.value).bit_length() + 5, bits.value)

    def places(self, h: np.ndarray):
        shift = np.uint64(64 - self.log)
        for k in range(3):
            yield mix(h + np.uint64(k)) >> shift

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    def words(self, h: np.ndarray) -> pa.Table:
        """The filter's 64-bit words that these phrases set, to be united by OR."""
        at = np.concatenate(list(self.places(h)))
        return pa.table({"word": (at >> np.uint64(6)).astype(np.int64),
                         "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})


class Slice:
    """The words of a row of the corpus: numbers, links and names of twice 64 bits."""

    def __init__(self, lang: str, words: bytes, places: bytes):
        self.words = words.split(b"\n")
        places = np.frombuffer(places, np.int32)
        self.index, self.linked = places >> 1, (places & 1).astype(bool)
        # Another seed than the words': a word "es" in "en" is not a word "en" in "es".
        seed = np.frombuffer(xxhash.xxh3_128_digest(lang.encode(), seed=1), np.uint64)
        names = b"".join(map(xxhash.xxh3_128_digest, self.words))
        self.names = np.ascontiguousarray(np.frombuffer(names, np.uint64).reshape(-1, 2).T)
        self.names = mix(self.names ^ seed[:, None])

    def codes(self, at: np.ndarray, n: int) -> np.ndarray:
        """A number for the ``n`` words from each place; equal numbers mean equal words."""
        size = bound = len(self.words)
        key = self.index[at].astype(np.int64)
        for k in range(1, n):
            if bound * size >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                bound = int(key.max(initial=0)) + 1
            key, bound = key * size + self.index[at + k], bound * size
        return key

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        known = pa.array(self.words, pa.large_binary()).cast(pa.large_string())
        parts = [known.take(pa.array(self.index[at + k])) for k in range(n)]
        return pc.binary_join_element_wise(*parts, _BLANK) if n > 1 else parts[0]

    def joined(self, at: np.ndarray, names: np.ndarray, n: int, side: np.ndarray):
        """Places and names of ``n`` words, from those one word shorter whose neighbours are ``side``."""
        keep = np.flatnonzero(side & (at[1:] == at[:-1] + 1) & self.linked[at[:-1] + n - 2])
        return keep, at[keep], mix(names[:, keep] * _PAIR[:, None] + names[:, keep + 1])


def counted(part: Slice, longest: int, now: Reached, old: Reached, first: bool):
    """(length, count, name) of what is active but has not had its cycle in this slice."""
    if first:
        yield 1, np.bincount(part.index, minlength=len(part.words)), part.names
    in_now, names = now.has(part.names[0])[part.index], part.names[:, part.index]
    in_old = (old.has(part.names[0])[part.index] if old is not None
              else np.zeros(len(part.index), bool))
    at = np.arange(len(part.index))
    for n in range(2, longest + 1):
        if len(at) < 2:
            return
        keep, at, names = part.joined(at, names, n, in_now[:-1] & in_now[1:])
        done = in_old[keep] & in_old[keep + 1]
        new = np.flatnonzero(~done)
        if len(new):
            _, where, count = np.unique(part.codes(at[new], n), return_index=True,
                                        return_counts=True)
            yield n, count, names[:, new[where]]
        if n < longest:
            in_now = now.has(names[0])
            in_old = done & old.has(names[0]) if old is not None else np.zeros(len(at), bool)


# Phrases travel in blocks: each bucket of names has rows of whole arrays, so that neither shuffles
# nor sums touch single rows. Arrays lie byte plane by byte plane, which compresses well. ``tag``
# holds a slice with the phrase and, in its last four bits, the number of words; ``seen`` is the
# step in which a phrase came up first.
_KINDS = {"h": np.uint64, "g": np.uint32, "f": np.int64, "tag": np.int64}
_BLOCK = "bucket int, " + ", ".join(f"{x} binary" for x in _KINDS)
_STATE = ("h", "g", "f", "tag", "seen")
_FLUSH = 1 << 20


def _summed(rows: dict) -> dict:
    """One entry a name, sorted by name: counts add up, the least tag and first step stay."""
    h, g = rows["h"], rows["g"]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (g[order][1:] != g[order][:-1])).any():
        order = np.lexsort((g, h))
    rows = {k: v[order] for k, v in rows.items()}
    h, g = rows["h"], rows["g"]
    start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))[:len(h)])
    how = {"f": np.add, "tag": np.minimum, "seen": np.minimum}
    return {k: how[k].reduceat(v, start) if k in how and len(start) else v[start]
            for k, v in rows.items()}


def _planes(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def _gathered(table: pa.Table, names) -> dict:
    def read(v: bytes, kind) -> np.ndarray:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(v, np.uint8).reshape(size, len(v) // size)
        return np.ascontiguousarray(planes.T).view(kind).ravel()

    kinds = _KINDS | {"seen": np.int64}
    return {x: np.concatenate([np.zeros(0, kinds[x])] + [
        read(v, kinds[x]) for v in table.column(x).to_pylist()]) for x in names}


def _scan(rows: DataFrame, longest: int, now, old, first: bool, buckets: int) -> DataFrame:
    """Counts of one shard in blocks; ``now`` and ``old`` are broadcast filters or None."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)

    def blocks(parts: list):
        rows = _summed({x: np.concatenate([p[x] for p in parts]) for x in _KINDS})
        cut = np.append(np.searchsorted(rows["h"], edges), len(rows["h"]))
        for k in np.flatnonzero(cut[1:] > cut[:-1]):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32())} | {
                x: pa.array([_planes(v[cut[k]:cut[k + 1]])]) for x, v in rows.items()})

    def step(batches):
        filters = Reached.sent(now), Reached.sent(old)
        parts, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                src, lang, words, places = (batch.column(x)[row].as_py()
                                            for x in ("src", "lang", "words", "places"))
                for n, f, name in counted(Slice(lang, words, places), longest, *filters, first):
                    parts.append({"h": name[0], "g": name[1].astype(np.uint32), "f": f.astype(np.int64),
                                  "tag": np.full(len(f), src * LENGTHS + n, np.int64)})
                    size += len(f)
                if size > _FLUSH:
                    yield from blocks(parts)
                    parts, size = [], 0
        if parts:
            yield from blocks(parts)

    return rows.mapInArrow(step, _BLOCK)


_AFTER = "bucket int, h binary, g binary, f binary, tag binary, seen binary, news binary, kind int"


def _after(scan: DataFrame, state: DataFrame, now, least: int, longest: int, shards: int,
           step: int) -> DataFrame:
    """Two blocks for each bucket after a scan.

    Kind 1 has running counts of what is in its cycle and may yet reach the threshold. Kind 0 has
    what leaves it: short phrases that have just done so (``news``), or that the filter ``now`` has,
    with all later counts of theirs; and frequent phrases of full length whose cycle is over. What
    had its cycle in vain is dropped. Counts of kind 0 add up over the steps.
    """

    def merge(scanned: pa.Table, before: pa.Table) -> pa.Table:
        bucket = (scanned if scanned.num_rows else before).column("bucket")[0]
        found = _gathered(scanned, _KINDS)
        found["seen"] = np.full(len(found["h"]), step, np.int64)
        old = _gathered(before, _STATE)
        all_ = _summed({x: np.concatenate([old[x], found[x]]) for x in _STATE})
        short = all_["tag"] % LENGTHS < longest
        known = short & Reached.sent(now).has(all_["h"])
        told = short & ~known & (all_["f"] >= least)
        over = all_["seen"] + shards - 1 <= step
        out = known | told | (over & ~short & (all_["f"] >= least))
        blocks = [{x: v[part] for x, v in all_.items()} for part in (out, ~out & ~over)]
        return pa.table({"bucket": pa.array([bucket.as_py()] * 2, pa.int32())} | {
            x: pa.array([_planes(block[x]) for block in blocks]) for x in _STATE} | {
            "news": pa.array([all_["h"][told].tobytes(), b""]),
            "kind": pa.array([0, 1], pa.int32())})

    return scan.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(merge, _AFTER)


def _bits(after: DataFrame, log: int) -> pa.Table:
    """The filter words of the news: at most 2^(log - 6) rows, whatever their number."""

    def step(batches):
        empty = Reached(log, np.zeros(0, np.uint64))
        for batch in batches:
            for news in batch.column("news"):
                yield from empty.words(np.frombuffer(news.as_py(), np.uint64)).to_batches()

    return (after.select("news").mapInArrow(step, "word long, bits long").groupBy("word")
            .agg(F.bit_or("bits").alias("bits")).toArrow())


def _frequent(steps: DataFrame, least: int) -> DataFrame:
    """(h, g, f, src, n) of the names whose counts over all steps come to ``least``."""

    def add(table: pa.Table) -> pa.Table:
        rows = _summed(_gathered(table, ("h", "g", "f", "tag")))
        rows = {k: v[rows["f"] >= least] for k, v in rows.items()}
        return pa.table({"h": rows["h"].view(np.int64), "g": rows["g"].astype(np.int64),
                         "f": rows["f"], "src": rows["tag"] // LENGTHS,
                         "n": (rows["tag"] % LENGTHS).astype(np.int32)})

    return (steps.select("bucket", "h", "g", "f", "tag").groupBy("bucket")
            .applyInArrow(add, "h long, g long, f long, src long, n int"))


def _worded(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, n, phrase, f): each found name is looked up in the one slice it remembers."""

    def look(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and wanted.num_rows:
            lang, words, places = (rows.column(x)[0].as_py() for x in ("lang", "words", "places"))
            part = Slice(lang, words, places)
            lengths = np.asarray(wanted.column("n"))
            at, names = np.arange(len(part.index)), part.names[:, part.index]
            for n in range(1, int(lengths.max()) + 1):
                if n > 1:
                    _, at, names = part.joined(at, names, n, np.ones(max(len(at) - 1, 0), bool))
                mine = wanted.filter(pa.array(lengths == n))
                if not mine.num_rows or not len(at):
                    continue
                h, g = (np.asarray(mine.column(x)).view(np.uint64) for x in ("h", "g"))
                likely = np.zeros(1 << 22, bool)
                likely[h & _LOW] = True
                here = np.flatnonzero(likely[names[0] & _LOW])
                here = here[np.unique(part.codes(at[here], n), return_index=True)[1]]
                # Both sides are distinct: match them on the whole name.
                left = np.stack([names[0, here], names[1, here] & _SHORT], 1).view([("", np.uint64)] * 2)
                right = np.stack([h, g], 1).view([("", np.uint64)] * 2)
                _, i, j = np.intersect1d(left.ravel(), right.ravel(), return_indices=True)
                parts.append(pa.table({
                    "lang": pa.repeat(pa.scalar(lang), len(i)),
                    "n": np.full(len(i), n, np.int32),
                    "phrase": part.phrases(at[here[i]], n).cast(pa.string()),
                    "f": mine.column("f").take(pa.array(j))}))
        return pa.concat_tables(parts) if parts else _EMPTY

    return (corpus.select("src", "lang", "words", "places").groupBy("src")
            .cogroup(found.groupBy("src")).applyInArrow(look, _WORDED))


_LOW = np.uint64((1 << 22) - 1)
_SHORT = np.uint64((1 << 32) - 1)
_WORDED = "lang string, n int, phrase string, f long"
_EMPTY = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()),
                    ("f", pa.int64())]).empty_table()


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                     least: int = 10, longest: int = 3, shards: int = 3, log_bits: int = 26,
                     limit: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """((lang, n, phrase, f), (lang, n)): phrases of up to ``longest`` words that occur ``least``
    times, with their number of words and occurrences, and all occurrences of words by language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks and into words at
    blanks and tabs; occurrences overlap, never cross a piece, and count per language. Null text
    counts as empty, null language as ``und``; repeated rows are rows of their own; an empty table
    gives no rows; other columns are not read, so their names may clash. Long texts are counted
    whole. ``limit`` bytes make a slice (a longer text is one of its own), ``longest`` is at most 15.
    ``log_bits`` bounds what is sent to tasks: 2^(log_bits - 3) bytes, twice. Beyond some 10 million
    frequent phrases the filter prunes less; results stay the same.
    """
    if not 2 <= longest < LENGTHS:
        raise ValueError("longest must be 2 to 15")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                        F.col(text_col).alias("text")).filter(F.col("text") != "")
    corpus = stored(_slices(texts, shards, limit))
    totals = stored(corpus.groupBy("lang").agg(F.sum("size").alias("n")))
    words = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, words >> 19)
    afters, state = [], spark.createDataFrame([], _AFTER)
    filters = [Reached(log_bits)]
    sent = [spark.sparkContext.broadcast(filters[0].bits)]
    step = 0
    while True:
        old = sent[step - shards] if step >= shards else None
        scan = _scan(corpus.filter(F.col("shard") == step % shards), longest, sent[step], old,
                     step < shards, buckets)
        after = stored(_after(scan, state, sent[step], least, longest, shards, step), "kind")
        afters.append(after.filter("kind = 0"))
        if step:
            discard(state, part="kind=1")
        state = after.filter("kind = 1")
        delta = _bits(afters[-1], log_bits)
        bits, at = filters[-1].bits, np.asarray(delta["word"])
        step += 1
        if len(at):
            bits = bits.copy()
            bits[at] |= np.asarray(delta["bits"]).view(np.uint64)
            sent.append(spark.sparkContext.broadcast(bits))
        else:
            sent.append(sent[-1])
        filters.append(Reached(log_bits, bits))
        # Over when every active phrase has had its cycle: the filter stood still for a whole one.
        if step >= shards and sent[step - shards] is sent[step]:
            break
    full = state
    for more in afters:
        full = full.unionByName(more)
    found = stored(_worded(corpus, _frequent(full, least)))
    discard(corpus, *afters)
    return found, totals


def _part(words: str, first, count) -> F.Column:
    return F.array_join(F.slice(F.col(words), first, count), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10,
                 longest: int = 3, cover: int = 50, top: int = 2000, shards: int = 3,
                 limit: int = SLICE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases that belong together most.

    The score of a phrase with count ``a`` is the lowest floor(1000000 a a / (l r)) over its cuts in
    two parts with counts ``l`` and ``r`` (ties: the earliest cut); ``n`` counts the language's words.
    A phrase goes if a longer frequent one holds its words and has at least ``cover`` percent of its
    count. The first ``top`` by score, count and phrase stay; that limit is the report's length.
    Nulls, empty tables, repeated rows and other columns as in ``frequent_phrases``.
    """
    counts, totals = frequent_phrases(docs, text_col, lang_col, least, longest, shards, limit=limit)
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    long_ = counts.filter("n >= 2").select("lang", "phrase", F.col("f").alias("a"),
                                           F.split("phrase", " ", -1).alias("w"))
    size = F.size("w")
    # One row a cut and side; the count of each side comes by a join on its text.
    cuts = long_.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), _part("w", 1, F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"),
                 _part("w", F.col("k") + 1, size - F.col("k")).alias("part")))).alias("s"))
    sides = sides.select("lang", "phrase", "a", "k", "s.left", "s.part")
    sides = spread_join(sides, known, ["lang", "part"], F.col("phrase"))
    scored = (sides.groupBy("lang", "phrase", "a", "k")
              .agg(F.max(F.when(F.col("left"), F.col("part_f"))).alias("l"),
                   F.max(F.when(~F.col("left"), F.col("part_f"))).alias("r")))
    for name in ("a", "l", "r"):
        scored = scored.withColumn(f"{name}_", F.col(name).cast("decimal(16,0)"))
    scored = scored.withColumn("score", F.expr("(a_ * a_ * 1000000BD) div (l_ * r_)"))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    # The largest count of a longer phrase around each shorter one.
    inner = long_.filter(size > 2).withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
    inner = inner.withColumn("s", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    around = (inner.select("lang", _part("w", F.col("s"), F.col("m")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("around")))
    kept = best.join(around, ["lang", "phrase"], "left").filter(
        "around IS NULL OR 100 * around < %d * a" % cover)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    short = (salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top))
    ranked = (short.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
