"""Spelling variants by pivotal grams: words one edit apart, found without comparing all pairs.

Every word has its bigrams sorted by how rare they are. The three rarest make its prefix, and among
them two that do not overlap, chosen by dynamic programming to be the rarest such pair, are its
pivots. One edit can spoil only one of two disjoint pivots. So of two words one edit apart, the one
whose prefix ends at the rarer bigram has a pivot that the other one holds too, at the same place
or one beside it, and holds in its prefix. Pivots are looked up in prefixes by bigram, place and
length; what meets there is verified by edit distance.

The bigrams of Latin letters without case are at most 8,100, so their counts are sent to all tasks.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import IS_LETTER, LOWER, runs, spread_join, stored, text_slices

# A letter here is A-Z, a-z or U+00C0 to U+00FF, which UTF-8 writes as C3 and one more byte.
_ASCII = IS_LETTER.copy()
_ASCII[128:] = False
_LONG = 64
# The usual table of the byte-wise checksum.
_TABLE = np.zeros(256, np.uint32)
for _k in range(256):
    _c = _k
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _TABLE[_k] = _c


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of the bytes [start, end) of each run, going on from the checksum ``state``."""
    out = state.copy()
    length = end - start
    for k in np.flatnonzero(length > _LONG):
        out[k] = zlib.crc32(data[start[k]:end[k]].tobytes(), int(state[k]))
    rest = np.flatnonzero(length <= _LONG)
    rest = rest[np.argsort(-length[rest], kind="stable")]
    now, at, sizes = ~state[rest], start[rest], length[rest]
    for j in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -j, "left"))
        now[:n] = _TABLE[(now[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (now[:n] >> np.uint32(8))
    out[rest] = ~now
    return out


def misspelt(data: np.ndarray, offsets: np.ndarray, ids: list, every: int, least: int):
    """(word, count): the long words of texts after the planted deletions, and how often."""
    data = LOWER[data]
    lead = data == 0xC3
    member = _ASCII[data] | lead
    member[1:] |= lead[:-1]
    start, end, text = runs(member, offsets)
    tail = np.concatenate(([0], np.cumsum(member & (data >= 0x80) & (data < 0xC0))))
    chars = (end - start) - (tail[end] - tail[start])
    long_ = chars >= least
    start, end, text, chars = start[long_], end[long_], text[long_], chars[long_]
    head = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = checksums(data, start, end, head[text])
    hit = np.flatnonzero(h % np.uint32(every) == 0)
    drop = np.zeros(len(data), bool)
    for k in hit:
        at = start[k] + np.flatnonzero((data[start[k]:end[k]] & 0xC0) != 0x80)
        place = int(h[k]) % len(at)
        drop[at[place]:at[place + 1] if place + 1 < len(at) else end[k]] = True
    chars[hit] -= 1
    fine = chars >= least
    keep = np.zeros(len(data) + 1, np.int8)
    keep[start[fine]] += 1
    keep[end[fine]] -= 1
    inside = (np.cumsum(keep)[:-1] > 0) & ~drop
    sizes = np.concatenate(([0], np.cumsum(inside)))
    at = np.concatenate(([0], np.cumsum(sizes[end[fine]] - sizes[start[fine]])))
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    return pc.value_counts(words)


def long_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", every: int = 31,
               least: int = 7, often: int = 2) -> DataFrame:
    """(word, n): runs of Latin letters of at least ``least`` code points and ``often`` occurrences.

    Runs are lower-cased in A-Z. Of each run whose crc32 of ``<id>:<run>`` is divisible by ``every``
    a code point is left out, the one at the checksum modulo the run's length; counts are taken
    after that. Null text has no run, a null id counts as empty text in the checksum; repeated rows
    are rows of their own, an empty table has no words, other columns are not read. A long text or
    run is read whole.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.col(text_col).alias("text")).filter(F.length("text") >= least)

    def step(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, last, data, offsets in text_slices(batch.column("text"), 1 << 22):
                found = misspelt(data, offsets, ids[first:last], every, least)
                yield pa.RecordBatch.from_arrays(
                    [found.field("values").cast(pa.large_string()).cast(pa.string()),
                     found.field("counts")], ["word", "n"])

    return (rows.mapInArrow(step, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).filter(F.col("n") >= often))


_GRAMS = ("word string, n long, size int, last string, letters long, "
          "pivots array<struct<gram:string,place:int>>, prefix array<struct<gram:string,place:int>>")


def pivots_of(places: list, cost: list, edits: int) -> list:
    """The cheapest ``edits`` + 1 of the sorted places that lie two or more apart.

    best[k][i]: the least cost of k places among the first i, the last of them taken or left out.
    """
    n = len(places)
    before = [sum(p <= places[i] - 2 for p in places[:i]) for i in range(n)]
    best = [[(0, ())] * (n + 1)] + [[None] * (n + 1) for _ in range(edits + 1)]
    for k in range(1, edits + 2):
        for i in range(1, n + 1):
            options = [x for x in (best[k][i - 1],) if x is not None]
            earlier = best[k - 1][before[i - 1]]
            if earlier is not None:
                options.append((earlier[0] + cost[i - 1], (*earlier[1], places[i - 1])))
            best[k][i] = min(options, default=None)
    return list(best[edits + 1][n][1])


def grams_of(words: DataFrame, counts: dict, edits: int = 1) -> DataFrame:
    """(word, n, size, last, letters, pivots, prefix) of words of at least 2 edits + 2 code points.

    ``last`` is the sorting key of the least rare bigram of the prefix. All places of that bigram
    belong to the prefix, so that comparing ``last`` also holds for repeated bigrams.
    """
    sent = words.sparkSession.sparkContext.broadcast(counts)

    def step(batches):
        known = {g: f"{n:020d}{g}" for g, n in sent.value.items()}
        freq = sent.value
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                keys = sorted((known[word[i:i + 2]], i) for i in range(len(word) - 1))
                last = keys[2 * edits][0]
                prefix = [i for key, i in keys if key <= last]
                near = sorted(i for _, i in keys[:2 * edits + 1])
                pivots = pivots_of(near, [freq[word[i:i + 2]] for i in near], edits)
                letters = 0
                for c in word:
                    letters |= 1 << (ord(c) * 0x9E3779B1 >> 7) % 63
                out.append((len(word), last, letters,
                            [{"gram": word[i:i + 2], "place": i} for i in pivots],
                            [{"gram": word[i:i + 2], "place": i} for i in prefix]))
            size, last, letters, pivots, prefix = zip(*out) if out else ((),) * 5
            grams = pa.list_(pa.struct([("gram", pa.string()), ("place", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(size, pa.int32()),
                 pa.array(last, pa.string()), pa.array(letters, pa.int64()),
                 pa.array(pivots, grams), pa.array(prefix, grams)],
                ["word", "n", "size", "last", "letters", "pivots", "prefix"])

    return words.select("word", "n").mapInArrow(step, _GRAMS)


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words one insertion, deletion or replacement apart, once.

    ``words`` has distinct words of at least 4 code points and their counts. They meet by (bigram,
    place, length); a word looks up its two rarest bigrams only, so frequent ones have short lists.
    """
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.length("word") - 2),
                                  lambda i: F.substring(F.col("word"), i + 1, F.lit(2))))
    counts = {r.gram: r.n for r in words.select(pairs.alias("gram")).groupBy("gram")
              .agg(F.count("*").alias("n")).toLocalIterator()}
    rows = stored(grams_of(words, counts))
    prefix = rows.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("size"),
                         F.col("last").alias("b_last"), F.col("letters").alias("b_letters"),
                         F.inline("prefix"))
    # An edit behind the bigram leaves its place, one before it moves it with the length.
    shifts = F.array(*(F.struct(F.lit(s).alias("longer"), F.lit(p).alias("moved"))
                       for s, p in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))))
    pivots = rows.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "size",
                         F.col("last").alias("a_last"), F.col("letters").alias("a_letters"),
                         F.inline("pivots"))
    pivots = pivots.select("*", F.inline(shifts)).select(
        "a", "a_n", "a_last", "a_letters", "gram", (F.col("place") + F.col("moved")).alias("place"),
        (F.col("size") + F.col("longer")).alias("size"))
    met = prefix.join(pivots, ["gram", "place", "size"])
    # A word whose prefix ends at the same bigram meets the other from both sides.
    met = met.filter((F.col("a") != F.col("b")) & (F.col("a_last") <= F.col("b_last"))
                     & (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2))
    met = met.filter(F.levenshtein("a", "b", 1) == 1)
    swap = F.col("a") > F.col("b")
    return met.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("b_n")).otherwise(F.col("a_n")).alias("a_n"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.when(swap, F.col("a_n")).otherwise(F.col("b_n")).alias("b_n")).distinct()


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root): each word, its near words and the form it varies.

    The form is the near word with the largest count (ties: the first in code-point order) if that
    is at least ``times`` the word's own; ``root`` follows forms to the last one. Counts grow
    tenfold with each form, so chains are short; they are halved each round all the same. Words
    without a near word have ``n_near`` 0, no form and themselves as root; no words, no rows.
    """
    words = stored(words)
    pairs = stored(near_words(words))
    both = pairs.select(F.inline(F.array(*(
        F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"),
                 F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("form")).alias("other"))
        for x, y in (("a", "b"), ("b", "a"))))))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("other").alias("o"))
    best = stored(best.select("word", "n_near", "o.form", (-F.col("o.less")).alias("form_n"),
                              (F.col("n") * times).alias("bar")))
    has = F.col("form_n") >= F.col("bar")
    steps = stored(best.filter(has).select("word", F.col("form").alias("root")))
    while True:
        # Every word jumps to where its root points.
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(spread_join(steps, on, ["root"], F.col("word"), "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return (words.join(best, "word", "left").join(steps, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                    F.when(has, F.col("form")).alias("form"),
                    F.when(has, F.col("form_n")).alias("form_n"),
                    F.coalesce("root", "word").alias("root")))
