"""URL filter: a weighted vocabulary found by Aho-Corasick, with host and path rules above it.

One automaton holds the strict and the soft terms. A hit counts where the term stands as a whole
word: no letter right before or after it. One strict term rejects an address, soft terms do so from
a number of different ones on; repeats of one soft term count once. The automaton walks over all
addresses of a batch at once, so Python is entered only for hits.
"""

from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

STRICT = ("casino", "porn", "xxx", "viagra", "cialis", "escort", "escorts", "hentai", "milf",
          "phishing", "malware", "spam", "warez")
SOFT = ("ad", "ads", "adult", "bet", "bets", "betting", "bonus", "buy", "cheap", "click", "coupon",
        "crack", "deal", "deals", "dating", "discount", "farm", "free", "gambling", "hot", "jackpot",
        "loan", "loans", "pill", "pills", "poker", "popup", "prize", "promo", "seo", "sex", "slot",
        "slots", "track", "tracker", "tracking", "win", "winner", "x")

# What parts two addresses of a batch; it is no letter and occurs in no term.
_GAP = "\n"
_SLICE = 1 << 22


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def term_hits(rows: DataFrame, text: str, strict: Iterable[str] = STRICT,
              soft: Iterable[str] = SOFT) -> DataFrame:
    """``rows`` with ``strict_hits`` and ``soft_hits``: how many different terms stand in ``text``.

    Letters A-Z of the text are lower-cased; terms are of a-z. A term counts where no a-z stands
    right before or after it, so overlapping and longer terms do not hide each other. A term in both
    lists is strict. Null text has no hit.
    """
    strict, soft = set(strict), set(soft)
    terms = sorted(strict) + sorted(soft - strict)
    if any(not t.isascii() or not t.isalpha() or t != t.lower() for t in terms):
        raise ValueError("terms are words of the letters a to z")
    first_soft = len(strict)

    def build():
        found = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            found.add_word(term, (number, len(term)))
        found.make_automaton()
        return found

    def count(automaton, texts: list) -> tuple[np.ndarray, np.ndarray]:
        joined = _GAP.join(t.lower() if t.isascii() else _lowered(t) for t in texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        hits = set()
        for end, (number, length) in automaton.iter(joined):
            before, after = end - length, end + 1
            if ((before < 0 or not "a" <= joined[before] <= "z")
                    and (after == len(joined) or not "a" <= joined[after] <= "z")):
                hits.add((int(np.searchsorted(start, before + 1, "right")) - 1, number))
        row, number = np.array(sorted(hits), np.int64).reshape(-1, 2).T
        return tuple(np.bincount(row[part], minlength=len(texts)).astype(np.int32)
                     for part in (number < first_soft, number >= first_soft))

    def step(batches):
        automaton = build() if terms else None
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            counts, at = [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= _SLICE):
                    size += len(texts[to])
                    to += 1
                none = np.zeros(to - at, np.int32)
                counts.append(count(automaton, texts[at:to]) if terms else (none, none))
                at = to
            strict_, soft_ = (np.concatenate([c[k] for c in counts]) if counts
                              else np.zeros(0, np.int32) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(strict_), pa.array(soft_)],
                [*batch.schema.names, "strict_hits", "soft_hits"])

    kept = rows.drop("strict_hits", "soft_hits")
    hits = [StructField(x, IntegerType()) for x in ("strict_hits", "soft_hits")]
    return kept.mapInArrow(step, StructType([*kept.schema.fields, *hits]))


def _lowered(text: str) -> str:
    """A-Z lower-cased, one character for one: other letters may change their length."""
    return text.translate(_CASE)


_CASE = {c: c + 32 for c in range(65, 91)}


def longest_rule(host: Column, path: Column, rules: Iterable[tuple]) -> Column:
    """Struct (rule, verdict) of the longest rule (host, path, verdict) that fits; else null.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long ones
    the longer host wins, then ``block``. Rules are a parameter of the plan, each one an expression:
    meant for some hundred.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(ordered):
        fits = (((host == rule_host) | host.endswith("." + rule_host))
                & path.startswith(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"),
                                      F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, rules: Iterable[tuple] = (), id_col: str = "page_id",
               url_col: str = "url", strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT,
               most_soft: int = 1) -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_hits), a row for each row of ``pages``.

    ``verdict`` is that of the longest rule that fits, else ``block`` for a strict term or more than
    ``most_soft`` different soft terms in host and path, else ``allow``. A null address or one
    without ``://`` has empty host and path and no hit, so it is allowed. Null and repeated ids and
    repeated rows stay as they are; an empty table gives no rows; other columns are not read. Long
    addresses are searched whole. No shuffle: a pass over the address column.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"),
                        path_of(url).alias("path"))
    rows = rows.withColumn("seen", F.concat("host", "path"))
    rows = term_hits(rows, "seen", strict, soft).drop("seen")
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") > most_soft), "block").otherwise(
        "allow")
    return (rows.withColumn("found", rule)
            .select("id", "host", "path", F.col("found.rule").alias("rule"),
                    F.coalesce("found.verdict", own).alias("verdict"), "strict_hits", "soft_hits"))
