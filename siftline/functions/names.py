"""Company-name normalisers and the fuzzy match score."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.text import strip, text_or_empty

_LETTERS = "a-zæøåöäü0-9"


def _denoised(name: Column) -> Column:
    out = F.lower(text_or_empty(name))
    for pattern in V.COMPANY_NOISE:
        out = F.regexp_replace(out, "(?U)" + pattern, "")
    return out


def company_key(name: Column) -> Column:
    """Letters and digits of a company name without legal forms and other noise."""
    return F.regexp_replace(_denoised(strip(text_or_empty(name))), f"[^{_LETTERS}]", "")


def anglicise(c: Column) -> Column:
    out = F.lower(c)
    for letter, plain in V.ANGLICISED:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def core_words(name: Column) -> Column:
    """Distinct words of a company name longer than one letter."""
    found = F.regexp_extract_all(_denoised(name), F.lit(f"[{_LETTERS}]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) > 1))


def name_forms(name: Column) -> Column:
    """All derived forms of a name in one struct, computed once per row."""
    key, core = company_key(name), core_words(name)
    return F.struct(key.alias("key"), anglicise(key).alias("ang"), core.alias("words"),
                    F.array_distinct(F.transform(core, anglicise)).alias("words_ang"))


def company_match_score(q: Column, n: Column) -> Column:
    """Match score 0-100 of a query's ``name_forms`` against an entry's."""
    q_len, n_len = F.length(q["key"]), F.length(n["key"])
    shared = F.arrays_overlap(q["words"], n["words"])
    shared_ang = F.arrays_overlap(q["words_ang"], n["words_ang"])

    def part(inner: Column, outer: Column) -> Column:
        return (F.lit(80) + F.floor(F.try_divide(inner, outer) * 10)).cast("int")

    short_q = (q_len <= 4) & (F.try_divide(q_len, n_len) < 0.5)
    short_n = (n_len <= 4) & (F.try_divide(n_len, q_len) < 0.5)
    q_in_n = n["key"].contains(q["key"]) & (~short_q | shared)
    n_in_q = q["key"].contains(n["key"]) & ~short_n
    a, b = F.length(q["ang"]), F.length(n["ang"])
    short_ang = (F.least(a, b) <= 4) & (F.try_divide(F.least(a, b), F.greatest(a, b)) < 0.5)
    ang_part = ((n["ang"].contains(q["ang"]) | q["ang"].contains(n["ang"]))
                & (~short_ang | shared_ang))
    both = F.size(F.array_intersect(q["words"], n["words"]))
    both_ang = F.size(F.array_intersect(q["words_ang"], n["words_ang"]))
    n_q = F.size(q["words"])
    overlap = F.when(both > 0, both).otherwise(both_ang)
    return (F.when((q_len == 0) | (n_len == 0), 0)
            .when(q["key"] == n["key"], 100)
            .when(q_in_n, part(q_len, n_len))
            .when(n_in_q, part(n_len, q_len))
            .when(q["ang"] == n["ang"], 85)
            .when(ang_part, 75)
            .when((n_q == 0) | (F.size(n["words"]) == 0) | (overlap == 0), 0)
            .when(n_q == 1, 70)
            .otherwise((F.lit(30) + F.floor(F.try_divide(overlap, n_q) * 40)).cast("int")))
