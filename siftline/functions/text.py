"""Text normalisers and regex helpers, all as native column expressions."""

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.strip understands it; Spark's own trim cuts blanks only.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SENTENCE_END = r"[.;!?\n\r•|]+"
ELLIPSIS = "…"


def text_or_empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Empty after stripping counts as missing."""
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """Every run of whitespace becomes one blank, ends trimmed."""
    odd = WHITESPACE.replace(" ", "")
    return F.btrim(F.regexp_replace(F.translate(c, odd, " " * len(odd)), " {2,}", " "))


def _quoted(char: str) -> str:
    return char if char.isalnum() or char in " -/&" else re.escape(char)


def any_of(phrases) -> str:
    """One pattern that matches any of the literal phrases.

    Phrases with a common start share it: Java tries the branches of an alternation one by one, so
    a long flat list costs a comparison per phrase at every position of the text.
    """
    words_, ends = {}, False
    for p in phrases:
        if p == "":
            ends = True
        else:
            words_.setdefault(p[0], []).append(p[1:])
    branches = [_quoted(c) + (any_of(rest) if rest != [""] else "")
                for c, rest in sorted(words_.items())]
    if not branches:
        return ""
    one = len(branches) == 1 and not ends
    return branches[0] if one else "(?:" + "|".join(branches) + ")" + ("?" if ends else "")


def either(patterns) -> str:
    """One alternation of regular expressions."""
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def on_line(pattern: str) -> str:
    """A pattern for ``gate_lines``: its white space is a blank, so no match leaves a sentence."""
    return pattern.replace(r"\s", " ")


def on_raw_line(pattern: str) -> str:
    """A pattern for raw lines: any white space but a line's end."""
    return pattern.replace(r"\s", r"[^\S\n]")


def contains_any(c: Column, phrases) -> Column:
    """True when any literal phrase is a substring."""
    hit = F.lit(False)
    for p in phrases:
        hit = hit | c.contains(p)
    return hit


def _pad(c: Column) -> Column:
    return F.concat(F.lit(" "), F.btrim(c), F.lit(" "))


def _only_words(low: Column, keep: str = "") -> Column:
    """Runs of anything but ``a-z 0-9`` and ``keep`` become one blank, in lower-case text.

    Kept marks stand in as capital letters, which lower-case text has none of, so the regex is the
    predefined ``\\W`` class; a custom class costs several times as much.
    """
    stand_in = "ABCDEFGH"[:len(keep)]
    marked = F.translate(low, keep + "_", stand_in + " ")
    spaced = F.regexp_replace(marked, r"\W+", " ")
    return F.translate(spaced, stand_in, keep) if keep else spaced


def words(c: Column) -> Column:
    """Lower-cased words between single blanks, padded; accented letters become blanks."""
    return _pad(_only_words(F.lower(text_or_empty(c))))


def axis_text(c: Column) -> Column:
    """Like ``words`` but keeps ``&`` and ``+``."""
    return _pad(_only_words(F.lower(text_or_empty(c)), "&+"))


@lru_cache(maxsize=None)
def _fold_tables():
    """Compatibility decompositions that end in ASCII, from the Unicode database.

    One-character results go to a ``translate`` table. Longer results of Latin ligatures and
    numerals are replaced one by one, behind a test that such a character occurs at all.
    """
    src, dst, longer = [], [], {}
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch)
                        if not unicodedata.combining(x))
        if 0x2010 <= cp <= 0x2015 or cp == 0x2212 or plain in ("‐", "‑"):
            plain = "-"
        if not plain or plain == ch or not plain.isascii():
            continue
        if len(plain) == 1:
            src.append(ch)
            dst.append(plain)
        elif plain.isalpha() and (cp < 0x0250 or 0x2100 <= cp < 0x2190 or 0xFB00 <= cp <= 0xFB06):
            longer[ch] = plain
    longer.update({"¼": "1 4", "½": "1 2", "¾": "3 4"})
    return "".join(src), "".join(dst), longer


def fold(c: Column) -> Column:
    """Strip accents and compatibility forms, fold every dash to ``-``."""
    src, dst, longer = _fold_tables()
    spelled = c
    for ch, plain in longer.items():
        spelled = F.replace(spelled, F.lit(ch), F.lit(plain))
    near = r"[\u00bc-\u00be\u0132-\u0149\u01c4-\u01f3\u2100-\u218f\ufb00-\ufb06]"
    spelled = F.when(c.rlike(near), spelled).otherwise(c)
    folded = F.regexp_replace(F.translate(spelled, src, dst), r"\p{M}+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def gate_text(c: Column) -> Column:
    """Folded lower-case text that keeps ``+ - / &``, padded."""
    return _pad(_only_words(F.lower(fold(text_or_empty(c))), "+-/&"))


def gate_lines(c: Column) -> Column:
    """``gate_text`` of every sentence, one padded line per sentence.

    Line *i* belongs to piece *i* of ``split(text, SENTENCE_END)``, so a hit on a line can be
    quoted from the raw text. One string, not an array: a test of the form "some sentence has A
    and not B" is then a single multi-line regex that stays inside generated code.
    """
    one_line = F.regexp_replace(text_or_empty(c), SENTENCE_END, "\n")
    kept = _only_words(F.lower(fold(one_line)), "+-/&\n")
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(kept, " *\n *", " \n "), F.lit(" ")),
                    F.lit(" "))


def sentences(c: Column) -> Column:
    """Non-blank sentences."""
    return F.filter(F.split(text_or_empty(c), SENTENCE_END, -1), lambda s: s.rlike(r"(?U)\S"))


def line_of(lines: Column, pattern: str) -> Column:
    """Zero-based line on which the first match of a pattern starts."""
    head = F.substring(lines, F.lit(1), F.regexp_instr(lines, F.lit(pattern)) - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def raw_sentence(raw: Column, line: Column) -> Column:
    """The raw sentence that produced a line of ``gate_lines``."""
    return collapse(F.get(F.split(raw, SENTENCE_END, -1), line))


def excerpt(span: Column, trigger: str, size: int = 300) -> Column:
    """At most ``size`` characters of a span, centred on the first match of ``trigger``."""
    room = size - 2
    at = F.regexp_instr(span, F.lit(trigger))
    width = F.length(F.regexp_substr(span, F.lit(trigger)))
    middle = at - 1 + F.coalesce(width, F.lit(0)) / 2
    start = F.greatest(F.lit(0), F.floor(middle - room // 2)).cast("int")
    start = F.least(start, F.greatest(F.lit(0), F.length(span) - room))
    cut = F.concat(F.when(start > 0, ELLIPSIS).otherwise(""),
                   F.substring(span, start + 1, F.lit(room)),
                   F.when(start + room < F.length(span), ELLIPSIS).otherwise(""))
    return (F.when(F.length(span) <= size, span)
            .when(at == 0, F.substring(span, 1, size))
            .otherwise(cut))


def clip(c: Column, size: int) -> Column:
    """Collapse whitespace and cut to ``size`` characters, marking the cut."""
    flat = collapse(text_or_empty(c))
    return F.when(F.length(flat) <= size, flat).otherwise(
        F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit(ELLIPSIS)))


def context(text: Column, start: Column, width: Column, size: int = 140) -> Column:
    """A readable window of ``size`` characters around [start, start + width)."""
    pad = F.greatest(F.floor((F.lit(size) - width) / 2), F.lit(0)).cast("int")
    left = F.greatest(F.lit(0), start - pad)
    right = F.least(F.length(text), start + width + pad)
    return F.concat(F.when(left > 0, ELLIPSIS).otherwise(""),
                    F.btrim(F.substring(text, left + 1, right - left)),
                    F.when(right < F.length(text), ELLIPSIS).otherwise(""))


def around(before: int, after: int, pattern: str) -> str:
    """A pattern with its run-up in group 1, itself in group 2 and its run-out in the last group.

    The run-up is a look-behind of exactly ``before`` characters, or fewer from the line start, so
    neighbouring matches may share text. A look-ahead tests the pattern first: the look-behind is
    costly and must run at matches only.
    """
    plain = re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)
    return (f"(?m)(?={plain})(?<=(^.{{0,{before - 1}}}|.{{{before}}}))({pattern})"
            f"(?=(.{{0,{after}}}))")


def first_in_order(text: Column, phrases, before: str = r"(?<![a-z0-9])",
                   after: str = r"(?![a-z0-9])") -> Column:
    """The first listed phrase that occurs anywhere, or null.

    A zero-width look-ahead reports at each position the first listed phrase that starts there;
    the smallest list position over all of them is the first phrase of the list.
    """
    listed = "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for p in phrases)
    found = F.regexp_extract_all(text, F.lit(f"{before}(?=({listed}){after})"), F.lit(1))
    order = F.split(F.lit("|".join(phrases)), r"\|", -1)
    best = F.array_min(F.transform(found, lambda p: F.array_position(order, p)))
    return F.get(order, (best - 1).cast("int"))
