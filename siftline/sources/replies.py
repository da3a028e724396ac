"""JSON out of noisy replies."""

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftline.functions.text import strip, text_or_empty

# Executors need no copy of this package: the helper below carries its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _valid(text: Column) -> Column:
    """The text if it parses as JSON, as a string; null otherwise."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def recovered_array(reply: Column) -> Column:
    """Bare array, else from the first ``[`` to the last ``]``, else null; ``[]`` stays ``[]``.

    A reply that is valid JSON but no array is null, not searched further.
    """
    text = strip(text_or_empty(reply))
    whole = F.try_parse_json(text)
    inner = F.regexp_substr(text, F.lit(r"(?s)\[.*\]"))
    return (F.when(whole.isNotNull(), F.when(text.startswith("["), text))
            .otherwise(_valid(inner)))


def recovered_report(reply: Column) -> Column:
    """Whole text, else a fenced block, else a greedy array or object."""
    text = strip(text_or_empty(reply))
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1), F.lit(""))
    greedy = F.nullif(F.regexp_extract(text, r"(?s)(\[.*\]|\{.*\})", 1), F.lit(""))
    return F.coalesce(_valid(F.nullif(text, F.lit(""))), _valid(fenced), _valid(greedy))


# A whole string, a brace, or the quote of a string without an end.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}]|"', re.S)
# A brace that JSON may go on from.
_START = re.compile(r'\{(?=[ \t\n\r]*["}])')
MOST_DEPTH = 1000
# The decoder counts lines up to an error, so what lies further behind is cut off before.
_BEHIND = 1 << 15


def _heights(text: str, start: int, end: int) -> tuple[dict, list]:
    """How deep objects nest in each object of a span that closes there, and the braces left open."""
    heights, open_ = {}, []
    for token in _TOKEN.finditer(text, start, end):
        if token[0] == "{":
            open_.append([token.start(), 1])
        elif token[0] == "}" and open_:
            at, height = open_.pop()
            heights[at] = height
            if open_:
                open_[-1][1] = max(open_[-1][1], height + 1)
        elif token[0] == '"':
            break
    return heights, [at for at, _ in open_]


def first_object(text: str) -> str | None:
    """The first JSON object of a text, braces tried left to right; null without one.

    A parse that fails rules out all braces that were open where it failed, since each of them would
    fail at that very place; objects it had completed are found at once. So no stretch of text is
    parsed again and again, however many braces it has. Objects that nest deeper than 1,000 do not
    count.
    """
    parse = json.JSONDecoder(parse_int=float).raw_decode
    ruled_out, base, rest = set(), 0, text
    for found in _START.finditer(text):
        at = found.start()
        if at in ruled_out:
            continue
        if at - base > _BEHIND:
            base, rest = at, text[at:]
        try:
            end = base + parse(rest, at - base)[1]
            if (text.count("{", at, end) <= MOST_DEPTH
                    or _heights(text, at, end)[0][at] <= MOST_DEPTH):
                return text[at:end]
        except json.JSONDecodeError as error:
            ruled_out.update(_heights(text, at, base + error.pos)[1])
        except RecursionError:
            heights, open_ = _heights(text, at, len(text))
            ruled_out.update(open_, (x for x, h in heights.items() if h > MOST_DEPTH))
    return None


@F.arrow_udf(StringType())
def _first_objects(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else first_object(t) for t in texts.to_pylist()],
                    pa.string())


def recovered_object(reply: Column) -> Column:
    """The first object: from a brace to the brace that closes it, braces tried left to right.

    Each text is read in time linear in its length (a batch helper in Python; a native fold has no
    way to give up a stretch of text). Replies without an object are null and can be set aside.
    """
    return _first_objects(text_or_empty(reply))


def is_quarantined(reply: Column, recovered: Column) -> Column:
    """A non-blank reply nothing could be recovered from."""
    return (strip(text_or_empty(reply)) != "") & recovered.isNull()
