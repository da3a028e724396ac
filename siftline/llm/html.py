"""Main text of pages by equivalence classes of template tokens.

Tokens of a page are its tags with the path of blocks above them, and its texts. Across the pages
of a host, tokens with the same occurrence vector form a class; vectors are compared by an
order-free fingerprint that partial sums can build, so a host of any size costs one row a token.
Large, frequent classes whose tokens come once a page, in one order, nest into the host's template.
Its tokens cut a page into slots, and the slots that are not menus, notices and the like hold the
article.
"""

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import spread_join, stored

SUPPORT = 0.6
TEXT_SUPPORT = 0.9
TEXT_PAGES = 10

# Elements of the HTML standard and usual names of parts that are no article.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "head title script style noscript template svg math nav aside footer form button select "
    "textarea iframe object canvas dialog menu audio video".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disclaimer footer gdpr masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pagination paywall popup promo promoted related "
    "respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets"
    .split())
CLOSES_P = BLOCKS - {"br", "title", "head"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|textarea)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>|[^<]++|<",
    re.S | re.I)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")


def _marked(attributes: str) -> bool:
    if not attributes:
        return False
    return any(not MARKS.isdisjoint(_PART.findall("".join(m.groups("")).lower()))
               for m in _NAME.finditer(attributes))


def _events(page: str):
    """(kind, token, path, state, text) along a page; see ``walk``.

    The state is (hidden by an element, places of the marked parts above, in an article or main).
    """
    stack: list = []
    none = (False, (), ())

    def path():
        return "/".join(s[0] for s in stack)

    for place, m in enumerate(_TOKEN.finditer(page)):
        raw = m.group()
        if raw[0] != "<" or raw == "<":
            yield "text", None, path(), stack[-1][1] if stack else none, raw
            continue
        name = (m.group(3) or "").lower()
        if not name or (name not in BLOCKS and name not in HIDDEN):
            continue
        if m.group(2):
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][2] == name), -1)
            if at >= 0:
                state = stack[at][1]
                del stack[at:]
                yield "close", "/" + name, path(), state, ""
            elif name == "p":
                yield "close", "/p", path(), stack[-1][1] if stack else none, ""
            continue
        if name in CLOSES_P:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][2] == "p"), -1)
            if at >= 0:
                del stack[at:]
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and \
                stack[-1][2] == name:
            stack.pop()
        attributes = m.group(4) or ""
        mark = name not in ("html", "body", "article", "main", "p") and _marked(attributes)
        hidden, marks, inside = stack[-1][1] if stack else none
        hidden = hidden or name in HIDDEN or (name == "header" and not inside)
        if name in ("article", "main"):
            inside = (*inside, (place, marks))
        state = (hidden, (*marks, place) if mark else marks, inside)
        label = name + (".x" if mark else "")
        yield "open", label, path(), state, ""
        if name not in VOID and not attributes.endswith("/"):
            stack.append((label, state, name))


def _holders(events: list) -> frozenset:
    """Places of the marked parts that contain the page's article; those hide nothing.

    The article is the article or main part with the most words of its own, where words under a
    further mark don't count; of equal ones the part with fewer marks above. A page without such
    parts has it where its first heading of the highest level stands, if no other words are more;
    where everything is marked, in the outermost part with the most words.
    """
    if not any(state[1] for _, _, _, state, _ in events):
        return frozenset()
    parts, words, heading = {}, {}, None
    for kind, token, _, (hidden, marks, inside), text in events:
        if hidden:
            continue
        if kind == "open" and token[:1] == "h" and token[1:2] in "123456" and len(token) > 1:
            if heading is None or token[1] < heading[0]:
                heading = (token[1], marks)
        if kind == "text":
            n = len(text.split())
            words[marks] = words.get(marks, 0) + n
            for part in inside:
                if part[1] == marks:
                    parts[part] = parts.get(part, 0) + n
    if any(parts.values()):
        return frozenset(max(parts, key=lambda p: (parts[p], -len(p[1]), -p[0]))[1])
    words = {m: n for m, n in words.items() if n}
    top = heading[1] if heading else ()
    if top and words.get(top, 0) > max(
            (n for m, n in words.items() if m != top and len(m) <= len(top)), default=0):
        return frozenset(top)
    if words and () not in words:
        return frozenset(max(words, key=lambda m: (-len(m), words[m], m)))
    return frozenset()


def walk(page: str):
    """(kind, token, path, hidden, text) along a page.

    kind: "open", "close" or "text". A block closes an open paragraph, an end tag closes what
    stands open in its element, stray end tags do nothing. Inline tags are no tokens. A marked part
    is hidden with all in it, unless it contains the article.
    """
    events = list(_events(page))
    holders = _holders(events)
    for kind, token, path, (hidden, marks, _), text in events:
        yield kind, token, path, hidden or any(m not in holders for m in marks), text


def squeeze(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def tokens(page: str) -> dict:
    """token -> (count, place of the first)."""
    found: dict = {}
    for place, (kind, token, path, hidden, text) in enumerate(walk(page)):
        if kind == "text":
            text = squeeze(text)
            if not text or hidden:
                continue
            token = "#" + text
        key = f"{token}@{path}"
        n, first = found.get(key, (0, place))
        found[key] = (n + 1, first)
    return found


def host_of(url) -> F.Column:
    """The host of a URL, lower case; a null or odd URL is a host of its own text."""
    bare = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    return F.when(bare != "", bare).otherwise(F.coalesce(url, F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, fixed): the ordered tokens of each host's template, its fixed texts."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for i in range(at, min(at + 256, batch.num_rows)):
                    out += [(i, k, n, p) for k, (n, p) in tokens(
                        batch.column("html")[i].as_py() or "").items()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array([x[0] for x in out], pa.int64()))
                       for c in ("host", "page")), pa.array([x[1] for x in out], pa.string()),
                     *(pa.array([x[k] for x in out], pa.int32()) for k in (2, 3))],
                    names=["host", "page", "token", "n", "place"])

    text = F.col("token").startswith("#")
    seen = pages.mapInArrow(run, "host string, page long, token string, n int, place int")
    # Texts go by digest: a token is short whatever the page holds.
    seen = seen.withColumn("token", F.when(text, F.concat(F.lit("#"), F.md5("token")))
                           .otherwise(F.col("token")))
    rows = seen.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("pages"),
        F.max("n").alias("most"), F.avg("place").alias("place"))
    totals = pages.groupBy("host").agg(F.count("*").alias("all"))
    rows = rows.join(totals, "host")
    once = (F.col("most") == 1) & (F.col("pages") >= SUPPORT * F.col("all"))
    fixed = F.col("token").startswith("#")
    frame = rows.filter(once & ~fixed).groupBy("host", "vector").agg(
        F.collect_list(F.struct("place", "token")).alias("members"))
    # A valid class has several tokens, which the tags of one element give already.
    frame = (frame.filter(F.size("members") > 1).groupBy("host")
             .agg(F.sort_array(F.flatten(F.collect_list("members")))["token"].alias("template")))
    texts = (rows.filter(once & fixed & (F.col("pages") >= TEXT_SUPPORT * F.col("all"))
                         & (F.col("all") >= TEXT_PAGES)).groupBy("host")
             .agg(F.collect_set("token").alias("fixed")))
    return frame.join(texts, "host", "full_outer")


def slots(page: str, template: list) -> list:
    """[(opening token, blocks)] of a page cut at its template's tokens.

    Blocks are (text, hidden, in an article). Tokens out of the template's order don't cut.
    """
    order = {t: i for i, t in enumerate(template)}
    last, out, words, state = -1, [["", []]], [], (False, False)

    def flush():
        text = squeeze("".join(words))
        if text:
            out[-1][1].append((text, *state))
        words.clear()

    for kind, token, path, hidden, text in walk(page):
        if kind == "text":
            parts = path.split("/")
            now = (hidden, "article" in parts or "main" in parts)
            if words and now != state:
                flush()
            state = now
            words.append(text)
            continue
        flush()
        place = order.get(f"{token}@{path}", -1)
        if place > last:
            last = place
            out.append([template[place], []])
    flush()
    return out


def _is(token: str, names: tuple) -> bool:
    return token.split("@")[0] in names


def main_text(page: str, template: list, fixed: set, digest) -> str:
    """Blocks of the slots that hold the article, joined by newlines.

    Those are the slots between the template's tokens of an article or main part. Where a page
    has none in its template, its own such parts count, else all slots. Hidden parts inside a slot
    and texts fixed in the template are left out.
    """
    cut = slots(page, template)
    opens = [i for i, (t, _) in enumerate(cut) if _is(t, ("article", "main"))]
    closes = [i for i, (t, _) in enumerate(cut) if _is(t, ("/article", "/main"))]
    if opens:
        article = cut[opens[0]:max([c for c in closes if c > opens[0]], default=len(cut))]
        chosen = [b for _, blocks in article for b in blocks]
    else:
        every = [b for _, blocks in cut for b in blocks]
        chosen = [b for b in every if b[2]] or every
    return "\n".join(t for t, hidden, _ in chosen
                     if not hidden and not (fixed and digest(t) in fixed))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Null html is empty and gives an empty text. A host with one page has that page's own tags as
    template; repeated rows are pages of their own.
    """
    import hashlib

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    found = stored(templates(rows.select("host", F.xxhash64("id", "url").alias("page"), "html")))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        def digest(text):
            return "#" + hashlib.md5(b"#" + text.encode("utf-8", "surrogatepass")).hexdigest()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py() or "", t.as_py() or [], set(f.as_py() or ()), digest)
                         for h, t, f in zip(part.column("html"), part.column("template"),
                                            part.column("fixed"), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["id", "url", "text", "n_chars"])

    return spread_join(rows, found, ["host"], F.xxhash64("id", "url"), "left").select(
        "id", "url", "html", "template", "fixed").mapInArrow(
        run, f"id {kind}, url string, text string, n_chars long")
