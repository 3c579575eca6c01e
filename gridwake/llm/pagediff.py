"""Main text of web pages by differencing pages of near URLs.

A page is cut into lines: the text of block elements, character references decoded, white space
collapsed. Each page meets the page with which its URL path shares most leading segments within
the host (ties: the least or greatest content hash, whichever differs from its own), their lines
are aligned by longest common subsequence, and shared lines are deleted.

Two articles can share a passage or be one text (mirrors, reprints), so lines inside `article` or
`main` are deleted as shared only if up to six further pages, drawn over the host by hash, have
them all, there are at least three differing pages to compare with, and such lines are less than
half of the article. The markup is a check after the differencing: lines inside menus, headers,
footers, sidebars, notices, adverts, forms and reader comments always go, and lines that are
neither shared nor so marked stay, whether the page has an article or not.

Partners are found by grouping URL prefixes, least and greatest page combined before the shuffle;
a host with a third of the pages is one small row per prefix. Prefixes, pages and lines travel for it
as 64-bit hashes.

Cases: null pages and pages without text give ''; null or odd URLs form a host of their own; a page
without a differing partner keeps its unshared lines; unclosed and cut-off markup is read as far
as it goes; rows equal in id, URL and page are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.session import stage

#: HTML element names by role, and words in class, id or role attributes that mark boilerplate.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("aside button dialog footer form head menu nav".split())
INSIDE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disclaimer "
    "discussion footer form header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "promotion related recommended reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|select|svg|iframe|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Kinds of lines.
OPEN, KEPT, GONE = 0, 1, 2
#: Share of an article's characters on all compared pages, from which these are taken for one text; pages to compare with at least.
REPRINT = 0.5
WITNESSES = 3


def _marked(attrs: str, inside: bool) -> bool:
    """Does an attribute mark boilerplate? A header inside an article is the article's own."""
    words = {p.lower() for groups in _MARKED.findall(attrs) for p in _PARTS.findall(" ".join(groups))}
    return bool(words & MARKS - ({"header"} if inside else set()))


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """Kind and text of every line of a page, in page order."""
    stack: list[tuple[str, int]] = []  # open elements with the kind of what they hold
    kind, pieces, out = OPEN, [], []

    def flush() -> None:
        if pieces:
            line = " ".join(html.unescape("".join(pieces)).split())
            if line:
                out.append((kind, line))
            pieces.clear()

    def close(name: str) -> None:
        nonlocal kind
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                kind = stack[-1][1] if stack else OPEN
                return
            if stack[k][0] in INSIDE | OUTSIDE and name not in INSIDE | OUTSIDE | {"body", "html"}:
                return

    for token in _TOKEN.finditer(page or ""):
        if token["text"] is not None:
            pieces.append(token["text"])
            continue
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if token["close"]:
            close(name)
            continue
        if name in BLOCKS and any(n == "p" for n, _ in stack[-3:]):
            close("p")  # a block ends an open paragraph
        if name in VOID or token["attrs"].endswith("/"):
            continue
        inner = kind
        if kind != GONE:
            if name in INSIDE:
                inner = KEPT
            elif name in OUTSIDE or (name not in {"body", "html", *HEADINGS} and _marked(token["attrs"], kind == KEPT)):
                inner = GONE
            elif name == "header":
                inner = GONE if kind == OPEN else kind
        stack.append((name, inner))
        kind = inner
    flush()
    return out


def shared_places(mine: list[int], other: list[int]) -> list[int]:
    """Places of a longest common subsequence, in `mine`; common ends are matched first."""
    head = 0
    while head < len(mine) and head < len(other) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(mine), len(other)) - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    a, b = mine[head : len(mine) - tail], other[head : len(other) - tail]
    both = set(a) & set(b)
    pa, pb = [k for k, x in enumerate(a) if x in both], [x for x in b if x in both]
    where: dict[int, list[int]] = {}
    for j, y in enumerate(pb):
        where.setdefault(y, []).append(j)
    ends, chains = [], []  # per length the least end in pb of a common subsequence, and its places
    for k in pa:
        for j in reversed(where[a[k]]):
            n = bisect_left(ends, j)
            if n == len(ends):
                ends.append(j)
                chains.append(None)
            elif ends[n] == j:
                continue
            ends[n], chains[n] = j, (k, chains[n - 1] if n else None)
    middle, chain = [], chains[-1] if chains else None
    while chain:
        middle.append(chain[0])
        chain = chain[1]
    return [*range(head), *[head + k for k in reversed(middle)], *range(len(mine) - tail, len(mine))]


def page_lines(pages: DataFrame) -> DataFrame:
    """`key, content, lines, prefixes`: per distinct page the hashes of its lines, their hash, and depth and hash of its URL's prefixes."""

    @F.pandas_udf("array<string>")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[line for _, line in lines_of(p)] for p in batch], dtype=object)

    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")
    parts = F.split(F.regexp_replace(address, "/+$", ""), "/+")
    prefixes = F.transform(parts, lambda p, i: F.struct(i.alias("depth"), F.xxhash64(F.array_join(F.slice(parts, 1, i + 1), "/")).alias("prefix")))
    rows = pages.select("key", prefixes.alias("prefixes"), texts("html").alias("texts"))
    hashed = rows.select("key", "prefixes", F.transform("texts", lambda x: F.xxhash64(x)).alias("lines")).dropDuplicates(["key"])
    return hashed.select("key", F.xxhash64("lines").alias("content"), "lines", "prefixes")


def shared_lines(pages: DataFrame) -> DataFrame:
    """`key, shared, general`: places of the lines that the nearest differing page shares, and of those that all compared pages of the host have too.

    Partners are chosen by their contents' hashes; lines are fetched once for the page that is chosen,
    and the lines common to the pages drawn over a host are worked out once per host.
    """
    own = stage(page_lines(pages))
    at = own.select("key", "content", F.explode("prefixes").alias("p")).select("key", "content", "p.*")
    drawn = [end(F.when(F.col("depth") == 0, F.struct(F.xxhash64("content", F.lit(seed)).alias("order"), "content"))) for seed in (1, 2) for end in (F.min, F.max)]
    names = [f"drawn{k}" for k in range(len(drawn))]
    ends = at.groupBy("prefix").agg(F.min("content").alias("low"), F.max("content").alias("high"), *[d.alias(n) for d, n in zip(drawn, names)]).filter("low <> high")
    some = F.array_distinct(F.array("low", "high", *[F.col(f"{n}.content") for n in names]))
    ends = stage(ends.select("prefix", "low", "high", F.when(F.col("drawn0").isNotNull(), some).alias("drawn")))
    contents = own.select("content", "lines").dropDuplicates(["content"])
    of_host = ends.select("prefix", F.explode("drawn").alias("content")).join(contents, "content").groupBy("prefix").agg(F.collect_list("lines").alias("pages"))  # six at most
    common = of_host.select("prefix", F.aggregate("pages", F.get("pages", F.lit(0)), F.array_intersect).alias("common"))
    met = at.join(ends.join(common, "prefix", "left"), "prefix")
    other = F.when(F.col("low") != F.col("content"), F.col("low")).otherwise(F.col("high"))
    offers = met.groupBy("key").agg(F.max_by(other, "depth").alias("other"), F.first("drawn", ignorenulls=True).alias("drawn"), F.first("common", ignorenulls=True).alias("common"))
    known = own.select("key", "content", "lines").join(offers, "key")
    others = F.size(F.filter("drawn", lambda c: (c != F.col("content")) & (c != F.col("other")))) + 1
    pairs = known.select("key", "lines", "other", "common", others.alias("n")).join(contents.select(F.col("content").alias("other"), F.col("lines").alias("theirs")), "other")

    @F.pandas_udf("struct<shared: array<int>, general: array<int>>")
    def shared(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            yield pd.DataFrame([_compared(list(a), list(b), set(c), n) for a, b, c, n in zip(*columns)], columns=["shared", "general"])

    return pairs.select("key", shared("lines", "theirs", "common", "n").alias("s")).select("key", "s.*")


def _compared(mine: list[int], other: list[int], common: set[int], n: int) -> tuple[list[int], list[int]]:
    """Places shared with the nearest page, and those of lines in `common`, if there are enough pages to compare with.

    A page that is itself among the drawn ones has all of its own lines, so `common` serves it too.
    """
    places = shared_places(mine, other)
    return places, [k for k in places if mine[k] in common] if n >= WITNESSES else []


def main_text(pages: DataFrame, page: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """Add `out`, and the numbers of lines deleted as shared and by the markup alone."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c in (url, page)])
    found = shared_lines(pages.select(key.alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("html")))

    @F.pandas_udf("struct<kinds: array<int>, texts: array<string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [lines_of(p) for p in batch]
            yield pd.DataFrame({"kinds": [[k for k, _ in lines] for lines in read], "texts": [["" if k == GONE else t for k, t in lines] for lines in read]})

    # only lines that may stay travel to the verdict, not the page
    rest = [c for c in pages.columns if c not in (out, "n_shared", "n_marked")]
    lines = pages.select(*[F.col(f"`{c}`") for c in rest], key.alias("__key"), cut(F.col(f"`{page}`")).alias("__cut"))
    joined = lines.join(found.select(F.col("key").alias("__key"), F.col("shared").alias("__shared"), F.col("general").alias("__general")), "__key", "left")

    @F.pandas_udf("struct<text: string, n_shared: long, n_marked: long>")
    def assemble(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        places = lambda p: set() if p is None else {int(x) for x in p}
        for columns in batches:
            made = [_assembled(list(k), list(t), places(s), places(g)) for k, t, s, g in zip(*columns)]
            yield pd.DataFrame(made, columns=["text", "n_shared", "n_marked"])

    made = joined.select(*[F.col(f"`{c}`") for c in rest], assemble("__cut.kinds", "__cut.texts", "__shared", "__general").alias("__made"))
    return made.select("*", F.col("__made.text").alias(out), "__made.n_shared", "__made.n_marked").drop("__made")


def _assembled(kinds: list[int], texts: list[str], shared: set[int], general: set[int]) -> tuple[str, int, int]:
    held = sum(len(text) for kind, text in zip(kinds, texts) if kind == KEPT)
    common = sum(len(texts[k]) for k in general if kinds[k] == KEPT)
    inside = general if common < REPRINT * held else set()
    kept, n_shared, n_marked = [], 0, 0
    for k, (kind, text) in enumerate(zip(kinds, texts)):
        if k in (inside if kind == KEPT else shared):
            n_shared += 1
        elif kind == GONE:
            n_marked += 1
        else:
            kept.append(text)
    return "\n".join(kept), n_shared, n_marked
