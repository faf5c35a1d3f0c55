"""Main text of web pages: markup where it speaks, repeats across a host's pages where not.

Each page becomes a stream of blocks. Markup decides about most of them: scripts,
menus, forms and the like go, an article's or main element's blocks stay. For the
others the token streams of a host's pages are concatenated and their suffixes
sorted; runs of ``DEPTH`` or more tokens that several distinct pages share are
boilerplate, and blocks covered by them go. Unique runs stay.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import kept, maybe_among
from corpusloom.llm.words import U, windows

# Suffixes are compared by so many tokens, block boundaries included.
DEPTH = 8
# Distinct pages that must share a run.
PAGES = 3
# Pages of one host whose streams are concatenated in one task.
GROUP_PAGES = 128
# Hosts with more pages than that are broadcast if they are no more than this.
MANY_HOSTS = 100_000

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
# Elements of HTML by what they mean for the text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav
    noscript ol optgroup option p pre search section select summary table tbody td template tfoot th
    thead tr ul""".split())
DROPPED = frozenset(
    "nav footer aside form noscript button select template dialog menu svg object canvas audio video search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BAD_NAMES = frozenset(
    """nav navbar navigation menu menus submenu header footer masthead topbar sidebar side aside rail ad ads
    adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos
    promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
    subscribe subscription signup login share sharing social related recommended recommendations
    breadcrumb breadcrumbs pagination pager widget widgets toolbar disqus reply replies respond
    skip disclaimer""".split())
GOOD_NAMES = frozenset("article content post entry story main text page wrapper container layout".split())
MAIN_NAMES = frozenset("article content post entry story main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block(NamedTuple):
    """``level``: -1 dropped, 0 undecided, 1 named like content, 2 in main, 3 in an article."""

    tag: str
    text: str
    level: int
    linked: int


def _level(name: str, attributes: str, above: int) -> int:
    if above < 0:
        return above
    names: list[str] = []
    role = ""
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip("/ \n\t\r") else ():
        value = (m[2] or "").strip("\"'").lower()
        kind = m[1].lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            return -1
        if kind == "role":
            role = value
        elif kind in ("class", "id"):
            names += re.split(r"[^a-z0-9]+", value)
    if name in DROPPED or (name == "header" and above < 3) or role in ROLES:
        return -1
    if any(x.startswith("comment") for x in names) and name not in ("body", "html", "main"):
        return -1
    good = GOOD_NAMES.intersection(names)
    if BAD_NAMES.intersection(names) and not good and name not in ("body", "html", "main", "article"):
        return -1
    if name == "article":
        return 3
    if name == "main" or role == "main":
        return max(above, 2)
    if MAIN_NAMES.intersection(names) and name in ("div", "section", "td"):
        return max(above, 1)
    return above


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; unclosed and unmatched tags are tolerated."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]
    parts: list[str] = []
    linked = 0
    tag = ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(tag, text, stack[-1][1], linked))
            parts.clear()
        linked = 0

    links = 0
    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        start = m.start() if m else end
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "img", "wbr", "input"):
                parts.append("" if name == "wbr" else " ")
            continue
        if name in BLOCK or name in DROPPED:
            flush()
            tag = name
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if any(s[1] != stack[i - 1][1] for s in stack[i:]):
                        flush()
                    del stack[i:]
                    break
            continue
        if name in BLOCK:  # a new block ends an open paragraph and what is open in it
            while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] not in BLOCK):
                stack.pop()
        if attributes.endswith("/") and name not in BLOCK:
            continue
        level = _level(name, attributes, stack[-1][1])
        if level != stack[-1][1]:
            flush()
        stack.append((name, level))
    flush()
    return out


def repeated(streams: list[np.ndarray], depth: int = DEPTH, pages: int = PAGES) -> list[np.ndarray]:
    """For each stream of token numbers, which tokens lie in a run that ``pages`` streams share.

    The streams are concatenated and their suffixes ranked by 1, 2, 4, ... tokens
    until suffixes of equal rank agree in ``depth`` tokens. Equal streams count as
    one page: a copy of a page does not turn its text into boilerplate.
    """
    n = np.fromiter(map(len, streams), np.int64, len(streams))
    if not n.sum():
        return [np.zeros(0, bool) for _ in streams]
    owner = np.repeat(np.arange(len(streams)), n)
    rank = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64) + 1
    last = np.cumsum(n)[owner]
    place = np.arange(rank.size)
    length = 1
    while length < depth:
        step = min(length, depth - length)
        ahead = place + step
        follow = np.where(ahead < last, rank[np.minimum(ahead, rank.size - 1)], 0)
        follow = np.where((rank == 0) | (follow == 0), 0, follow)
        pair = np.where(follow == 0, 0, rank * (rank.max() + 1) + follow)
        rank = np.unique(np.r_[0, pair], return_inverse=True)[1][1:].astype(np.int64)
        length += step
    first_like: dict[bytes, int] = {}
    page = np.fromiter((first_like.setdefault(s.tobytes(), i) for i, s in enumerate(streams)),
                       np.int64, len(streams))[owner]
    whole = rank > 0
    seen = np.unique(rank[whole] * len(streams) + page[whole]) // len(streams)
    shared = np.bincount(seen, minlength=int(rank.max()) + 1) >= pages
    starts = whole & shared[rank]
    edge = np.zeros(rank.size + 1, np.int64)
    edge[:-1] += starts
    np.add.at(edge, np.flatnonzero(starts) + depth, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.split(covered, np.cumsum(n)[:-1])


def stream_of(blocks: list[Block]) -> tuple[list[str], list[tuple[int, int] | None]]:
    """Tokens of the blocks that markup has not kept, and each block's place among them."""
    tokens: list[str] = []
    spans: list[tuple[int, int] | None] = []
    for b in blocks:
        if b.level >= 2:  # markup has decided
            spans.append(None)
            continue
        first = len(tokens)
        tokens.append(f"<{b.tag}>")
        tokens += b.text.lower().split()
        spans.append((first, len(tokens)))
    return tokens, spans


def run_hashes(tokens: list[str], depth: int = DEPTH) -> np.ndarray:
    """A hash of each ``depth`` consecutive tokens, the same in every task."""
    if len(tokens) < depth:
        return np.zeros(0, U)
    return windows(pd.util.hash_array(np.array(tokens, object)), depth)


def stream_hash(tokens: list[str]) -> int:
    """Names a stream: equal streams count as one page."""
    return int(windows(pd.util.hash_array(np.array(tokens, object)), len(tokens))[0].astype(np.int64))


def main_texts(pages: list[str | None], shared: np.ndarray | None = None) -> list[str]:
    """The main text of each of some pages of one host.

    ``shared`` has the hashes of the runs that are repeated on the host; without it
    the pages are all that the host has.
    """
    parsed = [blocks_of(p) if p else [] for p in pages]
    best = [max((b.level for b in blocks), default=-1) for blocks in parsed]
    streams, spans = [], []
    for blocks in parsed:
        tokens, own = stream_of(blocks)
        streams.append(tokens)
        spans.append(own)
    if shared is None:
        number: dict[str, int] = {}
        covered = repeated([np.array([number.setdefault(t, len(number)) for t in tokens], np.int64)
                            for tokens in streams])
    else:
        covered = []
        for tokens in streams:
            edge = np.zeros(len(tokens) + 1, np.int64)
            starts = np.flatnonzero(np.isin(run_hashes(tokens), shared))
            edge[starts] += 1
            edge[starts + DEPTH] -= 1
            covered.append(np.cumsum(edge[:-1]) > 0)
    out = []
    for blocks, level, own, cover in zip(parsed, best, spans, covered):
        text = []
        for b, span in zip(blocks, own):
            if b.level < level or level < 0:
                continue
            if span is not None:
                boilerplate = 2 * cover[span[0]:span[1]].sum() >= span[1] - span[0]
                if boilerplate or (2 * b.linked > len(b.text) and b.tag not in HEADINGS):
                    continue
            text.append(b.text)
        out.append("\n".join(text))
    return out


RUNS = "host string, part int, run long, page long"


def page_runs(pages: DataFrame, asking: bool) -> DataFrame:
    """Distinct runs of each page (host, part, html), with a hash of the page's stream.

    ``asking`` are the pages where markup does not decide all; else the others.
    """

    def run(batches):
        for batch in batches:
            for host, part, page in zip(batch["host"], batch["part"], batch["html"]):
                blocks = blocks_of(page) if page else []
                level = max((b.level for b in blocks), default=-1)
                if (0 <= level < 2) != asking:
                    continue
                tokens = stream_of(blocks)[0]
                runs = np.unique(run_hashes(tokens)).view(np.int64)
                if runs.size:
                    yield pd.DataFrame({"host": host, "part": part, "run": runs, "page": stream_hash(tokens)})

    return pages.select("host", "part", "html").where(F.col("html").isNotNull()).mapInPandas(run, RUNS)


def repeated_runs(pages: DataFrame) -> DataFrame | None:
    """(host, part, run): runs of the pages that ask for them, on ``PAGES`` distinct pages of the host.

    Of the other pages only the runs that may be asked for are counted. None if no
    page asks.
    """
    asked = kept(page_runs(pages, True), "asked-runs")
    if asked.limit(1).count() == 0:
        return None
    may = maybe_among(asked.select("run").distinct())
    others = page_runs(pages, False)
    every = asked.union(others.where(may(F.col("run")))).select("host", "run", "page").distinct()
    often = every.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= PAGES).select("host", "run")
    return asked.select("host", "part", "run").distinct().join(often, ["host", "run"], "left_semi")


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extracted_pages(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """Pages (page_id, url, html) → page_id, url, text, n_chars.

    Pages are grouped by host. A host of more than ``group_pages`` pages is dealt
    over groups of about that size by a hash; its runs are counted over all of its
    groups, and each group gets the repeated ones among its own. So no host, however
    large, meets in one task, and its size changes no result. Null and empty html
    has an empty text. Repeated rows are extracted each; a null url is a host of its
    own. Other columns are not looked at.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html").withColumn("host", host)
    hot = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_pages)
    hot = hot.select("host", F.ceil(F.col("n") / group_pages).cast("int").alias("groups"))
    if hot.limit(MANY_HOSTS + 1).count() <= MANY_HOSTS:
        hot = F.broadcast(hot)
    dealt = rows.join(hot, "host", "left").withColumn(
        "part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("groups", F.lit(1))).cast("int"))
    runs = repeated_runs(dealt.where(F.col("groups").isNotNull()))

    def texts_of(group: pd.DataFrame, shared: np.ndarray | None) -> pd.DataFrame:
        texts = main_texts([None if h is None else str(h) for h in group["html"]], shared)
        return pd.DataFrame({"page_id": group["page_id"], "url": group["url"], "text": texts,
                             "n_chars": [len(t) for t in texts]})

    def extract(group: pd.DataFrame) -> pd.DataFrame:
        return texts_of(group, None)

    def extract_with(group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        large = len(group) and bool(group["large"].iloc[0])
        return texts_of(group, own["run"].to_numpy().astype(np.int64).view(U) if large else None)

    key = ["host", "part"]
    if runs is None:
        return dealt.select("page_id", "url", "html", *key).groupBy(*key).applyInPandas(extract, EXTRACTED)
    large = F.col("groups").isNotNull().alias("large")
    return dealt.select("page_id", "url", "html", *key, large).groupBy(*key).cogroup(
        runs.groupBy(*key)).applyInPandas(extract_with, EXTRACTED)
