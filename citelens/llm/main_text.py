"""Problem 5: the page's own body, without menus, notices, teasers and footers.

Two passes of block rules. Pass 1 decides blocks by stop-word density, length and link density, by the kind of container they
stand in, and by whether they are made from a template: the way a line opens (its first three words, or a label before a
colon) is counted over all pages, and what opens lines on a fair share of the pages and sites, or of one site's pages, is
no text of one article. Headings and table cells may repeat. Pass 2 lets short undecided blocks (list entries, cells)
inherit from their nearest decided neighbours. The body's extent is the smallest container around the title heading that
holds a decided block of running text; on a page without containers it runs from the title heading to the first gap in the
source. No wording is listed: the function words are those of ten languages, the templates come from the data.

Scale. Openings are counted with map-side aggregation. A page has at most as many openings as twice its lines, so at most
(mean openings a page) / ``share`` of them open lines on that share of the pages: this set is small by proof, whatever the
number of pages, and is sent to the workers. Of one site's openings at most (mean openings a page) / ``site_share`` are
frequent. A page is then judged by itself in one Arrow batch; pages are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelens.functions.site import site_of
from citelens.llm.function_words import ALL as FUNCTION_WORDS
from citelens.llm.lines import ATTRIBUTES, COMMENT, HIDDEN, map_many, page_lines
from citelens.staging import spread, stage

_TAG = re.compile(r"<(?:(/?)([a-z][^\s/>]*)(" + ATTRIBUTES + r")|[!?/][^>]*+(?:>|\Z))", re.I)
_INLINE = frozenset("a b strong em i span u".split())
_HOLDERS = frozenset("div section article main aside header footer nav td form details body blockquote figure".split())
_LISTS = frozenset(("ul", "ol", "table"))
_SELF_CLOSING = frozenset(("li", "td", "tr", "p"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset(("td", "th"))
_VOID = frozenset("br hr img meta link input source wbr col area base".split())

# Names of containers (class, id or role) that hold no body text.
_ASIDE_NAMES = re.compile(
    r"cookie|consent|\bmenu|\bnavi?\b|breadcrumb|\bpfad|sidebar|related|teaser|footer|comment|kommentar|share|social"
    r"|newsletter|banner|\bads?\b|advert|promo|\bcard\b|dialog",
    re.I,
)
_PUNCTUATION = ".,;:()„“\"'"
# Labels that stand between a site's name and its country.
_SECOND_LEVEL = frozenset("ac co com edu gov gv ne net or org".split())
_SEPARATORS = re.compile(r"\s[›»>|]\s")

GOOD, BAD, OPEN = 1, -1, 0


class Block(NamedTuple):
    """A line with what the rules need; holder: the number of the innermost container around it, -1 without one."""

    text: str
    tag: str
    linked: float
    holder: int
    gap: bool


class Holder(NamedTuple):
    """A container; parent: the number of the one around it, always a smaller number, or -1."""

    tag: str
    attributes: str
    parent: int


def blocks_of(html: str) -> tuple[list[Block], list[Holder]]:
    """The blocks of a page and its containers, both in document order."""
    html = HIDDEN.sub("<br>", COMMENT.sub("", html))
    blocks: list[Block] = []
    holders: list[Holder] = []
    stack: list[tuple[str, int]] = []  # open tags, each with the innermost container that holds its text
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = total = anchors = at = 0
    gap = False

    def close() -> None:
        nonlocal linked, total, gap
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                tag, holder = stack[-1] if stack else ("", -1)
                blocks.append(Block(text, tag, linked / max(1, total), holder, gap))
                gap = False
            else:
                gap = gap or raw.count("\n") > 2
            parts.clear()
        linked = total = 0

    def cut(i: int) -> None:
        for name, _ in stack[i:]:
            opened[name] -= 1
        del stack[i:]

    for m in _TAG.finditer(html):
        if m.start() > at:
            text = html[at : m.start()]
            parts.append(text)
            size = len(text.strip())
            total += size
            if anchors:
                linked += size
        at = m.end()
        name = (m[2] or "!").lower()
        if name in _INLINE:
            if name == "a":
                anchors = 0 if m[1] else 1
            continue
        close()
        anchors = 0
        if name == "!" or name in _VOID:
            continue
        if m[1]:
            if opened.get(name):
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                cut(i)
            continue
        if name in _SELF_CLOSING and opened.get(name):  # an unclosed one ends where the next begins
            i = len(stack) - 1
            while stack[i][0] != name and stack[i][0] not in _HOLDERS and stack[i][0] not in _LISTS:
                i -= 1
            if stack[i][0] == name:
                cut(i)
        holder = stack[-1][1] if stack else -1
        if name in _HOLDERS:
            holders.append(Holder(name, m[3] or "", holder))
            holder = len(holders) - 1
        stack.append((name, holder))
        opened[name] = opened.get(name, 0) + 1
    if at < len(html):
        parts.append(html[at:])
    close()
    return blocks, holders


@lru_cache(4096)
def _name_pattern(names: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("|".join(rf"\b{re.escape(x)}\b" for x in names))


def _names(site: str | None, html: str) -> re.Pattern[str] | None:
    """The site's own name, from the title's last part and from the host."""
    names = set()
    title = re.search(r"<title[^>]*>([^<]*)", html, re.I)
    if title:
        last = " ".join(unescape(title[1]).split()).split(" | ")
        if len(last) > 1:
            names.add(last[-1])
    if site:
        labels = site.split(".")
        core = labels[-3 if len(labels) > 2 and labels[-2] in _SECOND_LEVEL else -2 if len(labels) > 1 else 0]
        names |= {core.replace("-", " "), core}
    names = {x.lower() for x in names if len(x) > 3}
    return _name_pattern(tuple(sorted(names, key=len, reverse=True))) if names else None


def openings(low: str) -> list[str]:
    """How a line opens: its first three words (all of a shorter line), and a word with a colon among them."""
    words = low.split(None, 3)[:3]
    out = [" ".join(words)]
    label = next((x for x in words if x[-1] == ":"), None)
    return [*out, f"* {label}"] if label and len(label) > 1 else out


def _running(words: list[str]) -> bool:
    """Whether the words have the stop-word density of running text."""
    least = 0.15 * len(words)
    if sum(w in FUNCTION_WORDS for w in words) >= least:  # punctuation can only hide some
        return True
    return sum(w.strip(_PUNCTUATION) in FUNCTION_WORDS for w in words) >= least


def _decide(block: Block, low: str, templates: frozenset[str], own_name: re.Pattern[str] | None) -> int:
    """Pass 1; ``low`` is the block's text in lower case."""
    words = low.split()
    if block.tag in _HEADINGS:
        return GOOD
    if block.tag not in _CELLS and not templates.isdisjoint(openings(low)):
        return BAD
    if len(words) < 25 and len(_SEPARATORS.findall(low)) > 1:
        return BAD
    if len(words) >= 8 and block.linked < 0.7 and _running(words):
        return GOOD
    if block.linked > 0.8 and (own_name and len(words) < 25 and own_name.search(low) or block.tag == "li" and len(words) < 5):
        return BAD
    return OPEN


def main_lines(html: str | None, site: str | None = None, templates: frozenset[str] = frozenset()) -> list[str]:
    """The lines of the body in their writing, each once; none for a null or empty page or one without running text.

    ``templates``: the openings that make no body line.
    """
    if not html:
        return []
    blocks, holders = blocks_of(html)
    own_name = _names(site, html)
    lows = [b.text.lower() for b in blocks]
    labels = [_decide(b, low, templates, own_name) for b, low in zip(blocks, lows)]
    n = len(holders)
    good, bad, first, last = [0] * n, [0] * n, [-1] * n, [-1] * n
    titled = [False] * n
    for i, b in enumerate(blocks):
        if b.holder >= 0:
            good[b.holder] += labels[i] == GOOD and b.tag != "h1"
            bad[b.holder] += labels[i] == BAD
            if first[b.holder] < 0:
                first[b.holder] = i
            last[b.holder] = i
            titled[b.holder] = titled[b.holder] or b.tag == "h1"
    for k in range(n - 1, -1, -1):  # containers count what those within them hold
        up = holders[k].parent
        if up >= 0 and first[k] >= 0:
            good[up] += good[k]
            bad[up] += bad[k]
            first[up] = first[k] if first[up] < 0 else min(first[up], first[k])
            last[up] = max(last[up], last[k])
            titled[up] = titled[up] or titled[k]
    aside = [False] * n
    for k, h in enumerate(holders):
        own = h.tag in ("nav", "aside", "footer") or bool(_ASIDE_NAMES.search(h.attributes))
        own = own or bad[k] > 1 and bad[k] > good[k]
        # Around the title stands the body, or a container that was never closed.
        aside[k] = own and not titled[k] or h.parent >= 0 and aside[h.parent]
    inside = [b.holder < 0 or not aside[b.holder] for b in blocks]

    titles = [i for i, b in enumerate(blocks) if b.tag == "h1" and inside[i]]
    keep = [False] * len(blocks)
    for title in titles:
        if keep[title]:
            continue
        k = blocks[title].holder
        while k >= 0 and not good[k]:
            k = holders[k].parent
        if k >= 0 and holders[k].tag != "body":
            keep[title : last[k] + 1] = [True] * (last[k] + 1 - title)
            continue
        for i in range(title, len(blocks)):
            b = blocks[i]
            if i > title and (b.gap or b.tag == "h1"):
                break
            keep[i] = True
    if not titles:
        keep = [label != BAD for label in labels]

    members = [i for i in range(len(blocks)) if keep[i] and inside[i]]
    before, after = [OPEN] * len(members), [OPEN] * len(members)  # the nearest decided neighbours
    for at in range(1, len(members)):
        before[at] = labels[members[at - 1]] or before[at - 1]
    for at in range(len(members) - 2, -1, -1):
        after[at] = labels[members[at + 1]] or after[at + 1]
    out: list[str] = []
    for at, i in enumerate(members):  # pass 2
        label = labels[i]
        if label == OPEN:
            near = (before[at], after[at])
            label = GOOD if GOOD in near or titles and BAD not in near else BAD
        if label == GOOD:
            out.append(blocks[i].text)
    return list(dict.fromkeys(out))


_FOUND = pa.schema([("page_id", pa.int64()), ("line", pa.string())])
_OPENINGS = pa.schema([("site", pa.string()), ("openings", pa.list_(pa.string()))])


def _page_openings(site: str | None, html: str | None) -> list[tuple]:
    found = {x for line in {x.lower() for x in page_lines(html)} for x in openings(line)}
    return [(site, [*found, ""])] if found else []  # "" counts the pages


def template_openings(pages: DataFrame, share: float, min_pages: int, min_sites: int) -> frozenset[str]:
    """The openings of lines on ``share`` of all pages and of all sites, but no fewer than ``min_pages`` and ``min_sites``.

    ``pages`` are (site, html); those without lines don't count.
    """
    listed = map_many(pages, _page_openings, _OPENINGS, "site string, openings array<string>")
    by_site = listed.select("site", F.explode("openings").alias("opening")).groupBy("site", "opening").agg(F.count("*").alias("n"))
    counted = by_site.groupBy("opening").agg(F.sum("n").alias("n"), F.count("*").alias("sites"))
    counted = stage(counted.where((F.col("n") >= min_pages) & (F.col("sites") >= min_sites)), "body-openings")
    whole = counted.where("opening = ''").first()
    if whole is None:  # too few pages or sites for any
        return frozenset()
    common = (F.col("n") >= share * whole["n"]) & (F.col("sites") >= share * whole["sites"]) & (F.col("opening") != "")
    return frozenset(x["opening"] for x in counted.where(common).collect())  # <= mean openings a page / share


def _judge(templates: frozenset[str]) -> Callable[..., list[tuple]]:
    def page(page_id: int | None, site: str | None, html: str | None) -> list[tuple]:
        return [(page_id, x) for x in dict.fromkeys(x.lower() for x in main_lines(html, site, templates))]

    return page


def body_lines(pages: DataFrame, share: float = 0.01, min_pages: int = 5, min_sites: int = 3) -> DataFrame:
    """(page_id, line): the body's lines in lower case, each once per page.

    ``pages`` needs page_id, url and html; further columns are ignored. Null or empty html gives no rows; a null url only
    hides the site's name from the rules; repeated rows are handled each by itself. Below ``min_pages`` pages or
    ``min_sites`` sites no opening counts as a template. Ties don't arise, since thresholds are inclusive.
    """
    narrow = spread(pages.select("page_id", "url", "html").where("length(html) > 0"))
    narrow = narrow.select("page_id", site_of(F.col("url")).alias("site"), "html")
    templates = template_openings(narrow.select("site", "html"), share, min_pages, min_sites)
    return map_many(narrow, _judge(templates), _FOUND, "page_id bigint, line string")
