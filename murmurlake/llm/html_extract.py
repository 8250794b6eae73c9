"""Main text of web pages as a maximum-scoring subsequence.

A page is read once into tokens: words, each under a context (the block element it stands in, whether in a link,
whether inside the page's own main container), and tags.  Words score by how much likelier their context is in
content than outside, tags cost by the opposite ratio; the weights come from labelled pages, that is a bounded
sample of pages whose authors mark the content by ``<article>`` or ``<main>`` (``MAX_LABELLED`` pages, in the order
of a hash of their ids).  A linear scan finds the contiguous region of greatest score.  Zones that are never content
(menus, footers, asides, forms, adverts, notices, comments, scripts, styles) are cut out by element, role or class
before the scan and score nothing, so that they can't split an article in two.  Inside the region every block
is returned whole: references decoded, white space folded, blocks joined by one line feed.

Edge cases: null or empty html, and pages without words, give an empty text; unclosed and stray tags are
tolerated; without any labelled page the built-in weights hold; repeated rows are answered each.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import map_rows

MAX_LABELLED = 2000
#: Longer pages aren't learned from; with MAX_LABELLED a bound on what the driver holds.
MAX_LABELLED_CHARS = 30_000

# Element names of the HTML standard by their role here.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset(
    "head nav footer aside form script style noscript template iframe svg button select textarea object dialog menu "
    "title datalist fieldset canvas audio video map".split()
)
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
) | CUT
MAIN = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id values that name a zone outside the content.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie "
    "cookies consent gdpr notice notices alert disclaimer sidebar aside comment comments commentlist disqus replies "
    "reply respond menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login popup modal overlay widget footer masthead "
    "pagination pager toolbar paywall trending outbrain taboola topbar skip".split()
)
_TAG = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*)>"  # a quote that isn't closed
    r"|<[!?][^>]*>",
    re.S,
)
_NAME = re.compile(r"""(?:^|\s)(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_ROLE = re.compile(r"""(?:^|\s)role\s*=\s*["']?([\w-]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

Token = tuple[str, str, int]  # context or tag, text ("" for tags), block number


def _outside(name: str, attrs: str, in_main: bool) -> bool:
    """Whether the element opens a zone without content."""
    if name in CUT or (name == "header" and not in_main):
        return True
    if not attrs or name in ("html", "body") or name in MAIN:
        return False
    if any(p.lower() in NAMES for m in _NAME.finditer(attrs) for p in _PARTS.split(m[1])):
        return True
    role = _ROLE.search(attrs)
    return bool(role and role[1].lower() in ROLES) or bool(_HIDDEN.search(attrs))


def tokens(page: str, marked: list[bool] | None = None) -> list[Token]:
    """Text runs (context ``w:...``) and tags (``t:...``) outside cut zones, in page order; ``marked`` gets whether each is in the page's own
    main container."""
    out: list[Token] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, cut, link, main
    block, at, end = 0, 0, len(page)
    cut = link = main = False
    context = "body"

    def text(raw: str) -> None:
        if not cut and raw:
            out.append((f"w:{context}{'/a' if link else ''}{'/main' if main else ''}", html_lib.unescape(raw), block))
            if marked is not None:
                marked.append(main)

    while at < end:
        found = _TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        name, attrs = (found["name"] or found["name2"] or "").lower(), found["attrs"] or found["attrs2"] or ""
        if not name:
            continue
        closing = "/" in (found["close"] or found["close2"] or "")
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            # An inline end tag without its start inside the nearest block is stray.
            if depth >= 0 and (name in BLOCK or not any(s[0] in BLOCK for s in stack[depth + 1 :])):
                del stack[depth:]
            elif name not in BLOCK:
                continue
        elif name == "br":
            text(" ")
            continue
        else:
            if name in ("p", "li", "dd", "dt", "td", "th", "tr", "option") or (name in BLOCK and stack and stack[-1][0] == "p"):
                # An unclosed paragraph, item or cell ends where the next block starts.
                ends = "p" if name not in ("li", "dd", "dt", "td", "th", "tr", "option") else name
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == ends:
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK - {"p"}:
                        break
            if name not in VOID and not attrs.rstrip().endswith("/") or name in RAW:
                in_main = main or name in MAIN or bool((r := _ROLE.search(attrs)) and r[1].lower() == "main")
                stack.append((name, cut or _outside(name, attrs, main), link or name == "a", in_main))
            if name in RAW:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.start() if close else end
        if stack:
            _, cut, link, main = stack[-1]
        else:
            cut = link = main = False
        if name in BLOCK:
            block += 1
            context = next((s[0] for s in reversed(stack) if s[0] in BLOCK), "body")
        if not cut:
            out.append((f"t:{name}", "", block))
            if marked is not None:
                marked.append(main)
    return out


#: Weights before any page is seen: words gain, words of links lose, tags cost a little.
DEFAULTS = {"w": 1.0, "w/a": -1.0, "t": -0.2}


def default_weight(kind: str) -> float:
    if kind[0] == "t":
        return DEFAULTS["t"]
    return 2.0 if kind.endswith("/main") else DEFAULTS["w/a"] if "/a" in kind else DEFAULTS["w"]


def learn(pages: list[str]) -> dict[str, float]:
    """Log ratios of each context and tag inside marked content against outside, over pages that mark it."""
    inside, outside = Counter(), Counter()
    for page in pages:
        marked: list[bool] = []
        found = tokens(page, marked)
        if any(marked):
            for (kind, text, _), own in zip(found, marked, strict=True):
                (inside if own else outside)[kind] += len(text.split()) if text else (kind[0] == "t")
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    weights = {}
    for kind in {*inside, *outside}:
        ratio = math.log((inside[kind] + 0.5) / n_in) - math.log((outside[kind] + 0.5) / n_out)
        weights[kind] = min(3.0, max(-3.0, ratio)) if kind[0] == "w" else -min(0.5, max(0.05, -ratio))
        if kind.endswith("/main"):
            weights[kind] = max(0.5, weights[kind])
    return weights


def best_region(found: list[Token], weights: dict[str, float]) -> tuple[int, int]:
    """[start, end) of the maximum-scoring contiguous run of tokens; empty if no run scores above 0."""
    best, at, span, start = 0.0, 0.0, (0, 0), 0
    for i, (kind, text, _) in enumerate(found):
        weight = weights.get(kind)
        if weight is None:
            weight = default_weight(kind)
        at += weight * (len(text.split()) if kind[0] == "w" else 1)
        if at <= 0:
            at, start = 0.0, i + 1
        elif at > best:
            best, span = at, (start, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found = tokens(page or "")
    start, end = best_region(found, weights)
    if start >= end:
        return ""
    # Whole blocks: the region's first and last ones are completed, not cut.
    while start and found[start - 1][0][0] == "w" and found[start - 1][2] == found[start][2]:
        start -= 1
    while end < len(found) and found[end][0][0] == "w" and found[end][2] == found[end - 1][2]:
        end += 1
    blocks: dict[int, list[str]] = {}
    for kind, text, block in found[start:end]:
        if kind[0] == "w":
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def labelled_pages(pages: DataFrame, limit: int = MAX_LABELLED) -> list[str]:
    """At most ``limit`` pages that mark their content, those of least id hash; the ids are chosen before pages are read whole."""
    text = F.col("html").cast("string")
    marked = pages.filter(text.rlike("(?i)<(?:article|main)[\\s>]") & (F.length(text) <= MAX_LABELLED_CHARS))
    chosen = marked.select(F.col("page_id").alias("chosen_id")).orderBy(F.xxhash64("page_id"), "page_id").limit(limit)
    rows = (
        pages.select("page_id", text.alias("html"))
        .join(F.broadcast(chosen), F.col("page_id") == F.col("chosen_id"))  # at most `limit` ids
        .select("html")
        .limit(limit)
        .collect()
    )
    return [r["html"] for r in rows if r["html"]]


def extract_main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    learned = learn(labelled_pages(pages)) if weights is None else weights

    def make():
        def work(columns: list) -> list:
            texts = [main_text(h, learned) for h in columns[2]]
            return [columns[0], columns[1], texts, [len(t) for t in texts]]

        return work

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_rows(rows, make, "page_id long, url string, text string, n_chars long")
