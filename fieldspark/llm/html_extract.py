"""Main text by site style trees.

All pages of a host are merged into one tree of branches (paths of tags with class and id words). The importance of what
a page has in a branch joins two things: the information of that content over the host's pages (what every page repeats
carries nothing, what few have carries all) and its presentation, which is a weight and decides nothing alone: being in
an article or main element and holding much of the page's text speak for it, a class or id word such as "sidebar" speaks
against it, the less of the page's text the element holds, the more. An element that holds an article or main element
loses nothing by its words. What is less important than ``MIN_IMPORTANCE`` goes from the page, and the rest is its text.
Only elements whose tag, role or hidden attribute says that they hold no main text (nav, footer, script) stay out.

Pages of a host with the same blocks are one page of its tree, so copies take nothing from each other or from others, and
of a branch only the contents that are repeated go. What n of a branch's m pages have carries 1 - log n / log (m + ``PRIOR``):
the more pages, the more a repetition says, without a size from which on it counts. Contents of a host are counted by
(host, page, branch, content), never gathered by page; a host with a thousandth of all pages gets its contents by
broadcast (there are at most a thousand such), so a host with a third of all pages is no hot group.

Null and empty pages have empty text; a page without a URL shares a tree with the others without one. Repeated pages keep
a row each, there are no ties, and pages of any length are parsed whole. An empty table gives no rows. Columns of any name
may stand beside the HTML and the URL; one named like ``out`` is replaced.
"""

from __future__ import annotations

import html
import itertools
import re
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import fresh, matched, scratch, sliced, stored

#: Pages that a branch is taken to have beside its own, each with content of its own, and the importance below which content goes.
PRIOR, MIN_IMPORTANCE = 4, 0.3
#: Presentation: added times its information for an article or main element, added times a branch's share of the page's text, and taken off less the squared share that a noise word's element holds.
ARTICLE, SHARE, NOISE = 0.2, 0.35, 1.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?i)(?<![a-z-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"(?i)</{t}(?=[\s/>]|\Z)[^>]*>?") for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input picture ruby rb rt".split())
_NOISE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe object embed svg canvas button select textarea dialog menu title audio video map datalist".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table select article section main nav aside div body footer header form".split())
_NOISE_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header footer masthead sidebar sidebars aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login form search share sharing social related recommended teaser comment comments "
    "commentlist disqus reply replies respond pagination pager toolbar widget legal copyright disclaimer alert skip".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ARTICLE_NOISE = frozenset("comment comments reply replies ad ads advert sponsored promo related teaser".split())


def host(url: str | None) -> str:
    """The host of a URL in lower case; empty without one."""
    m = re.match(r"(?i)\s*[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


class Block(NamedTuple):
    """A text in a branch: the line it is in, whether an article or main element holds it, and how much the word of a noise element around it weighs: 1 less its squared share of the page's text, or half of that where an article or main element has text elsewhere."""

    branch: str
    text: str
    line: int
    article: bool
    noise: float


def _look(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A node's key (its tag with class and id words), whether it holds no main text, and whether a word of it is noise."""
    words: list[str] = []
    noise = tag in _NOISE_TAGS
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role":
                noise |= value.strip() in _NOISE_ROLES
            elif name == "hidden" or name == "aria-hidden":
                noise |= name == "hidden" or value == "true"
            else:
                words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower())
    word = tag not in ("html", "body") and not (_ARTICLE_NOISE if tag in ("article", "main") else _NOISE_WORDS).isdisjoint(words)
    return ".".join([tag, *dict.fromkeys(words)]), noise, word


def parse(page: str | None) -> list[Block]:
    """The page's texts in their order, but for those in elements that hold no main text."""
    found: list[tuple[str, str, int, bool, int]] = []
    if not page:
        return []
    stack: list[tuple[str, str, bool, bool, int]] = [("", "", False, False, -1)]  # tag, branch, off, in an article, innermost noise word
    words: list[int] = []  # of each noise word's element, the one around it
    held: set[int] = set()  # those that hold an article or main element
    text: list[tuple[str, tuple]] = []
    line = 0

    def flush():
        nonlocal line
        line += 1
        parts: list[tuple[tuple, list[str]]] = []
        for t, top in text:
            if parts and (parts[-1][0] == top[1:] or not t.strip()):
                parts[-1][1].append(t)
            elif t.strip():
                parts.append((top[1:], [t]))
        found.extend((branch, "".join(t), line, article, word) for (branch, _, article, word), t in parts)
        text.clear()

    def pop(tags: tuple[str, ...], scope: frozenset = frozenset()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                if any(s[0] not in _INLINE for s in stack[k:]):
                    flush()
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1][2]:
            text.append((html.unescape(page[at:stop]), stack[-1]))
        if not m:
            break
        at = m.end()
        if m[1] is not None and not stack[-1][2]:
            text.append((m[1], stack[-1]))
        elif m[2]:
            tag = m[2].lower()
            if tag == "p" and not any(s[0] == "p" for s in stack):
                flush()
            pop((tag,))
        elif m[3]:
            tag = m[3].lower()
            if tag == "br":
                text.append((" ", stack[-1])) if not stack[-1][2] else None
                continue
            if tag in _CLOSES_P:
                pop(("p",), _SCOPE)
            if tag in _SELF_CLOSING:
                pop(_SELF_CLOSING[tag], _SCOPE - {tag})
            if tag not in _INLINE:
                flush()
            if tag in _VOID:
                continue
            up = stack[-1]
            key, off, noise = _look(tag, m[4] or "")
            if tag in _RAW:
                close = _RAW[tag].search(page, at)
                at = close.end() if close else end
                continue
            if (m[4] or "").endswith("/") and tag in _INLINE:
                continue
            article = tag in ("article", "main")
            if article and not noise and not off and not up[2]:
                w = up[4]
                while w >= 0 and w not in held:
                    held.add(w)
                    w = words[w]
            if noise:
                words.append(up[4])
            stack.append((tag, up[1] if tag in _INLINE and not (noise or off) else f"{up[1]}/{key}", up[2] or off, up[3] or article, len(words) - 1 if noise else up[4]))
    flush()

    def around(word: int):
        while word >= 0:
            if word not in held:
                yield word
            word = words[word]

    size = [0] * len(words)
    for _, t, _, _, word in found:
        for w in around(word):
            size[w] += len(t)
    total = sum(len(t) for _, t, _, _, _ in found)
    inner = [next(around(word), -1) for *_, word in found]
    other = any(article and w < 0 for (*_, article, _), w in zip(found, inner, strict=True))
    return [Block(branch, t, k, article and w < 0, 1 - (size[w] / total) ** 2 / (1 + other) if w >= 0 else 0.0) for (branch, t, k, article, _), w in zip(found, inner, strict=True)]


def lined(found: list[Block]) -> list[tuple[str, str]]:
    """(branch, text) of each line, its blocks put together."""
    out: list[tuple[str, str]] = []
    for _, own in itertools.groupby(found, key=lambda b: b.line):
        own = list(own)
        if t := " ".join("".join(b.text for b in own).split()):
            out.append((own[0].branch, t))
    return out


def blocks(page: str | None) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(branch, text) of each line that no word speaks against, in page order: of all, and of those in an article or main element."""
    found = [b for b in parse(page) if not b.noise]
    return lined(found), lined([b for b in found if b.article])


def branch_id(branch: str) -> int:
    return xxhash.xxh3_64_intdigest(branch) - (1 << 63)


def branches(found: list[Block]) -> dict[str, tuple[int, int]]:
    """For each branch of a page, the name of its content and its length."""
    of: dict[str, list[str]] = {}
    for b in found:
        of.setdefault(b.branch, []).append(" ".join(b.text.split()))
    return {b: (branch_id("\n".join([b, *t])), sum(map(len, t))) for b, t in of.items()}


def style_tree(pages: DataFrame, html_column: str = "html", url: str = "url", prior: int = PRIOR, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """(host, content, pages, information) of the contents that too many pages of a host have in one branch, over all pages.

    Pages with the same blocks count once. The mean information of a branch's contents is its entropy over its largest value.
    """

    def run(batches):
        for batch in sliced(batches, 4096):
            rows: set[tuple[str, int, int, int]] = set()
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own := branches(parse(h)):
                    page = branch_id("\n".join(f"{c}" for c, _ in own.values()))
                    rows.update((host(u), page, branch_id(b), c) for b, (c, _) in own.items())
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "page", "branch", "content"])

    seen = pages.select(F.col(f"`{url}`").alias("u"), F.col(f"`{html_column}`").alias("h")).mapInArrow(run, "host string, page long, branch long, content long")
    contents = stored(seen.distinct().groupBy("host", "branch", "content").agg(F.count("*").alias("n")), "contents")
    tree = contents.groupBy("host", "branch").agg(F.sum("n").alias("pages"))
    # fewer than this many pages leave enough in every branch, as a branch has no fewer
    least = next(n for n in range(2, 1 << 20) if n > (n + prior) ** (1 - min_importance))
    information = 1 - F.log("n") / F.log(F.col("pages") + prior)
    return contents.where(F.col("n") >= least).join(tree, ["host", "branch"]).select("host", "content", "pages", information.alias("information")).where(F.col("information") < min_importance)


def main_text(page: str | None, known: dict[int, float], min_importance: float = MIN_IMPORTANCE) -> str:
    """The page's lines without what is less important; ``known`` has the information of repeated contents, others have all."""
    found = parse(page)
    own = branches(found)
    total = sum(n for _, n in own.values()) or 1
    information = {b: known.get(c, 1.0) for b, (c, _) in own.items()}
    base = {b: information[b] + SHARE * n / total for b, (_, n) in own.items()}
    # what all pages repeat gains nothing by its article
    return "\n".join(t for _, t in lined([b for b in found if base[b.branch] + ARTICLE * information[b.branch] * b.article - NOISE * b.noise >= min_importance]))


def extract(pages: DataFrame, html_column: str = "html", url: str = "url", out: str = "text", prior: int = PRIOR, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """``pages`` with the main text in ``out``; empty if there is none."""
    key, ids, values, count = fresh(pages, "__host", "__low", "__information", "__pages")

    @F.pandas_udf("string")
    def hosts(urls):
        return urls.map(lambda u: host(u if isinstance(u, str) else None))

    @F.pandas_udf("string")
    def text(htmls, lows, informations):
        def one(h, low, information):
            return main_text(h if isinstance(h, str) else None, dict(zip(low, information, strict=True)) if low is not None else {}, min_importance)

        return pd.Series(list(map(one, htmls, lows, informations)), index=htmls.index, dtype=object)

    with scratch(pages.sparkSession):
        low = style_tree(pages, html_column, url, prior, min_importance)
        # of a branch of m pages fewer than m ** min_importance contents are repeated as often
        low = low.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("content", "information"))).alias("low")).select("host", "low.content", "low.information")
        counts = pages.select(F.col(f"`{url}`").alias("u")).groupBy("u").agg(F.count("*").alias("n")).select(hosts("u").alias("host"), "n").groupBy("host").agg(F.sum("n").alias("n"))
        low = stored(low.join(counts, "host"), "style", keep=True)
    names = low.select(F.col("host").alias(key), F.col("content").alias(ids), F.col("information").alias(values), F.col("n").alias(count))
    joined = matched(pages.withColumn(key, hosts(F.col(f"`{url}`"))), names, key, count, pages.count())
    return joined.withColumn(out, text(F.col(f"`{html_column}`"), F.col(ids), F.col(values))).drop(key, ids, values)


def page_texts(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
