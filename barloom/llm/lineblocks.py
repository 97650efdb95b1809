"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. A line weighs as many characters as it has outside links; lines of menus,
notices and other furniture weigh nothing, and edges of such parts are gaps as wide as the window. Over every line the
weights of a window are summed: where the sum surges a run of text starts, where it dives to nothing the run ends, and the
text between is kept. Inside an element that declares itself the article any text is a surge; on a page without one a run
has to be long by itself and against the longest run.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import schema, table

WINDOW = 3  # lines summed
SURGE, SHARE = 80, 0.2  # characters that start a run on a page without an article, and of the longest run

TOKEN = re.compile(
    r"<!--(?:(?!-->)[\s\S])*+(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)"
)
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
HIDDEN = re.compile(r"(?i)(?<![\w-])hidden(?![\w=-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")

# Names of elements, and words in class, id and role that mark furniture.
RAW = frozenset("script style noscript template iframe svg math canvas object select option textarea title xmp noembed noframes audio video".split())
FURNITURE = frozenset("nav footer aside form menu dialog head button fieldset datalist label".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search "
    "section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset("br td th wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs footer header "
    "masthead comment comments disqus respond reply replies related recommended recommendations share sharing social newsletter subscribe subscription signup login popup modal overlay widget pagination pager toolbar search searchform "
    "copyright complementary contentinfo skip topbar".split()
)
UNLESS = frozenset("no with without has".split())


def furniture(name: str, attributes: str) -> bool:
    """Whether an element's name, or a word of its class, id or role, marks it as no part of the article."""
    if name in FURNITURE:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    for m in ATTRIBUTE.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            words = re.split("[-_:]+", token)
            if words[0] not in UNLESS and not MARKED.isdisjoint(words):
                return True
    return False


class Lines:
    """Lines of a page: texts, characters in links, and the article that each belongs to; None in texts is a gap."""

    def __init__(self) -> None:
        self.texts: list[str | None] = []
        self.linked: list[int] = []
        self.article: list[int] = []
        self.parts: list[str] = []
        self.links = 0

    def close(self, article: int) -> None:
        if self.parts:
            text = " ".join(references.unescape("".join(self.parts)).split())
            if text:
                self.texts.append(text)
                self.linked.append(min(self.links, len(text)))
                self.article.append(article)
            self.parts, self.links = [], 0

    def gap(self) -> None:
        if self.texts and self.texts[-1] is not None:
            self.texts += [None] * WINDOW
            self.linked += [0] * WINDOW
            self.article += [-1] * WINDOW


def page_lines(html: str) -> Lines:
    lines, at, n = Lines(), 0, len(html)
    article, opened, articles, mains = -1, 0, 0, 0  # the present article, its depth of nested ones, articles and mains so far
    skipped, depth, link = "", 0, 0  # name of the furniture that we are in, and how deep its name is nested
    while at < n:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else n]
        if text and not skipped:
            lines.parts.append(text)
            lines.links += len(text) if link else 0
        if not m:
            break
        at = m.end()
        if (name := m[2]) is None:
            continue
        name, closing = name.lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*>?").search(html, at)
                at = end.end() if end else n
            continue
        if skipped:
            if name == "article" and not closing and not articles and skipped not in ("aside", "nav", "footer") and not furniture(name, m[3]):
                skipped = ""  # the page's article inside a wrapper that only looks like furniture
            else:
                if name == skipped:
                    depth += -1 if closing else 1
                    if not depth:
                        skipped = ""
                        lines.gap()
                continue
        if name in BLOCKS:
            lines.close(article)
        elif name in SPACES:
            lines.parts.append(" ")
        if name == "a":
            link = max(0, link + (-1 if closing else 1)) if closing else 1
        elif closing:
            if name in ("article", "main") and opened:
                opened -= 1
                if not opened:
                    lines.gap()
                    article = -1
        elif name in ("article", "main") and not (name == "article" and furniture(name, m[3])):
            if not opened:
                articles += name == "article"
                mains += 1
                article = mains
                lines.gap()
            opened += 1
        elif name not in VOID and (furniture(name, m[3]) or name == "header" and article < 0):
            lines.close(article)
            lines.gap()
            skipped, depth = name, 1
    lines.close(article)
    return lines


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by an empty line; empty if there is none."""
    lines = page_lines(html or "")
    if not lines.texts:
        return ""
    sizes = np.array([len(t) if t else 0 for t in lines.texts])
    article = np.array(lines.article)
    inside = np.bincount(article[article > 0], sizes[article > 0]) if (article > 0).any() else np.zeros(1)
    declared = int(inside.argmax()) if inside.any() else 0
    weights = np.where(article == declared, sizes, 0) if declared else np.where(sizes >= 2 * np.array(lines.linked), sizes - np.array(lines.linked), 0)
    sums = np.convolve(weights, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of a line and those after it
    kept, runs, i = [], [], 0
    while i < len(sums):
        if sums[i] == 0:
            i += 1
            continue
        surge = i + int(np.flatnonzero(weights[i:])[0])
        quiet = np.flatnonzero(sums[surge:] == 0)
        dive = surge + int(quiet[0]) if len(quiet) else len(sums)
        runs.append((surge, dive, int(weights[surge:dive].sum())))
        i = dive
    longest = max((total for _, _, total in runs), default=0)
    least = 1 if declared else max(SURGE, SHARE * longest)
    for surge, dive, total in runs:
        if total >= least:
            kept += [t for t, own in zip(lines.texts[surge:dive], article[surge:dive], strict=True) if t and (not declared or own == declared)]
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Rows with page_id, url and html to (page_id, url, text, n_chars). A null html gives an empty text; repeated rows each have their row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return given.mapInPandas(run, schema(page_id="bigint", url="string", text="string", n_chars="bigint"))


def op6_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
