"""Operator 7: main text of web pages. A page becomes flat text blocks; a decision tree, trained on the
small labelled table below, classifies each by its word count and link density, those of its
neighbours, and the elements that it lies in."""

from __future__ import annotations

import html
import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import ship, slices, table, text_of

# fixed values: elements of the markup
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside body div dl fieldset figure footer form header main menu nav ol section table ul".split())
SKIPPED = frozenset("button canvas iframe noscript object script select style svg template textarea title".split())
ASIDE = frozenset("aside fieldset footer form menu nav".split())
# fixed values: words of class names, ids and roles around what is no article; words of layout beside them
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer masthead menu nav navbar navigation newsletter"
    " notice pagination popup promo promotion related replies reply responses search share sharing sidebar side skip social sponsor sponsored subscribe toolbar widget widgets alert".split()
)
LAYOUT = frozenset(
    "area articles bar block bottom box button buttons column container content form global group header inner item items left link links list main media outer page panel post posts primary reader region right row"
    " rail secondary section site slot top user visitor wrap wrapper".split()
)
NAMES = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)

# (in article: 1 yes, 0 page has none, -1 outside it; in aside: 1; words; link density; words and link
#  density of the block before and after) and whether the block is main text. A range stands for
#  rows with each of its values.
FEATURES = ("article", "aside", "words", "links", "words_before", "links_before", "words_after", "links_after")
SIZES, DENSITIES, NEAR = (1, 4, 12, 60, 200), (0.0, 0.3, 1.0), (0, 1, 9, 60)
LABELLED = (
    ((1, 0, SIZES, 0.0, NEAR, (0.0, 1.0), NEAR, (0.0, 1.0)), 1),
    ((1, 0, SIZES, 0.3, NEAR, 0.0, NEAR, (0.0, 1.0)), 1),
    ((1, 0, (4, 12), 1.0, (9, 60), 0.0, (9, 60), 0.0), 1),
    ((1, 0, (1, 4, 12), 1.0, (1, 9), 1.0, (1, 9), 1.0), 0),
    ((1, 0, (1, 4, 12), 1.0, (1, 9), 1.0, 0, 0.0), 0),
    (((1, 0, -1), 1, SIZES, DENSITIES, NEAR, (0.0, 1.0), NEAR, (0.0, 1.0)), 0),
    ((-1, 0, SIZES, DENSITIES, NEAR, (0.0, 1.0), NEAR, (0.0, 1.0)), 0),
    ((0, 0, (25, 60, 200), (0.0, 0.2), NEAR, (0.0, 1.0), NEAR, (0.0, 1.0)), 1),
    ((0, 0, (15, 18), (0.0, 0.2), (40, 60), 0.0, NEAR, (0.0, 1.0)), 1),
    ((0, 0, (1, 4, 9), 0.0, (40, 60), 0.0, (30, 60), 0.0), 1),
    ((0, 0, (4, 8), 0.0, (0, 2), (0.0, 1.0), (40, 60), 0.0), 1),
    ((0, 0, (1, 4, 8), 0.0, (0, 1, 6), (0.0, 1.0), (0, 1, 6), (0.0, 1.0)), 0),
    ((0, 0, (4, 8), 0.0, (40, 60), 0.0, (0, 3), (0.0, 1.0)), 0),
    ((0, 0, (1, 4, 25, 60), (0.6, 1.0), NEAR, (0.0, 1.0), NEAR, (0.0, 1.0)), 0),
)


def hinted(attributes: str) -> bool:
    """Does a name of the element say that it is no article? A name counts if it has a word of HINTS and
    otherwise words of HINTS and LAYOUT alone: ``comments-list`` does, ``comments-on-method`` does not."""
    for m in NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
            if not HINTS.isdisjoint(words) and all(w in HINTS or w in LAYOUT for w in words):
                return True
    return False


def grow(x: np.ndarray, y: np.ndarray):
    """Classification tree by Gini impurity: a leaf's label, or (feature, threshold, low, high)."""
    if len(set(y.tolist())) == 1:
        return int(y[0])
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            cost = sum(m.sum() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t, low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t, low = best
    return f, float(t), grow(x[low], y[low]), grow(x[~low], y[~low])


def classify(tree, row) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def train() -> object:
    rows = [(r, v) for row, v in LABELLED for r in product(*(c if isinstance(c, tuple) else (c,) for c in row))]
    return grow(np.array([r for r, _ in rows], float), np.array([v for _, v in rows]))


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, in article, in aside) of the page's text blocks, in page order."""
    out: list[tuple[str, int, int, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, article, aside, hidden around it
    article = aside = hidden = in_link = False
    at = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, len(text.split(" ")), len(html.unescape("".join(linked)).split()), article, aside))
            parts, linked = [], []

    def add(text: str) -> None:
        if text and not hidden:
            parts.append(text)
            if in_link:
                linked.append(text)

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if not end and not attributes.endswith("/"):
                stop = _closing(tag).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag == "a":
            in_link = not end
            if in_link and linked:
                linked.append(" ")
        elif tag == "br":
            add(" ")
        elif tag in BLOCKS:
            close()
            in_link = False
            if tag in CONTAINERS:
                if not end:
                    stack.append((tag, article, aside, hidden))
                    article = article or tag in ("article", "main")
                    aside = aside or tag in ASIDE or (tag == "header" and not article) or (tag != "body" and hinted(attributes))
                    hidden = hidden or HIDDEN.search(attributes) is not None
                elif any(s[0] == tag for s in stack):
                    while True:
                        name, article, aside, hidden = stack.pop()
                        if name == tag:
                            break
    close()
    return out


_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in SKIPPED}


def _closing(tag: str) -> re.Pattern:
    return _CLOSING[tag]


def main_text(page: str, tree) -> str:
    """The blocks that the tree takes for main text, joined by an empty line."""
    found = blocks(page)
    has = any(b[3] and not b[4] for b in found)
    density = [b[2] / b[1] for b in found]
    keep = []
    for i, (text, words, _, article, aside) in enumerate(found):
        before, after = i - 1, i + 1 if i + 1 < len(found) else -1
        row = (
            1 if article else -1 if has else 0, int(aside), words, density[i],
            found[before][1] if before >= 0 else 0, density[before] if before >= 0 else 0.0,
            found[after][1] if after >= 0 else 0, density[after] if after >= 0 else 0.0,
        )
        if classify(tree, row):
            keep.append(text)
    return "\n\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``; n_chars counts code points.

    A null or empty html, or one without main text, gives an empty text. Markup that breaks off ends
    with the page. Repeated rows are extracted alike, null ids and urls are kept, very long pages are
    read whole, and other columns are not looked at.
    """
    ship(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        tree = train()
        for b in slices(batches, "_html"):
            texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), text_of("html").alias("_html"))
    return narrow.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
