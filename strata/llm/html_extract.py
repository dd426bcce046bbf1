"""Main text of web pages by a tree-structured graphical model over the DOM.

A page is parsed into a tree of elements (forgiving: unclosed, misnested and cut-off markup).
Every element has a binary variable, content or not.  Its own potential is log-linear in its
tag, its class, id and role words, its text length and its share of linked text; a potential
on each parent-child edge says how often a child shares its parent's label.  Sum-product
messages run from the leaves to the root and back, which is exact on a tree, and an
element's text is kept when its marginal for content is above a half.

The model is trained from labelled pages: pages whose markup says what their parts are (an
``article`` or ``main`` element, and ``nav``, ``footer``, ``aside`` and the like) label their own
elements.  The weights of the word lists below have a prior, so that parts that no training
page has are recognised too.  Training takes at most ``max_train`` pages, the first by a
hash of their id.

Text: character references decoded, white space within a block turned into one space, blocks joined by one
space in page order.  Null, empty and text-free pages give an empty text.  Repeated rows are
treated alike, extra columns are not read, an empty table gives no rows.  Without a page that
labels itself the prior weights decide alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import stream_bound

# HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section
select summary table tbody td tfoot th thead title tr ul""".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math select".split())
#: Start tags that end an open element of the given kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
CONTENT_TAGS, CONTENT_WORDS = {"article", "main"}, set("article main content post entry story body text".split())
OTHER_TAGS = set("nav header footer aside form button menu dialog label input fieldset legend option".split())
OTHER_WORDS = set("""nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement adverts
sponsor sponsored promo promotion banner cookie cookies consent notice popup modal overlay newsletter subscribe signup
comment comments disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs pagination
pager widget toolbar login search form complementary contentinfo""".split())
FEATURES = ["bias", "content tag", "content word", "other tag", "other word", "linked share", "long text", "short text",
            "paragraph or heading", "list or link"]
PRIOR = np.array([-0.5, 8.0, 2.0, -8.0, -8.0, -2.0, 1.0, -0.3, 1.0, -0.3])
#: Probability that a child has its parent's label, for a parent that is not content and one that is; before training.
EDGE_PRIOR = np.array([[0.9, 0.1], [0.02, 0.98]])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Page:
    """Elements of a page in document order (parents before children), and its texts."""

    def __init__(self, text: str):
        self.tags, self.parents, self.words, self.depths = ["#page"], [-1], [()], [0]
        self.texts: list[tuple[int, str]] = []  # element, text; -1 is a block's edge
        stack, at = [0], 0
        size = len(text)
        while at < size:
            m = _TOKEN.search(text, at)
            end = m.start() if m else size
            if end > at:
                self.texts.append((stack[-1], text[at:end]))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                at_tag = next((k for k in range(len(stack) - 1, 0, -1) if self.tags[stack[k]] == tag), 0)
                if at_tag:
                    del stack[at_tag:]
                if tag in BLOCK:
                    self.texts.append((-1, ""))
                continue
            if tag in BLOCK:
                self.texts.append((-1, ""))
                ends = CLOSES.get(tag, ())
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = self.tags[stack[k]]
                    if open_tag == "p" and tag != "br" or open_tag in ends:
                        del stack[k:]
                        break
                    if open_tag in ("table", "ul", "ol", "dl", "article", "section", "div") and not (
                            open_tag == "div" and "p" in ends):
                        break
            number = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.depths.append(self.depths[stack[-1]] + 1)
            found = ()
            if m[3] and "=" in m[3]:
                found = tuple(w for a in _ATTR.findall(m[3]) for w in _WORD.findall("".join(a).lower()))
            self.words.append(found)
            if tag in RAW:  # its inside is no text of the page
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(text, at)
                at = close.end() if close else size
                if tag in BLOCK:
                    self.texts.append((-1, ""))
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append(number)


def _features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents (-1: root), depths and tag numbers of all elements of some pages."""
    rows, parents, depths, base = [], [], [], 0
    for page in pages:
        n = len(page.tags)
        own, linked = [0] * n, [0] * n
        for node, text in page.texts:
            if node >= 0:
                own[node] += len(text)
        for k in range(n):
            if page.tags[k] == "a":
                linked[k] = own[k]
        for k in range(n - 1, 0, -1):  # sums over subtrees
            own[page.parents[k]] += own[k]
            linked[page.parents[k]] += own[k] if page.tags[k] == "a" else linked[k]
        for k in range(n):
            tag, words = page.tags[k], page.words[k]
            rows.append((1, tag in CONTENT_TAGS, any(w in CONTENT_WORDS for w in words), tag in OTHER_TAGS,
                         any(w in OTHER_WORDS for w in words), min(1.0, linked[k] / own[k]) if own[k] else 0.0,
                         own[k] > 200, own[k] < 40, tag in ("p", "h1", "h2", "h3", "blockquote", "pre"),
                         tag in ("a", "li", "ul")))
            parents.append(base + page.parents[k] if k else -1)
        depths += page.depths
        base += n
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(parents, np.int64), np.array(depths, np.int64)


def marginals(unary: np.ndarray, parents: np.ndarray, depths: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Probability of content of every element, by sum-product on the forest of all pages."""
    theta = np.stack([np.zeros(len(unary)), unary], 1)
    log_edge = np.log(edge)  # [parent, child]
    levels = [np.flatnonzero(depths == d) for d in range(int(depths.max()) + 1)] if len(depths) else []
    belief, up = theta.copy(), np.zeros_like(theta)  # belief: own potential and the children's messages
    for level in reversed(levels[1:]):
        up[level] = np.logaddexp(log_edge[:, 0] + belief[level, :1], log_edge[:, 1] + belief[level, 1:])
        np.add.at(belief, parents[level], up[level])
    for level in levels[1:]:
        rest = belief[parents[level]] - up[level]  # all that the parent knows but from this child
        rest -= rest.max(1, keepdims=True)
        belief[level] += np.logaddexp(rest[:, :1] + log_edge[0], rest[:, 1:] + log_edge[1])
    gap = np.clip(belief[:, 0] - belief[:, 1], -700, 700) if len(belief) else np.zeros(0)
    return 1 / (1 + np.exp(gap))


def own_labels(page: Page) -> list[int] | None:
    """Labels that the markup of a page gives its elements; None if it names no content."""
    if not CONTENT_TAGS & set(page.tags):
        return None
    labels = [0]
    shut = [False]
    for k in range(1, len(page.tags)):
        up = page.parents[k]
        other = shut[up] or page.tags[k] in OTHER_TAGS or any(w in OTHER_WORDS for w in page.words[k])
        shut.append(other)
        labels.append(0 if other else int(labels[up] or page.tags[k] in CONTENT_TAGS))
    return labels


def fit(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge probabilities from the labelled ones among ``pages``."""
    known = [(p, y) for p in map(Page, pages) if (y := own_labels(p)) is not None]
    if not known:
        return PRIOR, EDGE_PRIOR
    x, parents, _ = _features([p for p, _ in known])
    y = np.array([v for _, labels in known for v in labels], float)
    weights, strength = PRIOR.copy(), 0.01 * len(y)
    for _ in range(25):  # Newton steps of a logistic fit around the prior weights
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + strength * (weights - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(weights))
        weights = weights - np.linalg.solve(hessian, gradient)
    child = parents >= 0
    counts = EDGE_PRIOR * 10 + np.array([[np.sum((y[parents[child]] == a) & (y[child] == b)) for b in (0, 1)] for a in (0, 1)])
    return weights, counts / counts.sum(1, keepdims=True)


def page_text(page: Page, keep: np.ndarray) -> str:
    """Texts of the kept elements; the blocks' edges are white space."""
    out = []
    for node, text in page.texts:
        if node < 0:
            out.append(" ")
        elif keep[node]:
            out.append(html.unescape(text))
    return " ".join("".join(out).split())


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            max_train: int = 500) -> DataFrame:
    """Id, url and main ``text`` of every page."""
    # the hashes first, which are small; then the pages up to the last of them
    turn = F.xxhash64(F.col(id_col).cast("string"))
    full = pages.where(F.col(html_col).isNotNull())
    first = [r[0] for r in full.select(turn.alias("h")).orderBy("h").limit(max_train).collect()]
    sample = full.where(turn <= F.lit(first[-1] if first else 0)).limit(max_train)
    weights, edge = fit([r[0] for r in sample.select(html_col).collect()])
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for i in range(0, batch.num_rows, 256):
                trees = [Page(x or "") for x in batch.column(2).slice(i, 256).to_pylist()]
                x, parents, depths = _features(trees)
                keep = marginals(x @ weights, parents, depths, edge) > 0.5
                at = 0
                for tree in trees:
                    texts.append(page_text(tree, keep[at:at + len(tree.tags)]))
                    at += len(tree.tags)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema.names)

    return stream_bound(pages, [id_col, url_col, html_col]).mapInArrow(run, schema)
