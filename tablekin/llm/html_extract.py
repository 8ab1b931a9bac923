"""Main text of web pages by a tree-structured graphical model.

Each block element of a page is a node that is content (most of its text belongs to the article) or not. A node's
potential comes from its tag, the words of its class and id and those of the elements around it, its links and its text; parent-child potentials say how
labels pass down. Sum-product messages run up and down the tree, and the blocks of nodes whose marginal is at least one
half are the text.

The weights are trained on labelled pages: those whose markup names the article (article, main or role=main) are labelled
by it. Each is seen twice, once as it is and once with the article's tag, classes and ids taken away, so that text and
links have to tell. At most ``sample`` pages are labelled, those with the least hash of their html. Weights that the
pages say little about stay near a prior.

Defined results: a null or empty html gives an empty text. Tags may stay open, close without opening, or be cut off; a
comment, script or style without end goes on to the end of the page. Every row gives one row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import texts
from tablekin.session import materialize

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: elements whose content is never text
SKIPPED = frozenset("script style title noscript template svg math iframe object textarea select canvas audio video".split())
# fixed values: elements that start a new block
BLOCKS = frozenset(
    "html head body article main section nav aside header footer form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address fieldset details summary dialog menu hr center label button".split()
)
VOID = frozenset("hr br img meta link input wbr area base col embed source track param".split())
# fixed values: what an opening tag closes when it is open, and where the search for it stops
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})} | dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"}))
CLOSES["tr"] = ({"tr", "td", "th"}, {"table"})
# fixed values: words in class or id that speak against or for content
AGAINST = frozenset(
    "nav navigation navbar menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead banner ad ads advert adverts advertisement "
    "adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
    "login register search share sharing social comment comments commentlist reply replies disqus respond discussion related recommended "
    "recommendations widget widgets toolbar pagination pager tagcloud copyright legal disclaimer form skip teaser outbrain taboola".split()
)
FOR = frozenset("article content main post story entry body text prose articlebody maincontent".split())
AGAINST_TAGS = frozenset("nav aside footer form menu dialog button fieldset label".split())

FEATURES = [
    "bias", "against", "for", "article tag", "heading", "paragraph", "list", "division", "table",
    "link share", "length", "sentences", "share of page", "own text", "empty",
]
#: Prior mean of the weights, and how many nodes' worth of evidence it has.
PRIOR = np.array([-0.6, -40.0, 1.5, 3.5, 0.8, 1.0, -0.3, 0.0, -0.3, -5.0, 0.6, 0.8, 1.2, 0.0, -1.0])
PRIOR_STRENGTH = 30.0
#: Prior counts of (parent's label, child's label) for children that hold others and for children that only hold text.
PASSING = np.array([[[60.0, 4.0], [6.0, 40.0]], [[80.0, 0.01], [4.0, 60.0]]])
#: An element with more of the page's text than this is not taken for boilerplate by its name.
WHOLE_PAGE = 0.7


class Page:
    """Block elements in page order: parent, tag, hints, and the text blocks with their element."""

    def __init__(self, source: str):
        self.parent, self.tag, self.against, self.favours, self.links = [-1], ["html"], [False], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        stack, buffer, linked, in_link = [0], [], 0, 0
        at, end = 0, len(source)

        def flush() -> None:
            nonlocal buffer, linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append((stack[-1], text, min(linked, len(text))))
                buffer, linked = [], 0

        while at < end:
            token = _TOKEN.search(source, at)
            text = source[at : token.start() if token else end]
            if text:
                text = html.unescape(text) if "&" in text else text
                buffer.append(text)
                if in_link:
                    linked += len(text.strip())
            if not token:
                break
            at = token.end()
            name = token[2] or token[5]
            if not name:
                continue
            name, closing = name.lower(), token[1] or token[4]
            if closing:
                if name == "a":
                    in_link = 0
                elif name in BLOCKS and any(self.tag[k] == name for k in stack[1:]):
                    flush()
                    in_link = 0
                    while self.tag[stack.pop()] != name:
                        pass
                continue
            if name in SKIPPED:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                if not (token[3] or token[6] or "").endswith("/"):
                    at = stop.end() if stop else end
                continue
            if name == "a":
                in_link = 1
            elif name == "br":
                buffer.append(" ")
            elif name in BLOCKS:
                flush()
                in_link = 0
                if name in CLOSES:
                    closes, until = CLOSES[name]
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] in until:
                            break
                        if self.tag[stack[k]] in closes:
                            del stack[k:]
                            break
                elif self.tag[stack[-1]] == "p":
                    stack.pop()
                if name not in VOID and name != "html":
                    self._open(stack[-1], name, token[3] or token[6] or "")
                    stack.append(len(self.tag) - 1)
        flush()

    def _open(self, parent: int, name: str, attributes: str) -> None:
        against = favours = False
        if attributes:
            for _, *value in _ATTRIBUTE.findall(attributes):
                hints = {h.lower() for h in _HINT.findall("".join(value))}
                against |= not AGAINST.isdisjoint(hints)
                favours |= not FOR.isdisjoint(hints)
        self.parent.append(parent)
        self.tag.append(name)
        self.against.append(against)
        self.favours.append(favours)

    def plain(self, of: int) -> None:
        """Take the tag and hints from an element."""
        self.tag[of], self.favours[of] = "div", False

    def features(self) -> np.ndarray:
        n = len(self.tag)
        total, linked, ends, own = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text, in_links in self.blocks:
            total[node] += len(text)
            own[node] += len(text)
            linked[node] += in_links
            ends[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?", "…", "。"))
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            total[p] += total[k]
            linked[p] += linked[k]
            ends[p] += ends[k]
        all_, in_article, against = max(1, total[0]), [False] * n, [False] * n
        for k in range(1, n):
            t, p = self.tag[k], self.parent[k]
            in_article[k] = in_article[p] or t in ("article", "main")
            named = self.against[k] or t in AGAINST_TAGS or (t == "header" and not in_article[k])
            against[k] = against[p] or (named and total[k] < WHOLE_PAGE * all_)
        out = np.zeros((n, len(FEATURES)))
        x = np.array([total, linked, ends, own], float)
        size = np.maximum(x[0], 1)
        out[:, 0] = 1
        out[:, 1], out[:, 2] = against, self.favours
        for k, t in enumerate(self.tag):
            if t in ("article", "main"):
                out[k, 3] = not against[k]
            elif len(t) == 2 and t[0] == "h" and t[1].isdigit():
                out[k, 4] = 1
            elif t in ("p", "blockquote", "pre"):
                out[k, 5] = 1
            elif t in ("li", "ul", "ol", "dl", "dt", "dd"):
                out[k, 6] = 1
            elif t in ("div", "section", "body", "html"):
                out[k, 7] = 1
            elif t[0] == "t":
                out[k, 8] = 1
        out[:, 9] = x[1] / size
        out[:, 10] = np.log1p(x[0]) / 4 - 1
        out[:, 11] = np.minimum(1, 40 * x[2] / size) * (x[0] > 0)
        out[:, 12] = x[0] / all_
        out[:, 13] = x[3] / size
        out[:, 14] = x[0] == 0
        return out

    def holds(self) -> np.ndarray:
        """1 for elements that only hold text, 0 for those that hold others."""
        out = np.ones(len(self.tag), np.int64)
        out[self.parent[1:]] = 0
        return out

    def labels(self) -> np.ndarray | None:
        """Labels of a page whose markup names its article, else None: nodes most of whose text is in it."""
        roots = [k for k, t in enumerate(self.tag) if t in ("article", "main")]
        if not roots:
            return None
        n, inside, bad = len(self.tag), [False] * len(self.tag), [False] * len(self.tag)
        for k in range(1, n):
            bad[k] = bad[self.parent[k]] or self.against[k] or self.tag[k] in AGAINST_TAGS
            inside[k] = inside[self.parent[k]] or k in roots
        total, good = np.zeros(n), np.zeros(n)
        for node, text, _ in self.blocks:
            total[node] += len(text)
            good[node] += len(text) * (inside[node] and not bad[node])
        for k in range(n - 1, 0, -1):
            total[self.parent[k]] += total[k]
            good[self.parent[k]] += good[k]
        return np.where(total > 0, 2 * good >= total, [a and not b for a, b in zip(inside, bad, strict=True)]).astype(np.int64)


class Model:
    """Weights of the nodes' potentials, and log potentials [holds, parent's label, child's label]."""

    def __init__(self, weights: np.ndarray, passing: np.ndarray):
        self.weights, self.passing = weights, passing

    def marginals(self, page: Page) -> np.ndarray:
        """Probability that each node is content: messages up to the root, then down again."""
        score = (page.features() @ self.weights).tolist()
        n, parent, holds = len(score), page.parent, page.holds().tolist()
        table = np.exp(self.passing).tolist()
        # odds-free messages, scaled to sum 1
        belief = [[1 / (1 + np.exp(min(s, 40))), 1 / (1 + np.exp(max(-s, -40)))] for s in score]
        up = [(0.5, 0.5)] * n
        for k in range(n - 1, 0, -1):
            (b0, b1), t = belief[k], table[holds[k]]
            m0, m1 = t[0][0] * b0 + t[0][1] * b1, t[1][0] * b0 + t[1][1] * b1
            z = m0 + m1
            up[k] = m0, m1 = m0 / z, m1 / z
            p = belief[parent[k]]
            p[0], p[1] = p[0] * m0, p[1] * m1
            z = p[0] + p[1]
            p[0], p[1] = p[0] / z, p[1] / z
        for k in range(1, n):
            p, t, (m0, m1), b = belief[parent[k]], table[holds[k]], up[k], belief[k]
            q0, q1 = p[0] / max(m0, 1e-300), p[1] / max(m1, 1e-300)
            z = q0 + q1
            q0, q1 = q0 / z, q1 / z
            c0, c1 = b[0] * (q0 * t[0][0] + q1 * t[1][0]), b[1] * (q0 * t[0][1] + q1 * t[1][1])
            b[0], b[1] = c0 / (c0 + c1), c1 / (c0 + c1)
        return np.array([b[1] for b in belief])

    def text(self, source: str) -> str:
        page = Page(source)
        content = self.marginals(page) >= 0.5
        return "\n\n".join(text for node, text, _ in page.blocks if content[node])


def train(sources: list[str], rounds: int = 60) -> Model:
    """Piecewise training: node weights by Newton steps towards the labels with a prior, passing by smoothed counts."""
    rows, labels, passing = [], [], PASSING.copy()
    for source in sources:
        for plain in (False, True):
            page = Page(source)
            if (y := page.labels()) is None:
                break
            if plain:
                for k, t in enumerate(page.tag):
                    if t in ("article", "main"):
                        page.plain(k)
            rows.append(page.features())
            labels.append(y)
            if not plain:
                for k, h in zip(range(1, len(y)), page.holds()[1:], strict=True):
                    passing[h, y[page.parent[k]], y[k]] += 0.02
    weights = PRIOR.copy()
    if rows:
        x, y = np.concatenate(rows), np.concatenate(labels)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            gradient = x.T @ (y - p) / len(y) * 1000 - PRIOR_STRENGTH * (weights - PRIOR)
            curve = (x.T * (p * (1 - p))) @ x / len(y) * 1000 + PRIOR_STRENGTH * np.eye(len(weights))
            step = np.linalg.solve(curve, gradient)
            weights = weights + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
    return Model(weights, np.log(passing / passing.sum(2, keepdims=True)))


def fit(pages: DataFrame, sample: int = 300) -> Model:
    """The model from at most ``sample`` labelled pages; which ones depends on their html only."""
    named = pages.select("html").filter(F.col("html").rlike("(?i)<(article|main)[ >]"))
    first = named.select("html", F.xxhash64("html").alias("h")).orderBy("h", "html").limit(sample)
    return train(sorted(r["html"] for r in materialize(first, "labelled").collect()))


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.text(t) for t in texts(batch.column("html"))]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return run


def extract_text(pages: DataFrame, sample: int = 300) -> DataFrame:
    """(page_id, url, text, n_chars) of whole pages; blocks are joined by two line ends."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract(fit(pages, sample)), "page_id long, url string, text string, n_chars long")
