"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of block elements. Each element is content or not: its features (tag,
words in class and id, amount of text, share of links) give a node potential, parent and child a pair
potential that depends on what the parent is. Sum-product messages pass from the leaves to the root
and back, which gives every element's exact marginal; blocks of text whose element is content with a
probability of one half or more are kept in page order.

The potentials are trained on labelled pages: pages that mark their article themselves, elements in
it being content unless they are navigation, notes, forms or the like. Training maximises the pages'
exact conditional likelihood around a prior, on at most ``sample`` pages (those with the lowest hash
of url and html); extraction covers all pages and whole texts. Without labelled pages the prior holds.

Nulls: null html is an empty page with an empty text; null ids and urls are kept. Unclosed, stray and
cut-off markup is taken as browsers would roughly take it. Repeated rows are extracted each; extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.DOTALL)
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "body": {"html"}}
ASIDE = set("nav footer aside form script style head noscript button select iframe template dialog menu textarea title object svg canvas fieldset figure input".split()) - {"figure"}
ARTICLE = {"article", "main"}
# Fixed words by which sites name their parts.
AWAY = re.compile(r"\b(?:nav\w*|menu\w*|foot\w*|side\w*|aside|ad|ads|adv\w*|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|notice\w*|notif\w*|alert\w*|comment\w*|disqus|repl\w*|respond|discuss\w*|share\w*|social\w*|related|recommend\w*|breadcrumb\w*|crumb\w*|popup|modal|overlay|subscri\w*|newsletter|signup|login|search\w*|pagination|pager|widget\w*|masthead|topbar|toolbar|copyright|legal|disclaimer|skip\w*|hidden|tags?|meta|byline|header)\b", re.IGNORECASE)
TOWARD = re.compile(r"\b(?:article\w*|content\w*|post|entry\w*|story\w*|main\w*|body\w*|text\w*|prose)\b", re.IGNORECASE)
FEATURES = ("bias", "paragraph", "heading", "list", "table", "container", "article", "aside", "header", "away", "toward", "no text", "text", "links", "ends sentence")
PRIOR = np.array([-0.5, 1.0, 1.0, 0.0, 0.0, 0.0, 5.0, -8.0, -1.5, -7.0, 2.0, 0.0, 0.4, -2.5, 0.5])
# Log potentials (parent, child): the parent in neither, an aside, an article.
PAIR_PRIOR = np.array([[[1.0, -1.0], [-0.5, 1.5]], [[4.0, -8.0], [0.0, 0.0]], [[0.0, 0.0], [-1.0, 3.0]]])
PARAGRAPH, HEADINGS = {"p", "blockquote", "pre", "figcaption"}, {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS, TABLES = {"ul", "ol", "li", "dl", "dt", "dd"}, {"table", "tr", "td", "th", "tbody", "thead", "caption"}


class Page:
    """Elements (parent, tag, names) and blocks of text (element, text, characters in links)."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.named = [-1], ["html"], [""]
        self.blocks: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int]] = [("html", 0)]  # open tags, each with the block element it belongs to
        run: list[str] = []
        linked = [0]
        links = 0

        def flush() -> None:
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.blocks.append((stack[-1][1], text, linked[0]))
                run.clear()
                linked[0] = 0

        at, end = 0, len(source)
        while at < end:
            m = TOKEN.match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                t = m[0]
                if t[0] != "<" or len(t) == 1:
                    t = html.unescape(t) if "&" in t else t
                    run.append(t)
                    if links:
                        linked[0] += len(t)
                elif t.startswith("<![CDATA["):
                    run.append(t[9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if m[1]:
                if any(t == name for t, _ in stack[1:]):
                    if name not in INLINE:
                        flush()
                    while len(stack) > 1:
                        t, _ = stack[-1]
                        if t not in INLINE:
                            flush()
                        if t == "a":
                            links -= 1
                        stack.pop()
                        if t == name:
                            break
                elif name == "p":
                    flush()
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name in ("br", "img", "input"):
                    run.append(" ")
                continue
            if name in INLINE:
                stack.append((name, stack[-1][1]))
                links += name == "a"
                continue
            flush()
            if name == "html":
                continue
            shut = SAME.get(name, ())
            if shut or name in CLOSES_P:
                depth = len(stack) - 1
                while depth > 0:
                    t = stack[depth][0]
                    if t in shut or (name in CLOSES_P and t == "p"):
                        links -= sum(x[0] == "a" for x in stack[depth:])
                        del stack[depth:]
                    elif t not in INLINE and (t in SCOPE.get(name, ()) or (name not in SAME and t != "p")):
                        break
                    depth -= 1
                    depth = min(depth, len(stack) - 1)
            self.parent.append(stack[-1][1])
            self.tag.append(name)
            self.named.append(" ".join(a or b or c for a, b, c in NAMED.findall(m[3])) if m[3] else "")
            here = len(self.tag) - 1
            if name in RAW:
                stop = RAW_END[name].search(source, at)
                at = stop.start() if stop else end
                close = source.find(">", at) if stop else -1
                at = close + 1 if close >= 0 else end
            elif not (m[3] and m[3].endswith("/") and name in ("svg", "path", "use")):
                stack.append((name, here))
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        out = np.zeros((n, len(FEATURES)), np.float32)
        chars, words, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for e, text, links in self.blocks:
            chars[e] += len(text)
            words[e] += text.count(" ") + 1
            linked[e] += links
            stops[e] = max(stops[e], text[-1] in ".!?…。\"”")
        out[:, 0] = 1
        for i, t in enumerate(self.tag):
            k = 1 if t in PARAGRAPH else 2 if t in HEADINGS else 3 if t in LISTS else 4 if t in TABLES else 6 if t in ARTICLE else 7 if t in ASIDE else 8 if t == "header" else 5
            out[i, k] = 1
            if self.named[i]:
                named = re.sub(r"[_\-]+|(?<=[a-z])(?=[A-Z])", " ", self.named[i])
                away = bool(AWAY.search(named)) and t not in ARTICLE and t != "html" and t != "body"
                out[i, 9], out[i, 10] = away, bool(TOWARD.search(named)) and not away
        out[:, 11] = chars == 0
        out[:, 12] = np.minimum(np.log1p(words), 5)
        out[:, 13] = np.minimum(linked / np.maximum(chars, 1), 1)
        out[:, 14] = stops
        return out

    def kinds(self) -> np.ndarray:
        return np.array([1 if t in ASIDE else 2 if t in ARTICLE else 0 for t in self.tag], dtype=np.int8)

    def labels(self, features: np.ndarray) -> np.ndarray | None:
        """Content or not by the page's own article or main element; None where it has none."""
        if not any(t in ARTICLE for t in self.tag):
            return None
        out = np.zeros(len(self.tag), dtype=np.int8)
        away = (features[:, 7] > 0) | (features[:, 9] > 0)
        for i, t in enumerate(self.tag):  # parents come before their children
            out[i] = not away[i] and (t in ARTICLE or (self.parent[i] >= 0 and out[self.parent[i]]))
        return out


def depths(parent: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parent), np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            out[i] = out[p] + 1
    return out


def marginals(parent: np.ndarray, depth: np.ndarray, kind: np.ndarray, node: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-product over a forest: (node marginals [n, 2], pair marginals [n, parent, child], log
    normaliser per root). ``node`` [n, 2] and ``pair`` [kind, parent, child] are log potentials."""
    n = len(parent)
    below = node.copy()  # node potential and all messages from children
    up = np.zeros((n, 2))
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if n else []
    psi = np.zeros((n, 2, 2))
    inner = parent >= 0
    psi[inner] = pair[kind[parent[inner]]]
    for rows in reversed(levels[1:]):
        up[rows] = np.logaddexp(psi[rows, :, 0] + below[rows, None, 0], psi[rows, :, 1] + below[rows, None, 1])
        for s in (0, 1):
            below[:, s] += np.bincount(parent[rows], up[rows, s], n)
    down = np.zeros((n, 2))
    both = np.zeros((n, 2, 2))
    for rows in levels[1:]:
        rest = below[parent[rows]] + down[parent[rows]] - up[rows]
        joint = rest[:, :, None] + psi[rows]
        down[rows] = np.logaddexp(joint[:, 0], joint[:, 1])
        full = joint + below[rows, None, :]
        both[rows] = np.exp(full - np.logaddexp.reduce(full.reshape(len(rows), 4), axis=1)[:, None, None])
    belief = below + down
    z = np.logaddexp(belief[:, 0], belief[:, 1])
    return np.exp(belief - z[:, None]), both, z[parent < 0]


class Potentials:
    def __init__(self, node: np.ndarray = PRIOR, pair: np.ndarray = PAIR_PRIOR) -> None:
        self.node, self.pair = node.copy(), pair.copy()

    def infer(self, parent, depth, kind, features):
        score = features @ self.node
        return marginals(parent, depth, kind, np.stack((np.zeros_like(score), score), 1), self.pair)

    def fit(self, parent, depth, kind, features, labels, rounds: int = 60, rate: float = 0.05, hold: float = 0.02) -> Potentials:
        """Gradient ascent on the exact conditional likelihood less the squared distance from the prior."""
        inner = parent >= 0
        seen = np.zeros((3, 2, 2))
        np.add.at(seen, (kind[parent[inner]], labels[parent[inner]], labels[inner]), 1)
        trees = max(1, int((~inner).sum()))
        for _ in range(rounds):
            node, both, _ = self.infer(parent, depth, kind, features)
            g = features.T @ (labels - node[:, 1]) / trees
            expected = np.stack([both[inner][kind[parent[inner]] == k].sum(0) for k in range(3)])
            self.node += rate * (g - hold * (self.node - PRIOR))
            self.pair += rate * ((seen - expected) / trees - hold * (self.pair - PAIR_PRIOR))
        return self


def fitted(pages: DataFrame, sample: int = 200) -> Potentials:
    """Potentials from at most ``sample`` pages that mark their article."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0):
                page = Page(source.as_py())
                x = page.features()
                y = page.labels(x)
                if y is not None:
                    row = {"parent": [np.array(page.parent, np.int32).tobytes()], "kind": [page.kinds().tobytes()], "x": [x.tobytes()], "y": [y.tobytes()]}
                    yield pa.RecordBatch.from_pydict(row, schema=pa.schema([(k, pa.binary()) for k in row]))

    some = pages.select("html").where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).orderBy(F.xxhash64("html"), "html").limit(sample)
    rows = some.mapInArrow(parse, "parent binary, kind binary, x binary, y binary").collect()
    if not rows:
        return Potentials()
    parents, at = [], 0
    for r in rows:
        p = np.frombuffer(r["parent"], np.int32).astype(np.int64)
        parents.append(np.where(p >= 0, p + at, -1))
        at += len(p)
    parent = np.concatenate(parents)
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
    return Potentials().fit(parent, depths(parent), join("kind", np.int8), join("x", np.float32).reshape(at, -1), join("y", np.int8).astype(np.int64))


def text_of(source: str, potentials: Potentials, least: float = 0.5) -> str:
    page = Page(source)
    parent = np.array(page.parent, np.int64)
    node, _, _ = potentials.infer(parent, depths(parent), page.kinds(), page.features())
    return "\n".join(t for e, t, _ in page.blocks if node[e, 1] >= least)


def extract(pages: DataFrame, batch_pages: int = 64) -> DataFrame:
    """page_id, url, text, n_chars of each page (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(fitted(rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        potentials = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, batch_pages):
                part = batch.slice(k, batch_pages)
                parsed = [Page(x.as_py()) for x in part.column(2)]
                sizes = np.array([len(p.tag) for p in parsed])
                starts = np.cumsum(sizes) - sizes
                parent = np.concatenate([np.where(np.array(p.parent) >= 0, np.array(p.parent) + s, -1) for p, s in zip(parsed, starts.tolist(), strict=True)])
                node, _, _ = potentials.infer(parent, depths(parent), np.concatenate([p.kinds() for p in parsed]), np.concatenate([p.features() for p in parsed]))
                keep = (node[:, 1] >= 0.5).tolist()
                texts = ["\n".join(t for e, t, _ in p.blocks if keep[s + e]) for p, s in zip(parsed, starts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return rows.mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
