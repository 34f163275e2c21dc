"""Main text of web pages from a tree-structured graphical model.

Every node of a page (block or text run) is content or not. A node's own potential is the sum of the weights of its features;
a potential on each edge ties parent and child, by the kind of child. Sum-product messages run up from the leaves and down
from the root and give every node's exact marginal; text runs whose marginal exceeds one half are kept in page order.

Weights maximise the likelihood of labelled pages. Labels come from pages that mark their article: its text runs are content,
the page's others are not. As pages differ in mark-up, each labelled page is also trained on in further layouts (``LAYOUTS``),
where the same texts (some shortened) stand in other elements, some without telling names, and paragraphs of other pages stand in the places
beside the article. Training takes at most ``sample`` different labelled pages (least hash); extraction covers every page.

NULL and empty pages have the empty text, as have pages without content. Without labelled pages all shown text is kept.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from profilar.llm.page_tree import Page, read_page
from profilar.llm.samples import least_hashed
from profilar.session import save_and_reload

SAMPLE = 128
ROUNDS = 150
STEP = 0.15
PENALTY = 0.02
BATCH_NODES = 50_000


class Forest:
    """Trees of several pages as arrays, and exact inference on all of them at once."""

    def __init__(self, pages: list[Page], features: dict[str, int], grow: bool = False):
        starts = np.cumsum([0] + [len(p.parent) for p in pages])
        self.starts = starts
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s)
                                      for p, s in zip(pages, starts)]) if pages else np.zeros(0, dtype=np.int64)
        depth = np.concatenate([p.depth for p in pages]) if pages else np.zeros(0, dtype=np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
        # parents of each level, and where each of its nodes finds its own among them
        self.above = [np.unique(self.parent[level], return_inverse=True) if len(level) > 1 else (self.parent[level], level)
                      for level in self.levels]
        self.kind = np.array([t is None for p in pages for t in p.text], dtype=np.int64)
        node, feature = [], []
        for p, s in zip(pages, starts):
            for k, names in enumerate(p.features):
                for name in names:
                    f = features.setdefault(name, len(features)) if grow else features.get(name)
                    if f is not None:
                        node.append(s + k)
                        feature.append(f)
        self.node, self.feature = np.array(node, dtype=np.int64), np.array(feature, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.parent)

    def marginals(self, weights: np.ndarray, ties: np.ndarray, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Marginal of content for each node, and if asked for of each pair of labels for a node and its parent.

        ``ties``: log-potentials by kind of child, label of the parent and label of the child.
        """
        own = np.zeros((len(self), 2))
        own[:, 1] = np.bincount(self.node, weights[self.feature], len(self))
        gathered, up, tied = own.copy(), np.zeros((len(self), 2)), ties[self.kind]
        for level, (parents, place) in zip(self.levels[:0:-1], self.above[:0:-1]):
            joint = tied[level] + gathered[level][:, None, :]
            sent = np.logaddexp(joint[:, :, 0], joint[:, :, 1])  # for each label of the parent
            up[level] = sent
            if len(level) > 1:
                sent = np.stack([np.bincount(place, sent[:, label], len(parents)) for label in (0, 1)], axis=1)
            gathered[parents] += sent
        belief, pairs = gathered.copy(), np.zeros((len(self), 2, 2)) if with_pairs else None
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - up[level]  # what the parent knows without this child
            joint = above[:, :, None] + tied[level] + gathered[level][:, None, :]
            belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            if with_pairs:
                joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
                pairs[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pairs


@dataclass
class PageModel:
    features: dict[str, int]
    weights: np.ndarray
    ties: np.ndarray

    def texts(self, sources: list[str | None]) -> list[str]:
        """Main text of each page."""
        out: list[str] = []
        held: list[Page] = []
        size = 0
        for source in sources:
            held.append(read_page(source))
            size += len(held[-1].parent)
            if size >= BATCH_NODES:
                out += self._read(held)
                held, size = [], 0
        return out + self._read(held)

    def _read(self, pages: list[Page]) -> list[str]:
        forest = Forest(pages, self.features)
        content = forest.marginals(self.weights, self.ties)[0] > 0.5 if len(forest) else []
        return ["\n".join(t for k, t in enumerate(p.text) if t is not None and content[s + k])
                for p, s in zip(pages, forest.starts)]


def article_labels(page: Page) -> list[bool] | None:
    """Which nodes lie in the page's only article, itself included; None if there is not exactly one."""
    if page.tag.count("article") != 1:
        return None
    inside = [tag == "article" for tag in page.tag]
    for k, parent in enumerate(page.parent):
        inside[k] = inside[k] or parent >= 0 and inside[parent]
    return inside


# fixed values: layouts that labelled pages are re-set in; {main} is the article, {c} names its container or doesn't,
# {0} ... {9} are paragraphs of other pages, {s0} ... {s3} a few of their words, {anchors} and {links} linked words
LAYOUTS = (
    '<body><header class="site-header"><div class="logo">{s0}</div><nav class="menu"><ul>{links}</ul></nav></header>'
    '<div class="cookie-notice"><p>{0}</p><button>{s3}</button></div><main><div {c}>{main}</div></main>'
    '<aside class="sidebar"><h3>{s1}</h3><p>{1}</p><ul>{links}</ul></aside><footer><p>{2}</p></footer></body>',
    '<body><div id="header"><h2>{s0}</h2><div class="navigation">{anchors}</div></div><div {c}>{main}'
    '<div class="related"><h4>{s1}</h4><ul>{links}</ul></div></div><div id="comments"><h3>{s2}</h3><div class="comment"><p>{0}</p>'
    '</div><div class="comment"><p>{1}</p><p>{2}</p></div></div><div id="footer">{3}</div></body>',
    '<body><nav>{anchors}</nav><div class="wrap"><div class="col"><article>{main}<form><label>{s0}</label><p>{s1}</p>'
    '<button>{s2}</button></form></article></div><div class="col side"><div class="ad">{0}</div><div class="ads"><p>{1}</p></div>'
    '</div></div><footer class="foot">{s3} <a href="#">{s1}</a></footer></body>',
    '<body><table><tr><td class="menu"><ul>{links}</ul></td><td {c}>{main}</td></tr></table><p class="copyright">{s0}</p></body>',
    '<body><div class="banner"><p>{0}</p></div><section class="story"><article>{main}<aside><p>{1}</p></aside></article></section>'
    '<section class="comments"><article class="comment"><p>{2}</p></article><article class="comment"><p>{3}</p></article></section>'
    '<div role="contentinfo">{s0}</div></body>',
    '<body><div>{anchors}</div><div {c}>{main}</div><div class="newsletter"><p>{0}</p><form><input name="q"><button>{s1}</button></form>'
    '</div><div class="modal"><p>{1}</p></div><div><small>{s2}</small></div></body>',
    '<body><header><h1>{s0}</h1><p>{0}</p></header><main {c}>{main}<div class="share">{anchors}</div><div class="sponsored"><p>{1}</p>'
    '</div></main><div class="widget"><p>{2}</p></div><footer><p>{3}</p><ul>{links}</ul></footer></body>',
    '<body><div class="alert">{0}</div><div {c}><header><nav>{anchors}</nav></header>{main}<footer>{s0}</footer></div>'
    '<div class="replies"><ol><li>{1}</li><li><p>{2}</p></li></ol></div></body>',
    '<body><main><section>{main}</section></main><aside><section><h2>{s1}</h2><p>{0}</p></section></aside><section class="reviews">'
    '<h2>{s0}</h2><blockquote>{1}</blockquote><p>{2}</p></section><footer><div><h4>{s2}</h4><p>{3}</p></div></footer></body>',
    '<body><header>{s0}<p>{0}</p></header><div class="row"><div {c}><article>{main}</article></div><div class="right-sidebar">'
    '<h2>{s1}</h2><p>{1}</p><p>{2}</p></div></div><section id="respond"><h3>{s2}</h3><form><p>{3}</p></form></section></body>',
)
# fixed values: attributes of an article's container
CONTAINERS = ('class="content"', 'id="main-content"', 'class="entry-content"', 'class="post-body"', 'class="article-text"',
              'id="story"', 'class="container"', 'class="col-8"', "", "")


def _set_article(texts: list[tuple[str, str]], mark: str, rng: np.random.Generator) -> str:
    """Mark-up of an article's texts: a heading, and paragraphs among lists, quotations, subheads and the like."""
    out = []
    for n, (tag, text) in enumerate(texts):
        if tag == "h1":
            tag = str(rng.choice(["h1", "h1", "h2", "p"]))
        elif n and rng.random() < 0.3:
            tag = str(rng.choice(["li", "li", "li", "blockquote", "h2", "h3", "div", "figcaption", "pre", "dd", "td"]))
        if tag in ("h2", "h3") and n:
            text = " ".join(text.split()[:8])
        end = "" if tag == "p" and rng.random() < 0.2 else f"</{tag}>"
        before, after = {"li": ("<ul>", "</ul>"), "figcaption": ("<figure><img>", "</figure>"), "dd": ("<dl>", "</dl>"),
                         "td": ("<table><tr>", "</tr></table>")}.get(tag, ("", ""))
        out.append(f"{before}<{tag}>{mark}{html.escape(text)}{end}{after}")
    return "".join(out)


def labelled_pages(sources: list[str], seed: int = 5) -> list[tuple[Page, np.ndarray]]:
    """Pages with the labels of their nodes: as they are, and in every layout."""
    rng = np.random.default_rng(seed)
    read = [(page, inside) for page in map(read_page, sources) if (inside := article_labels(page)) is not None]
    inside_text = [[(page.tag[page.parent[k]], t) for k, t in enumerate(page.text) if t is not None and inside[k]]
                   for page, inside in read]
    pool = [t for texts in inside_text for _, t in texts]
    out = []
    for (page, inside), texts in zip(read, inside_text):
        out.append((page, _element_labels(page, np.array(inside, dtype=float))))
        if not texts:
            continue
        mark = "zq%dqz" % rng.integers(1 << 40)
        for layout in LAYOUTS:
            # one article in four is cut to its first runs of a few words
            used = texts if rng.random() < 0.75 else [
                (tag, " ".join(t.split()[:int(rng.integers(1, 5))])) for tag, t in texts[:int(rng.integers(1, 4))]]
            drawn = [html.escape(pool[int(k)]) for k in rng.integers(len(pool), size=16)]
            short = [" ".join(t.split()[:int(rng.integers(1, 5))]) for t in drawn]
            anchors = "".join(f'<a href="/x">{t}</a> ' for t in short[:6])
            links = "".join(f'<li><a href="/x">{t}</a></li>' for t in short[:6])
            named = {f"s{k}": short[6 + k] for k in range(4)}
            new = read_page(layout.format(*drawn[:10], main=_set_article(used, mark, rng), anchors=anchors, links=links,
                                          c=CONTAINERS[int(rng.integers(len(CONTAINERS)))], **named))
            labels = np.array([t is not None and t.startswith(mark) for t in new.text], dtype=float)
            new.text = [t.removeprefix(mark) if t is not None else None for t in new.text]
            out.append((new, _element_labels(new, labels)))
    return out


def _element_labels(page: Page, labels: np.ndarray) -> np.ndarray:
    """Labels of the text runs, and for each element whether content fills over half of the text below it."""
    size = np.array([0 if t is None else len(t) for t in page.text], dtype=float)
    content = size * labels
    for k in range(len(size) - 1, 0, -1):  # children follow their parents
        size[page.parent[k]] += size[k]
        content[page.parent[k]] += content[k]
    return np.where([t is None for t in page.text], content > 0.5 * size, labels).astype(float)


def train(sources: list[str], rounds: int = ROUNDS, step: float = STEP, penalty: float = PENALTY) -> PageModel:
    """Maximise the labels' penalised likelihood by gradient ascent with per-weight steps."""
    pages = labelled_pages(sources)
    features: dict[str, int] = {}
    forest = Forest([p for p, _ in pages], features, grow=True)
    model = PageModel(features, np.zeros(len(features)), np.zeros((2, 2, 2)))
    if not pages:
        model.features, model.weights = {"text": 0}, np.array([1.0])
        return model
    y = np.concatenate([labels for _, labels in pages])
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1.0)
    value = np.zeros(len(features) + 8)
    first, second = np.zeros_like(value), np.zeros_like(value)
    for n in range(1, rounds + 1):
        content, pairs = forest.marginals(value[:-8], value[-8:].reshape(2, 2, 2), with_pairs=True)
        expected = np.stack([pairs[child[forest.kind[child] == kind]].sum(axis=0) for kind in (0, 1)])
        slope = np.concatenate([np.bincount(forest.feature, (y - content)[forest.node], len(features)),
                                (seen - expected).ravel()]) / len(pages) - penalty * value / 10
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
        value += step * (first / (1 - 0.9 ** n)) / (np.sqrt(second / (1 - 0.99 ** n)) + 1e-8)
    model.weights, model.ties = value[:-8], value[-8:].reshape(2, 2, 2)
    return model


def learn(pages: DataFrame, source: str = "html", sample: int = SAMPLE) -> PageModel:
    """Train on at most ``sample`` different pages that mark one article, those of least hash.

    Pages are read in ranges of their hash from the least on, each eight times as wide, until one holds enough.
    """
    @F.pandas_udf("boolean")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            marks = {s: article_labels(read_page(s)) is not None for s in set(batch)}
            yield batch.map(marks).astype(bool)

    hashed = pages.where(F.col(source).isNotNull()).select(F.xxhash64(source).alias("h"), F.col(source).alias("s"))
    share = 8 * sample / max(hashed.count(), 1)
    while True:
        reach = hashed.where(F.shiftrightunsigned("h", 11).cast("double") * 2.0 ** -53 < share)
        # what has no such tag in its source has no such element
        marked = reach.where(F.lower("s").contains("article")).where(labelled("s")).select("h").distinct()
        chosen = [row["h"] for row in least_hashed(save_and_reload(marked, "labelled"), F.col("h"), sample).collect()]
        if len(chosen) >= sample or share >= 1:
            break
        share *= 8
    taken = hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("s").alias("s"))
    return train([row["s"] for row in sorted(taken.collect(), key=lambda row: row["h"])])


def extract(pages: DataFrame, model: PageModel, source: str = "html", result: str = "text") -> DataFrame:
    """``pages`` with the main text of each."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    @F.pandas_udf("string")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.texts(list(batch)), dtype=object)

    return pages.withColumn(result, each(F.col(source)))
