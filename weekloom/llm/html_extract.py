"""HTML extraction by a tree-structured graphical model.

Every block element and every text block of a page is a node with a hidden label, content or not. A node's
own potential is a weighted sum of its features (tag, words of class, id and role, link density, length,
whether an article or main element encloses it); an edge potential couples each node with its parent. Exact
sum-product messages pass from the leaves to the root and back, and the text blocks whose marginal is above
one half are the main text.

The weights are fitted on a bounded sample of labelled pages: pages with exactly one article element, whose
text blocks are content unless a menu, aside, form, footer or comment section inside the article holds them.
Fitting maximises the conditional likelihood with gradients from the same messages; a Gaussian prior around
hand-set weights speaks where the sample has no example. Every page is then extracted in whole, map-only.

Edge cases: null, empty and markup-free inputs work (bare text is judged like any block). Unclosed and
truncated markup is closed at the end. Without a labelled page the prior weights are used. Pages of any length
and depth take time in proportion. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.dom import INLINE_HEADS, Node, parse

#: Labelled pages that a model is fitted on, and the longest page among them.
SAMPLE, SAMPLE_CHARS = 200, 100_000
STEPS, RATE, PULL = 25, 0.3, 0.02

#: Words of class, id and role that speak against and for main content.
AGAINST = frozenset(
    "ad ads advert advertisement adsense alert aside banner breadcrumb breadcrumbs byline captcha comment comments consent "
    "contentinfo cookie cookies copyright dialog disqus footer form gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice overlay pager pagination popup privacy promo promoted recommended related reply replies "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
FOR = frozenset("article articlebody body content entry main post story text".split())
TAGS = {"nav": -6.0, "aside": -6.0, "footer": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "article": 5.0, "main": 4.0}
PRIOR = {f"tag:{t}": w for t, w in TAGS.items()} | {
    "page header": -5.0, "against": -7.0, "for": 4.0, "hidden": -7.0, "enclosed": 2.0, "outside": -3.0, "apart": -6.0, "bias": -0.3,
    "heading": 0.6, "p": 1.5, "li": 0.0, "linked": -2.5, "long": 1.5, "loose": -0.5,
}
#: Edge potentials (parent label, child label) per kind of child; a parent without content seldom has any below.
EDGES = {(k, a, b): w for k in ("#text", "block") for (a, b), w in {(0, 0): 0.7, (0, 1): -0.7, (1, 0): -1.0, (1, 1): 1.5}.items()}


def kind(node: Node) -> str:
    return "#text" if node.tag == "#text" else "block"


def against(n: Node) -> bool:
    return n.tag not in ("body", "html", "article", "main") and any(w in AGAINST for w in n.names)


def stands_apart(n: Node) -> bool:
    return TAGS.get(n.tag, 0.0) < 0 or n.hidden or against(n)


def features(nodes: list[Node]) -> list[list[str]]:
    out: list[list[str]] = []
    enclosed, apart = [False] * len(nodes), [False] * len(nodes)
    marked = any(n.tag in ("article", "main") for n in nodes)
    for i, n in enumerate(nodes):
        f = ["bias"] if n.parent >= 0 else []
        above = n.parent >= 0 and enclosed[n.parent]
        enclosed[i] = above or n.tag in ("article", "main")
        apart[i] = (n.parent >= 0 and apart[n.parent]) or stands_apart(n) or (n.tag == "header" and not above)
        if n.tag == "#text":
            owner = nodes[n.parent].tag
            f.append("heading" if owner in INLINE_HEADS else "p" if owner in ("p", "blockquote", "pre") else "li" if owner == "li" else "loose")
            if n.chars and n.linked > 0.5 * n.chars:
                f.append("linked")
            if n.chars > 80:
                f.append("long")
            if apart[i]:
                f.append("apart")
            if marked and not above:
                f.append("outside")
        else:
            if n.tag in TAGS:
                f.append(f"tag:{n.tag}")
            if n.tag == "header" and not above:
                f.append("page header")
            if n.hidden:
                f.append("hidden")
            if against(n):
                f.append("against")
            elif any(w in FOR for w in n.names):
                f.append("for")
        if above:
            f.append("enclosed")
        out.append(f)
    return out


def soft(x: float, y: float) -> float:
    """log(e^x + e^y)"""
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def marginals(nodes: list[Node], unary: list[float], edges: dict) -> tuple[list[float], list[list[float]]]:
    """P(content) of each node, and per node the joint table with its parent (00, 01, 10, 11)."""
    n = len(nodes)
    tables = {k: [edges[k, a, b] for a in (0, 1) for b in (0, 1)] for k in ("#text", "block")}
    up, message = list(unary), [0.0] * n  # log odds from below; message to the parent
    for i in range(n - 1, 0, -1):
        t = tables[kind(nodes[i])]
        message[i] = soft(t[2], t[3] + up[i]) - soft(t[0], t[1] + up[i])
        up[nodes[i].parent] += message[i]
    belief, joint = list(up), [[0.0] * 4 for _ in range(n)]
    for i in range(1, n):
        t, p = tables[kind(nodes[i])], nodes[i].parent
        rest = belief[p] - message[i]
        belief[i] = up[i] + soft(t[1], t[3] + rest) - soft(t[0], t[2] + rest)
        logs = [t[0], t[1] + up[i], t[2] + rest, t[3] + rest + up[i]]
        top = max(logs)
        e = [math.exp(x - top) for x in logs]
        s = sum(e)
        joint[i] = [x / s for x in e]
    return [1 / (1 + math.exp(-max(-700.0, min(700.0, b)))) for b in belief], joint


def labels(nodes: list[Node]) -> list[int] | None:
    """Labels of a page with exactly one article element; None for other pages."""
    if sum(n.tag == "article" for n in nodes) != 1:
        return None
    out = []
    for n in nodes:
        inside = n.tag == "article" or (n.parent >= 0 and out[n.parent] == 1)
        out.append(int(inside and not stands_apart(n)))
    return out


class Model:
    def __init__(self) -> None:
        self.weights, self.edges = dict(PRIOR), dict(EDGES)

    def fit(self, pages: list[str]) -> Model:
        seen = [(nodes, features(nodes), y) for nodes in map(parse, pages) if (y := labels(nodes)) is not None]
        total = sum(len(nodes) for nodes, _, _ in seen)
        for _ in range(STEPS if seen else 0):
            gw, ge = dict.fromkeys(self.weights, 0.0), dict.fromkeys(self.edges, 0.0)
            for nodes, fs, y in seen:
                p, joint = marginals(nodes, self.unary(fs), self.edges)
                for i, f in enumerate(fs):
                    for name in f:
                        gw[name] += y[i] - p[i]
                    if i:
                        k = kind(nodes[i])
                        for a in (0, 1):
                            for b in (0, 1):
                                ge[k, a, b] += ((y[nodes[i].parent], y[i]) == (a, b)) - joint[i][2 * a + b]
            for g, w, prior in ((gw, self.weights, PRIOR), (ge, self.edges, EDGES)):
                for name in w:
                    w[name] += RATE * (10 * g[name] / total - PULL * (w[name] - prior[name]))
        return self

    def unary(self, fs: list[list[str]]) -> list[float]:
        return [sum(self.weights[name] for name in f) for f in fs]

    def extract(self, html: str | None) -> str:
        nodes = parse(html or "")
        if len(nodes) == 1:
            return ""
        p, _ = marginals(nodes, self.unary(features(nodes)), self.edges)
        return "\n".join(n.text for n, x in zip(nodes, p) if n.tag == "#text" and x > 0.5)


def fitted(pages: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most ``sample`` labelled pages, picked by hash so that reruns agree."""
    rows = (
        pages.where(F.col("html").contains("<article") & (F.length("html") <= chars))
        .select("html", F.xxhash64("url", "html").alias("_h"))
        .orderBy("_h", "html")
        .limit(sample)
        .collect()
    )
    return Model().fit([r["html"] for r in rows])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url and the main text of every page."""
    model = model or fitted(pages)
    slim = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [model.extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string())], names=["page_id", "url", "text"])

    schema = f"{slim.select('page_id', 'url').schema.simpleString()[7:-1]},text:string"
    return slim.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
