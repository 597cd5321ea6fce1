"""HTML extraction: a tree-structured graphical model over the elements of a page.

Each element is content or not. Its tag, names, text and links give a unary potential; parent and child share a pairwise
one. Messages go up from the leaves and down from the root, after which each element has its exact marginal; a block
belongs to the text when its element is more likely content than not. Both potentials are learned from labelled pages,
which ``labelled_pages`` writes from a seed: the tables hold no labels.
"""

from __future__ import annotations

import functools
import html
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, tidy
from .dom import INLINE, Page

#: Labelled pages that are learned from.
PAGES = 500

#: Words that sites use in class and id names.
NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toolbar tabs toc skip",
    "header": "header masthead banner top brand logo hero",
    "footer": "footer foot bottom copyright colophon legal",
    "side": "sidebar side aside rail related recommended popular trending widget tags archive",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay message dialog",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad adsense outbrain taboola",
    "form": "form search login signup signin subscribe newsletter register contact",
    "comment": "comment comments reply replies discussion disqus respond commentlist feedback",
    "share": "share sharing social follow byline author-box",
    "content": "article content post entry story main body text article-body post-content entry-content maincontent prose",
}
_OF = {w: k for k, ws in enumerate(NAMES.values()) for w in ws.split()}
_TAGS = "#page html head body nav header footer aside main article section div p h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre figure figcaption form dl dt dd center address details summary fieldset button dialog".split()
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
_PART = re.compile(r"[a-z]+(?:-[a-z]+)?|[a-z]+")
#: Groups of child tags that have pairwise potentials of their own.
KINDS = {t: 1 for t in ("nav", "header", "footer", "aside", "form", "dialog", "button", "fieldset")} | {t: 2 for t in ("article", "main")} | {t: 3 for t in INLINE}
N_NAMES, N_TAGS = len(NAMES), len(_TAGS) + 2
N_FEATURES = N_TAGS + N_NAMES + 8


def _name_ids(names: str) -> set[int]:
    out = set()
    for token in names.split():
        for w in (token, *_PART.findall(token), *re.split(r"[-_]+", token)):
            if w in _OF:
                out.add(_OF[w])
    return out


def features(page: Page) -> list[list[tuple[int, float]]]:
    """Sparse features by element: tag, names, own text, share of it in links, and what the subtree holds."""
    n = len(page.tag)
    total, in_links = page.own[:], page.linked[:]
    for e in range(n - 1, 0, -1):
        total[page.parent[e]] += total[e]
        in_links[page.parent[e]] += in_links[e]
    every = max(1, total[0])
    out = []
    base = N_TAGS + N_NAMES
    for e in range(n):
        f = [(_TAG_AT.get(page.tag[e], N_TAGS - 2 if page.tag[e] in INLINE else N_TAGS - 1), 1.0)]
        if page.names[e]:
            f += [(N_TAGS + k, 1.0) for k in _name_ids(page.names[e])]
        own = page.own[e]
        f += [(base, 1.0), (base + 1, math.log1p(own) / 5), (base + 2, min(1.0, page.linked[e] / own) if own else 0.0), (base + 3, min(1.0, in_links[e] / total[e]) if total[e] else 0.0)]
        f += [(base + 4, total[e] / every), (base + 5, 1.0 if own > 80 else 0.0), (base + 6, e / n), (base + 7, 1.0 if own == 0 else 0.0)]
        out.append(f)
    return out


@dataclass
class TreeModel:
    """weights of the unary log odds; pair[kind][parent][child] are pairwise potentials."""

    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, page: Page) -> list[float]:
        """Probability of content by element: sum-product, exact on a tree."""
        w = self.weights.tolist()
        n = len(page.tag)
        belief = [0.0] * n
        for e, f in enumerate(features(page)):
            s = 0.0
            for k, v in f:
                s += w[k] * v
            belief[e] = max(-12.0, min(12.0, s))
        pair = self.pair.tolist()
        up = [0.0] * n
        parent, tag = page.parent, page.tag
        for e in range(n - 1, 0, -1):  # children come after their parents
            (p00, p01), (p10, p11) = pair[KINDS.get(tag[e], 0)]
            x = math.exp(max(-30.0, min(30.0, belief[e])))
            up[e] = math.log((p10 + p11 * x) / (p00 + p01 * x))
            belief[parent[e]] += up[e]
        for e in range(1, n):
            (p00, p01), (p10, p11) = pair[KINDS.get(tag[e], 0)]
            x = math.exp(max(-30.0, min(30.0, belief[parent[e]] - up[e])))
            belief[e] += math.log((p01 + p11 * x) / (p00 + p10 * x))
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, b)))) for b in belief]

    def text(self, source: str) -> str:
        if not source:
            return ""
        page = Page(source)
        if not page.blocks:
            return ""
        if len(page.tag) == 1:  # text without any element
            return " ".join(t for _, t in page.blocks)
        m = self.marginals(page)
        return " ".join(t for e, t in page.blocks if m[e] > 0.5)


def labelled_pages(count: int = PAGES, seed: int = 3) -> list[tuple[str, set[str]]]:
    """(html, texts of its content blocks). Every block's text is unique, so a block's label is whether it is among them."""
    r = np.random.default_rng(seed)
    syllables = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo za".split()
    serial = 0

    def words(low: int, high: int) -> str:
        nonlocal serial
        serial += 1
        k = int(r.integers(low, high + 1))
        return " ".join(["".join(r.choice(syllables, int(r.integers(1, 5)))) for _ in range(k)]).capitalize() + f" q{serial}."

    def pick(*options: str) -> str:
        return options[int(r.integers(len(options)))]

    def name(kind: str, chance: float = 0.8) -> str:
        return f' {pick("class", "id")}="{pick(*NAMES[kind].split())}"' if r.random() < chance else ""

    def menu() -> str:
        items = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(int(r.integers(3, 9))))
        return pick(f"<nav{name('menu', .5)}><ul>{items}</ul></nav>", f"<div{name('menu', 1)}><ul>{items}</ul></div>", f"<ul{name('menu', 1)}>{items}</ul>")

    def aside(kind: str) -> str:
        body = pick(f"<p>{words(4, 30)}</p>", f"<h3>{words(1, 4)}</h3><ul><li><a href='/y'>{words(3, 8)}</a></li><li><a href='/z'>{words(3, 8)}</a></li></ul>", words(4, 25))
        tag = {"side": pick("aside", "div"), "notice": pick("div", "div", "dialog", "section"), "advert": pick("div", "aside", "section")}[kind]
        return f"<{tag}{name(kind, 1 if tag != 'aside' else .5)}>{body}</{tag}>"

    def form() -> str:
        return f"<form{name('form', .5)}><label>{words(1, 4)}</label><input name='q'><button>{words(1, 2)}</button><p>{words(3, 15)}</p></form>"

    def comments() -> str:
        each = "".join(f"<{t}{name('comment', .6)}><b>{words(1, 2)}</b><p>{words(5, 60)}</p></{t}>" for t in [pick("div", "li", "article")] for _ in range(int(r.integers(1, 5))))
        return f"<{(t := pick('div', 'section', 'ol'))}{name('comment', 1)}><h3>{words(1, 3)}</h3>{each}</{t}>"

    def footer() -> str:
        body = pick(f"&copy; {words(3, 20)}", f"<p>{words(3, 20)}</p><ul><li><a href='/t'>{words(1, 3)}</a></li></ul>", words(5, 15))
        return pick(f"<footer{name('footer', .3)}>{body}</footer>", f"<div{name('footer', 1)}>{body}</div>")

    out = []
    for _ in range(count):
        serial_content: set[str] = set()

        def own(text: str, keep=serial_content) -> str:
            keep.add(" ".join(html.unescape(re.sub(r"<[^>]*>", "", text)).split()))
            return text

        def block() -> str:
            kind = r.random()
            if kind < 0.65:
                text = own(words(1, 3 if r.random() < 0.5 else 90) if r.random() < 0.85 else f"{words(1, 20)} <a href='/l'>{words(1, 4)}</a> {words(1, 20)}")
                return pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>")
            if kind < 0.75:
                return f"<h2>{own(words(1, 8))}</h2>"
            if kind < 0.83:
                return f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{own(words(1, 20))}</li>" for _ in range(int(r.integers(1, 5)))) + f"</{t}>"
            if kind < 0.88:
                return f"<blockquote>{own(words(5, 40))}</blockquote>"
            if kind < 0.92:
                return f"<pre>{own(words(3, 20))}</pre>"
            if kind < 0.96:
                return f"<table><tr><td>{own(words(1, 8))}</td><td>{own(words(1, 8))}</td></tr></table>"
            return aside(pick("advert", "side", "notice"))

        title = own(words(1, 12))
        body = f"<h1>{title}</h1>" if r.random() < 0.9 else f"<header><h1>{title}</h1></header>"
        if r.random() < 0.3:
            body += f"<p><b>{own(words(2, 15))}<br>"
        body += "".join(block() for _ in range(int(r.integers(0 if r.random() < 0.15 else 1, 14))))
        if r.random() < 0.15:
            body += f"<div{name('share', 1)}><a href='/s'>{words(1, 3)}</a></div>"
        tag = pick("article", "article", "main", "div", "section", "td")
        start, end = (f"<table><tr><td{name('content', 1)}>", "</td></tr></table>") if tag == "td" else (f"<{tag}{name('content', 1 if tag in ('div', 'section') else .4)}>", f"</{tag}>")
        content = start + body + end
        if r.random() < 0.35:
            content = f"<{(t := pick('div', 'main', 'section'))}{name('content', .3) if t != 'main' else ''}>{content}{comments() if r.random() < 0.4 else ''}</{t}>"
        page = ""
        if r.random() < 0.5:
            page += f"<header{name('header', .4)}><h1>{words(1, 3)}</h1><p>{words(2, 8)}</p></header>" if r.random() < 0.6 else f"<div{name('header', 1)}><a href='/'>{words(1, 3)}</a></div>"
        page += menu() if r.random() < 0.8 else ""
        before = [aside(k) for k in ("advert", "notice", "side") if r.random() < 0.35] + ([form()] if r.random() < 0.2 else [])
        after = [aside(k) for k in ("advert", "notice", "side") if r.random() < 0.3] + ([comments()] if r.random() < 0.3 else []) + ([form()] if r.random() < 0.2 else [])
        page += "".join(before) + content + "".join(after) + (footer() if r.random() < 0.85 else "")
        out.append((f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}" + ("</body></html>" if r.random() < 0.9 else ""), serial_content))
    return out


def train(pages: list[tuple[str, set[str]]], steps: int = 400) -> TreeModel:
    """Logistic unary potentials by gradient descent, pairwise potentials from smoothed counts over the unary's share."""
    x_rows, y, pairs = [], [], np.ones((4, 2, 2))
    for source, content in pages:
        page = Page(source)
        n = len(page.tag)
        good, bad = [0] * n, [0] * n
        for e, t in page.blocks:
            (good if t in content else bad)[e] += len(t)
        for e in range(n - 1, 0, -1):
            good[page.parent[e]] += good[e]
            bad[page.parent[e]] += bad[e]
        # An element is content if its subtree has content only, or content mostly.
        label = [int(g > 2 * b) for g, b in zip(good, bad)]
        for e, f in enumerate(features(page)):
            if good[e] + bad[e]:
                row = np.zeros(N_FEATURES)
                for k, v in f:
                    row[k] += v
                x_rows.append(row)
                y.append(label[e])
                if e:
                    pairs[KINDS.get(page.tag[e], 0), label[page.parent[e]], label[e]] += 1
    x, y = np.array(x_rows), np.array(y, dtype=np.float64)
    w = np.zeros(N_FEATURES)
    m = np.zeros_like(w)
    v = np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    given_parent = pairs / pairs.sum(axis=2, keepdims=True)
    share = pairs.sum(axis=1) / pairs.sum(axis=(1, 2))[:, None]  # the unary knows the child's own share
    return TreeModel(w, given_parent / share[:, None, :])


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: id, url, text, n_chars (code points).

    Null and empty html, and html without content, give an empty text; text without any element is all content. Ids and urls pass through as they are, null or
    repeated. Pages are read whole, one at a time; an empty table gives an empty result, other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches):
        m = shared.value
        for b in batches:
            texts = [m.text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(tidy(run), f"`{id_col}` {kinds['id']}, `{url_col}` {kinds['url']}, text string, n_chars long")


@functools.lru_cache(maxsize=1)
def trained() -> TreeModel:
    """The model that the seeded pages give, once a process."""
    return train(labelled_pages())


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained())
