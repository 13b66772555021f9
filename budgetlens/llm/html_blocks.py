"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags. A
block is described by the hashed names on its tag path (tags, classes, ids,
roles), by its hashed words, and by a few ratios. A bidirectional LSTM in numpy
reads a page's whole sequence of blocks and labels each one as main text or
not, so that a block is judged by what surrounds it as well.

The labeller is trained here, on pages composed by rule from many layouts,
whose labels are known because the rule places the blocks, filled with words
of a bounded sample of the given pages. No block of the sample is labelled by
hand or by pattern.
"""

from __future__ import annotations

import html as html_chars
import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import map_batches

#: Tags whose text joins the text around it (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIP = frozenset("script style template noscript svg math iframe object canvas title select textarea".split())
#: Of these, the ones that a slash at the end of their tag closes.
FOREIGN = frozenset(("svg", "math"))
#: An opening tag of these ends an open paragraph; those of the second list end an open one of their kind.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
                   "p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                       re.IGNORECASE)
WORD = re.compile(r"[a-z]+|[^\W\d_a-z]+")
SPACE = re.compile(r"\s+")
#: Inputs: hashed path names, hashed words, ratios.
PATH_DIM, WORD_DIM, N_RATIOS = 192, 96, 8
DIM = PATH_DIM + WORD_DIM + N_RATIOS


class Block:
    __slots__ = ("text", "path", "linked", "index")

    def __init__(self, text: str, path: tuple[str, ...], linked: int, index: int):
        self.text, self.path, self.linked, self.index = text, path, linked, index


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    out = [tag]
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in ATTRIBUTE.finditer(attributes):
            value = m.group(2) or m.group(3) or m.group(4) or m.group(1)
            out += [f".{w}" for w in WORD.findall(value.lower())]
    return tuple(out)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order: character references decoded, white
    space made single, trimmed; blocks without text left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = anchors = 0
    skip = ""
    at = 0

    def close() -> None:
        nonlocal linked
        whole = "".join(text)
        if "&" in whole:
            whole = html_chars.unescape(whole)
        whole = SPACE.sub(" ", whole).strip()
        if whole:
            out.append(Block(whole, tuple(n for _, names in stack for n in names), min(linked, len(whole)), len(out)))
        text.clear()
        linked = 0

    def leave(upto: int) -> None:
        nonlocal anchors
        close()
        del stack[upto:]

    n = len(page)
    while at < n:
        if skip:
            end = re.compile(rf"</{re.escape(skip)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at, skip = (end.end() if end else n), ""
            continue
        m = PIECE.search(page, at)
        raw = page[at:m.start()] if m else page[at:]
        if raw:
            text.append(raw)
            if anchors:
                linked += len(raw)
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in INLINE:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
            else:
                close()
            continue
        if tag in SKIP:
            if tag not in FOREIGN or not m.group(3).rstrip().endswith("/"):
                skip = tag
            text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                anchors += 1
            elif tag in ("br", "img"):
                text.append(" ")
            continue
        close()
        anchors = 0
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    leave(k)
                    break
                if stack[k][0] in ("td", "th", "div", "article", "section", "body"):
                    break
        if tag in SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SAME[tag]:
                    leave(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "tbody"):
                    break
        if tag not in VOID:  # a slash at the end of a tag closes no HTML element
            stack.append((tag, names_of(tag, m.group(3))))
    close()
    return out


def bucket(name: str, size: int, salt: int = 0) -> int:
    return zlib.crc32(name.encode("utf-8", "replace"), salt) % size


class WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        k = self[word] = bucket(word, WORD_DIM, 7)
        return k


def vectors(blocks: list[Block], names: dict[str, int]) -> np.ndarray:
    """One row of inputs for each block; ``names`` is a cache of path buckets."""
    x = np.zeros((len(blocks), DIM), np.float32)
    paths: dict[tuple[str, ...], np.ndarray] = {}
    words_at = WordBuckets()
    for i, b in enumerate(blocks):
        if b.path not in paths:
            row = np.zeros(PATH_DIM, np.float32)
            for depth, name in enumerate(reversed(b.path)):
                k = names.get(name)
                if k is None:
                    k = names[name] = bucket(name, PATH_DIM)
                row[k] = max(row[k], 1.0 if depth < 4 else 0.7)
            paths[b.path] = row
        x[i, :PATH_DIM] = paths[b.path]
        words = WORD.findall(b.text.lower())
        if words:
            at = [words_at[w] for w in words]
            counts = np.bincount(at, minlength=WORD_DIM)
            x[i, PATH_DIM:PATH_DIM + WORD_DIM] = counts / np.sqrt((counts * counts).sum())
        n = len(b.text)
        stops = b.text.count(".") + b.text.count(",")
        x[i, -N_RATIOS:] = (min(1.0, np.log1p(n) / 8), b.linked / n, min(1.0, 20 * stops / n), len(words) < 4,
                            i / len(blocks), i == 0, i == len(blocks) - 1, not b.path)
    return x


class Lstm:
    """Bidirectional LSTM over padded pages and a logistic output; Adam training."""

    def __init__(self, hidden: int = 16, dim: int = DIM, inner: int = 24, seed: int = 1):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden = hidden
        self.p = {"e": rng.normal(0, 0.15, (dim, inner)).astype(f), "o": rng.normal(0, 0.2, 2 * hidden + inner).astype(f),
                  "c": np.zeros(1, f)}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.2, (inner + hidden, 4 * hidden)).astype(f)
            self.p["v" + d] = np.zeros(4 * hidden, f)
            self.p["v" + d][hidden:2 * hidden] = 1.0  # forget little at first

    def _pass(self, e: np.ndarray, mask: np.ndarray, d: str, keep: list | None):
        n, t, _ = e.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.zeros((n, t, k), np.float32)
        w, v = self.p["w" + d], self.p["v" + d]
        for j in (range(t) if d == "f" else range(t - 1, -1, -1)):
            z = np.concatenate((e[:, j], h), axis=1)
            g = z @ w + v
            s = 1 / (1 + np.exp(-np.clip(g[:, :3 * k], -30, 30)))
            a = np.tanh(g[:, 3 * k:])
            m = mask[:, j:j + 1]
            c2 = s[:, k:2 * k] * c + s[:, :k] * a
            th = np.tanh(c2)
            h2 = s[:, 2 * k:] * th
            if keep is not None:
                keep.append((j, z, s, a, c, th, m))
            c, h = m * c2 + (1 - m) * c, m * h2 + (1 - m) * h
            out[:, j] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        e = np.tanh(x @ self.p["e"])
        f, b = [], []
        hf = self._pass(e, mask, "f", f if kept is not None else None)
        hb = self._pass(e, mask, "b", b if kept is not None else None)
        top = np.concatenate((hf, hb, e), axis=2)
        y = 1 / (1 + np.exp(-np.clip(top @ self.p["o"] + self.p["c"], -30, 30)))
        if kept is not None:
            kept |= {"e": e, "f": f, "b": b, "top": top}
        return y

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict = {}
        p = self.forward(x, mask, kept)
        k = self.hidden
        dy = (p - y) * mask / max(1.0, mask.sum())
        g = {"o": np.einsum("nt,ntk->k", dy, kept["top"]), "c": dy.sum(keepdims=True).reshape(1)}
        dtop = dy[:, :, None] * self.p["o"]
        de = dtop[:, :, 2 * k:].copy()
        inner = de.shape[2]
        for d, at in (("f", 0), ("b", k)):
            w = self.p["w" + d]
            gw, gv = np.zeros_like(w), np.zeros(4 * k, np.float32)
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            for j, z, s, a, c, th, m in reversed(kept[d]):
                dh = dh + dtop[:, j, at:at + k]
                dh2, dc2 = m * dh, m * dc
                i, fg, o = s[:, :k], s[:, k:2 * k], s[:, 2 * k:]
                dc2 = dc2 + dh2 * o * (1 - th * th)
                dg = np.concatenate((dc2 * a * i * (1 - i), dc2 * c * fg * (1 - fg), dh2 * th * o * (1 - o),
                                     dc2 * i * (1 - a * a)), axis=1)
                gw += z.T @ dg
                gv += dg.sum(axis=0)
                dz = dg @ w.T
                de[:, j] += dz[:, :inner]
                dh = (1 - m) * dh + dz[:, inner:]
                dc = (1 - m) * dc + dc2 * fg
            g["w" + d], g["v" + d] = gw, gv
        de *= 1 - kept["e"] ** 2
        g["e"] = x.reshape(-1, x.shape[2]).T @ de.reshape(-1, inner)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, size: int = 32, rate: float = 0.01,
            seed: int = 2) -> Lstm:
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), size):
                some = [pages[i] for i in order[a:a + size]]
                x, mask = padded([s[0] for s in some])
                y = padded([s[1][:, None] for s in some])[0][:, :, 0]
                # Names and words the layouts never use must not be relied on.
                x[:, :, :PATH_DIM + WORD_DIM] *= rng.random((len(some), 1, PATH_DIM + WORD_DIM)) > 0.1
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9 ** step)) /
                                 (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(r) for r in rows)
    x = np.zeros((len(rows), t, rows[0].shape[1]), np.float32)
    mask = np.zeros((len(rows), t), np.float32)
    for i, r in enumerate(rows):
        x[i, :len(r)], mask[i, :len(r)] = r, 1
    return x, mask


# --- training pages -------------------------------------------------------

#: Layout names (fixed values): class words of containers of main text and of the rest.
MAIN_NAMES = "content main article post entry story body text page-content post-body entry-content article-body".split()
REST_NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs links sitemap pagination pager toc".split(),
    "header": "header masthead banner logo site-header topbar brand search".split(),
    "footer": "footer site-footer copyright legal bottom credits colophon".split(),
    "side": "sidebar aside related widget rail recommended popular trending more-stories archive tags".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner-ad adsense outbrain".split(),
    "notice": "cookie consent notice alert popup modal newsletter subscribe gdpr paywall message".split(),
    "comments": "comments comment responses discussion replies reply disqus thread user-comment".split(),
    "form": "form login signup search-form contact-form register subscribe-form".split(),
    "share": "share social sharing follow byline-share toolbar buttons".split(),
}
REST_TAGS = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"),
             "side": ("aside", "div", "section"), "advert": ("div", "aside", "section", "ins"),
             "notice": ("div", "section", "aside"), "comments": ("section", "div", "ol"), "form": ("form", "div"),
             "share": ("div", "ul")}
MAIN_MARK, REST_MARK = "\ue000", "\ue001"  # private-use characters


class Composer:
    """Composes labelled pages by rule. Every text starts with a private mark
    that says whether the rule placed it in the main text."""

    def __init__(self, words: list[str], seed: int):
        self.rng, self.words = random.Random(seed), words or ["word"]

    def some(self, low: int, high: int) -> str:
        out = self.rng.choices(self.words, k=self.rng.randint(low, high))
        return html_chars.escape(" ".join(out))

    def attributes(self, kind: str) -> str:
        r = self.rng.random()
        if r < 0.15:
            return ""
        name = self.rng.choice(REST_NAMES.get(kind) or MAIN_NAMES)
        return f' id="{name}"' if r < 0.35 else f' class="{name}"'

    def leaf(self, mark: str, tag: str, low: int, high: int) -> str:
        bare = self.rng.random() < 0.1
        link = self.rng.random() < 0.1
        body = self.some(low, high)
        if link:
            body += f' <a href="/x">{self.some(1, 4)}</a>'
        if self.rng.random() < 0.1:
            body = f"<b>{body}<br>" if self.rng.random() < 0.6 else f"<em>{body}</em>"
        return f"<{tag}>{mark}{body}" + ("" if bare and tag in ("p", "li") else f"</{tag}>")

    def rest(self, kind: str) -> str:
        tag = self.rng.choice(REST_TAGS[kind])
        inner = ""
        n = self.rng.randint(1, 7)
        if kind in ("menu", "share") or kind in ("side", "footer", "header") and self.rng.random() < 0.5:
            items = "".join(f'<li><a href="/{i}">{REST_MARK}{self.some(1, 4)}</a></li>' for i in range(n))
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind in ("comments", "side", "form"):
            inner = "".join(self.leaf(REST_MARK, self.rng.choice(("p", "div", "h3", "label" if kind == "form" else "p")),
                                      2, 40 if kind == "comments" else 20) for _ in range(n))
        else:
            low, high = 2, 30
            inner = (REST_MARK + self.some(low, high)) if self.rng.random() < 0.6 else \
                "".join(self.leaf(REST_MARK, "p", low, high) for _ in range(self.rng.randint(1, 3)))
        plain = tag in ("nav", "header", "footer", "aside", "form") and self.rng.random() < 0.6
        return f"<{tag}{'' if plain else self.sure(kind)}>{inner}</{tag}>"

    def sure(self, kind: str) -> str:
        a = self.attributes(kind)
        return a or f' class="{self.rng.choice(REST_NAMES[kind])}"'

    def page(self) -> str:
        rng = self.rng
        n = rng.choice((1, 1, 2, 3, 5, 8, 12, 20))
        main = [self.leaf(MAIN_MARK, "h1", 2, 12)] if rng.random() < 0.85 else []
        for _ in range(n):
            tag = rng.choices(("p", "h2", "li", "blockquote", "td"), (20, 2, 2, 1, 1))[0]
            low, high = rng.choice(((1, 3), (3, 20), (20, 120), (20, 120), (100, 500)))
            leaf = self.leaf(MAIN_MARK, tag, low, high)
            main.append({"li": f"<ul>{leaf}</ul>", "td": f"<table><tr>{leaf}</tr></table>"}.get(tag, leaf))
            if rng.random() < 0.04:
                main.append(self.rest(rng.choice(("advert", "share", "side", "notice", "form"))))
        body = "".join(main)
        wrap = rng.random()
        if wrap < 0.6:
            tag = rng.choice(("article", "main", "article"))
            body = f"<{tag}{self.attributes('') if rng.random() < 0.4 else ''}>{body}</{tag}>"
        else:
            body = f'<div class="{rng.choice(MAIN_NAMES)}">{body}</div>'
        if rng.random() < 0.2:
            body = f'<div id="{rng.choice(("wrapper", "container", "main", "page"))}">{body}</div>'
        before = [self.rest(k) for k in rng.sample(("menu", "header", "advert", "notice", "form", "share", "side"),
                                                   rng.randint(0, 4))]
        after = [self.rest(k) for k in rng.sample(("comments", "side", "share", "advert", "menu"), rng.randint(0, 3))]
        if rng.random() < 0.75:
            after.append(self.rest("footer"))
        if rng.random() < 0.1:  # nothing but main text, or next to nothing
            before, after = [], after[:rng.randint(0, 1)]
            if rng.random() < 0.4:
                body = re.sub(r"<h1.*?</h1>", "", body, count=1)
        return "<html><body>" + "".join(before) + body + "".join(after) + "</body></html>"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a composed page without their marks, and 1 for main text."""
    blocks = blocks_of(page)
    y = np.array([MAIN_MARK in b.text for b in blocks], np.float32)
    for b in blocks:
        b.text = b.text.replace(MAIN_MARK, "").replace(REST_MARK, "").strip() or "."
    return blocks, y


def train(pages: DataFrame, sample: int = 200, composed: int = 1000, epochs: int = 12) -> Lstm:
    """A labeller from ``composed`` pages; their words come from the blocks of
    at most ``sample`` given pages, the ones whose page_id hashes lowest."""
    ids = [r["id"] for r in pages.select(F.col("page_id").cast("long").alias("id")).filter("id is not null")
           .distinct().orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    rows = (pages.filter(F.col("page_id").cast("long").isin(ids)).filter("html is not null")
            .select(F.substring("html", 1, 20_000).alias("html"))
            .orderBy(F.xxhash64("html"), "html").limit(sample).collect())  # at most sample * 20,000 characters
    words = sorted({w for r in rows for b in blocks_of(r["html"]) for w in b.text.split()[:60]})
    composer, names, data = Composer(words, 3), {}, []
    for _ in range(composed):
        blocks, y = labelled(composer.page())
        if blocks:
            data.append((vectors(blocks, names), y))
    return Lstm().fit(data, epochs)


def label_pages(model: Lstm, pages: list[list[Block]], names: dict[str, int], cells: int = 8192) -> list[np.ndarray]:
    """For each page its blocks' probabilities of being main text. Pages of
    like length go through the network together, ``cells`` blocks at a time."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= cells:
            end += 1
        some = order[at:end]
        x, mask = padded([vectors(pages[i], names) for i in some])
        y = model.forward(x, mask)
        for i, row in zip(some, y, strict=True):
            out[i] = row[:len(pages[i])]
        at = end
    return out


def extract(pages: DataFrame, model: Lstm | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per page: (page_id, url, text, n_chars, n_blocks, n_main): the
    blocks labelled as main text, joined by one line feed.

    Defined cases: null or empty html, and pages without main blocks, give an
    empty text; null page_id and url stay null; repeated rows come back as
    often as they occur; an empty table gives an empty result (the labeller is
    then trained without sample words); other columns are not read.
    """
    model = model or train(pages)
    pick = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").alias("html"))

    def run(batch):
        names: dict[str, int] = {}
        # Few pages at a time: their vectors are what needs memory.
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            blocks = [blocks_of(h or "") for h in part.column("html").to_pylist()]
            main = [[b.text for b, p in zip(bs, ps.tolist(), strict=True) if p >= threshold]
                    for bs, ps in zip(blocks, label_pages(model, blocks, names), strict=True)]
            text = ["\n".join(m) for m in main]
            yield {"page_id": part.column("page_id"), "url": part.column("url"), "text": text,
                   "n_chars": list(map(len, text)), "n_blocks": list(map(len, blocks)), "n_main": list(map(len, main))}

    return map_batches(pick, run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
