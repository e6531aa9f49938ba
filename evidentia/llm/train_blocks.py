"""Trains the block labeller on generated pages: ``python -m evidentia.llm.train_blocks``.

Pages are laid out at random: article containers of several kinds, with and without telling
names, and menus, headers, sidebars, notices, adverts, forms, related links, comments and
footers before, after and inside them.  Words are made of random syllables, so the model
learns from paths, shapes and order, and from the words that such blocks are known by.
"""

from __future__ import annotations

import os
import random
import re

import numpy as np

from . import blocks as B

SYLLABLES = "an the er on in re ou ti es ha ing ed or st en nd ch le de la qu ie sch ung ción es ar do mi ñ é ai ou".split()
COMMON = "the of and to in a is that for it with as was on be at by le la de et les des die der und das el los en que".split()
BOILER = {
    "menu": "home about contact news products services login search blog help shop archive".split(),
    "footer": "© copyright 2023 2024 all rights reserved privacy policy terms imprint contact sitemap".split(),
    "notice": "we use cookies accept this site cookie consent settings agree privacy notice".split(),
    "ad": "advertisement sponsored buy now offer sale click here deal ad".split(),
    "form": "email name subscribe newsletter submit sign up your message send search password".split(),
    "comment": "reply posted says comment comments ago like report user thanks great".split(),
    "side": "related posts popular tags categories recent latest share follow read more archives".split(),
}
NAMES = {
    "menu": ["nav", "menu", "navbar", "main-nav", "top-menu", "breadcrumbs", "site-nav", "navigation"],
    "header": ["header", "site-header", "masthead", "banner", "top", "page-header", "branding"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "page-footer", "credits"],
    "side": ["sidebar", "aside", "related", "widget", "tags", "share", "social", "more-stories", "recommended"],
    "notice": ["cookie", "cookie-notice", "notice", "consent", "alert", "gdpr-banner", "popup", "modal", "disclaimer"],
    "ad": ["ad", "ads", "advert", "sponsor", "promo", "advertisement", "ad-slot", "banner-ad"],
    "form": ["newsletter", "subscribe", "search-form", "login", "signup", "contact-form"],
    "comment": ["comments", "comment-list", "respond", "discussion", "comment", "replies", "disqus"],
    "main": ["content", "article", "post", "entry-content", "article-body", "story", "main", "post-content", "text", "body-copy"],
}
KEPT, DROPPED = "\x02", "\x03"


class Pages:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.piped = self.stray = 0.0

    def word(self) -> str:
        return self.r.choice(COMMON) if self.r.random() < 0.4 else "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, a: int, b: int, kind: str | None = None) -> str:
        n = self.r.randint(a, b)
        out = [self.r.choice(BOILER[kind]) if kind in BOILER and self.r.random() < 0.35 else self.word() for _ in range(n)]
        if self.r.random() < 0.25:
            out = [w + self.r.choice(["%%%", "&amp;&amp;&amp;", "###", "$$$", "***", "!!"]) for w in out]
        for i in range(self.r.randint(3, 12), len(out), self.r.randint(4, 14)):
            out[i] += self.r.choice([",", ".", ".", ";"])
        text = " ".join(out)
        return text[:1].upper() + text[1:] + (self.r.choice([".", ".", ""]) if kind is None else self.r.choice(["", "", "."]))

    def mark(self, keep: bool, text: str) -> str:
        """Text with a mark that tells its label; the parser takes it for a character."""
        return (KEPT if keep else DROPPED) + text

    def named(self, kind: str) -> str:
        x = self.r.random()
        name = self.r.choice(NAMES[kind])
        if x < 0.55:
            return f' class="{name}"'
        if x < 0.7:
            return f' id="{name}"'
        if x < 0.8:
            return f' class="{self.word()} {name} {self.word()}"'
        return ""

    def box(self, kind: str, tags: list[str], inner: str, bare: bool = False) -> str:
        tag = self.r.choice(tags)
        name = self.named(kind)
        if not name and tag == "div" and not bare:
            name = f' class="{self.r.choice(NAMES[kind])}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def links(self, kind: str, a: int = 3, b: int = 9) -> str:
        n = self.r.randint(a, b)
        items = [f'<a href="/{self.word()}">{self.mark(False, self.words(1, 3, kind))}</a>' for _ in range(n)]
        style = self.r.random()
        if style < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if style < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def short(self, kind: str, a: int = 2, b: int = 18) -> str:
        tag = self.r.choice(["p", "div", "span", "h3", ""])
        text = self.mark(False, self.words(a, b, kind))
        return f"<{tag}>{text}</{tag}>" if tag else text

    def menu(self) -> str:
        return self.box("menu", ["nav", "nav", "div", "ul"], self.links("menu"))

    def header(self) -> str:
        inner = f"<h1>{self.mark(False, self.words(1, 5))}</h1>" if self.r.random() < 0.5 else self.short("menu", 1, 8)
        return self.box("header", ["header", "header", "div"], inner + (self.menu() if self.r.random() < 0.5 else ""))

    def footer(self) -> str:
        inner = "".join(self.r.choice([lambda: self.mark(False, f"&copy; {self.word()}.example.com &middot; {self.words(2, 12)}"), lambda: self.short("footer"), lambda: self.links("footer")])() for _ in range(self.r.randint(1, 3)))
        return self.box("footer", ["footer", "footer", "div"], inner)

    def ad(self) -> str:
        return self.box("ad", ["div", "div", "aside", "section"], self.short(self.r.choice(["ad", "plain"]), 3, 25) if self.r.random() < 0.5 else self.mark(False, self.words(3, 25, self.r.choice(["ad", "plain"]))))

    def notice(self) -> str:
        return self.box("notice", ["div", "div", "section", "aside"], self.short(self.r.choice(["notice", "plain"]), 4, 30) + ("<button>" + self.mark(False, self.words(1, 2, "notice")) + "</button>" if self.r.random() < 0.5 else ""))

    def side(self) -> str:
        inner = (f"<h3>{self.mark(False, self.words(1, 3, 'side'))}</h3>" if self.r.random() < 0.6 else "") + (self.links("side") if self.r.random() < 0.6 else self.short(self.r.choice(["side", "plain"]), 4, 40))
        return self.box("side", ["aside", "aside", "div", "section"], inner)

    def form(self) -> str:
        inner = "".join(f"<label>{self.mark(False, self.words(1, 4, 'form'))}</label><input name=x>" for _ in range(self.r.randint(1, 3))) + f"<button>{self.mark(False, self.words(1, 2, 'form'))}</button>"
        if self.r.random() < 0.5:
            inner = f"<p>{self.mark(False, self.words(3, 20, 'form'))}</p>" + inner
        return self.box("form", ["form"], inner) if self.r.random() < 0.8 else self.box("form", ["div"], f"<form>{inner}</form>")

    def comments(self) -> str:
        one = lambda: self.box("comment", ["div", "li", "article", "p"], (f"<b>{self.mark(False, self.words(1, 2))}</b> " if self.r.random() < 0.4 else "") + self.r.choice(["", "<p>"]) + self.mark(False, self.words(3, 60, self.r.choice(["comment", "plain"]))))
        return self.box("comment", ["section", "div", "div"], (f"<h3>{self.mark(False, self.words(1, 3, 'comment'))}</h3>" if self.r.random() < 0.6 else "") + "".join(one() for _ in range(self.r.randint(1, 6))))

    def paragraph(self) -> str:
        x = self.r.random()
        kind = self.r.choice(list(BOILER)) if self.r.random() < self.stray else None
        text = self.words(*((1, 6) if x < 0.15 else (5, 90) if x < 0.9 else (100, 400)), kind)
        if self.r.random() < self.piped:
            text = " | ".join(text.split())
        if self.r.random() < 0.05:
            text = text.upper()
        if self.r.random() < 0.1:
            text += self.r.choice([" 53.219.45.38", " x.y@mail6.example.com", " +49 30 1234567", " All rights reserved.", " Released under the MIT License.", f" &copy; {self.word()}"])
        if self.r.random() < 0.15:
            text += f' <a href="/x">{self.words(1, 4)}</a> ' + self.words(1, 10)
        text = self.mark(True, text)
        y = self.r.random()
        if y < 0.62:
            return f"<p>{text}</p>"
        if y < 0.72:
            return f"<p><b>{text}<br>"
        if y < 0.77:
            return f"<p>{text}<br>{self.words(3, 30)}</p>"
        if y < 0.83:
            return f"<h2>{self.mark(True, self.words(1, 8))}</h2>"
        if y < 0.88:
            return "<ul>" + "".join(f"<li>{self.mark(True, self.words(1, 15))}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if y < 0.92:
            return f"<blockquote>{text}</blockquote>"
        if y < 0.95:
            return "<table>" + "".join(f"<tr><td>{self.mark(True, self.words(1, 4))}</td><td>{self.mark(True, self.words(1, 4))}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{text}</div>" if y < 0.98 else f"<pre>{text}</pre>"

    def article(self) -> str:
        n = self.r.choice([1, 1, 2, 3, 5, 8, 12, 20, 40])
        self.piped = self.r.choice([0, 0, 0, 0, 0.05, 0.5, 1])
        self.stray = self.r.choice([0, 0.05, 0.2])
        body = [self.paragraph() for _ in range(n)]
        if self.r.random() < 0.75:
            title = f"<h1>{self.mark(True, self.words(1, 10))}</h1>"
            body.insert(0, f"<header>{title}</header>" if self.r.random() < 0.12 else title)
        for part in (self.ad, self.side, self.notice, self.form, self.side):
            if self.r.random() < 0.22:
                body.insert(self.r.randint(1, len(body)), part())
        inner = "".join(body)
        x = self.r.random()
        if x < 0.5:
            return f"<article>{inner}</article>"
        if x < 0.6:
            return f"<main{self.named('main')}><article{self.named('main')}>{inner}</article></main>"
        if x < 0.72:
            return self.box("main", ["main", "section"], inner)
        return self.box("main", ["div"], inner)

    def page(self) -> str:
        head = "".join(x() for x in self.some([self.menu, self.header, self.notice, self.ad, self.side, self.form], [0.75, 0.4, 0.25, 0.45, 0.2, 0.12]))
        tail = "".join(x() for x in self.some([self.side, self.comments, self.ad, self.form, self.notice, self.footer], [0.3, 0.35, 0.3, 0.2, 0.2, 0.8]))
        body = f"{head}{self.article()}{tail}"
        if self.r.random() < 0.3:
            body = f'<div id="{self.r.choice(["page", "wrapper", "container", "root"])}">{body}</div>'
        return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'

    def some(self, parts: list, chances: list[float]) -> list:
        return [p for p, c in zip(parts, chances, strict=True) if self.r.random() < c]


def labelled(page: str) -> tuple[list, list[int]]:
    """Blocks without marks, and 1 for each that is article text."""
    read, labels = [], []
    for text, path, linked in B.leaf_blocks(page):
        labels.append(int(KEPT in text))
        clean = " ".join(re.sub(f"[{KEPT}{DROPPED}]", "", text).split())
        read.append((clean or "-", path, min(linked, len(clean))))
    return read, labels


def start(rng: np.random.Generator) -> dict:
    d = B.PATH + B.WORD + B.FIGURES
    m = {"path": rng.normal(0, 0.3, (B.BUCKETS, B.PATH)), "word": rng.normal(0, 0.1, (B.BUCKETS, B.WORD)), "skip": rng.normal(0, 0.1, d), "bias": np.zeros(())}
    for k in "fb":
        m |= {"W" + k: rng.normal(0, 0.25, (d, 4 * B.HIDDEN)), "U" + k: rng.normal(0, 0.2, (B.HIDDEN, 4 * B.HIDDEN)), "b" + k: np.concatenate([np.zeros(B.HIDDEN), np.ones(B.HIDDEN), np.zeros(2 * B.HIDDEN)]), "v" + k: rng.normal(0, 0.2, B.HIDDEN)}
    return {k: np.asarray(v, np.float32) for k, v in m.items()}


def gradients(f: dict, y: np.ndarray, m: dict) -> tuple[float, dict]:
    x, ps, ws = B.vectors(f, m)
    out = x @ m["skip"] + m["bias"]
    kept = {}
    for k, place in zip("fb", B.layout(f["sizes"]), strict=True):
        inside = place >= 0
        xs = x[np.where(inside, place, 0)] * inside[:, :, None]
        hs, saved = B.lstm(xs, m["W" + k], m["U" + k], m["b" + k], keep=True)
        kept[k] = (place, inside, xs, hs, saved)
        out[place[inside]] += hs[inside] @ m["v" + k]
    p = B.sigmoid(out)
    loss = float(-np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-7)))
    d = ((p - y) / len(y)).astype(np.float32)
    g = {"skip": x.T @ d, "bias": d.sum()}
    dx = np.outer(d, m["skip"])
    H = B.HIDDEN
    for k, (place, inside, xs, hs, saved) in kept.items():
        dout = np.where(inside, d[np.where(inside, place, 0)], 0)
        g["v" + k] = np.einsum("tn,tnh->h", dout, hs)
        dz_all = np.zeros((*place.shape, 4 * H), np.float32)
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
        gU = np.zeros_like(m["U" + k])
        for t in range(len(place) - 1, -1, -1):
            i, f_, o, gg, tc, h0, c0 = saved[t]
            dh = dh + dout[t][:, None] * m["v" + k]
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f_ * (1 - f_), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
            dz_all[t] = dz
            gU += h0.T @ dz
            dh, dc = dz @ m["U" + k].T, dc * f_
        g["W" + k] = np.einsum("tnd,tnz->dz", xs, dz_all)
        g["U" + k], g["b" + k] = gU, dz_all.sum((0, 1))
        np.add.at(dx, place[inside], (dz_all @ m["W" + k].T)[inside])
    for name, index, at, share, part in (("path", f["path"], f["path_at"], ps, dx[:, : B.PATH]), ("word", f["word"], f["word_at"], ws, dx[:, B.PATH : B.PATH + B.WORD])):
        g[name] = np.zeros_like(m[name])
        np.add.at(g[name], index, part[np.repeat(np.arange(len(at) - 1), np.diff(at))] * share[:, None])
    return loss, g


def train(pages: int = 7000, epochs: int = 16, batch: int = 24, seed: int = 5, rate: float = 0.01) -> tuple[dict, float]:
    """The weights, and the share of blocks labelled right on 300 pages held out."""
    rng = np.random.default_rng(seed)
    made = Pages(seed)
    data = [labelled(made.page()) for _ in range(pages)]
    data = [x for x in data if x[0]]
    m = start(rng)
    first, second, step = {k: 0 * v for k, v in m.items()}, {k: 0 * v for k, v in m.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), batch):
            some = [data[i] for i in order[a : a + batch]]
            _, g = gradients(B.features([x[0] for x in some]), np.concatenate([x[1] for x in some]), m)
            step += 1
            speed = rate * (1 - epoch / epochs) + 0.0005
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1, 1 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v**2
                m[k] = (m[k] - speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m, accuracy(m, seed + 1)


def accuracy(m: dict, seed: int, pages: int = 300) -> float:
    made = Pages(seed)
    data = [labelled(made.page()) for _ in range(pages)]
    got = B.scores(B.features([x[0] for x in data]), m) > 0
    return float(np.mean(got == (np.concatenate([x[1] for x in data]) > 0)))


if __name__ == "__main__":
    weights, right = train()
    np.savez_compressed(os.path.join(os.path.dirname(__file__), "blocks.npz"), **weights)
    print(f"held-out accuracy {right:.4f}")
