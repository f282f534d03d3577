"""Train the block labeller of html_extract on generated pages: ``python -m granary.llm.html_train``.

The generator lays out pages of many kinds (menus, headers, sidebars, notices,
adverts, forms, reader comments, related links and footers around and within an
article, in semantic elements or in plain ones with telling or with no names) in
words that mean nothing, and knows which blocks it wrote as main text.
"""

from __future__ import annotations

import os
import random
import sys

import numpy as np

from .html_extract import HIDDEN, INPUTS, blocks, read_one_way, scores, vectors

SYLLABLES = ["th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve", "sch ung ein ich der und auf zu ber ge ver lich keit heit st pf tz ä ö ü", "le la de eau ment tion que oi ou é è ê vi re pa aux", "ción que os as ar ado mente ll rr ñ es ez í ó"]
#: Words that texts and their surroundings share, so that no word by itself gives a block away.
COMMON = "the of and to in is that for with on as are this be by at from or an not we you it was which have new now more here home page about first second one two all read news der die das und ist nicht le la les et est une el los que es una".split()
NAMES = {
    "content": "content main-content post post-body entry entry-content article article-body story story-text text body-copy page-content prose markdown-body",
    "nav": "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs pagination tabs links toc",
    "header": "header site-header masthead top-bar branding logo banner-top hero",
    "footer": "footer site-footer page-footer colophon bottom copyright legal",
    "side": "sidebar side aside widget widgets related recommended most-read popular trending tags archive",
    "ad": "ad ads advert advertisement adbox sponsored promo promoted banner sponsor",
    "notice": "cookie cookie-banner notice consent gdpr alert popup modal overlay paywall message",
    "form": "search search-form newsletter subscribe signup login contact-form comment-form",
    "comments": "comments comment comment-list discussion replies responses reader-comments disqus",
    "share": "share social share-buttons byline-tools follow",
    "plain": "wrap wrapper container row col grid box inner outer section block page layout x1 css-1a2b",
}
LABELS = {"nav": "Home About News Contact Products Next Previous Archive Login", "footer": "All rights reserved Privacy Terms Imprint Contact © 2024", "notice": "We use cookies Accept Close Your browser is not supported", "form": "Search Email Name Subscribe Submit Password", "comments": "Reply says wrote ago Report Like 3 replies", "share": "Share Tweet Facebook Print Email", "ad": "Advertisement Sponsored Buy now Learn more", "side": "Related Popular Read more Tags Latest", "header": "Welcome to the home of"}


ALL_LABELS = " ".join(LABELS.values()).split()


class Generator:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        k = self.r.random()
        if k < self.common:
            return self.r.choice(COMMON if k < 0.9 * self.common else ALL_LABELS)
        return "".join(self.r.choices(self.sounds, k=self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        out = [self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(w + self.r.choice([",", "", "", "", ""]) for w in out)

    def prose(self, low: int = 1, high: int = 8) -> str:
        s = " ".join(self.words(2, 18).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.08:  # the text itself may be junk: that isn't the labeller's business
            w = s.split()
            s = self.r.choice([s.upper(), " | ".join(w), "### ".join(w), " ".join(x for x in w[:9] for _ in range(self.r.randint(2, 60)))])
        return s if self.r.random() < 0.7 else s.replace(" ", self.r.choice([" <b>", " <em>", ' <a href="/x">']), 1) + self.r.choice(["</b>", "</em>", "</a>", "", "<br>"])

    def named(self, kind: str, tag: str = "div") -> str:
        r = self.r.random()
        name = self.r.choice(NAMES[kind].split())
        if r < 0.15:
            name = name + " " + self.r.choice(NAMES["plain"].split())
        bare = 0.96 if kind in ("nav", "share", "side", "form") else 0.6 if kind == "plain" else 2  # without a name, prose can't be told from the text
        return f"<{tag}>" if r > bare else f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}">'

    def out(self, html: str, main: bool = False) -> str:
        """Text with a mark by which its block's label is known."""
        return f"\x01{html}" if main else html

    def menu(self, kind: str, tags: tuple[str, ...]) -> str:
        tag = self.r.choice(tags)
        items = [self.r.choice(LABELS.get(kind, LABELS["nav"]).split()) if self.r.random() < 0.3 else self.words(1, 3) for _ in range(self.r.randint(2, 9))]
        if self.r.random() < 0.75:
            body = "<ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(items)) + "</ul>"
        else:
            body = " ".join(f'<a href="/{i}">{x}</a>' for i, x in enumerate(items))
        return (f"<{tag}>" if tag in ("nav", "aside") and self.r.random() < 0.7 else self.named(kind, tag)) + body + f"</{tag}>"

    def junk(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.menu("nav", ("nav", "nav", "div"))
        if kind == "side":
            return self.menu("side", ("aside", "aside", "div", "section"))
        if kind == "share":
            return self.menu("share", ("div", "ul", "div"))
        label = LABELS.get(kind, "")
        if kind in ("header", "footer"):
            body = f"{self.words(1, 5)}" if r.random() < 0.4 else f"<p>{self.prose(1, 2)}</p>"
            body = r.choice([f"&copy; {self.word()} &middot; {self.prose(1, 2)}", f"{label} {body}", body, f"<h1>{self.words(1, 3)}</h1>" if kind == "header" else body, f"<a href='/'>{self.words(1, 2)}</a>" + body])
            return (f"<{kind}>{body}</{kind}>") if r.random() < 0.65 else self.named(kind) + body + "</div>"
        if kind in ("ad", "notice"):
            body = r.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f"{label} {self.words(1, 6)}", f"<a href='/b'>{self.words(2, 8)}</a>", f"<p>{self.prose(1, 2)}</p><button>{self.words(1, 2)}</button>"])
            tag = r.choice(["div", "div", "aside", "section", *["p"] * ("<p>" not in body)])
            return self.named(kind, tag).replace(">", f' role="{r.choice(["alert", "dialog", "banner"])}">' if kind == "notice" and r.random() < 0.2 else ">", 1) + body + f"</{tag}>"
        if kind == "form":
            parts = [f"<label>{self.words(1, 3)}</label>" * (r.random() < 0.5), "<input name=q>", f"<textarea>{self.words(1, 3)}</textarea>" * (r.random() < 0.2)]
            parts += [f"<p>{self.prose(1, 2)}</p>" * (r.random() < 0.3), "<select><option>A one<option>B two</select>" * (r.random() < 0.2)]
            r.shuffle(parts)
            body = "".join(parts) + f"<button>{self.words(1, 2)}</button>" * (r.random() < 0.8) + f"<p>{self.prose(1, 2)}</p>" * (r.random() < 0.2)
            return ("<form>" if r.random() < 0.5 else self.named("form", "form")) + body + "</form>"
        if kind == "comments":
            one = lambda: self.named("comments") + r.choice([f"<p>{self.prose(1, 4)}</p>", f"<b>{self.word()}</b> {label.split()[1]} <p>{self.prose(1, 3)}</p>", self.prose(1, 3), f"<h4>{self.word()}</h4><p>{self.prose(1, 5)}</p><a href='#r'>Reply</a>"]) + "</div>"
            tag = r.choice(["div", "section", "ol"])
            return self.named("comments", tag).replace(f"<{tag}>", f'<{tag} class="comments">') + (f"<h3>{self.words(1, 2)}</h3>" if r.random() < 0.5 else "") + "".join(one() for _ in range(r.randint(1, 6))) + f"</{tag}>"
        return f"<{r.choice(['script', 'style'])}>var a='<p>x</p>';</script></style>"

    def article(self) -> str:
        r, parts = self.r, []
        main = lambda tag, text: f"<{tag}>{self.out(text, True)}" + ("" if tag == "p" and r.random() < 0.15 else f"</{tag}>")
        if r.random() < 0.85:
            parts.append(main("h1", self.words(2, 9)))
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            k = r.random()
            if k < 0.62:
                parts.append(main("p", self.prose()))
            elif k < 0.7:
                parts.append(main(r.choice(["h2", "h3"]), self.words(1, 7)))
            elif k < 0.76:
                parts.append("<ul>" + "".join(main("li", self.words(1, 12)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.8:
                parts.append(main("blockquote", self.prose(1, 3)) if r.random() < 0.5 else "<blockquote>" + main("p", self.prose(1, 3)) + "</blockquote>")
            elif k < 0.82:
                parts.append("<table><tr>" + main("td", self.words(1, 3)) + main("td", self.words(1, 3)) + "</tr></table>")
            elif k < 0.84:
                parts.append(main("pre", self.words(3, 15)))
            else:
                parts.append(self.junk(r.choice(["ad", "share", "form", "form", "side", "notice", "script"])))
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        self.sounds = r.choice(SYLLABLES).split()
        self.common = r.choice((0, 0.2, 0.5, 0.8))
        before = [self.junk(k) for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < 0.45]
        after = [self.junk(k) for k in ("share", "side", "ad", "comments", "form", "nav", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        if r.random() < 0.3:
            r.shuffle(after)
        if r.random() < 0.04:  # bare text, with or without a body around it
            text = self.out(self.prose(1, 12).translate({60: None, 62: None, 47: None}), True)
            return r.choice([text, text, f"<html><body>{text}</body></html>", f"<body>{text}", f"<pre>{text}</pre>", f"<p>{text}", f"<div>{text}</div>"])
        k, body = r.random(), self.article()
        if k < 0.55:
            body = "<article>" + body + (self.junk("comments") if r.random() < 0.1 else "") + "</article>"
        elif k < 0.7:
            body = "<main>" + (body if r.random() < 0.5 else self.named("content") + body + "</div>") + "</main>"
        elif k < 0.95:
            body = self.named("content") + body + "</div>"
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            body = self.named("plain") + body + "</div>"
        page = "".join(before) + body + "".join(after)
        if r.random() < 0.3:
            page = self.named("plain") + page + "</div>"
        if r.random() < 0.02:
            page = "".join(before + after)  # a page without an article
        end = "" if r.random() < 0.1 else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{page}{end}"


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(page)
    y = np.array(["\x01" in "".join(b.parts) for b in found], np.float32)
    for b in found:
        b.parts = [p.replace("\x01", "") for p in b.parts]
    y, found = y[[bool(b.text()) for b in found]], [b for b in found if b.text()]
    return vectors(found), y


def gradients(x: np.ndarray, mask: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
    """Of the mean log loss over the blocks of a batch."""
    kept: tuple[list, list] = ([], [])
    hf = read_one_way(x @ w["xf"] + w["bf"], mask, w["hf"], kept[0])
    hb = read_one_way((x @ w["xb"] + w["bb"])[::-1], mask[::-1], w["hb"], kept[1])[::-1]
    z = hf @ w["of"] + hb @ w["ob"] + w["b"]
    p = 1 / (1 + np.exp(-z))
    n = mask.sum()
    loss = float((mask * (np.logaddexp(0, z) - y * z)).sum() / n)
    dz = mask * (p - y) / n
    g = {"of": np.einsum("tn,tnh->h", dz, hf), "ob": np.einsum("tn,tnh->h", dz, hb), "b": dz.sum()}
    for side, keep, dh_out, x_side in (("f", kept[0], dz[..., None] * w["of"], x), ("b", kept[1], (dz[..., None] * w["ob"])[::-1], x[::-1])):
        u = w["h" + side]
        gates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        du, dh, dc = np.zeros_like(u), np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(keep) - 1, -1, -1):
            h0, c0, i, f, o, gg, th, m = keep[t]
            dh = dh + dh_out[t]
            live = dh * m
            dnew = dc * m + live * o * (1 - th * th)
            dzt = np.concatenate([dnew * gg * i * (1 - i), dnew * c0 * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - gg * gg)], 1)
            gates[t] = dzt
            du += h0.T @ dzt
            dh = dzt @ u.T + dh * (1 - m)
            dc = dnew * f + dc * (1 - m)
        g["h" + side], g["x" + side], g["b" + side] = du, np.einsum("tnx,tng->xg", x_side, gates, optimize=True), gates.sum((0, 1))
    return g, loss


def train(pages: int = 8000, epochs: int = 14, seed: int = 5, say=print) -> dict[str, np.ndarray]:  # noqa: ANN001
    rng, make = np.random.default_rng(seed), Generator(seed)
    data = [d for d in (labelled(make.page()) for _ in range(pages)) if len(d[1])]
    w = {f"x{s}": rng.standard_normal((INPUTS, 4 * HIDDEN)).astype(np.float32) * 0.08 for s in "fb"} | {f"h{s}": rng.standard_normal((HIDDEN, 4 * HIDDEN)).astype(np.float32) * 0.2 for s in "fb"}
    w |= {f"b{s}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32) for s in "fb"} | {f"o{s}": rng.standard_normal(HIDDEN).astype(np.float32) * 0.2 for s in "fb"} | {"b": np.float32(0)}
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(epochs):
        order = np.array(sorted(range(len(data)), key=lambda k: len(data[k][1]) + rng.random()))
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        rng.shuffle(batches)
        total = 0.0
        for b in batches:
            steps = max(len(data[k][1]) for k in b)
            x, mask, y = np.zeros((steps, len(b), INPUTS), np.float32), np.zeros((steps, len(b)), np.float32), np.zeros((steps, len(b)), np.float32)
            for j, k in enumerate(b):
                x[: len(data[k][1]), j], mask[: len(data[k][1]), j], y[: len(data[k][1]), j] = data[k][0], 1, data[k][1]
            x[..., : INPUTS - 12] *= rng.random(x[..., : INPUTS - 12].shape, np.float32) > 0.1  # names may be unknown
            g, loss = gradients(x, mask, y, w)
            total += loss
            step += 1
            rate = 0.006 * (1 - epoch / epochs) + 0.0003
            size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k in w:
                d = g[k] * min(1, 2 / (size + 1e-9)) + 1e-5 * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        say(f"epoch {epoch}: loss {total / len(batches):.4f}")
    return w


def accuracy(w: dict[str, np.ndarray], pages: int = 500, seed: int = 99) -> tuple[float, float]:
    """Of blocks, and of whole pages, on pages that weren't trained on."""
    make = Generator(seed)
    data = [d for d in (labelled(make.page()) for _ in range(pages)) if len(d[1])]
    right = [(z > 0) == (y > 0) for z, (_, y) in zip(scores([x for x, _ in data], w), data, strict=True)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    made = train()
    print("accuracy of blocks and pages:", accuracy(made))
    np.savez_compressed(sys.argv[1] if len(sys.argv) > 1 else os.path.join(os.path.dirname(__file__), "html_labeller.npz"), **made)
