"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each block is main text or not. The field scores a block by its ancestors' tags and names and by its text, and
neighbouring blocks by their pair of labels; it is trained by gradient ascent on the conditional likelihood of
labelled pages (forward-backward, all pages at once) and decoded by Viterbi. The labelled pages are written by
``training_pages``: a fixed number of pages of varied layouts whose main blocks are known. Pages are decoded
one by one in Arrow batches, without a shuffle.

Defined cases: NULL or empty html and pages without main blocks give an empty text; a text without tags is one
block; unclosed tags, comments and scripts end with the page; repeated pages are read one by one; an empty table
gives no rows; a very long page is one sequence in one task; of labellings with equal scores Viterbi takes the one that
leaves blocks out; the kept columns travel in the struct ``row``, where no name can clash.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quantframe.llm.common import field, map_texts
from quantframe.llm.html_blocks import LABEL, Block, parse, path_features, text_features

PATHS = 50_000
SYLLABLES = "an ber ch de el en er ge ha ie in ka la le lo mi na ne on ou pa que ra re sa se ta ti un ver".split()


@dataclass
class Field:
    """Weights of features for 'main', and of (label before, label) pairs."""

    weights: dict[str, float]
    pairs: np.ndarray


def _prose(rng: random.Random, words: int, stop: str = ".") -> str:
    made = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(max(words, 1))]
    for i in range(len(made)):
        if rng.random() < 0.1:
            made[i] += rng.choice([",", ".", " &amp;", ";"])
    style = rng.random()
    if style < 0.06:
        return " | ".join(made)
    if style < 0.12:
        return " ".join(m + rng.choice(["***", "%%%", "&amp;&amp;", "$$$", "###"]) for m in made)
    if style < 0.16:
        return " ".join(m.upper() + "!!" for m in made)
    if style < 0.2:
        return " ".join(rng.choices(made[:3], k=words))
    return " ".join(made).capitalize() + stop


#: Names that pages give to the parts around an article, and to the article itself.
MENU = "nav menu navbar navigation breadcrumb breadcrumbs topnav tabs pagination pager toc links".split()
HEAD = "header masthead topbar site-header page-header banner logo branding".split()
FOOT = "footer site-footer page-footer copyright colophon legal imprint bottom credits".split()
SIDE = "sidebar side aside widget related recommended more-stories popular trending tags rail recirc teaser".split()
NOTE = "notice cookie cookie-banner consent gdpr alert warning message popup modal overlay paywall toast info-bar".split()
ADS = "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsbox ad-slot outbrain".split()
FORM = "form search newsletter subscribe signup login contact search-form register".split()
TALK = "comments comment-list reader-comments discussion replies responses disqus comment reviews thread".split()
SHARE = "share social sharing buttons follow toolbar meta byline author-box".split()
MAIN = "content main article post entry story body text post-content entry-content article-body story-body".split()


def _part(rng: random.Random, names: list[str], tags: str, items: int, words: int, linked: bool = False) -> str:
    tag = rng.choice(tags.split())
    name = rng.choice(names)
    label = "" if tag not in ("div", "section", "ul", "p", "span") and rng.random() < 0.5 else \
        f' {rng.choice(["class", "class", "id"])}="{name}"'
    out = []
    for _ in range(items):
        text = _prose(rng, rng.randint(max(1, words // 3), words), rng.choice(["", ".", "."]))
        text = f'<a href="/x">{text}</a>' if linked else text
        out.append(rng.choice([f"<p>{text}</p>", f"<li>{text}</li>" if linked else f"<p>{text}</p>", f"<div>{text}</div>",
                               text if items == 1 else f"<p>{text}"]))
    body = "".join(out)
    body = f"<ul>{body}</ul>" if "<li>" in body and tag != "ul" else body
    return f"<{tag}{label}>{body}</{tag}>"


def _around(rng: random.Random, place: str) -> str:
    """Parts that stand before, beside or after the article."""
    choices = {
        "before": [lambda: _part(rng, MENU, "nav nav div ul", rng.randint(3, 8), 2, True),
                   lambda: _part(rng, HEAD, "header header div", rng.randint(1, 2), 6),
                   lambda: _part(rng, ADS, "div div aside section", 1, 25),
                   lambda: _part(rng, NOTE, "div div section", rng.randint(1, 2), 30),
                   lambda: _part(rng, FORM, "form form div", rng.randint(1, 3), 6)],
        "inside": [lambda: _part(rng, ADS, "div div aside", 1, 25), lambda: _part(rng, SHARE, "div ul", 2, 3, True),
                   lambda: _part(rng, SIDE, "aside aside div", rng.randint(1, 3), 20, rng.random() < 0.5),
                   lambda: _part(rng, FORM, "form form div", rng.randint(1, 2), 15),
                   lambda: _part(rng, NOTE, "div", 1, 25)],
        "after": [lambda: _part(rng, FOOT, "footer footer footer div", rng.randint(1, 3), 20),
                  lambda: f"<footer>&copy; {_prose(rng, 2)} &middot; {_prose(rng, 12)}</footer>",
                  lambda: _part(rng, TALK, "section section div", rng.randint(1, 6), 60),
                  lambda: _part(rng, SIDE, "aside aside div section", rng.randint(1, 5), 20, rng.random() < 0.5),
                  lambda: _part(rng, ADS, "div div aside", 1, 25), lambda: _part(rng, FORM, "form form div", 2, 12),
                  lambda: _part(rng, NOTE, "div div section", 1, 30)]}[place]
    return rng.choice(choices)()


def _article(rng: random.Random) -> str:
    """Main text; every block of it lies under ``data-label="main"``."""
    tag = rng.choice(["article"] * 5 + ["main", "main", "div", "div", "section"])
    name = f' class="{rng.choice(MAIN)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
    out = []
    if rng.random() < 0.85:
        n = rng.choice([1, 1, 2])
        out.append(f'<h{n} data-label="main">{_prose(rng, rng.randint(1, 12), rng.choice(["", "."]))}</h{n}>')
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12, 20])):
        text = _prose(rng, rng.choice([1, 2, 4, 8, 15, 40, 80, 150]))
        kind = rng.random()
        if kind < 0.6:
            out.append(f'<p data-label="main">{text}</p>')
        elif kind < 0.7:
            out.append(f'<p data-label="main"><b>{text}<br>')
        elif kind < 0.78:
            out.append(f'<p data-label="main">{text} <a href="/y">{_prose(rng, 3)}</a> {_prose(rng, 5)}</p>')
        elif kind < 0.86:
            items = "".join(f'<li data-label="main">{_prose(rng, rng.randint(1, 12))}</li>' for _ in range(rng.randint(2, 5)))
            out.append(f"<ul>{items}</ul>")
        elif kind < 0.92:
            out.append(f'<blockquote data-label="main">{text}</blockquote>')
        elif kind < 0.96:
            out.append(f'<h2 data-label="main">{_prose(rng, 4, "")}</h2>')
        else:
            out.append(f'<pre data-label="main">{text}</pre>' if rng.random() < 0.5 else
                       f'<table><tr><td data-label="main">{_prose(rng, 3)}</td><td data-label="main">{text}</td></tr></table>')
        if rng.random() < 0.06:
            out.append(_around(rng, "inside"))
    if rng.random() < 0.12:
        out.append(_part(rng, TALK, "section div", rng.randint(1, 5), 60))
    inner = "".join(out)
    if rng.random() < 0.2:
        inner = f'<div class="{rng.choice(MAIN)}">{inner}</div>'
    return f"<{tag}{name}>{inner}</{tag}>"


def training_pages(n: int, seed: int = 1) -> list[str]:
    """Pages of varied layouts; an element with ``data-label="main"`` holds main text, and so
    does a page without tags."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        if rng.random() < 0.02:
            pages.append(_prose(rng, rng.randint(1, 60)))
            continue
        body = [_around(rng, "before") for _ in range(rng.randint(0, 4))] + [_article(rng)]
        body += [_around(rng, "after") for _ in range(rng.randint(0, 4))]
        wrap = rng.choice(["{}", "{}", '<div id="page">{}</div>', '<div class="container wrapper">{}</div>'])
        end = rng.choice(["</body></html>", "</body></html>", ""])
        pages.append(f"<!DOCTYPE html><html><head><title>x</title></head><body>{wrap.format(''.join(body))}{end}")
    return pages


def is_main(block: Block) -> bool:
    """The label of a block of a training page."""
    return not block.path or any(f"{LABEL}=main" in names for _, names in block.path)


def fit(pages: int = 700, seed: int = 1, passes: int = 150, ridge: float = 2e-3) -> Field:
    """Maximise the mean conditional log-likelihood of the labelled pages by AdaGrad steps."""
    parsed = [b for b in map(parse, training_pages(pages, seed)) if b]
    names: dict[str, int] = {}
    longest = max(map(len, parsed))
    label = np.zeros((len(parsed), longest), dtype=np.int64)
    mask = np.zeros((len(parsed), longest))
    cell, feature = [], []
    for p, blocks in enumerate(parsed):
        for i, block in enumerate(blocks):
            label[p, i] = is_main(block)
            mask[p, i] = 1
            for f in path_features(block.path) + text_features(block, i, len(blocks)):
                cell.append(p * longest + i)
                feature.append(names.setdefault(f, len(names)))
    cell, feature = np.array(cell), np.array(feature)
    w, pairs = np.zeros(len(names)), np.zeros((2, 2))
    seen_w, seen_pairs = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    both = mask[:, 1:] * mask[:, :-1]
    true_pairs = np.array([[(both * (label[:, :-1] == a) * (label[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for _ in range(passes):
        score = np.zeros((len(parsed), longest, 2))
        score[:, :, 1] = np.bincount(cell, w[feature], minlength=label.size).reshape(label.shape)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for i in range(1, longest):
            step = np.logaddexp.reduce(forward[:, i - 1, :, None] + pairs, axis=1) + score[:, i]
            forward[:, i] = np.where(mask[:, i, None] > 0, step, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(pairs + (score[:, i + 1] + backward[:, i + 1])[:, None, :], axis=2)
            backward[:, i] = np.where(mask[:, i + 1, None] > 0, step, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)[:, None]
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total) * mask
        joint = np.exp(forward[:, :-1, :, None] + pairs + (score + backward)[:, 1:, None, :] - total[:, :, None, None])
        grad = np.bincount(feature, (label * mask - chance).reshape(-1)[cell], minlength=len(w)) / len(parsed) - ridge * w
        grad_pairs = (true_pairs - (joint * both[:, :, None, None]).sum(axis=(0, 1))) / len(parsed) - ridge * pairs
        seen_w += grad * grad
        seen_pairs += grad_pairs * grad_pairs
        w += 0.5 * grad / np.sqrt(seen_w)
        pairs += 0.5 * grad_pairs / np.sqrt(seen_pairs)
    return Field({f: float(w[i]) for f, i in names.items()}, pairs)


class Extractor:
    """Main text of pages. Weights of ancestor paths are kept, as few paths occur in very many blocks."""

    def __init__(self, field_: Field):
        self.weights, self.pairs, self.paths = field_.weights, field_.pairs.tolist(), {}

    def _score(self, block: Block, i: int, n: int) -> float:
        weights = self.weights
        known = self.paths.get(block.path)
        if known is None:
            if len(self.paths) > PATHS:
                self.paths.clear()
            known = self.paths[block.path] = sum(weights.get(f, 0.0) for f in path_features(block.path))
        return known + sum([weights.get(f, 0.0) for f in text_features(block, i, n)])

    def labels(self, blocks: list[Block]) -> list[int]:
        """Most likely labels of the whole sequence."""
        (oo, om), (mo, mm) = self.pairs
        n = len(blocks)
        other, main, steps = 0.0, 0.0, []
        for i, block in enumerate(blocks):
            score = self._score(block, i, n)
            if i == 0:
                main = score
                continue
            from_other, from_main = other + oo >= main + mo, other + om >= main + mm
            other, main = (other + oo if from_other else main + mo), (other + om if from_main else main + mm) + score
            steps.append((0 if from_other else 1, 0 if from_main else 1))
        out = [int(main > other)]
        for step in reversed(steps):
            out.append(step[out[-1]])
        return out[::-1]

    def __call__(self, page: bytes) -> tuple[str, int]:
        """Main text and the number of its blocks."""
        blocks = parse(page.decode("utf-8", "replace"))
        if not blocks:
            return "", 0
        kept = [b.text for b, main in zip(blocks, self.labels(blocks), strict=True) if main]
        return "\n".join(kept), len(kept)


def extract(pages: DataFrame, model: Field | None = None, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Struct ``row`` of the kept columns, text, n_chars and n_blocks of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())

    def make():
        extractor = Extractor(shared.value)

        def compute(texts: list[bytes]):
            found = [extractor(t) for t in texts]
            return [t for t, _ in found], [len(t) for t, _ in found], [n for _, n in found]

        return compute

    return map_texts(pages, html, make, [field("text", "string"), field("n_chars", "bigint"), field("n_blocks", "int")],
                     keep=keep)
