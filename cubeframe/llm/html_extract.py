"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: the text between two block-level tags, with the elements open around it. A block's features are its
ancestors' tags and the words of their class, id and role, and of its text the length, the share inside links, how it ends and a few
cue words. The field has the labels main text and other; it is trained on labelled pages (``labelled_pages`` writes such pages in many layouts;
other labelled blocks can be given) by Adam on the exact likelihood, and decoded by Viterbi. The weights, a number per feature, are broadcast.

Scripts, styles, titles, form controls, templates, graphics, what players show in their stead, and comments are never text; formulas are. Character
references are decoded, white space inside a block is one space, and the main blocks are joined in page order by one space.

Defined cases: a null or empty page, or one without main blocks, has the text ''. Unclosed elements end where HTML ends them (a paragraph at
the next block, an item at the next item) or with their parent; only elements of raw text (``RAW``) that are not closed take the page's rest. Unmatched
end tags are ignored; a '<' that starts no tag is text; a quote that is closed nowhere ends with its tag; a tag that is not closed takes the page's
rest, as in HTML. Rows that repeat are extracted each; other columns are not read, whatever their names; an empty table gives an empty result. Pages are
taken whole, whatever their length: the scanner goes forward only, and what is known of the open elements is kept with them, so work
grows with the length also for unclosed tags and deep nesting.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import ship

#: Block-level elements (fixed values of HTML), whose tags end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content; whose content is raw text that is not the page's; whose content is not shown, or is a control's (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("select button template object svg canvas audio video datalist".split())
#: Start tags that end an open element of these names, up to the nearest of the bounds (fixed values of HTML).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_NAME = re.compile(r"[^\s/>]+")
_TAG_STOP = re.compile(r">|=\s*([\"'])")
_NAMED = re.compile(r"(?:\s|^)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]{2,}")
#: Words that tell blocks around an article (fixed values); other words are no features.
CUES = frozenset("advertisement sponsored cookie cookies privacy subscribe newsletter login register search menu share tweet comments reply replies related copyright rights reserved terms contact".split())


class Block:
    __slots__ = ("inner", "linked", "names", "parts", "tags")

    def __init__(self, tags: frozenset[str], inner: str, names: frozenset[str]):
        #: The block-level elements around the text, the innermost of them, and the names of all elements around it.
        self.tags, self.inner, self.names, self.parts, self.linked = tags, inner, names, [], 0

    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


class _Open:
    """The open elements: where each name is open, and of each element what holds for the text in it."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.around: list[tuple[frozenset[str], str, frozenset[str]]] = [(frozenset(), "-", frozenset())]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.links = self.hidden = 0

    def last(self, names: frozenset[str] | set[str]) -> int:
        """The place of the innermost open element of these names, -1 without one."""
        return max([self.places[n][-1] for n in names if self.places.get(n)], default=-1)

    def push(self, name: str, named: frozenset[str]) -> None:
        tags, inner, names = self.around[-1]
        if name in BLOCKS:
            self.blocks.append(len(self.names))
            if name not in ("html", "body"):
                tags, inner = tags if name in tags else tags | {name}, name
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.around.append((tags, inner, names if named <= names else names | named))
        self.links += name == "a"
        self.hidden += name in HIDDEN

    def close(self, place: int) -> None:
        """End the elements from the place on."""
        while len(self.names) > place:
            name = self.names.pop()
            self.around.pop()
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            self.links -= name == "a"
            self.hidden -= name in HIDDEN


def _tag_end(html: str, at: int, unclosed: set[str]) -> int:
    """Where a tag whose attributes start at ``at`` ends, the length of the page if it is not closed."""
    while True:
        stop = _TAG_STOP.search(html, at)
        if stop is None:
            return len(html)
        quote = stop[1]
        if quote is None:
            return stop.start()
        close = -1 if quote in unclosed else html.find(quote, stop.end())
        if close < 0:
            # No such quote in the rest of the page, and so never again.
            unclosed.add(quote)
            end = html.find(">", stop.end())
            return len(html) if end < 0 else end
        at = close + 1


def blocks(html: str, known: frozenset[str] | None = None) -> list[tuple[Block, str]]:
    """Each leaf block that has text, and its text; of the elements' names those ``known`` (all without it)."""
    found: list[Block] = []
    open_, unclosed = _Open(), set()
    now: Block | None = None
    at, size = 0, len(html)

    def add(raw: str) -> None:
        nonlocal now
        if raw and not open_.hidden:
            if now is None:
                now = Block(*open_.around[-1])
                found.append(now)
            now.parts.append(raw)
            if open_.links:
                now.linked += len(raw)

    while at < size:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        add(html[at:start])
        sign = html[start + 1 : start + 2]
        ends = sign == "/"
        first = html[start + 2 : start + 3] if ends else sign
        if not (first.isascii() and first.isalpha()):
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = size if end < 0 else end + 3
            elif sign and sign in "!?/":
                end = html.find(">", start + 2)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = start + 1
            continue
        name = _NAME.match(html, start + 1 + ends)
        end = _tag_end(html, name.end(), unclosed)
        at, tag, attributes = end + 1, name[0].lower(), html[name.end() : end]
        if tag in BLOCKS:
            now = None
        elif tag == "br":
            add(" ")
        if ends:
            if open_.places.get(tag):
                open_.close(open_.places[tag][-1])
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(html, at)
                end = html.find(">", close.end()) if close else -1
                at = size if end < 0 else end + 1
            continue
        if tag in BLOCKS and not open_.hidden and open_.blocks and open_.names[open_.blocks[-1]] == "p":
            open_.close(open_.blocks[-1])
        if tag in ENDS:
            own, bounds = ENDS[tag]
            place = open_.last(own)
            if place > open_.last(bounds):
                open_.close(place)
        if tag not in VOID and not (tag in HIDDEN and attributes.endswith("/")):
            named = " ".join(x for m in _NAMED.findall(attributes) for x in m) if attributes else ""
            names = frozenset(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower())) if named else frozenset()
            open_.push(tag, names if known is None else names & known)
    out = []
    for block in found:
        text = block.text()
        if text:
            out.append((block, text))
    return out


def features(block: Block, text: str) -> list[str]:
    n = text.count(" ") + 1
    share = min(1.0, block.linked / max(1, len(text)))
    own = [f"tag {t}" for t in block.tags] + [f"name {x}" for x in block.names]
    own += [f"in {block.inner}", f"words {min(6, n.bit_length())}", f"links {0 if share == 0 else 1 if share < 0.5 else 2}"]
    own.append("ends" if text[-1] in ".!?\"'»”…:;" else "open")
    if n <= 40:
        own += [f"cue {w}" for w in CUES.intersection(_WORD.findall(text.lower()))]
        if "©" in text or "·" in text or "|" in text:
            own.append("mark")
    return own


class Field:
    """Weights of the chain: per feature (of main text against other), transitions [from][to], and the start."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]], start: float):
        self.weights, self.steps, self.start = weights, steps, start
        #: The names of elements that have a weight.
        self.names = frozenset(f.removeprefix("name ") for f in weights if f.startswith("name "))

    def decode(self, features: list[list[str]]) -> list[bool]:
        """The likeliest labels (Viterbi); of equals, other."""
        get, steps = self.weights.get, self.steps
        other, main, back = 0.0, self.start, []
        for i, own in enumerate(features):
            gain = sum([get(f, 0.0) for f in own])
            if i:
                to_other = (other + steps[0][0], main + steps[1][0])
                to_main = (other + steps[0][1], main + steps[1][1])
                back.append((to_other[1] > to_other[0], to_main[1] > to_main[0]))
                other, main = max(to_other), max(to_main)
            main += gain
        label, labels = main > other, []
        for step in reversed([None, *back]):
            labels.append(label)
            if step:
                label = step[label]
        return labels[::-1][: len(features)]


def train(pages: list[list[tuple[list[str], bool]]], steps: int = 160, rate: float = 0.1, decay: float = 2e-3) -> Field:
    """The field that makes the labels likely: Adam on the chain's log-likelihood, all pages at a time."""
    names = {f: i for i, f in enumerate(sorted({f for page in pages for own, _ in page for f in own}))}
    n, most = len(pages), max(map(len, pages))
    x = np.zeros((n, most, len(names)), np.float32)
    y, mask = np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, page in enumerate(pages):
        for j, (own, label) in enumerate(page):
            x[i, j, [names[f] for f in own]] = 1
            y[i, j], mask[i, j] = label, True
    flat = x.reshape(-1, len(names))
    theta = np.zeros(len(names) + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gain = np.zeros((n, most, 2))
        gain[:, :, 1] = (flat @ theta[: len(names)].astype(np.float32)).reshape(n, most)
        gain[:, 0, 1] += theta[-1]
        move = theta[len(names) : len(names) + 4].reshape(2, 2)
        ahead = np.zeros((n, most, 2))
        ahead[:, 0] = gain[:, 0]
        for j in range(1, most):
            new = np.logaddexp.reduce(ahead[:, j - 1, :, None] + move, axis=1) + gain[:, j]
            ahead[:, j] = np.where(mask[:, j, None], new, ahead[:, j - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros((n, most, 2))
        grad_move = np.zeros((2, 2))
        for j in range(most - 2, -1, -1):
            tail = gain[:, j + 1] + behind[:, j + 1]
            behind[:, j] = np.where(mask[:, j + 1, None], np.logaddexp.reduce(move[None] + tail[:, None, :], axis=2), 0)
            pair = np.exp(np.clip(ahead[:, j, :, None] + move + tail[:, None, :] - total[:, None, None], -60, 0)) * mask[:, j + 1, None, None]
            grad_move += pair.sum(axis=0)
            for a in (0, 1):
                for b in (0, 1):
                    grad_move[a, b] -= ((y[:, j] == a) & (y[:, j + 1] == b) & mask[:, j + 1]).sum()
        main = np.exp(np.clip(ahead[:, :, 1] + behind[:, :, 1] - total[:, None], -60, 0)) * mask
        off = (main - y * mask).astype(np.float32)
        gradient = np.concatenate([off.reshape(-1) @ flat, grad_move.ravel(), [off[:, 0].sum()]]) / n + decay * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in names.items()}, theta[len(names) : len(names) + 4].reshape(2, 2).tolist(), float(theta[-1]))


def labelled_pages(n: int = 360, seed: int = 11) -> list[list[tuple[list[str], bool]]]:
    """Pages in many layouts, written here with the label of every block: the training set."""
    dice = random.Random(seed)
    syllables = "an be ci do er fa gu he in jo ka le mi no ou pa qu ri st th un ve wo ya zu ß é ñ ö".split()

    def words(low: int, high: int) -> str:
        text = " ".join("".join(dice.choices(syllables, k=dice.randint(1, 4))) for _ in range(dice.randint(low, high)))
        kind = dice.random()
        if kind < 0.05:
            text = text.upper().replace(" ", "!! ")
        elif kind < 0.1:
            text = text.replace(" ", dice.choice(["*** ", "### ", " | ", "%%% "]))
        return text.capitalize() if kind > 0.05 else text

    def sentence(low: int, high: int) -> str:
        return words(low, high) + dice.choice([".", ".", ".", "!", "?", "", ":"])

    def main(inner: str) -> str:
        return f"\x01{inner}\x02"

    def other(cue: str = "") -> str:
        return dice.choice([words(1, 6), sentence(3, 16), sentence(1, 40), cue or words(1, 3)])

    def listing(item) -> str:
        close = dice.choice(["</li>", ""])
        return "<ul>" + "".join(f"<li>{item()}{close}" for _ in range(dice.randint(2, 9))) + "</ul>"

    def link() -> str:
        return f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'

    def attribute(*names: str) -> str:
        return dice.choice(["class", "class", "id"]) + '="' + dice.choice(names) + '"'

    def article() -> str:
        parts = [f"<h1>{main(words(2, 10))}</h1>"] if dice.random() < 0.85 else []
        for _ in range(dice.choice([1, 1, 2, 3, 4, 6, 9])):
            text = main(sentence(*dice.choice([(1, 2), (1, 8), (8, 60), (30, 150)])))
            if dice.random() < 0.25:
                text = f"<b>{text}"
            parts.append(dice.choice([f"<p>{text}</p>"] * 6 + [f"<p>{text}", f"<p>{text}<br>", f"<h2>{main(words(1, 6))}</h2><p>{text}</p>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li><li>{main(words(2, 12))}</li></ul>", f"<pre>{text}</pre>", f"<p>{main(words(3, 20) + ' ' + link() + ' ' + sentence(3, 20))}</p>", f"<figure><figcaption>{text}</figcaption></figure>", f"<table><tr><td>{main(words(1, 4))}<td>{main(words(1, 4))}</table>"]))
            if dice.random() < 0.12:
                parts.append(dice.choice([advert, share, notice])())
        return "".join(parts)

    def wrapped(inner: str) -> str:
        kind = dice.random()
        if kind < 0.5:
            return f"<article>{inner}</article>"
        if kind < 0.62:
            return f"<main>{inner}</main>"
        if kind < 0.72:
            return f"<main><article {attribute('post', 'entry', 'story')}>{inner}</article></main>"
        return f"<{dice.choice(['div', 'section'])} {attribute('content', 'post-content', 'entry-content', 'article-body', 'main-content', 'story', 'post', 'text')}>{inner}</div>"

    def advert() -> str:
        return f"<{dice.choice(['div', 'div', 'aside', 'section'])} {attribute('ad', 'ads', 'advert', 'ad-banner', 'banner', 'sponsored', 'promo', 'advertisement')}>{dice.choice(['', '<p>'])}{other('Advertisement')}</div>"

    def share() -> str:
        return f"<div {attribute('share', 'social', 'share-buttons')}>{link()} {link()}</div>"

    def notice() -> str:
        return f"<div {attribute('notice', 'cookie-notice', 'cookie-banner', 'consent', 'alert', 'gdpr', 'popup', 'modal')}><p>{other('We use cookies.')}</p></div>"

    def menu() -> str:
        return dice.choice([f"<nav>{listing(link)}</nav>", f"<div {attribute('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs')}>{listing(link)}</div>", f"<nav>{link()} {link()}</nav>", f'<ul class="menu">{listing(link)}</ul>'])

    def header() -> str:
        return dice.choice([f"<header>{other()}</header>", f"<header><h1>{words(1, 4)}</h1>{menu()}</header>", f"<div {attribute('header', 'masthead', 'site-header', 'top')}><p>{other()}</p></div>"])

    def form() -> str:
        return f"<form {attribute('search', 'login', 'newsletter', 'subscribe', 'signup')}><label>{words(1, 3)}</label><input name=q>{dice.choice(['', f'<p>{other()}</p>'])}</form>"

    def sidebar() -> str:
        inner = dice.choice([listing(link), f"<h3>{words(1, 3)}</h3><p>{other()}</p>", f"<h3>{words(1, 3)}</h3>{listing(link)}"])
        return dice.choice([f"<aside>{inner}</aside>", f"<div {attribute('sidebar', 'side', 'related', 'widget', 'related-posts')}>{inner}</div>", f'<aside class="sidebar">{inner}</aside>'])

    def comments() -> str:
        def own() -> str:
            return f"<p>{sentence(*dice.choice([(2, 12), (8, 60), (30, 90)]))}</p>"

        kind, inner = dice.random(), "".join(own() for _ in range(dice.randint(1, 5)))
        if kind < 0.4:
            return f"<{dice.choice(['section', 'div'])} {attribute('comments', 'comment-list', 'reader-comments', 'discussion', 'disqus')}><h3>{words(1, 2)}</h3>{inner}</div>"
        return f'<div {attribute("comments", "replies", "responses")}>{"".join(f"<div class=comment>{own()}</div>" for _ in range(3))}</div>' if kind < 0.7 else f'<ol class="comments">{listing(own)}</ol>'

    def footer() -> str:
        inner = dice.choice([f"&copy; {words(1, 2)} &middot; {other()}", other("All rights reserved."), f"<p>{other()}</p>{listing(link)}"])
        return dice.choice([f"<footer>{inner}</footer>"] * 2 + [f"<div {attribute('footer', 'site-footer', 'bottom', 'copyright')}>{inner}</div>"])

    def some(*makers, share: float = 0.45) -> str:
        return "".join(m() for m in makers if dice.random() < share)

    out = []
    for _ in range(n):
        page = some(notice, header, menu, advert, form) + some(menu, share=0.4) + some(advert, share=0.3)
        inside = article() + some(comments, share=0.08)
        page += wrapped(inside) if dice.random() < 0.94 else inside
        page += some(share, advert, comments, sidebar, form, menu, notice, share=0.3) + some(footer, share=0.85)
        labelled = []
        for block, text in blocks(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>"):
            plain = text.replace("\x01", "").replace("\x02", "")
            labelled.append((features(block, plain), plain != text))
        out.append(labelled)
    return out


@cache
def standard_field() -> Field:
    """The field trained on the labelled pages of this module."""
    return train(labelled_pages())


def main_text(html: str | None, field: Field) -> str:
    found = blocks(html or "", field.names)
    return " ".join(text for (_, text), keep in zip(found, field.decode([features(*own) for own in found]), strict=True) if keep)


def extract(pages: DataFrame, field: Field | None = None, ident: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: id, text (main text), n_chars."""
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field or standard_field())
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _text.slices(whole, "html"):
                texts = [main_text(x, shared.value) for x in batch.column(2).to_pylist()]
                yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col(ident).cast("long").alias("id"), F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(_text.frugal(work), "id long, url string, text string, n_chars long").withColumnRenamed("id", ident)
