"""HTML extraction (operator 2): a linear-chain conditional random field labels the leaf blocks of a page as main text or not.

Blocks.  A page is cut at the tags of block elements; what lies between two such tags is a leaf block, with the elements that
are open around it.  Scripts, styles, comments, the head and void elements have no text.  Character references are decoded,
white space in a block becomes one space, empty blocks are skipped.  Unclosed and stray tags are read as browsers do.  Formulas,
objects, media and noscript are elements like others.

Model.  Features of a block: each ancestor's tag, the words of its class, id and role, pairs of an ancestor with the section
it stands in, the innermost block tag, and of the text: length, share inside links, last character, cue words.  The chain
adds a weight for each pair of neighbouring labels.  Weights maximise the penalised likelihood of labelled pages (forward and
backward sums, Adam); the best labels of a page are found by Viterbi.  The labelled pages are drawn by ``labelled_pages``, a
bounded sample (``TRAIN`` pages) of layouts with known main text, over half of them without an element or name that tells the
article.  Features of fewer than three pages have no weight.

Cases: null and empty pages have the empty text; a page cut off anywhere keeps what was read; text without any tag is one
block; very long pages and deep nesting are read whole in linear time; of equal labellings the one with more main text, from the
end, is taken; repeated rows and extra columns make no difference.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.llm.common import Memo, pa_schema, slices

TRAIN = 2400
#: Elements by how they part text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or no part of the page, with what ends them.
RAW = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in "script style template title xmp".split()}
SECTIONS = frozenset("article aside body footer form header main nav section".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CUES = frozenset("©|copyright|rights|reserved|cookie|cookies|privacy|terms|subscribe|newsletter|sign|login|log|share|advertisement|sponsored|reply|replies|comment|comments|posted|related|read|more|menu|home|search|previous|next|tags|follow".split("|"))
MARKUP = re.compile(r"""<!--.*?(?:--!?>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|</([a-zA-Z][^\s/>]*+)[^>]*>|<[!?/][^>]*>|<[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*\Z""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


def names_in(attributes: str) -> tuple[str, ...]:
    return tuple(sorted({w for m in NAMES.finditer(attributes) for w in PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[1]).lower())})) if "=" in attributes else ()


class Place:
    """An open element and those around it; elements share their ancestors, so a block's place costs nothing to keep."""

    __slots__ = ("around", "tag", "names", "depth", "section", "inner")

    def __init__(self, around: Place | None, tag: str, names: tuple[str, ...]):
        self.around, self.tag, self.names, self.depth = around, tag, names, around.depth + 1 if around else 0
        self.section = tag if tag in SECTIONS else names[0] if names else around.section if around else "body"
        self.inner = tag if tag in BLOCKS else around.inner if around else "body"

    def own(self) -> list[str]:
        """Features of this element alone and of it within the section around it."""
        out = [f"t:{self.tag}", *(f"n:{n}" for n in self.names)]
        return out + [f"{self.around.section if self.around else 'body'}>{x}" for x in out]

    def leaf(self) -> tuple[str, str]:
        return f"inner:{self.inner}", f"in:{self.section}>{self.inner}"


PAGE = Place(None, "", ())


def blocks(page: str) -> list[tuple[Place, str, int]]:
    """(innermost open element, text, characters inside links) of each leaf block."""
    out: list[tuple[Place, str, int]] = []
    stack: list[Place] = [PAGE]
    tops: list[int] = []  # where the stack's block elements are
    opened: list[Counter] = [Counter()]  # open inline elements since each of them
    whole: Counter = Counter()  # open block elements
    parts: list[str] = []
    linked = links = 0
    names = Memo(names_in, 10_000)
    at, head = 0, False

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1], text, linked))
            parts.clear()
        linked = 0

    def close(upto: int):
        nonlocal links
        while len(stack) > upto:
            tag = stack.pop().tag
            links -= tag == "a"
            if tag in BLOCKS:
                tops.pop()
                opened.pop()
                whole[tag] -= 1
            else:
                opened[-1][tag] -= 1

    while True:
        m = MARKUP.search(page, at)
        begin = m.start() if m else len(page)
        if begin > at and not head:
            parts.append(page[at:begin])
            if links:
                linked += begin - at
        if m is None:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "head":
                head = True
                continue
            if tag in RAW:
                if not m[2].endswith("/"):
                    end = RAW[tag].search(page, at)
                    at = end.end() if end else len(page)
                parts.append(" ")
                continue
            if tag in BLOCKS:
                head = False
                flush()
                above = stack[tops[-1]].tag if tops else ""
                if above == "p" or above in CLOSES.get(tag, ()):
                    close(tops[-1])
            elif tag == "br":
                parts.append(" ")
            if tag not in VOID:
                if tag in BLOCKS:
                    tops.append(len(stack))
                    opened.append(Counter())
                    whole[tag] += 1
                else:
                    opened[-1][tag] += 1
                stack.append(Place(stack[-1], tag, names[m[2]]))
                links += tag == "a"
        elif m[3]:
            tag = m[3].lower()
            if tag == "head":
                head = False
            if tag in BLOCKS:
                flush()
            if whole[tag] if tag in BLOCKS else opened[-1][tag] > 0:  # else a stray end tag
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
    flush()
    return out


def place_features(place: Place) -> tuple[str, ...]:
    """All distinct features of the elements around a block."""
    found, leaf = {"bias"}, place.leaf()
    while place is not PAGE:
        found.update(place.own())
        place = place.around
    return (*sorted(found), *leaf)


def text_features(text: str, linked: int) -> list[str]:
    n = text.count(" ") + 1
    link = 0 if not linked else 1 if 2 * linked < len(text) else 2
    out = [f"link:{link}>{min(n, 6)}", f"len:{(n > 1) + (n > 3) + (n > 8) + (n > 20) + (n > 50)}", f"link:{link}", f"end:{text[-1] if text[-1] in '.!?:,;' else 'x'}"]
    if n <= 20:
        out += [f"cue:{w}" for w in CUES.intersection(text.lower().split())]
    return out


class Crf:
    """Two labels; ``weights[f]`` is what feature f adds to the score of label 1, ``chain[a, b]`` of label b after a."""

    def __init__(self, weights: dict[str, float], chain: np.ndarray):
        self.weights, self.chain = weights, chain

    def __reduce__(self):
        return Crf, (self.weights, self.chain)

    def places(self, found: list[tuple[Place, str, int]]) -> Iterator[float]:
        """The scores of ``place_features`` of each block.  Blocks stand in page order, so each element is entered and left once."""
        get, path, seen, score = self.weights.get, [PAGE], Counter(), self.weights.get("bias", 0.0)
        for place, _, _ in found:
            enter = []
            while place is not PAGE and not (place.depth < len(path) and path[place.depth] is place):
                enter.append(place)
                place = place.around
            while len(path) > place.depth + 1:
                for f in path.pop().own():
                    seen[f] -= 1
                    if not seen[f]:
                        score -= get(f, 0.0)
            for e in reversed(enter):
                path.append(e)
                for f in e.own():
                    seen[f] += 1
                    if seen[f] == 1:
                        score += get(f, 0.0)
            yield score + sum(get(f, 0.0) for f in path[-1].leaf())

    def labels(self, found: list[tuple[Place, str, int]]) -> list[int]:
        """Viterbi; of equal scores, the block and the one before it count as main text."""
        get, ((c00, c01), (c10, c11)) = self.weights.get, self.chain.tolist()
        zero, one, back = 0.0, 0.0, []
        for k, ((_, text, linked), of) in enumerate(zip(found, self.places(found))):
            u = of + sum(get(f, 0.0) for f in text_features(text, linked))
            if not k:
                zero, one = 0.0, u
                continue
            from0, from1 = one + c10 > zero + c00, one + c11 >= zero + c01
            zero, one = (one + c10 if from0 else zero + c00), (one + c11 if from1 else zero + c01) + u
            back.append((from0, from1))
        if not found:
            return []
        out = [int(one >= zero)]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def text(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(t for (_, t, _), y in zip(found, self.labels(found)) if y)


def train(pages: list[tuple[str, set[str]]], rounds: int = 120, penalty: float = 0.01, rate: float = 0.15) -> Crf:
    """``pages``: html and the texts of its main blocks."""
    rows, on = [], Counter()
    for page, main in pages:
        found = [((*place_features(p), *text_features(t, k)), int(t in main)) for p, t, k in blocks(page)]
        if found:
            rows.append(found)
            on.update({f for fs, _ in found for f in fs})
    # names of one page alone say nothing about others
    numbers = {f: i for i, f in enumerate(sorted(f for f, k in on.items() if k >= 3))}
    rows = [[([numbers[f] for f in fs if f in numbers], y) for fs, y in r] for r in rows]
    rows.sort(key=len, reverse=True)  # so the pages that have a block at a place come first
    longest, n = len(rows[0]), len(rows)
    there, gold = np.zeros((longest, n), bool), np.zeros((longest, n), int)  # a row for each place in a page
    cell, feature = [], []
    for i, r in enumerate(rows):
        for t, (fs, y) in enumerate(r):
            there[t, i], gold[t, i] = True, y
            cell += [t * n + i] * len(fs)
            feature += fs
    cell, feature = np.array(cell), np.array(feature)
    w, chain = np.zeros(len(numbers)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(chain), np.zeros_like(chain)]
    pair = there[1:] & there[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:-1][pair], gold[1:][pair]), 1)
    alive, last = there.sum(1).tolist(), (there.sum(0) - 1, np.arange(n))
    for step in range(1, rounds + 1):
        u = np.bincount(cell, w[feature], n * longest).reshape(longest, n)
        (c00, c01), (c10, c11) = chain
        forward, backward = np.zeros((2, longest, n)), np.zeros((2, longest, n))
        forward[1, 0] = u[0]
        for t in range(1, longest):
            m = alive[t]
            a, b = forward[0, t - 1, :m], forward[1, t - 1, :m]
            forward[0, t, :m] = np.logaddexp(a + c00, b + c10)
            forward[1, t, :m] = np.logaddexp(a + c01, b + c11) + u[t, :m]
        for t in range(longest - 2, -1, -1):
            m = alive[t + 1]
            a, b = backward[0, t + 1, :m], backward[1, t + 1, :m] + u[t + 1, :m]
            backward[0, t, :m] = np.logaddexp(c00 + a, c01 + b)
            backward[1, t, :m] = np.logaddexp(c10 + a, c11 + b)
        whole = np.logaddexp(forward[0][last], forward[1][last])
        share = np.exp(np.where(there, forward[1] + backward[1] - whole, -np.inf))
        after = (backward[0, 1:], u[1:] + backward[1, 1:])
        both = np.array([[np.exp((forward[x, :-1] + chain[x, y] + after[y] - whole)[pair]).sum() for y in (0, 1)] for x in (0, 1)])
        grads = (np.bincount(feature, ((gold - share) * there).ravel()[cell], len(w)) / n - penalty / n * w, (seen - both) / n - penalty / n * chain)
        for k, (x, g) in enumerate(zip((w, chain), grads)):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            x += rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return Crf({f: round(float(w[i]), 5) for f, i in numbers.items() if abs(w[i]) > 1e-4}, np.round(chain, 5))


def labelled_pages(n: int = TRAIN, seed: int = 5) -> list[tuple[str, set[str]]]:
    """Pages of many layouts in invented words, each with the texts of its main blocks."""
    r = random.Random(seed)
    syllables = "an ber ch de en er ez ga he ie la mi nt on or que ra sch th ti ung ve wa ción é ü ж".split()
    pool = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(5000)]
    word = lambda: r.choice(pool)

    def words(lo: int, hi: int, end: str = ".") -> str:
        w = r.choices(pool, k=r.randint(lo, hi))
        if r.random() < 0.1:
            w = [x + r.choice(("***", "%%%", "$$$", "!!", " |")) for x in w]
        return " ".join(w).capitalize() + end

    def page() -> tuple[str, set[str]]:
        main: set[str] = set()

        def own(text: str) -> str:
            main.add(" ".join(re.sub("<br/?>", " ", text).split()))
            return text

        def prose() -> str:
            return own(words(1, r.choice((1, 3, 8, 16, 20, 30, 60, 90)), r.choice((".", ".", ".", ".", ".", "!", "?", "", ":"))))

        def link(text: str) -> str:
            return f'<a href="/{word()}">{text}</a>'

        def attr(*names: str) -> str:
            return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"'

        def menu() -> str:
            items = "".join(f"<li>{link(words(1, 3, ''))}</li>" for _ in range(r.randint(2, 9)))
            return r.choice((f"<nav><ul>{items}</ul></nav>", f"<ul{attr('menu', 'navbar', 'nav-links', 'main-menu', 'breadcrumbs')}>{items}</ul>", f"<div{attr('menu', 'nav', 'navigation', 'topnav')}><ul>{items}</ul></div>", f'<div role="navigation">{items}</div>'))

        def header() -> str:
            inner = r.choice((f"<h1>{words(1, 4, '')}</h1>", f"<p>{words(1, 6, '')}</p>", f"<div>{link(words(1, 3, ''))}</div>", link(words(1, 3, "")), words(1, 4, ""))) + (menu() if r.random() < 0.4 else "")
            if r.random() < 0.2:
                return f"<{(t := r.choice(('div', 'div', 'p')))}>{link(words(1, 3, ''))}</{t}>"
            if r.random() < 0.05:
                return f'<div role="banner">{inner}</div>'
            return r.choice((f"<header>{inner}</header>", f"<div{attr('header', 'site-header', 'masthead', 'banner', 'top-bar', 'logo')}>{inner}</div>"))

        def advert() -> str:
            inner = r.choice((words(2, 25), f"<p>{words(2, 25)}</p>", link(words(2, 10, ""))))
            return f"<{(t := r.choice(('div', 'div', 'aside', 'section', 'p')))}{attr('ad', 'ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'sponsor')}>{inner}</{t}>"

        def notice() -> str:
            if r.random() < 0.1:
                return f"<noscript>{r.choice((words(3, 20), f'<p>{words(3, 20)}</p>'))}</noscript>"
            inner = r.choice((words(3, 30), f"<p>{words(3, 30)}</p>")) + (f"<button>{words(1, 2, '')}</button>" if r.random() < 0.5 else "")
            return f"<div{attr('notice', 'cookie', 'cookie-banner', 'alert', 'consent', 'gdpr', 'popup', 'warning', 'modal', 'paywall', 'message')}>{inner}</div>"

        def form() -> str:
            inner = f"<label>{words(1, 4, '')}</label><input type=text>" + r.choice(("", f"<p>{words(3, 15)}</p>", f"<textarea>{words(1, 5)}</textarea>", f"<select><option>{word()}<option>{word()}</select>")) + f"<button>{words(1, 2, '')}</button>"
            return r.choice((f"<form>{inner}</form>", f"<form{attr('search', 'newsletter', 'subscribe', 'signup', 'login')}>{inner}</form>", f"<div{attr('newsletter', 'subscribe', 'signup')}>{inner}</div>"))

        def sidebar() -> str:
            inner = r.choice((f"<h3>{words(1, 3, '')}</h3>", f"<h2>{words(1, 3, '')}</h2>", "")) + r.choice((f"<p>{words(2, 40)}</p>" * r.randint(1, 2), "<ul>" + "".join(f"<li>{link(words(1, 8, ''))}</li>" for _ in range(r.randint(1, 6))) + "</ul>", words(2, 20)))
            return r.choice((f"<aside>{inner}</aside>", f"<aside{attr('sidebar', 'related', 'widget')}>{inner}</aside>", f"<div{attr('sidebar', 'related', 'recommended', 'widget', 'side', 'rail', 'trending', 'popular', 'share', 'social', 'tags')}>{inner}</div>"))

        def comments() -> str:
            one = lambda: r.choice((f'<div class="comment"><p>{words(2, 40)}</p></div>', f'<li class="comment">{words(2, 40)}</li>', f'<div class="comment"><b>{word()}</b> {words(1, 20)}</div>', f"<p>{words(2, 40)}</p>", f"<article{attr('comment', 'comment-body')}><p>{words(2, 40)}</p></article>"))
            inner = r.choice(("", f"<h2>{r.choice(('Comments', words(1, 2, '')))}</h2>")) + "".join(one() for _ in range(r.randint(1, 5))) + (form() if r.random() < 0.2 else "")
            return f"<{(t := r.choice(('section', 'div', 'div', 'ol')))}{attr('comments', 'comments', 'comment-list', 'reader-comments', 'responses', 'discussion', 'disqus', 'replies')}>{inner}</{t}>"

        def footer() -> str:
            inner = r.choice((f"&copy; {word()} &middot; {words(1, 20)}", f"<p>&copy; {words(1, 8)}</p>", f"<p>{words(2, 30)}</p>", "<ul>" + f"<li>{link(words(1, 3, ''))}</li>" * r.randint(1, 4) + "</ul>"))
            if r.random() < 0.05:
                return f'<div role="contentinfo">{inner}</div>'
            return r.choice((f"<footer>{inner}</footer>", f"<footer{attr('site-footer', 'footer')}>{inner}</footer>", f"<div{attr('footer', 'copyright', 'bottom', 'legal', 'credits')}>{inner}</div>"))

        def body(headed: float = 0.8, plain: bool = False) -> str:
            out = "" if r.random() >= headed else r.choice((f"<h1>{own(words(1, 9, r.choice(('', '.'))))}</h1>", f"<h1>{own(words(1, 9, ''))}</h1>", f"<h1>{own(words(1, 9, ''))}</h1>" if plain else f"<header><h1>{own(words(1, 9, ''))}</h1></header>", f"<h2>{own(words(1, 9, ''))}</h2>"))
            for _ in range(r.choice((1, 2, 4, 8, 14))):
                x = r.random()
                if x < 0.68:
                    out += r.choice((f"<p>{prose()}</p>", f"<p>{prose()}</p>", f"<p><b>{prose()}<br>", f"<p>{prose()}", f"<div>{prose()}</div>", f"<p class=\"{word()}\">{prose()}</p>"))
                elif x < 0.74:
                    out += f"<h{(k := r.randint(2, 4))}>{own(words(1, 6, ''))}</h{k}>"
                elif x < 0.79:
                    out += "<ul>" + "".join(f"<li>{prose()}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
                elif x < 0.82:
                    out += f"<blockquote>{r.choice((prose(), f'<p>{prose()}</p>'))}</blockquote>"
                elif x < 0.84:
                    out += f"<pre>{own(words(1, 12, ''))}</pre>"
                elif x < 0.86:
                    out += f"<table><tr><td>{own(words(1, 4, ''))}</td><td>{own(words(1, 4, ''))}</td></tr></table>"
                elif x < 0.88:
                    t = words(1, 4, "")
                    out += f"<p>{link(own(t))}</p>"
                elif x < 0.90:
                    out += f"<figure><img src=x><figcaption>{own(words(1, 12))}</figcaption></figure>"
                elif x < 0.93:
                    out += advert()
                elif x < 0.95:
                    out += notice()
                elif x < 0.97:
                    out += sidebar()
                else:
                    out += form()
            return out + (comments() if r.random() < 0.15 else "")

        def lines() -> str:
            """Text that only line breaks or nothing at all part: one block."""
            return own(r.choice(("<br>", "<br/>\n", "\n\n")).join(words(4, 60) for _ in range(r.randint(1, 5)))).replace("\n\n", "\n")

        def nest(inner: str) -> str:
            """Elements around the text whose names say nothing, with or without the rest of the page inside."""
            for _ in range(r.randint(1, 4)):
                tag = r.choice(("div", "div", "div", "section", "section", "center", "span", "td", "td", "dl"))
                name = r.choice(("", attr("wrapper", "container", "row", "col", "inner", "outer", "page", "grid", "box", "left", "w"), attr(word())))
                if tag == "td":
                    beside = r.choice(("", f"<td>{menu()}</td>", f"<td>{sidebar()}</td>", f"<td{name}>{link(words(1, 2, ''))}</td>", f"<td{name}>{link(words(1, 3, ''))}<br>{link(words(1, 3, ''))}</td>"))
                    inner = f"<table{name}><tr>{beside}<td>{inner}</td></tr></table>"
                elif tag == "dl":
                    inner = f"<div><div{name}>{inner}</div></div>"
                else:
                    inner = f"<{tag}{name}>{inner}</{tag}>"
            return inner

        kind = r.random()
        inner = lines() if kind >= 0.94 else body(0.8 if kind < 0.44 else 0.4, kind >= 0.44)
        if kind < 0.2:
            inner = f"<article>{inner}</article>"
        elif kind < 0.28:
            inner = f"<main>{r.choice((inner, f'<article>{inner}</article>', f'<div>{inner}</div>'))}</main>"
        elif kind < 0.44:
            inner = f"<div{attr('content', 'main-content', 'post', 'entry-content', 'story', 'article-body', 'post-body', 'main', 'text', 'page-content')}>{inner}</div>"
        elif kind < 0.64 or 0.94 <= kind < 0.97:
            inner = nest(inner)
        if kind >= 0.98:  # a page of text
            return inner, main
        top = [f() for f in (header, menu, notice, advert) if r.random() < 0.5]
        low = [f() for f in (sidebar, comments, advert, form, footer) if r.random() < 0.45]
        r.shuffle(top)
        if kind >= 0.44 and r.random() < 0.3:  # one wrapper around all of the page
            inner, top, low = nest("".join(top) + inner + "".join(low)), [], []
        out = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(1, 6, '')}</title><style>p{{margin:0}}</style><script>var t='<p>';</script></head><body>{''.join(top)}<!-- x -->{inner}{''.join(low)}</body></html>"
        return (out[: r.randint(len(out) // 2, len(out))] if r.random() < 0.05 else out), main

    return [page() for _ in range(n)]


@functools.cache
def model() -> Crf:
    return train(labelled_pages())


def extract(pages: DataFrame, crf: Crf, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_blocks, n_main) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(crf)  # some thousand weights, by the labelled sample
    ddl = f"{key} long, {url} string, text string, n_chars long, n_blocks long, n_main long"
    out = pa_schema(pages.sparkSession, ddl)

    def run(batches):
        m = shared.value
        for b in slices(batches, 100):
            texts, counts, mains = [], [], []
            for p in b.column(2).to_pylist():
                found = blocks(p)
                main = [t for (_, t, _), y in zip(found, m.labels(found)) if y]
                texts.append("\n".join(main))
                counts.append(len(found))
                mains.append(len(main))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, f.type) for x, f in zip((texts, map(len, texts), counts, mains), list(out)[2:]))], schema=out)

    return pages.select(F.col(key).cast("long").alias(key), url, F.coalesce(F.col(page), F.lit("")).alias(page)).mapInArrow(run, ddl)
