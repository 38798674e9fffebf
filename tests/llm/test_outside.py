"""Operators 2 and 7 on pages and words that no generator of theirs drew."""

from __future__ import annotations

import random
import string

import pytest

from srcquarry.llm import html_extract, secrets

TEXT = [
    "The river rose overnight and the lower fields were under water by morning.",
    "Farmers moved their animals to higher ground, helped by neighbours.",
    "By noon the rain had stopped and people began to clear the roads.",
]
PARAS = "".join(f"<p>{x}</p>" for x in TEXT)
NAV = '<nav><a href="/">Home</a> <a href="/news">News</a></nav>'
FOOT = "<footer>© 2024 The Gazette. All rights reserved.</footer>"
#: (page, blocks that are no article); the article is TEXT, sometimes with its heading.
LAYOUTS = {
    "bare body": f"<body>{NAV}{PARAS}{FOOT}</body>",
    "section": f"<section>{PARAS}</section>",
    "div": f"<div>{PARAS}</div>",
    "grid": f'<div class="wrapper"><div class="row"><div class="col-8">{PARAS}</div></div></div>',
    "text alone": " ".join(TEXT),
    "table": f"<table><tr><td><a href=a>Home</a><br><a href=b>Contact</a></td><td>{PARAS}</td></tr></table>",
    "heading": f'<body><div><a href="/">Gazette</a></div><h1>Flood in the valley</h1>{PARAS}<div class="footer">© 2024 Gazette</div></body>',
    "line breaks": "<body>" + "<br><br>".join(TEXT) + "</body>",
    "center": f"<center><font size=2>{PARAS}</font></center>",
    "container": f'<div id="container"><header><h1>The Gazette</h1></header><ul class="menu"><li><a href=a>Sport</a></li><li><a href=b>Weather</a></li></ul><div>{PARAS}</div><div id="sidebar"><h3>Popular</h3><ul><li><a href=c>Ten tips for spring</a></li></ul></div>{FOOT}</div>',
    "unknown names": f'<div class="xk-9"><div class="q7"><h2>Flood in the valley</h2>{PARAS}</div></div>',
    "list": "<body><ul>" + "".join(f"<li>{x}</li>" for x in TEXT) + "</ul></body>",
    "role": f'<div role="banner"><p>The Gazette</p></div><div role="main">{PARAS}</div><div role="contentinfo"><p>© 2024</p></div>',
    "deep": "<div>" * 12 + PARAS + "</div>" * 12,
    "article": f"<body>{NAV}<article><h1>Flood in the valley</h1>{PARAS}</article><aside><h3>Related</h3><p>Storms to come</p></aside>{FOOT}</body>",
    "cookies": f'<div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><div class="post">{PARAS}</div>',
}


def test_plain_layouts():
    crf = html_extract.model()
    own = {"The river", "Farmers moved", "By noon", "Flood in"}
    kept = lost = wrong = others = 0
    for page in LAYOUTS.values():
        found = html_extract.blocks(page)
        for (_, text, _), y in zip(found, crf.labels(found)):
            if any(text.startswith(x) for x in own):
                kept, lost = kept + y, lost + (not y)
            else:
                others, wrong = others + 1, wrong + y
    assert kept / (kept + lost) >= 0.95 and wrong <= 0.05 * others, (kept, lost, wrong, others)


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_no_layout_loses_the_article(name):
    got = html_extract.model().text(LAYOUTS[name])
    assert all(x in got for x in TEXT)


ORDINARY = [
    "a" * 20, "x" * 40, "z" * 20, "Aa" * 12, "qwertyuiopasdfghjkl", string.ascii_lowercase, "ISBN978-3-16-148410-0", "550e8400-e29b-41d4-a716-446655440000", "loooooooooooooooooooong",
    "QWERTYUIOPASDFGHJKLZXCVBNM", string.ascii_lowercase[::-1], "www.example.com/some/path/index.html", "org.apache.spark.sql.catalyst", "NM_001234567890123", "GSE1234567890123456",
    "donaudampfschifffahrtsgesellschaft", "supercalifragilisticexpialidocious", "getUserNameFromRequest", "test_that_nothing_breaks_here", "2024-01-02T03-04-05.678", "anticonstitutionnellement",
    "application/vnd.openxmlformats-officedocument", "aaaabbbbccccddddeeee", "HELLO_WORLD_CONSTANT_NAME", "README.contributing.markdown", "internationalization-and-localization", "1234567890.1234567890",
]


def test_ordinary_words_are_no_secrets():
    s = secrets.scanner()
    assert [w for w in ORDINARY if s.spans(f"see {w} there.")] == []


def test_dotted_keys_are_found():
    s, r = secrets.scanner(), random.Random(21)
    letters = string.ascii_letters + string.digits
    keys = ["".join(r.choices(letters + ".", k=40)) for _ in range(400)] + [".".join("".join(r.choices(letters + "_-", k=k)) for k in (20, 30, 27)) for _ in range(100)]
    assert sum(any(k == 3 for _, k, _ in s.spans(f"key {w}. End")) for w in keys) >= 0.95 * len(keys)
    (start, kind, end), = s.spans("key ..Zq8fKd02LmXw7Rt1Yb5N... End")
    assert (kind, start, end) == (3, 6, 26)
