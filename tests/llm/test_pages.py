"""Extraction from pages as themes make them, with gold text."""

import re
from collections import Counter

import pytest

from pellucid.llm import html_mincut

TEXT = [
    "The river rose in the night, and by morning the lower fields were under water, as the old people had said.",
    "Nobody was surprised. They had carried the seed corn up to the loft a week before, sack by sack.",
    "What the water left behind was a fine grey mud, which the children drew pictures in until it dried and cracked.",
    "By the end of the month the first green showed, thin and pale, along the ditch that had broken.",
]
PROSE = "".join(f"<p>{t}</p>" for t in TEXT)
GOLD = " ".join(TEXT)
NAV = "<nav><ul><li><a href=/>Home</a><ul><li><a href=/a>Rivers</a></li><li><a href=/b>Fields</a></li></ul></li><li><a href=/c>About us</a></li></ul></nav>"
SIDE = "<div class=sidebar><h3>More to read</h3><p>Our newsletter brings the best stories of the valley to you, each week, for nothing.</p><ul><li><a href=/1>Ten old mills</a></li></ul></div>"
FOOT = "<footer><p>Copyright of the valley press, all rights are reserved, and nothing may be copied without leave.</p></footer>"
COOKIE = '<div class="cookie-consent"><p>We use cookies so that the site works as it should, and to count our visitors.</p><button>Accept</button></div>'
SAID = ["I remember that year well, my father lost two cows.", "Good piece, but the mill was on the other bank, surely?", "Thank you all, I have put the date right now.", "We had the same in the next valley, only later."]


def comments(tag, shape, extra):
    return f"<{tag}>" + "".join(f"<{extra} class={shape}><span>Reader {k}</span><div>{k} days ago</div><p>{t}</p><a href=#r>Reply</a></{extra}>" for k, t in enumerate(SAID)) + f"</{tag}>"


#: name: (page, the text that is wanted)
PAGES = {
    "plain": (f"<body>{NAV}<div>{PROSE}</div>{FOOT}", GOLD),
    "layout-with-sidebar": (f"<body>{NAV}<div id=content class='layout-with-sidebar'>{PROSE}</div>", GOLD),
    "article has-sidebar": (f"<body>{NAV}<article class='post has-sidebar'>{PROSE}</article>{FOOT}", GOLD),
    "article category-social": (f"<article class='category-social'>{PROSE}</article>", GOLD),
    "related-work": (f"<section id=related-work>{PROSE}</section>", GOLD),
    "search-theory": (f"<main><div class='search-theory'>{PROSE}</div></main>", GOLD),
    "no-banner wrap": (f"<div class='no-banner wrap'>{PROSE}</div>", GOLD),
    "wrapper with its sidebar": (f"<body>{COOKIE}<div class='content-sidebar-wrap'>{NAV}<div class=inner>{PROSE}</div>{SIDE}</div>{FOOT}", GOLD),
    "two wrappers": (f"<div class='page has-header'><div class='widget-area-wrap'><div>{PROSE}</div>{SIDE}</div></div>", GOLD),
    "page in a form": (f"<body><form id=aspnetForm action=/>{NAV}<div id=main>{PROSE}</div>{FOOT}</form>", GOLD),
    "form and wrapper": (f"<body><form id=f><div class='master-header-fixed'>{NAV}<div>{PROSE}</div>{SIDE}</div></form>", GOLD),
    "article in a form": (f"<form><article>{PROSE}</article>{SIDE}</form>", GOLD),
    "header outside": (f"<header><h1>The Valley Press</h1><p>News of the valley since the year of the great flood, every day.</p></header><div class='toolbar-padding'>{PROSE}</div>", GOLD),
    "main is styled": (f"<main class='with-comments no-share'>{PROSE}</main>{comments('section id=comments', 'c', 'div')}", GOLD),
    "role main": (f"<div role=main class='sidebar-left'>{PROSE}</div>{SIDE}", GOLD),
    "short page": ("<div>Short page</div>", "Short page"),
    "short page with a menu": (f"{NAV}<div>Nothing here yet</div>{FOOT}", "Nothing here yet"),
    "one paragraph": ("<p>Gone fishing.", "Gone fishing."),
    "unnamed comments in divs": (f"<body><div>{PROSE}</div>{comments('div', 'x1', 'div')}", GOLD),
    "unnamed comments in a list": (f"<body><div>{PROSE}</div>{comments('ol', 'x1', 'li')}", GOLD),
    "unnamed comments beside article": (f"<body>{NAV}<article>{PROSE}</article>{comments('section', 'q', 'div')}{FOOT}", GOLD),
    "unnamed comments in a wrapper": (f"<div class='wrap sidebar-right'><div>{PROSE}</div>{comments('div', 'b', 'article')}{SIDE}</div>", GOLD),
    "named comments, more than text": (f"<article>{PROSE}</article><div id=comments>{comments('div', 'k', 'div') * 5}</div>", GOLD),
    "named comments inside article": (f"<article>{PROSE}<section class=comment-list>{comments('div', 'k', 'div')}</section></article>", GOLD),
    "nested menus": (f"<div class=menu>{NAV}{NAV}<ul><li><a href=/x>Deep</a><ul><li><a href=/y>Deeper</a></li></ul></li></ul></div><div>{PROSE}</div>", GOLD),
    "advert between": (f"<article><p>{TEXT[0]}</p><div class=ad>Buy the new waders, now at half the price, while we have them.</div><p>{' '.join(TEXT[1:])}</p></article>", GOLD),
    "advert between, wrapper named": (f"<div class='ads-enabled'><p>{TEXT[0]}</p><div class=ad>Buy the new waders, now at half the price, while we have them.</div><p>{' '.join(TEXT[1:])}</p></div>", GOLD),
    "sections with headings": ("<article>" + "".join(f"<section class=s><h2>Part {k}</h2><p>{t}</p></section>" for k, t in enumerate(TEXT)) + "</article>", " ".join(f"Part {k} {t}" for k, t in enumerate(TEXT))),
    "hidden": (f"<div>{PROSE}</div><div style='display:none'>{PROSE}</div><p hidden>{TEXT[0]}</p>", GOLD),
    "notice first": (f"<div role=alert><p>We are closed on Monday, and the shop opens again on the day after that.</p></div><div>{PROSE}</div>", GOLD),
    "table layout": (f"<table><tr><td class=nav><a href=/>Home</a></td><td>{PROSE}</td></tr></table>", GOLD),
    "quote": (f"<article>{PROSE}<blockquote>It was the water that made us, she said, and it may have us back.</blockquote></article>", GOLD + " It was the water that made us, she said, and it may have us back."),
    "only menus": (NAV + FOOT, ""),
}


def shared(a, b):
    return sum((Counter(a.split()) & Counter(b.split())).values())


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, gold = PAGES[name]
    got = html_mincut.main_text(page)
    assert not gold or got
    assert shared(got, gold) >= 0.95 * len(gold.split()) and shared(got, gold) >= 0.95 * len(got.split()), got


def test_precision_and_recall_of_words():
    """The figures that the README gives."""
    got = [(html_mincut.main_text(page), gold) for page, gold in PAGES.values()]
    both = sum(shared(a, b) for a, b in got)
    assert both / sum(len(a.split()) for a, _ in got) >= 0.98 and both / sum(len(b.split()) for _, b in got) >= 0.98


def test_no_article_of_prose_is_lost():
    """Whatever an article or its wrappers are called."""
    for name in sorted(html_mincut._BOILER_NAMES):
        for page in (f"<article class='{name}'>{PROSE}</article>{FOOT}", f"<div class='x {name}'><article>{PROSE}</article>{NAV}</div>", f"<div id='{name}'><div class='y-{name}'><article>{PROSE}</article></div></div>"):
            assert html_mincut.main_text(page) == GOLD, page


def test_labels_against_all_labellings():
    """The whole labelling costs no more than any other: terminal costs and smoothness edges as they're defined."""
    import math

    page = f"<div class=sidebar><p>{TEXT[0]}</p></div><div><h2>Head</h2><p>{TEXT[1]}</p><ul><li><a href=/>Home</a></li><li>Item</li></ul><p>{TEXT[2]}</p></div><p>End</p>"
    blocks = html_mincut.blocks_of(page)
    got = html_mincut.labels(blocks)
    assert 5 <= len(blocks) <= 10
    scale = html_mincut._SCALE
    soft = lambda x: round(scale * math.log1p(math.exp(x)))
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, round(scale * html_mincut.ADJACENT / (1 + html_mincut._steps_apart(blocks[i - 1].parent, b.parent)))))
        above = id(b.parent.parent or b.parent)
        if above in last and last[above] != i - 1:
            edges.append((last[above], i, round(scale * html_mincut.SIBLING)))
        last[above] = i

    def cost(side):
        return sum(soft(-b.log_odds) if s else soft(b.log_odds) for b, s in zip(blocks, side, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])

    assert cost(got) == min(cost([k >> i & 1 > 0 for i in range(len(blocks))]) for k in range(2 ** len(blocks)))
    assert re.search(r"\bNobody\b", html_mincut.main_text(page))
