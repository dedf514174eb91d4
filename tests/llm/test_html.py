import runpy
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from marigrid.llm import gbt, html


@pytest.fixture(scope="module")
def model():
    return html.train()


def one(model, page):
    return html.texts([page], model)[0]


PAGE = """<!DOCTYPE html><html><head><title>Off</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="ad">Buy now!</div>{main}<footer>&copy; 2024 all rights reserved</footer><script>var x = "</p>";</script></body></html>"""
PROSE = ["A storm, long expected, reached the coast on Monday and stayed for three days.", "Water rose &amp; fell; the harbour&#39;s gauge\n\n kept   counting all the while.", "Nobody was hurt, and the boats were back by Friday, which surprised everyone in town."]
TEXT = "A storm, long expected, reached the coast on Monday and stayed for three days.\nWater rose & fell; the harbour's gauge kept counting all the while.\nNobody was hurt, and the boats were back by Friday, which surprised everyone in town."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<main><div id="content">{}</div></main>'])
def test_layouts(model, wrap):
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    assert one(model, PAGE.format(main=wrap.format(body))) == TEXT
    assert one(model, PAGE.format(main=wrap.format("<p>".join(["", *PROSE])))) == TEXT  # unclosed


def test_junk_inside_and_comments(model):
    junk = '<div class="share"><ul><li><a href=x>Tweet</a></li><li><a href=x>Mail</a></li></ul></div><aside><h3>Related</h3><ul><li><a href=y>Other story</a></li></ul></aside>'
    talk = '<section id="comments"><h3>Comments</h3><div class="comment"><p>I saw the storm too, and it was quite something to behold from the pier.</p></div></section>'
    body = f"<p>{PROSE[0]}</p>{junk}<p>{PROSE[1]}</p><!-- ad --><p>{PROSE[2]}</p>"
    assert one(model, PAGE.format(main=f"<article>{body}</article>{talk}")) == TEXT


def test_held_out_pages(model):
    rng = np.random.default_rng(1234)
    wrong = total = 0
    for _ in range(120):
        p = html.Page(html._generated(rng), labelled=True)
        kept = html.decode(p, model.margin(html.features(p)))
        wrong += sum(len(t) for n, t, _ in p.runs if kept[n] != bool(p.label[n]))
        total += sum(len(t) for _, t, _ in p.runs)
    assert wrong / total < 0.01


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(2)
    for _ in range(50):
        p = html.Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p>")
        margin = rng.standard_normal(len(p.kind)) * 2
        kept = html.decode(p, margin)
        assert all(kept[p.parent[v]] for v in range(1, len(kept)) if kept[v])
        score = lambda k: sum(-np.logaddexp(0, -m if x else m) for m, x in zip(margin[1:], k[1:], strict=True))
        for bits in range(2 ** (len(kept) - 1)):
            k = [True] + [bool(bits >> i & 1) for i in range(len(kept) - 1)]
            if all(k[p.parent[v]] for v in range(1, len(k)) if k[v]):
                assert score(k) <= score(kept) + 1e-9


def test_odd_pages(spark, model):
    odd = [None, "", "plain text only", "<", "<p", "<!-- never closed", "<script>never closed", "<div>" * 3000, "</div></p>", '<p class="unclosed>x</p>', "<p>&#xZZ; &unknown; &nbsp; x</p>", "\x00<p>\x00", "<p>" + "long words " * 100_000 + "</p>"]
    rows = [(i if i else None, None if i == 1 else "u", h, 5) for i, h in enumerate(odd)] + [(2, "u", "plain text only", 5)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text is not None and r.n_chars == len(r.text)
    assert [r.text for r in got if r.page_id is None] == [""]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = gbt.fit(x[:2000], y[:2000])
    assert ((model.margin(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.97


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>If <math><mi>x</mi> = <mn>2</mn></math> holds, it <object data=a.svg>is shown here</object>.</p>", "If x = 2 holds, it is shown here."),
        ("<p>One.</p><video src=a><p>Two.</p><button><p>Three.</p>", "One.\nTwo.\nThree."),
        ("<p>One <button>Go</button>two <select><option>A</select>three.</p>", "One two three."),
        ("<p>One.</p><style>p{}<p>Two.</p>", "One."),
        ('<p title="a > b">One.</p><p title=\'it\'s\'>Two.</p><p 5">Three.</p>', "One.\nTwo.\nThree."),
        ('<p class="open>One.</p><p>Two.</p>', "One.\nTwo."),
        ("<p>1 < 2 and a<b", "1 < 2 and a<b"),
    ],
)
def test_no_text_is_lost_to_markup(page, text):
    assert "\n".join(t for _, t, _ in html.Page(page).runs) == text


@pytest.mark.parametrize("piece", ["<div>", "<div></p>", "<a '", '<a b="', '<a b="c>', "<button>", "<head>", "<p><li></td>", "a" * 20, "<!--", "<", "&", "</div"])
@pytest.mark.parametrize("around", [("", ""), ("<p ", ">"), ('<p "', "='>")])
def test_reading_takes_linear_time(piece, around):
    start = time.process_time()
    html.Page(around[0] + piece * 100_000 + around[1])
    assert time.process_time() - start < 10


#: Written by hand: nothing of them comes from the generator that the trees learn from.
BY_HAND = [
    (
        """<html><body class="single"><div id="top-menu" class="navbar"><a href="/">Home</a> | <a href="/w">World</a> | <a href="/s">Sport</a></div>
<div class="wrapper"><div class="entry-content"><h1>River ferry returns after nine years</h1>
<p>The ferry between the old mill and the market quay ran again on Saturday, nine years after the council withdrew its grant. About 400 people crossed in the first six hours.</p>
<blockquote>We had stopped hoping, said a baker who has worked on the far bank since 1998.</blockquote>
<p>A single fare costs two crowns; children travel free. The boat, built in 1964, was repaired by volunteers.</p></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten bridges to see</a></li><li><a href="/2">Winter timetable</a></li></ul></div></div>
<div class="footer">Printed in the valley. All rights reserved.</div></body></html>""",
        ["River ferry returns after nine years", "The ferry between", "We had stopped hoping", "A single fare costs"],
        ["World", "Most read", "Winter timetable", "All rights reserved"],
    ),
    (
        """<!DOCTYPE html><html lang=en><head><title>Bread</title></head><body><header><a href=/>Kitchen notes</a><nav><ul><li><a href=/soups>Soups</a><li><a href=/cakes>Cakes</a></ul></nav></header>
<main><article><h2>Rye bread in a cold oven</h2><p>Mix 400 g of rye flour with 300 g of warm water, salt and a ladle of sour dough, and leave it overnight under a cloth.
<p>In the morning the dough should have doubled. Turn it into a tin without kneading.<ol><li>Put the tin into the cold oven and heat it to 220 degrees.</li><li>Bake for fifty minutes, then let the loaf rest until evening.</li></ol></article>
<section id=comments class=comments><h3>2 comments</h3><div class=comment><p>Mine came out flat, what did I do wrong?</p></div><div class=comment><p>Try more sour dough.</p></div></section></main>
<aside class=promo><p>Order our cookbook today!</p></aside><footer><p>Kitchen notes, since 2009</p></footer></body></html>""",
        ["Rye bread in a cold oven", "Mix 400 g of rye flour", "In the morning the dough", "Put the tin into", "Bake for fifty minutes"],
        ["Soups", "Mine came out flat", "Try more sour dough", "cookbook", "since 2009"],
    ),
    (
        """<body><div class="cookie-consent"><p>We use cookies to make this site better. <a href=/c>Settings</a></p></div><table><tr><td class="menu"><a href=/a>Archive</a><br><a href=/b>About</a></td>
<td class="main"><h1>Notes on tides</h1><p>Twice a day the water in the bay climbs by four metres, and the mud flats vanish. Sailors keep a table of the hours beside the door.</p>
<p>The highest water does not come at full moon but a day and a half later, because the sea takes time to answer.</p><div class="share-buttons"><a href=t>Tweet</a> <a href=m>Mail</a></div></td></tr></table>
<form class="newsletter"><p>Get our letter</p><input name=mail></form></body>""",
        ["Notes on tides", "Twice a day the water", "The highest water does not come"],
        ["We use cookies", "Archive", "Tweet", "Get our letter"],
    ),
]


@pytest.mark.parametrize(("page", "has", "lacks"), BY_HAND)
def test_pages_written_by_hand(model, page, has, lacks):
    lines = one(model, page).split("\n")
    assert [h for h in has if not any(line.startswith(h) for line in lines)] == []
    assert [x for x in lacks if any(x in line for line in lines)] == []


@pytest.mark.parametrize(("pages", "share"), [("PAGES", 0.02), ("HELD_OUT", 0.05)])
def test_pages_in_layouts_of_the_web(model, pages, share):
    path = Path(__file__).parent / "html_pages.py"
    found = runpy.run_path(str(path))
    lost = alien = total = 0
    for page, blocks in found[pages]:
        got, want = Counter(one(model, page).split()), Counter(" ".join(blocks).split())
        lost, alien, total = lost + sum((want - got).values()), alien + sum((got - want).values()), total + sum(want.values())
    assert lost < share * total
    assert alien < 0.01 * total


def test_tokens_of_names_are_hashed_features():
    plain, named = (html.features(html.Page(f"<div{a}><p>One two three.</p></div>")) for a in ("", ' class="mw-panel"'))
    assert (named[1] != plain[1]).sum() == 2  # one column for each of its tokens
    assert (named[2] == plain[2]).all()
