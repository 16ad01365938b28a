"""Wrapper induction on hosts with copies and with ids of their own."""

import json
import random

import pytest

from tidegate.llm import html_text

LAYOUT = "<html><body><nav>Menu</nav><div class='box'>Same box</div>{}<footer>Foot</footer></body></html>"


def extracted(spark, pages):
    rows = [(i, f"http://host.example/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}


def test_copies_of_a_page_are_no_template(spark):
    for around in ("<article>{}</article>", "<div class='content'>{}</div>"):
        pages = [LAYOUT.format(around.format(f"<h1>Title {i}</h1><p>Text of page {i}</p>")) for i in range(30)]
        copy = around.format("<h1>Copied</h1><p>Copied text</p><ul><li>first<li>second</ul><blockquote>Words</blockquote>")
        pages += [LAYOUT.format(copy)] * 12
        # Copies with a box of their own are different pages, but few of the host's.
        pages += [LAYOUT.format(copy.replace("Copied text", f"Copied text {i}")) for i in range(12)]
        out = extracted(spark, pages)
        for i in range(30):
            assert out[i] == f"Title {i}\nText of page {i}"
        for i in range(30, 42):
            assert out[i] == "Copied\nCopied text\nfirst\nsecond\nWords"
            assert out[i + 12] == f"Copied\nCopied text {i - 30}\nfirst\nsecond\nWords"


def test_pages_with_ids_of_their_own(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    for tag in ("article", "div"):
        pages = []
        for i, w in enumerate(words):
            text = f"<p>Text {w} {'long ' * i}</p>"
            inner = f"<h1 id='{w}'>Title {w}</h1><div class='note'>Follow us</div>" + (f"<section id='about-{w}'>{text}</section>" if tag == "article" else text)
            pages.append(f"<html><body class='post-{i} {w}'><div id='left'><p>Box</p></div><{tag} id='post-{i}' class='post-{i} {'about-' + w if tag == 'article' else 'text'}'>{inner}</{tag}></body></html>")
        out = extracted(spark, pages)
        assert out == {i: f"Title {w}\nText {w} {'long ' * i}".strip() for i, w in enumerate(words)}


def test_template_does_not_grow_with_ids():
    def size(node):
        return 1 + sum(map(size, node.kids))

    def page(i):
        own = "".join(chr(97 + int(c)) for c in str(i))
        return html_text.parse(f"<body id=b{i} class=single-{own}><div id='{own}' class='box box-{i}'><h2 id='{own}'>A {i}</h2><p>b {i}</div><article id=post-{i} class='post tag-{own}'><p id={own}>c {i}</article></body>")[0]

    template = page(0)
    for i in range(1, 200):
        html_text.merged(template, page(i))
    assert size(template) == size(page(0))


def test_ids_keep_siblings_apart(spark):
    pages = [f"<body>{'<div id=left><p>Same news</p></div>' * (i % 3 > 0)}<div id=content><p>Text of page {i}</p></div></body>" for i in range(12)]
    assert extracted(spark, pages) == {i: f"Text of page {i}" for i in range(12)}


def lines(i, n=3):
    rng = random.Random(i)
    return [f"page {i} line {k} " + " ".join(rng.choices("abcdefghij", k=12)) for k in range(n)]


BOILER = ["We are a shop of fine things since long ago and tell so at great length on every page", "Our many partners are named here one after the other for the readers of all of our pages"]


def plain_page(i):
    """No article, no names: what is the text, only other pages tell."""
    top = "".join(f"<p>{t}</p>" for t in BOILER * 3)
    return f"<html><body><div><section>{top}</section></div><div><h1>Title of {i}</h1>{''.join(f'<p>{t}</p>' for t in lines(i))}<div>Read this and all the rest</div></div><div><blockquote>{BOILER[0]}</blockquote></div></body></html>"


def test_alignment_finds_what_names_and_mass_can_t(spark):
    want = {i: "\n".join([f"Title of {i}", *lines(i)]) for i in range(9)}
    assert extracted(spark, [plain_page(i) for i in range(9)]) == want
    alone = [html_text.main_text(plain_page(i), None) for i in range(9)]
    assert all(alone[i] != want[i] and BOILER[0] in alone[i] for i in range(9))


def test_constant_places_by_brute_force(spark):
    """Pages of one layout: a place with one text on all pages goes, any other stays."""
    rng = random.Random(3)
    pages, want = [], {}
    common = {k: rng.random() < 0.4 for k in range(12)}
    for i in range(8):
        texts = [f"always {k}" if common[k] else f"text {k} of {i} {'more ' * rng.randint(3, 9)}".strip() for k in range(12)]
        pages.append("<body><div>" + "".join(f"<div class='c{chr(97 + k)}'><p>{t}</p></div>" for k, t in enumerate(texts)) + "</div></body>")
        want[i] = "\n".join(t for k, t in enumerate(texts) if not common[k])
    assert extracted(spark, pages) == want


def test_names_are_not_believed_over_mass(spark):
    for name in ("social-history", "sidebar", "share-box"):
        pages = [f"<body><h1>Title {i}</h1><section class='{name}'>{''.join(f'<p>{t}</p>' for t in lines(i, 9))}</section><div>Same</div></body>" for i in range(6)]
        out = extracted(spark, pages)
        assert all(set(lines(i, 9)) <= set(out[i].split("\n")) for i in range(6)), name
    # A part of the text keeps its place if its name only begins like a box's; a real box and comments go.
    pages = [f"<body><article><h1>Title {i}</h1><p>{' '.join(lines(i, 4))}</p><section class='social-history'><p>Past of {i}</p></section><div class='share-buttons'>Share {i}</div><div id='comments'>{''.join(f'<p>{t}</p>' for t in lines(90 + i, 30))}</div></article></body>" for i in range(6)]
    assert extracted(spark, pages) == {i: f"Title {i}\n{' '.join(lines(i, 4))}\nPast of {i}" for i in range(6)}


@pytest.mark.parametrize("fan", [512, 3])
def test_templates_are_functions_of_the_table(spark, monkeypatch, fan):
    monkeypatch.setattr(html_text, "FAN", fan)
    pages = [plain_page(i) if i % 4 else plain_page(i).replace("<blockquote>", "<p>own box</p><blockquote>") for i in range(24)]
    rows = [(f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    found = set()
    for seed, parts in ((0, 1), (1, 4), (2, 7)):
        random.Random(seed).shuffle(rows)
        found.add(tuple(tuple(r) for r in html_text.templates(spark.createDataFrame(rows, "url string, html string").repartition(parts)).collect()))
    assert len(found) == 1 and len(next(iter(found))) == 1
    assert json.loads(next(iter(found))[0][1])[1] == 24
