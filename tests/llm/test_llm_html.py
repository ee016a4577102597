import random
import time

import numpy as np
import pytest

from docyard.llm import htmltree as H


def brute_marginals(model, features, parent, leaf):
    """Sum over every labelling of a small tree."""
    n = len(parent)
    score = features @ model.unary
    total, hits = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [(bits >> k) & 1 for k in range(n)]
        w = np.exp(sum(score[k] * y[k] for k in range(n))
                   + sum(model.pair[int(leaf[k]), y[parent[k]], y[k]] for k in range(n) if parent[k] >= 0))
        total += w
        hits += w * np.array(y)
    return hits / total


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(1)
    for _ in range(10):
        n = 9
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        model = H.Model(rng.normal(size=len(H.FEATURES)), rng.normal(size=(H.EDGES, 2, 2)))
        features, leaf = rng.normal(size=(n, len(H.FEATURES))), rng.random(n) < 0.4
        p, joint = H.sweep(model, features, parent, leaf)
        assert np.allclose(p, brute_marginals(model, features, parent, leaf))
        assert np.allclose(joint[1:].sum(axis=1)[:, 1], p[1:]) and np.allclose(joint[1:].sum(axis=2)[:, 1], p[parent[1:]])


def blocks(html):
    t = H.parse(html)
    return [x for x in t.text if x]


def test_parser_blocks():
    assert blocks("<p>a  b\n c<br>d<p>e &amp; f&copy;") == ["a b c d", "e & f©"]
    assert blocks("<ul><li>one<li>two <b>x</b></ul><table><tr><td>1<td>2</table>") == ["one", "two x", "1", "2"]
    assert blocks("<script>var a='<p>no</p>'</script><style>p{}</style><!-- c --><p>yes</p></div></p>") == ["yes"]
    assert blocks("<div>a<div>b</div>c</div>") == ["a", "b", "c"] and blocks("") == [] and blocks(None) == []


def test_head_without_end_tag():
    for start in ("<html><head><title>x</title><body>", "<head><meta charset=utf-8><title>x</title>\n<style>p{}</style>",
                  "<head><head><title>x</title><body>", "<head><noscript><link href=x><p>no</p><body>", "<head><title>x</title><br>"):
        assert blocks(start + "<article><p>one</p></head><p>two</p></article>") == ["one", "two"]
    assert blocks("<head><title>x</title>one<p>two") == ["one", "two"]
    assert blocks("<head><noscript><p>no</p></noscript><title>a <b>b</b></title></head><p>one<head><p>two") == ["one", "two"]


def test_self_closed_svg_and_math():
    for tag in ("<svg/>", "<svg class='i' />", "<math/>", "<svg><svg/><path d='x'/><text>no</text></svg>"):
        assert blocks(f"<div>one {tag}two<p>three</p></div><p>four</p>") == ["one two", "three", "four"]
        assert blocks(f"<head><title>x</title>{tag}<p>one</p>") == ["one"]


def test_what_has_no_end_runs_to_the_end_of_the_page():
    for tail in ("<!-- never closed <p>tail", "<div class='x' <p>tail", "<!doctype x <p", "<?php <p", "</div <p"):
        assert blocks(f"<p>one</p><!-- c --><p>two</p>{tail}")[:2] == ["one", "two"]
    assert blocks("<p>one<!-- never closed <p>tail") == ["one"] and blocks("<p>one<!-- a --><p>two<!-- b <p>x") == ["one", "two"]
    assert blocks("<p>1 < 2 & 3 <b>x") == ["1 < 2 & 3 x"]


def test_a_page_labels_nothing_by_attributes():
    assert set(H.parse("<div data-label='1'><p data-label=0>x</p></div>").label) == {-1}
    assert set(H.parse("<div data-label='1'><p data-label=0>x</p></div>", True).label) == {-1, 0, 1}


def test_names_are_whole_tokens():
    name = lambda **a: H.name_of(a)
    for state in ("no-sidebar", "has-header", "widget-area-off", "logged-out cookies-not-set", "comments-open", "isNav", "x"):
        assert name(**{"class": state}) == 0, state
    assert name(**{"class": "sidebar"}) == H.BAD | H.WHOLLY_BAD and name(id="side sidebar-left") == H.BAD
    assert name(**{"class": "commentList"}) == H.BAD | H.WHOLLY_BAD and name(role="navigation") == H.BAD | H.WHOLLY_BAD
    assert name(itemprop="articleBody") == H.GOOD and name(**{"class": "post more-info"}) == H.BAD | H.GOOD


def test_deep_pages_are_linear():
    t0 = time.time()
    H.parse("<p><object>" + "<div>" * 50_000)
    H.parse("<table>" + "<li>" * 30_000 + "<td>" * 30_000)
    assert time.time() - t0 < 2


def test_parsing_is_linear():
    t0 = time.time()
    for html in ("<div>" * 50_000 + "x", "<li>x" * 50_000, "<b>x</i>" * 50_000, "<p><span>" * 30_000, "<td>x" * 50_000):
        H.parse(html)
    assert time.time() - t0 < 12


FILL = ["Some prose of a paragraph, with a clause and an end.", "More of it comes here. It goes on for a while, and then ends.",
        "A third one, much like the others, but it says something else at its end."]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    pages = ["<nav><ul><li><a href=x>Home</a></ul></nav><div class=ad>Buy now.</div><article><h1>T</h1>"
             + "".join(f"<p>{t}</p>" for t in rng.sample(FILL, 2)) + "</article><footer>(c) me</footer>" for _ in range(60)]
    return H.train(H.labelled_pages(pages))


def test_held_out_accuracy_on_other_layouts(model):
    rng, right, n = random.Random(77), 0, 0
    for _ in range(200):
        tree = H.parse(H.redress(rng.choices(FILL, k=4), ["Home", "Read also: this and that.", "Sign up"], rng), True)
        truth = H._spread_labels(tree)
        p, _ = H.sweep(model, *H.flatten([tree]))
        for k, text in enumerate(tree.text):
            if text:
                n += 1
                right += (p[k] > 0.5) == truth[k]
    assert right / n > 0.97


def test_main_text_leaves_everything_else_out(model):
    page = (f"<header><h1>Site</h1></header><aside><p>{FILL[0]}</p></aside><div class='cookie-notice'>We use cookies.</div>"
            f"<article><h1>Title</h1><p>{FILL[1]} &lt;b&gt;</p><form><p>Subscribe</p></form><p>{FILL[2]}</p></article>"
            f"<section id='comments'><p>{FILL[0]}</p></section><footer>end</footer>")
    assert H.extract_batch(model, [page]) == [f"Title\n\n{FILL[1]} <b>\n\n{FILL[2]}"]


CLASSES = ("single-post no-sidebar", "has-header", "page with-nav", "widget-area-off", "logged-out cookies-not-set", "comments-open",
           "story-more", "post more-info", "article-tags-x", "layout sidebar-left")


@pytest.mark.parametrize("cls", CLASSES)
def test_ordinary_class_names_lose_no_article(model, cls):
    """On the body, on a wrapper and on the article, with and without an ``article`` element."""
    ps = "".join(f"<p>{t}</p>" for t in FILL)
    rest = ("<nav><ul><li><a href=x>Home</a></li></ul></nav>", "<footer>(c) me</footer>")
    pages = [f"<body class='{cls}'><div>{ps}</div></body>", f"<body><div class='{cls}'>{ps}</div></body>",
             f"<body class='{cls}'><article>{ps}</article></body>", f"<body><article class='{cls}'>{ps}</article></body>",
             f"<body class='{cls}'>{rest[0]}<div class='{cls}'><article>{ps}</article></div>{rest[1]}</body>",
             f"<body>{rest[0]}<form class='{cls}'><article class='{cls}'>{ps}</article></form>{rest[1]}</body>"]
    assert H.extract_batch(model, pages) == ["\n\n".join(FILL)] * len(pages)


def test_whole_pages(model):
    """Hand-made pages with their full expected texts."""
    ps, want = "".join(f"<p>{t}</p>" for t in FILL), "\n\n".join(FILL)
    remark = "I like it a lot, thank you. It was a good read."
    pages = {
        f"<article>{ps}</article><ol><li>{remark}</li><li><p>{remark}</p></li></ol>": want,
        f"<article>{ps}</article><section class='comments'><ol>{f'<li><p>{remark}</p></li>' * 9}</ol></section>": want,
        f"<article>{ps}</article><div class='comment-list'>{f'<div><p>{FILL[0]}</p></div>' * 9}</div>": want,
        f"<article>{ps}</article><div data-label='1'><nav><ul><li><a href=x>Home</a></li></ul></nav></div>": want,
        f"<main><h1>Title</h1>{ps}<aside><p>Buy now.</p></aside></main><!-- never closed <p>tail": f"Title\n\n{want}",
        f"<header><p>Site</p></header><article><blockquote><p>{FILL[1]}</p></blockquote><ul><li>{FILL[0]}</ul></article>":
            f"{FILL[1]}\n\n{FILL[0]}",
        f"<nav><ul><li><a href=x>Home</a></li></ul></nav><footer>(c) me</footer>": "",
    }
    assert H.extract_batch(model, list(pages)) == list(pages.values())


def test_pages_table(spark, model):
    page = f"<nav>menu</nav><article><p>{FILL[0]}</p><p>é 😀</p></article>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<nav><a>x</a></nav>"), (4, "x", page * 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'extra' as text", "'extra' as n_chars")
    out = H.extract_pages(df, model).collect()
    want = f"{FILL[0]}\n\né 😀"
    assert len(out) == 6 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"] for r in out if r["page_id"] == 1] == [want, want]
    assert {r["text"] for r in out if r["page_id"] in (2, 3, None)} == {""}
    assert next(r["text"] for r in out if r["page_id"] == 4) == "\n\n".join([want] * 400)
    none = df.limit(0)
    assert H.extract_pages(none, H.fit_pages(none)).count() == 0


def test_training_sample_is_bounded_by_ids(spark, monkeypatch):
    monkeypatch.setattr(H, "train", lambda trees: None)
    taken = []
    monkeypatch.setattr(H, "labelled_pages", taken.extend)
    rows = [(None, f"<p>{k}") for k in range(50)] + [(1, f"<p>one {k}") for k in range(50)] + [(2, "<p>two"), (3, None)]
    H.fit_pages(spark.createDataFrame(rows, "page_id long, html string"))
    assert taken == ["<p>one 0", "<p>two"]
