"""Paths against a plain parser, the weight of the scores, long pages, awkward rows."""

import random
import time
from html.parser import HTMLParser

import numpy as np

from corpusloom.llm import html_extract

from .conftest import prose

BLOCKS = ("html", "body", "div", "article", "section", "p", "h1", "ul", "li", "nav", "footer")


class Plain(HTMLParser):
    """Texts of a well-formed page with their paths of block elements."""

    def __init__(self):
        super().__init__()
        self.open, self.found, self.links = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.links += 1
        else:
            self.open.append(".".join([tag, *(v for k, v in attrs if k == "class")]))

    def handle_endtag(self, tag):
        if tag == "a":
            self.links -= 1
        else:
            self.open.pop()

    def handle_data(self, data):
        if data.strip():
            self.found.append(("/".join(self.open), data.strip(), bool(self.links)))


def page(rng):
    say = lambda n: f"{prose(rng, n)}, {prose(rng, 3)}."
    items = "".join(f"<li><a>{prose(rng, 2)}</a></li>" for _ in range(4))
    article = "".join(f"<p>{say(rng.choice([2, 30, 80]))}</p>" for _ in range(rng.randint(2, 9)))
    comments = "".join(f"<p>{say(60)}</p>" for _ in range(3))
    content = f"<h1>{prose(rng, 5)}</h1>{article}"
    return f'<html><body><nav><ul>{items}</ul></nav><div class="ad">{say(6)}</div><div class="x">{content}<div class="comments">{comments}</div></div><footer>{say(5)}</footer></body></html>', content


def test_ratios_are_those_of_the_paths():
    rng = random.Random(41)
    for _ in range(20):
        source, _ = page(rng)
        got, want = html_extract.Page(source), Plain()
        want.feed(source)
        assert got.text == [t for _, t, _ in want.found]
        marks = lambda t: sum(c in ".,;:!?" for c in t)
        ratios = html_extract.path_ratios([got.path[e] for e in got.element], [len(t) for t in got.text], [marks(t) for t in got.text], got.linked)
        for b, (path, _, _) in enumerate(want.found):
            same = [(t, a) for p, t, a in want.found if p == path]
            assert np.isclose(ratios[0][b], sum(len(t) for t, _ in same) / len(same))
            assert np.isclose(ratios[1][b], sum(marks(t) for t, _ in same) / len(same))
            assert np.isclose(ratios[2][b], 1 - sum(len(t) for t, a in same if a) / sum(len(t) for t, _ in same))


def test_scores_decide(monkeypatch):
    rng = random.Random(42)
    pages = [page(rng) for _ in range(40)]
    want = ["\n".join(t for _, t, _ in parsed(c)) for _, c in pages]
    assert [html_extract.main_text(p) for p, _ in pages] == want
    monkeypatch.setattr(html_extract, "path_scores", lambda p: np.ones(len(p.text)))
    assert sum(html_extract.main_text(p) != w for (p, _), w in zip(pages, want, strict=True)) == 40


def test_names_do_not_drop_text_of_an_article():
    rng = random.Random(43)
    say = lambda n: f"{prose(rng, n)}, {prose(rng, 3)}. {prose(rng, 4).capitalize()}, {prose(rng, 2)}."
    for name in ("alert", "notice", "share", "search", "copyright", "related-work", "comments-on-the-law", "legal", "side"):
        texts = [say(40), say(25), say(30)]
        source = f'<body><nav><a>one</a><a>two</a></nav><article><h1>Head</h1><p>{texts[0]}</p><div class="{name}"><p>{texts[1]}</p></div><p>{texts[2]}</p></article><footer>All rights, reserved.</footer></body>'
        assert html_extract.main_text(source).split("\n") == ["Head", *texts], name


def test_names_of_adverts_and_comments_drop_them():
    rng = random.Random(44)
    say = lambda n: f"{prose(rng, n)}, {prose(rng, 3)}."
    for name in ("ad", "ad-slot-3", "sponsored box", "comments", "comment-list", "cookie-consent", "newsletter-signup", "post-comments"):
        texts = [say(40), say(25)]
        inner = f'<body><article><h1>Head</h1><p>{texts[0]}</p><div class="{name}"><p>{say(20)}</p></div><p>{texts[1]}</p></article></body>'
        assert html_extract.main_text(inner).split("\n") == ["Head", *texts], name
    for name in ("notice", "related-posts", "share-buttons", "alert bar"):
        outer = f'<body><div class="{name}"><p>{say(20)}</p></div><article><h1>Head</h1><p>{texts[0]}</p></article></body>'
        assert html_extract.main_text(outer).split("\n") == ["Head", texts[0]], name


def test_links_inside_an_article_fall_by_their_ratios():
    rng = random.Random(45)
    texts = [f"{prose(rng, n)}, {prose(rng, 3)}." for n in (50, 40)]
    links = "".join(f'<a href="#">{prose(rng, 3)}</a> ' for _ in range(5))
    source = f'<article><h1>Head</h1><p>{texts[0]}</p><div class="share">{links}</div><p>{texts[1]}</p></article>'
    assert html_extract.main_text(source).split("\n") == ["Head", *texts]


def parsed(source):
    p = Plain()
    p.feed(source)
    return p.found


def test_long_pages_take_linear_time():
    began = time.time()
    assert html_extract.main_text("<div>" * 100_000 + "deep, and long.") == "deep, and long."
    assert len(html_extract.main_text("<div>word, word." * 50_000).split("\n")) == 50_000
    assert html_extract.main_text("<p>" + "A word, and more. " * 100_000).count("word") == 100_000
    assert html_extract.main_text("<i><div>" + "<b>" * 50_000 + "text, it is." + "</i>" * 50_000) == "text, it is."
    assert time.time() - began < 20


def test_awkward_pages(spark):
    good = "<article><h1>Head</h1><p>One, two. Three, four.</p></article>"
    rows = [(1, "u", good, "t", 3, "h"), (1, "u", good, "t", 3, "h"), (None, None, good, None, None, None), (2, None, None, "t", 0, ""), (3, "u", "", "t", 0, "")]
    got = html_extract.query(spark.createDataFrame(rows, "page_id int, url string, html string, text string, n_chars int, path string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = "Head\nOne, two. Three, four."
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got.collect()) == [(0, "", text, len(text)), (1, "u", text, len(text)), (1, "u", text, len(text)), (2, "", "", 0), (3, "u", "", 0)]
