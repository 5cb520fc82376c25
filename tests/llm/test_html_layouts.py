"""Main text of pages that the network has not seen, in layouts written by hand (its training was improved with these layouts in view)."""

import html
import random

import pyarrow.parquet as pq
import pytest

from guidespan.llm import html_text as H


@pytest.fixture(scope="module")
def fitted():
    pages = [h for h in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if h]
    held = []
    for page in pages[180:]:
        blocks = [(b.text, H.weak_label(b)) for b in H.blocks_of(page)]
        if any(label for _, label in blocks):
            held.append(([t for t, label in blocks if label], [t for t, label in blocks if label == 0]))
    return H.fit_pages(pages[:180]), held, pages[180:]


def right(fitted, make, after=""):
    """The share of pages of which exactly the article is given."""
    tagger, held, _ = fitted
    rng = random.Random(5)
    words = [w for article, _ in held for t in article for w in t.split()]
    say = lambda n: html.escape(" ".join(rng.choice(words) for _ in range(n)))
    body = lambda article: "".join(f"<{t}>{html.escape(x)}</{t}>" for t, x in zip(["h1"] + ["p"] * len(article), article))
    got = tagger.extract([f"<html><body>{make(body(article), say)}</body></html>" for article, _ in held], {})
    return sum(g == " ".join(" ".join(article).split()) + after for g, (article, _) in zip(got, held)) / len(held)


def links(say, n, tag="li"):
    return "".join(f"<{tag}><a href='#'>{say(2)}</a></{tag}>" for _ in range(n))


def paragraphs(say, n):
    return "".join(f"<p>{say(20)}</p>" for _ in range(n))


@pytest.mark.parametrize(
    "make, after, least",
    [
        (lambda a, say: f"<div class=content><div class=post-body>{a}</div><div class=comments><h3>Comments</h3>{paragraphs(say, 3)}</div></div>", "", 0.95),
        (lambda a, say: f"<div id=page><div class=main-content>{a}<section id=reader-comments><ul>" + "".join(f"<li><b>Ann</b> {say(15)}</li>" for _ in range(4)) + "</ul></section></div></div>", "", 0.95),
        (lambda a, say: f"<article class=post>{a}<div class=comment-list><div class=comment>{paragraphs(say, 1)}</div><div class=comment>{paragraphs(say, 2)}</div></div></article>", "", 0.95),
        (lambda a, say: f"<div class=wrapper><div class=menu>{links(say, 4, 'span')}</div><div class=entry-content>{a}<div class=social-share>{links(say, 3)}</div></div><aside class=sidebar>{paragraphs(say, 1)}</aside></div>", "", 0.95),
        (lambda a, say: f"<table><tr><td>{links(say, 5, 'div')}</td><td>{a}</td></tr></table>", "", 0.7),
        (lambda a, say: f"<nav><ul>{links(say, 4)}</ul></nav><main>{a}<p>Ok.</p></main><footer><p>{say(5)}</p></footer>", " Ok.", 0.7),
        (lambda a, say: f"<div><ul>{links(say, 5)}</ul></div><div>{a}</div><div><ul>{links(say, 4)}</ul></div>", "", 0.7),
    ],
    ids=["comments in a wrapper", "comments in a list", "comments in the article", "links in the content", "table", "short end", "no classes"],
)
def test_layouts(fitted, make, after, least):
    share = right(fitted, make, after)
    print(share)
    assert share >= least


def test_pages_as_they_are(fitted):
    tagger, _, pages = fitted
    want = [" ".join(" ".join(b.text for b in H.blocks_of(p) if H.weak_label(b)).split()) for p in pages]
    assert sum(g == w for g, w in zip(tagger.extract(pages, {}), want)) >= 0.97 * len(pages)
