import itertools
import random

import numpy as np
import pytest

from notewright.llm import html_blocks, html_extraction
from notewright.llm.html_training import Maker


@pytest.fixture(scope="module")
def chain():
    return html_extraction.train_chain()


def test_held_out_pages(chain):
    wrong = total = 0
    for blocks, labels in html_extraction.labelled_pages(200, seed=4242, odd=0):
        wrong += sum(a != b for a, b in zip(chain.decode(html_extraction.block_features(blocks)), labels))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    chain = html_extraction.Chain(rng.normal(size=(html_extraction.FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in range(1, 8):
        features = [list(rng.integers(0, html_extraction.FEATURES, 3)) for _ in range(n)]
        u = chain.scores(features)

        def score(y, u=u, n=n):
            return chain.start[y[0]] + sum(u[i, y[i]] for i in range(n)) + sum(chain.pair[y[i], y[i + 1]] for i in range(n - 1))

        assert score(chain.decode(features)) == pytest.approx(max(score(y) for y in itertools.product((0, 1), repeat=n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-banner"><p>We use cookies on this site.</p></div>
<article><h1>A title &amp; more</h1><p>First   para&shy;graph with <b>bold</b>&nbsp;text,<br>and more of it here.</p><!-- <p>gone</p> --><div class="ad">Buy this thing now.</div>
<p>Second paragraph, which goes on for a while &#233;&#x20ac;.<ul><li>one item of it<li>another item of it</ul></article>
<section id="comments"><h3>Comments</h3><ol><li class="comment"><p>I liked this long article very much, thank you for it.</p></li></ol></section>
<form action="/s"><label>Search</label><input name=q><button>Go</button></form><footer>&copy; 2024 us.</footer></body></html>"""


def test_page(chain):
    want = "A title & more\nFirst para­graph with bold text, and more of it here.\nSecond paragraph, which goes on for a while é€.\none item of it\nanother item of it"
    assert html_extraction.main_text(PAGE, chain) == want


#: Pages written by hand, of kinds that the usual maker doesn't make: short ones, a thread of one message, a site's title
#: in the header, a named notice, a table layout, no article.
HAND = [
    ("<p>Just one paragraph of text, without any page around it.</p>", "Just one paragraph of text, without any page around it."),
    ("<article><p>Text with <b>bold</b> words here.</p></article>", "Text with bold words here."),
    ("<html><body><p>Short note.</p></body></html>", "Short note."),
    ("<html><body><h1>Opening hours</h1><p>We are open from nine to five on all days but Sunday.</p></body></html>", "Opening hours\nWe are open from nine to five on all days but Sunday."),
    ("""<html><body><div class="forum"><h1>How do I boil an egg?</h1><div class="post"><div class="author">anna77</div><div class="message">I put it into water, but for how long should it stay there?</div></div></div></body></html>""",
     "How do I boil an egg?\nI put it into water, but for how long should it stay there?"),
    ("""<html><body><header><h1>The Daily Example</h1><nav><a href="/">Home</a> <a href="/w">World</a></nav></header><article><h2>River rises again</h2><p>After three days of rain the river has left its bed, and two bridges are closed.</p></article><footer>© 2024 Example</footer></body></html>""",
     "River rises again\nAfter three days of rain the river has left its bed, and two bridges are closed."),
    ("""<html><body><main><h1>Cold remedies</h1><p>Rest and drink a lot of water, and see a doctor if fever stays.</p></main><p class="disclaimer notice">This page does not replace the advice of a doctor.</p></body></html>""",
     "Cold remedies\nRest and drink a lot of water, and see a doctor if fever stays."),
    ("""<html><body><table class="layout"><tr><td><a href="/a">Home</a><br><a href="/b">Products</a><br><a href="/c">Contact</a></td><td><h1>Our garden tools</h1><p>We make spades, rakes and shears by hand, as we have done since 1921.</p><p>Each of them is tested before it leaves the house.</p></td></tr></table></body></html>""",
     "Our garden tools\nWe make spades, rakes and shears by hand, as we have done since 1921.\nEach of them is tested before it leaves the house."),
    ("""<html><body><div id="menu"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div><h1>A walk in the hills</h1><p>The path begins behind the church, and climbs slowly.</p><ul><li>Take water with you.</li><li>Wear good shoes.</li></ul></div><div class="footer">Imprint</div></body></html>""",
     "A walk in the hills\nThe path begins behind the church, and climbs slowly.\nTake water with you.\nWear good shoes."),
    ("""<div class="cookie-consent">We use cookies to make this page better for you.</div><p>The museum shows two hundred pictures of the town and its harbour.</p>""",
     "The museum shows two hundred pictures of the town and its harbour."),
]


@pytest.mark.parametrize("html, want", HAND)
def test_pages_written_by_hand(chain, html, want):
    assert html_extraction.main_text(html, chain) == want


@pytest.mark.parametrize("kind", ["short_page", "thread_page", "table_page", "titled_page"])
def test_new_pages_of_each_other_kind(chain, kind):
    maker, wrong, total = Maker(999), 0, 0
    for _ in range(200):
        blocks = html_blocks.leaf_blocks(getattr(maker, kind)())
        labels = [maker.labels.get(b.text, 0) for b in blocks]
        wrong += sum(a != b for a, b in zip(chain.decode(html_extraction.block_features(blocks)), labels))
        total += len(labels)
        maker.labels.clear()
    assert wrong <= 0.03 * total


def texts(html):
    return [b.text for b in html_blocks.leaf_blocks(html)]


def test_raw_elements_end_where_they_end():
    """Lower-casing a letter may lengthen it: places must be sought in the page itself."""
    dots = "İ" * 30
    assert texts(f"<p>{dots}</p><script>var a=1;</SCRIPT ><p>abcdefghijkl after the script</p>") == [dots, "abcdefghijkl after the script"]
    two = f"<p>{dots}</p><script>var a=1;</script><script>var b=2; var evenmore=4;</script><p>rest</p>"
    assert texts(two) == [dots, "rest"]
    assert texts("<p>one <script>x</scripts></script>two</p><style>p</style>three") == ["one two", "three"]
    assert texts("<script>x</ſcript>y</script>z") == ["z"]


def test_formulas_and_media_are_part_of_their_sentence():
    formula = "<math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>E=mc^2</annotation></math>"
    assert texts(f"<p>Energy is {formula} here.</p>") == ["Energy is E=mc2 here."]
    assert texts("<p>See <svg><text>no</text></svg>this <button>Go</button><object>drawing</object> now.</p>") == ["See this drawing now."]
    assert texts("<svg><p>kept, the drawing never ends</p>") == ["kept, the drawing never ends"]


def test_deep_nesting_takes_linear_time():
    deep = "".join(f"<div><b>w{i} </b>" for i in range(30_000)) + "</i></section>" * 30_000
    assert sum(len(t.split()) for t in texts(deep)) == 30_000
    assert texts("<svg>" * 50_000 + "<p>x</p>") == ["x"]


@pytest.mark.parametrize("html", ["", "<", "<p", "a < b", "<!--", "<script>x", "<p title='x>y", "<![CDATA[x]]>", "</p></p>", "<a>" * 500, "\x00<p>\x00"])
def test_malformed_markup_is_read(chain, html):
    assert isinstance(html_extraction.main_text(html, chain), str)


def test_long_and_hostile_pages_take_linear_time():
    rng = random.Random(1)
    junk = "".join(rng.choice("<>\"'= abp/!-") for _ in range(200_000))
    assert html_blocks.leaf_blocks(junk) is not None
    assert len(html_blocks.leaf_blocks("<p>x</p>" * 50_000)) == 50_000


def test_whole_pages_against_article_markup(spark, small, chain):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r for r in html_extraction.extract_pages(pages, chain=chain).collect()}
    for r in pages.collect():
        art = re.sub(r"<br>", " ", re.search(r"<article>(.*)</article>", r["html"], re.S)[1])
        art = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1)>", "\n", art))
        want = "\n".join(x for x in (re.sub(r"\s+", " ", unescape(y)).strip() for y in art.split("\n")) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_edges(spark, chain):
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "", "y")], "page_id long, url string, html string, text string")
    out = html_extraction.extract_pages(df, chain=chain).collect()
    assert [(r["text"], r["n_chars"]) for r in out] == [("", 0)] * 3
    assert html_extraction.extract_pages(df.limit(0), chain=chain).count() == 0
