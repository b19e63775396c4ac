import random
from collections import Counter

import pytest

from lodestar.llm.html_text import extract, learn, main_text, observe, weigh

ARTICLE = "<html><head><title>T &amp; t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- c --><div class=\"ad\">Buy now and here.</div><article><h1>Head &amp; more</h1><p><b>First  para\n of it.<br><p>Second, with <a href=y>link text</a>.</p><div class='ad'>Advert</div><p>End.</p><section id=comments><p>I like it.</p></section></article><footer>&copy; us</footer></body></html>"
DIVS = "<body><header>Site name here</header><div id='sidebar'><p>About us and much more of this text that is long enough to win.</p></div><div class=content><p>One two three four five six.</p><p>Seven eight nine.</p><form>Name <input> send</form><p>Ten.</p></div><div class='cookie-notice'>We use cookies</div></body>"


@pytest.fixture(scope="module")
def weights():
    c = Counter()
    for _ in range(20):
        observe(ARTICLE, c)
    return weigh(c)


def test_pages(weights):
    want = "Head & more\nFirst para of it.\nSecond, with link text.\nEnd."
    for w in ({}, weights):
        assert extract(ARTICLE, w) == want
        assert extract(ARTICLE.replace("</body></html>", "").replace("<footer>&copy; us</footer>", "<footer>&copy; u"), w) == want
        assert extract(DIVS, w) == "One two three four five six.\nSeven eight nine.\nTen."
        assert extract("just words without any tag &lt;3", w) == "just words without any tag <3"
        assert extract("<p>a</p>", w) in ("a", "")
        for x in (None, "", " ", "<nav><a>x</a></nav>", "<", "<p", "<!-- open", "<script>x"):
            assert extract(x, w) == ("<" if x == "<" else ""), x
    assert all(v < 0 for k, v in weights.items() if k[0] == "tag")
    assert weights["p", False, False] > 0 > weights["li", True, True]


def test_names(weights):
    """Only names all of whose words say so are furniture; others follow the labelled pages."""
    page = ARTICLE.replace("<p>Second,", '<div class="related-work"><p>Others did this before us.</p></div><div class="adaptive search-space"><p>We look there.</p></div><div class="newsletter-signup"><p>Sign up today.</p></div><p>Second,')
    for w in ({}, weights):
        assert extract(page, w) == "Head & more\nFirst para of it.\nOthers did this before us.\nWe look there.\nSecond, with link text.\nEnd."
    zq = '<body><div class="zq7"><p>Words that no reader wants to see, but in a plain paragraph.</p></div><article><div class="zq8"><p>A story that is told.</p></div></article>'
    c = Counter()
    for _ in range(20):
        observe(zq, c)
    w = weigh(c)
    assert w["name", "zq7"] < 0 < w["name", "zq8"]
    plain = zq.replace("article>", "div>")
    assert extract(plain, w) == "A story that is told." and extract(plain, {}).startswith("Words")


def test_anchors_classes_and_formulas(weights):
    """Ids of sections and headings, one class of several, formulas and an object's own text belong to the article."""
    page = (
        '<body><nav><a href=x>Menu</a></nav><article><h1>Trees</h1><p>A tree has nodes and edges in it.</p><h2 id="search">Search trees</h2><p id="alert" class="lead alert">They keep order.</p>'
        '<section id="related"><p>Others wrote of them.</p></section><section id="legal"><h3 id="share" class="title">Law</h3><p>It says so.</p></section>'
        "<p>So <math><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup><semantics><annotation encoding=x>a=b^2</annotation></semantics></math> holds.</p>"
        '<object data="x.swf"><p>No film here.</p></object><p class="alert">Notice.</p><div id="share-bar">Share it.</div><p>That is all.</p>'
        '<section id="comments"><p>First!</p></section><article id="comment-12"><p>Second!</p></article></article></body>'
    )
    want = "Trees\nA tree has nodes and edges in it.\nSearch trees\nThey keep order.\nOthers wrote of them.\nLaw\nIt says so.\nSo a=b2 holds.\nNo film here.\nThat is all."
    for w in ({}, weights):
        assert extract(page, w) == want
    long = "<article><p>It is shown here.</p><p><math>" + "<mrow><mi>x</mi></mrow>" * 200 + "</math></p><p>That was it.</p></article>"
    assert extract(long, {}) == "It is shown here.\n" + "x" * 200 + "\nThat was it."
    assert extract("<article><p>An open <math><mi>x</mi><p>formula ends <b>with</b> its block.</p></article>", {}) == "An open x\nformula ends with its block."


def test_of_equal_stretches_the_first():
    assert extract("<p>aa bb cc</p>" + "</div>" * 5 + "<p>dd ee ff</p>", {}) == "aa bb cc"
    assert extract("<p>aa bb cc</p>" + "</div>" * 5 + "<p>dd ee ff gg</p>", {}) == "dd ee ff gg"


def test_the_stretch_is_the_best_one():
    """Against all stretches."""
    import itertools

    from lodestar.llm.html_text import HOLE, Block, before, parse

    rng = random.Random(5)
    for _ in range(150):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<nav>", "</nav>", "<a>", "</a>", "<section class=ad>", "</section>", "<br>", "one", " two ", "three four five "]) for _ in range(rng.randrange(40)))
        tokens = parse(page)
        bad = lambda t: t.furniture or "ad" in t.names if isinstance(t, Block) else t[2] or "ad" in t[1]
        scores = [t.plain * before((t.tag, False, bad(t))) + t.linked * before((t.tag, True, bad(t))) if isinstance(t, Block) else HOLE if bad(t) else before(("tag", t[0])) for t in tokens]
        best = max((sum(scores[i:j]) for i, j in itertools.combinations(range(len(tokens) + 1), 2)), default=0)
        found = {"\n".join(t.text for t in tokens[i:j] if isinstance(t, Block) and not bad(t)) for i, j in itertools.combinations(range(len(tokens) + 1), 2) if best > 0 and sum(scores[i:j]) > best - 1e-9}
        assert extract(page, {}) in (found or {""}), page


def test_long_and_broken(weights):
    assert extract("<article>" + "<p>word word</p>" * 20000, weights).count("\n") == 19999
    assert extract("<div title=\"a>b\"><p>some text of a page</p></div>", weights) == "some text of a page"
    assert extract("<div title=\"a><p>some text of a page</p>" + "</div>", weights) == "some text of a page"


def test_table(spark, weights):
    rows = [(1, "u", ARTICLE, 3), (2, None, None, 1), (3, "u", "", 1), (1, "u", ARTICLE, 3)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(2)
    got = sorted(map(tuple, main_text(d).collect()), key=str)
    text = extract(ARTICLE, weights)
    assert got == sorted([(1, "u", text, len(text)), (2, None, "", 0), (3, "u", "", 0), (1, "u", text, len(text))], key=str)
    assert main_text(d.limit(0)).count() == 0
    assert learn(d.where("page_id = 3")) == {}


def test_real_pages_hold_their_articles(spark):
    """Against a plain cut between the article's tags, for pages of the one template of the test tables."""
    import html
    import re

    for r in main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in want if x)
