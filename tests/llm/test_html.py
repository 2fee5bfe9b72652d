import time
import html as H
import re

import pytest

from sillage.llm import html

P = "<p>Thinouer shen onndeable it heed as of reinntnt thesing, reties. Inble and was.</p>"


def text(page):
    return html.main_text(page, html.trained())


def test_exact_on_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner[1])]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><header><h1>X</h1></header><div id='cookie-notice'>X cookies?</div><div class='content'><h1>T</h1>{P}<div class='ad'>X!</div><p>a &amp; b&nbsp;c</p></div><div class='comments'><p>X nice.</p></div><footer>X</footer>", 3),
        (f"<nav><ul><li><a href=/>X</a></ul></nav><article><h1>T</h1>{P}<aside>X {P.replace('Thin', 'X')}</aside><p>It.</p></article><form><p>X</p></form>", 3),
        (f"<body><p>{P}", 1),
        ("<main><h1>T</h1><p>A.</p><p>B</p></main>", 3),
        ("<body><div class='sidebar'><p>X x.</p></div><article><p><b>One<br><p>Two</article><script>X</script><style>X</style><!-- X -->", 2),
    ],
)
def test_regions(page, want):
    got = text(page)
    assert "X" not in got and len(got.split("\n")) == want


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words"), (4, "u", "<p>a\n b<p>" + "c " * 100_000), (5, "u", "<div>" * 5000 + "deep")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "" and got[4].startswith("a b\nc c") and len(got) == 5


def exact(nodes, model):
    """Marginals by summing over all states."""
    import itertools
    import math

    total, main = 0.0, [0.0] * len(nodes)
    place = {n: i for i, n in enumerate(nodes)}
    seen = html.observed(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        x = model.root[states[0]]
        for i, n in enumerate(nodes):
            part = html.PART if html.plain(n) else 1.0
            x += part * sum(model.seen[f][states[i]] for f in seen[i] if f in model.seen)
            if i:
                x += model.edge[html.plain(n)][states[place[n.parent]]][states[i]]
        p = math.exp(x)
        total += p
        main = [m + p * s for m, s in zip(main, states, strict=True)]
    return [m / total for m in main]


def test_messages_give_exact_marginals():
    model = html.trained()
    nodes = html.ordered(html.parse("<div class='content'><p>One two. <a href=x>three</a></p><div class='ad'><b>Buy</b></div></div><footer>c</footer>"))
    assert model.marginals(nodes) == pytest.approx(exact(nodes, model))


@pytest.mark.parametrize("name", ["social", "tags", "top", "lead", "adventure"])
def test_classes_inside_an_article_do_not_decide(name):
    page = (
        "<html><body><nav class='menu'><a href='/'>Home</a></nav><article><h1>T</h1><p>First one here. It is long.</p>"
        f"<p class='{name}'>The boats came back at noon, and nobody had seen it.</p><p>Another paragraph, with an end.</p></article></body></html>"
    )
    assert "The boats came back" in html.main_text(page, html.trained())


def test_unknown_elements_in_a_paragraph_stay():
    page = "<article><p>Let <math><mi>x</mi> + y</math> be a <noscript>plain</noscript> sum. It is <x-word>long</x-word> enough.</p></article>"
    assert html.main_text(page, html.trained()) == "Let x + y be a plain sum. It is long enough."


def test_unclosed_head():
    assert html.main_text("<html><head><title>T</title><p>Body text goes here. It is long enough.</p>", html.trained()) == "Body text goes here. It is long enough."


def test_deep_pages_take_linear_time():
    began = time.time()
    deep = "<article>" + "<div>" * 200_000 + "<p>One paragraph here.<p>Two." + "</div>" * 200_000 + "</article>"
    assert html.main_text(deep, html.trained()) == "One paragraph here.\nTwo."
    assert time.time() - began < 20


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>One paragraph here. It is fine.</p>", "x", 5)] * 2, "page_id long, url string, html string, text string, n_chars int")
    assert [r["text"] for r in html.extract(df).collect()] == ["One paragraph here. It is fine."] * 2
    assert html.extract(df.limit(0)).count() == 0

PARAGRAPH = "The boats came back at noon again, and nobody had seen the storm the radio spoke of."
NAV, FOOT = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>", "<footer>All rights reserved.</footer>"
#: Containers and class words of which none is in the labelled pages, next to such that are.
HOLDERS = {
    "article": "<article>{}</article>", "main": "<main>{}</main>", "div": "<div>{}</div>", "section": "<section>{}</section>", "story": "<div class='story'>{}</div>",
    "named section": "<section class='story'>{}</section>", "unknown word": "<div class='qxz-12'>{}</div>", "unknown section": "<section id='zzz'>{}</section>", "bare": "{}",
    "nested": "<div class='container'><div class='row'><div class='col'>{}</div></div></div>", "unknown nested": "<div class='aaa'><div><div id='bbb'>{}</div></div></div>",
}


@pytest.mark.parametrize("holder", HOLDERS)
@pytest.mark.parametrize("around", ["", "nav", "foot", "both"])
def test_articles_of_any_length_in_any_container(holder, around):
    for n in (1, 2, 3, 4, 6, 8, 12, 30):
        for title in ("", "<h1>T</h1>"):
            inner = title + f"<p>{PARAGRAPH}</p>" * n
            page = f"<html><body>{NAV if around in ('nav', 'both') else ''}{HOLDERS[holder].format(inner)}{FOOT if around in ('foot', 'both') else ''}</body></html>"
            assert text(page).split("\n") == ["T"] * bool(title) + [PARAGRAPH] * n, (n, title)


@pytest.mark.parametrize("word", "widget banner search comment notice contact lead sidebar menu footer popup promo ad qxz".split())
@pytest.mark.parametrize("holder", ["article", "div", "bare"])
def test_any_class_of_a_paragraph_in_an_article(word, holder):
    inner = f"<h1>T</h1><p>{PARAGRAPH}</p><p class='{word}'>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    assert text(f"<html><body>{NAV}{HOLDERS[holder].format(inner)}{FOOT}</body></html>").count(PARAGRAPH) == 3


def test_header_of_the_article_and_of_the_page():
    page = f"<body><header><h1>X Gazette</h1></header><article><header><h1>Head line</h1></header><p>{PARAGRAPH}</p></article>{FOOT}</body>"
    assert text(page) == f"Head line\n{PARAGRAPH}"


def test_held_out_pages():
    """Pages of the rule by another seed: the share of letters that are told wrong."""
    maker, wrong, whole = html._Maker(99), 0, 0
    for _ in range(200):
        nodes = html.ordered(html.parse(maker.page()))
        state = {}
        for n, found in zip(nodes, html.trained().marginals(nodes)):
            said = n.attrs.get("data-main")
            state[n] = int(said) if said is not None else state[n.parent] if n.parent else 0
            k = sum(len(x.strip()) for x in n.parts if isinstance(x, str))
            whole, wrong = whole + k, wrong + k * ((found > 0.5) != state[n])
    assert wrong < 0.1 * whole
