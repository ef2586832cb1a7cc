import random

import pytest

from shelfline.llm import html_extraction as he
from shelfline.llm.html_extraction import extract, induce, main_texts, match, parse


def page(k, body, nav="Home", extra=""):
    return (f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li>{nav}"
            f"<li>More</ul></nav><div class='site'><div class='content'>{body}</div><div class='sidebar'>Links</div></div>{extra}"
            f"<footer>&copy; x</footer></body></html>")


CASES = [
    ("<article><h1>A &amp; B</h1><p>one\n  two<p>three <b>bold</b><br>end</article>", "A & B\none two\nthree bold end"),
    ("<article><p>x</p><div class=comments><p>reader</p></div><aside>no</aside><form>no</form><!-- c --></article>", "x"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>a &lt;b&gt; &#233;</p>", "a <b> é"), ("", ""), (None, ""),
    ("<article><ul><li>one<li>two</ul><pre>a  b</pre></article>", "one\ntwo\na b"),
    ("<p>no article</p></div></div><p>still", "no article\nstill"),
    ("<article><p title='a>b'>quoted</p><script>if (a<b) {}</script>", "quoted"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_single_pages(html, text):
    assert extract(html, None) == text


def test_matching_and_template():
    pages = [page(k, f"<h1>Title {k}</h1><p>Body text number {k} is long enough</p><div class='box'>Always here</div>") for k in range(6)]
    wrapper = induce(pages)
    assert wrapper["main"].endswith("div.content")
    assert extract(pages[0], wrapper) == "Title 0\nBody text number 0 is long enough"
    size, pairs = match(parse(pages[0]), parse(pages[1]))
    assert size == len(pairs) > 8


def test_title_and_lead_outside_the_body():
    long = "<p>A long paragraph of the article, number {0}.</p>" * 30
    lists = "<ul><li>first {0}" + "<li>item {0} of many" * 60 + "</ul>"
    for inner in ("<div class=body>" + long + "</div>", lists, "<section>" + long + "</section>"):
        pages = [page(k, f"<div class=box>Always here</div><article><h1>Title {k}</h1><p class=lead>Lead {k}</p>{inner.format(k)}</article>")
                 for k in range(6)]
        wrapper = induce(pages)
        assert wrapper["main"].endswith("/article")
        assert extract(pages[2], wrapper).startswith("Title 2\nLead 2\n") and "Always" not in extract(pages[2], wrapper)


def test_copies_are_not_template():
    pages = [page(0, "<article><h1>Same</h1><p>copy</p></article>")] * 6
    assert extract(pages[0], induce(pages)) == "Same\ncopy"


def test_table(spark):
    rows = [(k, f"http://h.example/{k}", page(k, f"<article><h1>T {k}</h1><p>{'word ' * (k + 1)}</p></article>"), "x") for k in range(30)]
    rows += [(100, None, None, "x"), (101, "not a url", "", "x"), (3, rows[3][1], rows[3][2], "x"), (None, "http://h.example/n", "<p>null id", "x"),
             (102, "http://long.example/", "<article>" + "<p>para</p>" * 20_000, "x")]
    got = main_texts(spark, spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in range(30):
        assert by[k].text == f"T {k}\n" + " ".join(["word"] * (k + 1)) and by[k].n_chars == len(by[k].text)
    assert by[100].text == by[101].text == "" and by[102].text.count("\n") == 19_999 and by[None].text == "null id"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_texts(spark, empty).collect() == []


def test_minority_layouts_and_all_articles(spark):
    rows = [(k, f"http://h.example/{k}", page(k, f"<article><h1>T {k}</h1><p>long text {k} of the host</p></article>")) for k in range(40)]
    other = "<html><body><div class=menuless>Same line</div><div class=story><h2>S {0}</h2><p>one {0}</p><article><p>two {0}</p></article><article><p>three {0}</p></article></div></body></html>"
    rows += [(100 + k, f"http://h.example/o{k}", other.format(k)) for k in range(5)]
    got = {r.page_id: r.text for r in main_texts(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(40):
        assert got[k] == f"T {k}\nlong text {k} of the host"
    for k in range(5):
        assert got[100 + k] == f"S {k}\none {k}\ntwo {k}\nthree {k}"
    assert extract("<article>a<article>b</article></article><main>c</main>", None) == "a\nb\nc"


def texts_of(spark, rows):
    return {r.page_id: r.text for r in main_texts(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_wrappers_by_join(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.example/{k}", page(k, f"<h1>Title {k}</h1><p>Body text number {k}</p><div class='box'>Always here</div>")) for k in range(30)]
    one = texts_of(spark, rows)
    monkeypatch.setattr(he, "WRAPPER_BYTES", 0)
    assert texts_of(spark, rows) == one == {k: f"Title {k}\nBody text number {k}" for k in range(30)}


def test_deep_nesting(spark):
    deep = "<div>" * 30_000 + "<p>low" + "</div>" * 30_000 + "<p>after"
    spans = "<article>" + "<b>" * 20_000 + "text" + "<section>" * 5000 + "<p>more"
    rows = [(k, f"http://d.example/{k}", deep) for k in range(3)] + [(9, "http://e.example/", spans)]
    rows += [(20 + k, f"http://f.example/{k}", "<article>" + "<div>" * 3000 + f"<h1>T {k}</h1><p>body {k}") for k in range(4)]
    got = texts_of(spark, rows)
    assert all(got[k] == "low\nafter" for k in range(3)) and got[9] == "text\nmore"
    assert all(got[20 + k] == f"T {k}\nbody {k}" for k in range(4))


def test_ids_of_their_own_share_a_layout(spark):
    rows = [(k, f"http://i.example/{k}", f"<body><div class=box>Menu of all pages</div><div class=post id=post-{chr(97 + k % 26)}{chr(97 + k // 26)}>"
                                         f"<h1>Title {k}</h1><p>text {k} of the page</p></div></body>") for k in range(60)]
    assert texts_of(spark, rows) == {k: f"Title {k}\ntext {k} of the page" for k in range(60)}


def test_a_slot_that_varies_anywhere_is_content(spark):
    by = lambda k: "Bob, a guest writer" if k % 10 == 9 else "Ann"
    rows = [(k, f"http://s.example/{k}", f"<article><h1>T {k}</h1><div class=by>By {by(k)}</div><div class=box><div class=in>Always</div></div><p>text {k}</p></article>")
            for k in range(100)]
    # one page in two hundred has another box: the box is template, but not that page's text
    rows += [(1000 + k, f"http://o.example/{k}", f"<article><h1>T {k}</h1><div class=box>{'Odd' if k == 77 else 'Always'}</div><p>text {k}</p></article>") for k in range(200)]
    got = texts_of(spark, rows)
    for k in range(100):
        assert got[k] == f"T {k}\nBy {by(k)}\ntext {k}"
    for k in range(200):
        assert got[1000 + k] == f"T {k}\n" + ("Odd\n" if k == 77 else "") + f"text {k}"


def test_wrappers_come_from_all_pages(spark):
    # a box of 6 pages in 200, and a text beside the main region that 2 pages in 300 have otherwise: a dozen pages would not show them
    rows = [(k, f"http://r.example/{k}", f"<article><h1>T {k}</h1>{'<section><p class=box>Always</p></section>' if k % 33 == 1 else '<section></section>'}<p>text {k}</p></article>")
            for k in range(199)]
    rows += [(1000 + k, f"http://m.example/{k}", f"<body><div class=top>{'Odd' if k in (77, 177) else 'Always'}</div><div class=post><h1>T {k}</h1><p>text {k}</p></div></body>")
             for k in range(300)]
    got = texts_of(spark, rows)
    for k in range(199):
        assert got[k] == f"T {k}\ntext {k}"
    for k in range(300):
        assert got[1000 + k] == ("Odd\n" if k in (77, 177) else "") + f"T {k}\ntext {k}"


def test_copies_of_an_article_are_not_template(spark):
    # equal main texts beside varying ones, dealt to any group
    rows = [(k, f"http://c.example/{k}", f"<div class=top>Always</div><article><h1>One</h1><p>copy</p></article><!-- {k} -->") for k in range(150)]
    assert set(texts_of(spark, rows).values()) == {"One\ncopy"}


def test_skeletons_survive_their_rows():
    rng = random.Random(2)

    def grown(depth):
        return "".join(f"<{t}>{rng.choice(['', 'a', 'b <i>c</i>'])}{grown(depth - 1)}</{t}>" for t in rng.choices(["div", "p", "b", "nav", "ul class='x y'"], k=rng.randint(0, 4 if depth else 0)))

    for _ in range(100):
        root = parse(grown(4))
        top = he.skeleton(root)
        again = he._grown(*he._flat(top))
        assert top.digest == he._digest(root) and [x.digest for x in he._walk(top)] == [he._digest(x.source) for x in he._walk(top)]
        assert [(x.name, x.digest, x.own, x.shown) for x in he._walk(top)] == [(x.name, x.digest, x.own, x.shown) for x in he._walk(again)]


def recursive(a, b):
    """The textbook version."""
    if a.name != b.name:
        return 0
    x, y = he._elements(a), he._elements(b)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + recursive(x[i], y[j]))
    return 1 + best[-1][-1]


def test_tree_matching_equals_the_textbook(monkeypatch):
    rng = random.Random(1)

    def grown(depth):
        return "".join(f"<{t}>{grown(depth - 1)}</{t}>" for t in rng.choices(["div", "section", "ul", "div class=a"], k=rng.randint(0, 4 if depth else 0)))

    for _ in range(150):
        a, b = parse(grown(4)), parse(grown(4))
        size, pairs = match(a, b)
        assert size == recursive(a, b) == len(pairs)
        assert all(p.name == q.name for p, q in pairs) and len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs}) == size
    # longer lists: an item that one page has more shifts the rest
    items = [f"<section class=c{chr(97 + k % 7)}><div>{k}</div></section>" for k in range(300)]
    a, b = parse("".join(items)), parse("".join(items[:50] + ["<section class=new><div>x</div></section>"] + items[50:]))
    assert match(a, b)[0] == 1 + 2 * 300
