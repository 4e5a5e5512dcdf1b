import random

import pytest

from panelcast.llm import extract, htmltree


def text(page):
    return extract.main_text(page, lambda path: 1.0)


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<p>1 < 2 &amp; <b>x", "1 < 2 & x"),
    ("<ul><li>a<li>b</ul>tail<scr", "a\nb\ntail"), ("<p>a<br>b  c\n d</p>", "a b c d"),
    ("<script>var a='</p><p>x';</script><style>p{}</style>after &#x41;&nbsp;&lt;p&gt;", "after A <p>"),
    ("<article><header><h1>T</h1></header><p>a<section class=comments><p>no</section></article>", "T\na"),
    ("<header>h</header><nav>n</nav><article><p>x</p></article><aside>s</aside><footer>f</footer>", "x"),
    ("<div id=content><p>x</p></div><div class='cookieNotice'>c</div><form>f<input value='>'></form>", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<!-- <p>no</p> --><p>yes</p><!-- cut", "yes"),
    ("<p title=\"a>b\">q</p></div></b>r", "q\nr"), ("<nav>only a menu</nav>", ""), ("<textarea><p>no</textarea>x", "x"),
    ("<p>&am &a &quo &copy;</p>", "&am &a &quo ©"), ("<title>no</title><body><h1>h</h1>", "h"),
])
def test_page(page, want):
    assert text(page) == want


def test_block_paths():
    nodes, blocks = htmltree.parse("<div class='b a x12' id=k7><p>t<b>u</b></p></div>")
    again, _ = htmltree.parse("<div id=k8 class='a b x3'><p>v</div>")
    assert nodes[0].step == "div.a.b.k.x" and [n.path for n in nodes[:2]] == [n.path for n in again]
    assert [(t, n.tag) for t, n in blocks] == [("tu", "p")]


def site(n=30):
    rng = random.Random(4)

    def words(k):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    rows, want = [], []
    promo = [words(6) for _ in range(2)]
    for i in range(n):
        main = words(30)
        rows.append((i, f"http://big.example/{i}", f"<div class=top>Our site</div><div class=body><p>{main}</p></div>"
                                                   f"<div class=side>{rng.choice(promo)}</div>"))
        want.append(main)
    for i in range(3):  # a host of one page: the tree of all hosts knows its side column
        main = words(20)
        rows.append((100 + i, f"http://small{i}.example/", f"<div class=body><p>{main}</p></div><div class=side>{promo[0]}</div>"))
        want.append(main)
    copies = [(200 + i, "http://copies.example/x", "<article><p>the same article</p></article>") for i in range(8)]
    return rows + copies, want + ["the same article"] * 8


def test_repeating_branches_go_without_a_name(spark):
    rows, want = site()
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, row int")
    got = extract.extract_pages(pages).orderBy("page_id").collect()
    assert [r.text for r in got] == want and [r.n_chars for r in got] == [len(t) for t in want]
    joined = extract.extract_pages(pages, few=-1).orderBy("page_id").collect()
    assert [tuple(r) for r in joined] == [tuple(r) for r in got]


def test_importance_is_the_entropy(spark):
    nodes = spark.createDataFrame(
        [(i, "h", 1, 5, 7 if i < 4 else 100 + i) for i in range(8)], "row long, host string, path long, style long, content long")
    got = {(r.host, r.path): r for r in extract.style_tree(nodes).collect()}
    from math import log
    content = 1 - (4 * log(4)) / (8 * log(8))
    assert got["h", 1].m == 8 and abs(got["h", 1].importance - extract.GAMMA * content) < 1e-9
    assert got[None, 1].importance == got["h", 1].importance


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "<p>x"), (3, "not a url", "<p>x"), (None, "HTTP://H:80/", "<p>y</p>"),
            (4, "http://h/", "<div>" * 3000 + "deep"), (5, "http://h/", "<p>" + "word " * 200000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract.extract_pages(pages).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[1].n_chars == 0 and by[3].text == "x" and by[None].text == "y"
    assert by[4].text == "deep" and by[5].n_chars == 999999
    assert extract.extract_pages(pages.limit(0)).count() == 0


MANY = " ".join(f"word{i}" for i in range(120))


@pytest.mark.parametrize("page, want", [
    ("<div class='has-sidebar'><article><p>x</p></article><div class=sidebar>s</div></div>", "x"),
    ("<div id='search-results'><nav>n</nav><main><p>x</p></main></div>", "x"),
    ("<body class=app><div class=no-ads><article><p>x</p><div class=ad>buy</div></article></div>", "x"),
    ("<form><header>h</header><nav>n</nav><article><p>x</p></article><footer>f</footer></form>", "x"),
    ("<form><div class=menu>m</div><div><p>x</p></div></form>", "x"),
    ("<div class='has-sidebar'><p>x</p><div class=sidebar>s</div></div>", "x"),
    ("<div class='banner'>a</div><div class='promo'>b</div>", "a\nb"),
    ("<div class=has-sidebar><article><p>x</p></article><section class=comments><article>c</article></section></div>", "x"),
    (f"<div><p>the body</p></div><aside class=related><article>t</article></aside><p>{MANY}</p>", f"the body\n{MANY}"),
    (f"<div><p>x</p></div><div class=legal><p>{MANY}</p></div>", f"x\n{MANY}"),
])
def test_a_name_alone_does_not_decide(page, want):
    assert text(page) == want


@pytest.mark.parametrize("n", [30, 60, 500])
@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("role", ["section class=comments", "div id=comment-list", "div class=footer", "footer", "aside", "nav",
                                  "div class=sidebar", "form", "div class=notice", "div class=cookie-notice", "div class=ad",
                                  "header", "div class=menu"])
def test_length_never_saves_what_isnt_the_article(n, inside, role):
    if inside and role == "header":
        return  # an article's own headline
    words = " ".join(f"own{i}" for i in range(n))
    branch = f"<{role}><p>{words}</p></{role.split()[0]}>"
    body = f"<h1>Title</h1><p>{MANY}</p>"
    page = f"<article>{body}{branch}</article>" if inside else f"<div><div class=story>{body}</div>{branch}</div>"
    assert text(page) == f"Title\n{MANY}"


def test_broken_pages_take_linear_time():
    import time
    units = ["<a", "<a b=' ", "<a b=\"", "<a \"'", "</ ", "<!", "<!--", "<", "<div>x", "<b>", "<p><b>", "<a b='>", "&#", "<b></i>",
             "<td><b></td>", "</p>"]
    for unit in units:
        page = unit * (1_000_000 // len(unit)) + ">'"
        t = time.perf_counter()
        htmltree.parse(page)
        assert time.perf_counter() - t < 20, unit
    for unit in ("<a", "<a b=' "):
        t = time.perf_counter()
        htmltree.parse(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - t < 1.5, unit


def test_odd_tags():
    def blocks(page):
        return [t for t, _ in htmltree.parse(page)[1]]
    assert blocks("a < b <c d='>x'>y</c> 1<2") == ["a < b y 1<2"]
    assert blocks("x<p title=\"never closed>y</p><p>z</p>") == ["x", "y", "z"]
    assert blocks("<p>a<script>if (a<b) '</p>'</script>b") == ["ab"]
    assert blocks("<p>a</ p><b") == ["a"]
    deep = htmltree.parse("<div>" * 2000 + "x" + "</div>" * 2000 + "<p>y")
    assert [t for t, _ in deep[1]] == ["x", "y"] and max(n.depth for n in deep[0]) == htmltree.DEEPEST


def test_the_style_tree_judges_named_branches(spark):
    rng = random.Random(8)
    rows, want = [], []
    same = " ".join(f"s{i}" for i in range(120))
    for i in range(12):
        main, own = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(k)) for k in (30, 120))
        rows.append((i, f"http://h/{i}", f"<div class=body><p>{main}</p></div><div class=related><p>{own}</p></div>"
                                         f"<div class=legal><p>{same}</p></div><div class=ad>ad{i}</div>"))
        want.append(f"{main}\n{own}")
    got = extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in got] == want
