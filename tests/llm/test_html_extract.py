from __future__ import annotations

import html
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shotgrid.llm import html_extract as H

SF = "/root/testdata/sf0.01"


def article_text(page):
    """The text between the article's tags, by plain search: what the tables' pages hold."""
    a = page[page.find("<article>") + 9:].split("</article>")[0].split("<footer")[0]
    a = re.sub(r"<[^>]*(>|$)", "", re.sub(r"<(?:p|h1|/p|/h1)>", "\n", a))
    lines = (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in a.split("\n"))
    return "\n".join(x for x in lines if x)


def test_whole_table_equals_plain_search(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = H.main_texts(pages).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.text == article_text(source[r.page_id]) and r.n_chars == len(r.text)


def tree(rng, depth=0):
    kids = [tree(rng, depth + 1) for _ in range(rng.randint(0, 3))] if depth < 3 else []
    return [rng.choice("ab") if depth else "r", rng.randint(0, 2), 1, kids]


def brute(a, b):
    """Best weight over all order-keeping choices of child pairs."""
    best, x, y = 0.0, a[3], b[3]
    for k in range(min(len(x), len(y)) + 1):
        for i in itertools.combinations(x, k):
            for j in itertools.combinations(y, k):
                if all(p[0] == q[0] for p, q in zip(i, j)):
                    best = max(best, sum(brute(p, q) for p, q in zip(i, j)))
    return best + (1.5 if a[1] == b[1] else 1.0)


def test_tree_matching_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        a, b = tree(rng), tree(rng)
        weight, pairs = H.match(a, b)
        assert weight == brute(a, b)
        assert weight == sum(1.5 if p[1] == q[1] else 1.0 for p, q in pairs) and all(p[0] == q[0] for p, q in pairs)


def page(i, extra=""):
    words = " ".join(f"w{i}x{k}" for k in range(60))
    return (f"<html><head><title>t{i}</title></head><body><div id=top>Site name</div><div class='side-bar sidebar'>links {i}</div>"
            f"<div class=col><div class=post><h2>Head {i}</h2><p>First&nbsp;&lt;{i}&gt;  {words}<br>more</p>"
            f"<p class=tag-line>Always the same line here</p><ul><li>one {i}<li>two {i}</ul>{extra}</div>"
            f"<div class=comments><p>reader {i} says {words} {words}</p></div></div>"
            f"<form><p>Sign up</p></form><footer>f{i}</footer><script>x = '<p>no</p>'</script></body></html>")


def kept_alive(pairs):
    return sorted((id(p), id(q)) for p, q in pairs)


@pytest.mark.parametrize("common", [0, 1, 64])
def test_long_lists_are_matched_like_short_ones(monkeypatch, common):
    rng = random.Random(7)
    monkeypatch.setattr(H, "COMMON", common)
    for _ in range(60):
        a, b = (["r", 0, 1, [tree(rng, 2) for _ in range(rng.randint(0, 12))]] for _ in "ab")
        monkeypatch.setattr(H, "CELLS", 1 << 16)
        short = H.match(a, b)
        monkeypatch.setattr(H, "CELLS", 0)      # every list counts as long
        long = H.match(a, b)
        assert long[0] == short[0] and kept_alive(long[1]) == kept_alive(short[1])


def test_a_long_list_keeps_its_equal_rows():
    """One label ahead of its turn does not throw the rest of a long list out of step."""
    row = lambda k: ["tr", k, 1, [["td", 10_000 + k, 1, []], ["td", 5, 1, []]]]
    a = ["table", 1, 1, [row(k) for k in range(1, 601)]]
    b = ["table", 2, 1, [row(k) for k in range(301, 601)] + [["tfoot", 9, 1, []]]]
    weight, pairs = H.match(a, b)
    assert weight == 1 + 300 * 4.5
    assert sum(p[0] == "tr" and p[1] == q[1] for p, q in pairs) == 300


def test_template_nodes_and_marks_go(spark):
    rows = [(i, f"http://a.example/{i}", page(i, f"<p>tail {i}</p>")) for i in range(12)]
    rows += [(100 + i, f"http://a.example/c{i}", rows[0][2]) for i in range(30)]   # copies are no evidence
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        words = " ".join(f"w{i}x{k}" for k in range(60))
        assert got[i] == f"Head {i}\nFirst <{i}> {words} more\none {i}\ntwo {i}\ntail {i}"
    assert {got[100 + i] for i in range(30)} == {got[0]}


@pytest.mark.parametrize("source, text", [
    ("", ""), ("plain &amp; text", "plain & text"), ("<article><p>a<p>b", "a\nb"), ("<p>x</p><aside>y</aside>", "x"),
    ("<body><nav>n</nav><div>a <b>b</b>\n c</div>d<!-- <p>no --></body>", "a b c\nd"), ("<p>a &#233;&eacute;", "a éé"),
    ("<header>h</header><article><header>t</header><p>b", "t\nb"), ("<div hidden>x</div><p>y", "y"),
    ("<p>cut <b>off &am", "cut off &am"), ("<p>a</p></div></p>b<table><tr><td>1<td>2<tr><td>3</table>", "a\nb\n1\n2\n3"),
    ("<p>1 < 2 and <a href='x>y'>link</a>", "1 < 2 and link"), ("<textarea>t</textarea><p>" + "deep <div>" * 3000, "\n".join(["deep"] * 3000)),
])
def test_broken_markup(source, text):
    assert H.extract(source, [], set()) == text


@pytest.mark.parametrize("source, text", [
    ("<body><form id=aspnetForm><input value=x><article><p>a<p>b</article><button>go</button></form>", "a\nb"),
    ("<body><div>top</div><form><h1>Head</h1><p>a long paragraph</p><label>Name</label></form>", "top\nHead\na long paragraph"),
    ("<article><p>a</p></article><form><p>Sign up with a text that is longer than the article</form>", "a"),
    ("<article data-title='A hidden life'><p title='the hidden gem'>a</p><p data-x=hidden>b</p><p HIDDEN>c", "a\nb"),
    ("<p style='color:red; display : none'>x</p><p aria-hidden=true>y</p><p aria-hidden=false>z", "z"),
    ("<main><header><h1>Head</h1></header><p>a</main>", "Head\na"),
    ("<article><p class=side>a</p><p class=alert>b</p><label>c</label><p class='side ad'>d</p><div class=alert>e</div>", "a\nb\nc"),
    ("<label for=x>Menu</label><article>a</article>", "a"),
])
def test_attributes_forms_and_headers(source, text):
    assert H.extract(source, [], {}) == text


def renamed(source):
    """Article, navigation, header, footer and aside as plain div elements without classes."""
    source = re.sub(r"<(/?)(?:article|nav|header|footer|aside)\b[^>]*>", r"<\1div>", source)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", source)


def test_content_slot_is_learnt_where_tags_say_nothing(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    source = {r.page_id: r for r in pages.withColumn("host", H.host(F.col("url"))).collect()}
    of_host = Counter(r.host for r in source.values())
    rows = [(i, r.url, renamed(r.html)) for i, r in source.items()]
    got = H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    right = {True: [], False: []}
    for r in got:
        right[of_host[source[r.page_id].host] >= H.MIN_PAGES].append(r.text == article_text(source[r.page_id].html))
    assert len(right[True]) > 100 and sum(right[True]) >= 0.9 * len(right[True])


def test_slots_around_the_content(spark):
    def page(i, rest="", head=""):
        return (f"<title>Head {i} - site</title><body><div><ul><li><a href=x>m{i}</a><li><a href=y>n{i}</a></ul></div><div>advert {i}</div>"
                f"<div>Head {i}</div>{head}<div><p>{words(i, 60)}</p><p>{words(i, 40, 'v')}</p></div>{rest}<div>all rights {i}</div></body>")

    got = texts(spark, [page(i, "<div><p>Epilogue %d</div>" % i if i == 2 else "", f"<div><h2>Part {i}</h2></div>") for i in range(10)])
    for i, g in enumerate(got):     # words of the title, paragraphs and headings stay
        assert g == f"Head {i}\nPart {i}\n{words(i, 60)}\n{words(i, 40, 'v')}" + ("\nEpilogue 2" if i == 2 else "")
    few = texts(spark, [page(i) for i in range(3)])     # too few pages to learn from: nothing goes
    assert all(f"advert {i}" in g and f"all rights {i}" in g for i, g in enumerate(few))


def test_deep_and_wide_pages(spark):
    deep = "<body>" + "<div>" * 5000 + "<p>deep text" + "</div>" * 5000
    wide = "<body><article>" + "".join(f"<p>para {i}" for i in range(3000)) + "</article>"
    rows = [(1, "http://a/1", deep), (2, "http://a/2", wide), (3, "http://a/3", wide.replace("para", "item"))]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "deep text"
    assert got[2].split("\n") == [f"para {i}" for i in range(3000)] and got[3].split("\n")[-1] == "item 2999"


def test_defined_cases(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://h/x", "<p>a"), (3, "http://h/x", "<p>a"), (None, "http://H/y", "<p>" + "b " * 100_000)]
    pages = (spark.createDataFrame(rows, "page_id long, url string, html string")
             .withColumn("text", F.lit("clash")).withColumn("host", F.lit("x")).withColumn("wrapper", F.lit("y")))
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in H.main_texts(pages).collect())
    assert got == sorted([(1, None, "", 0), (2, "no url", "", 0)] + [(3, "http://h/x", "a", 1)] * 2
                         + [(0, "http://H/y", ("b " * 100_000).strip(), 199_999)], key=lambda r: (r[0], r[1] or ""))
    assert H.main_texts(pages.where("false")).count() == 0


def texts(spark, pages):
    rows = [(i, f"http://one.example/{i}", p) for i, p in enumerate(pages)]
    got = H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def words(i, n, tag="w"):
    return " ".join(f"{tag}{i}x{k}" for k in range(n))


def test_nothing_beside_the_heaviest_container_is_lost(spark):
    n = range(8)
    got = texts(spark, [f"<body><article><h1>Head {i}</h1><div class=entry><p>{words(i, 90)}</div>"
                        f"<section><p>{words(i, 10, 'end')}</section></article></body>" for i in n])
    assert got == [f"Head {i}\n{words(i, 90)}\n{words(i, 10, 'end')}" for i in n]
    got = texts(spark, [f"<body><article>{words(i, 50)}<br>{words(i, 50, 'v')}<table><tr><td>cell {i}</table></article></body>" for i in n])
    assert got == [f"{words(i, 50)} {words(i, 50, 'v')}\ncell {i}" for i in n]
    # the container of the text is the second of its label, and on some pages the third
    got = texts(spark, [f"<body><div>Site line</div>{'<div>note of %d</div>' % i if i % 4 == 3 else ''}<div><p>{words(i, 40)}</div></body>" for i in n])
    assert got == [("note of %d\n" % i if i % 4 == 3 else "") + words(i, 40) for i in n]
    got = texts(spark, [f"<body><h1>Head {i}</h1><ul><li><a href=x>link {i}</a></ul><article><p>{words(i, 40)}</article></body>" for i in n])
    assert all(g.startswith(f"Head {i}\n") and g.endswith(words(i, 40)) for i, g in zip(n, got))


@pytest.mark.parametrize("before, after", [
    ("<body><article class='post has-comments'>", "</article>"), ("<body class='right-sidebar nav-open'><div>", "</div>"),
    ("<body class=sidebar><div>", "</div>"), ("<body><article class=share>", "</article>"),
    ("<body><div id='content-with-menu'>", "</div>"), ("<body><div class='share-enabled'>", "</div>"),
    ("<body><div class=share>", "</div>"), ("<body><div class=sidebar><article>", "</article></div>"),
    ("<body><article>", "</article><div class=comments><article class=comment>not this</article></div>"),
])
def test_marks_do_not_take_the_article(spark, before, after):
    got = texts(spark, [f"{before}<h1 class='post-header'>Head {i}</h1><p>{words(i, 40)}<p class='related-text'>End {i}{after}</body>" for i in range(6)])
    assert got == [f"Head {i}\n{words(i, 40)}\nEnd {i}" for i in range(6)]


@pytest.mark.parametrize("around", ["article", "div"])
def test_copies_of_an_article_are_no_template(spark, around):
    copy = f"<h1>One head</h1><p>{words(0, 30)}<p>{words(0, 30, 'v')}"
    pages = [f"<body><div>advert {i} of today</div><{around} class=text>{copy}</{around}><p><a href=x>more {i}</a></body>" for i in range(16)]
    pages += [f"<body><div>advert {i} of today</div><{around} class=text><h1>Head {i}</h1><p>{words(i, 30)}<p>{words(i, 30, 'v')}</{around}></body>" for i in range(2)]
    got = texts(spark, pages)
    assert all(f"One head\n{words(0, 30)}\n{words(0, 30, 'v')}" in g for g in got[:16])
    assert all(f"Head {i}\n{words(i, 30)}\n{words(i, 30, 'v')}" in got[16 + i] for i in range(2))


def test_template_goes_at_its_slot_only(spark):
    line = "<p>Read our terms here</p>"
    got = texts(spark, [f"<body>{line}<article><p>{words(i, 30)}</p>{line if i == 3 else ''}<p>End {i}</article></body>" for i in range(8)])
    assert got == [f"{words(i, 30)}\n" + ("Read our terms here\n" if i == 3 else "") + f"End {i}" for i in range(8)]
    got = texts(spark, [f"<body><p>{words(i, 30)}</p>{line}{line if i == 3 else ''}<p>End {i}</body>" for i in range(8)])
    assert got == [f"{words(i, 30)}\n" + ("Read our terms here\n" if i == 3 else "") + f"End {i}" for i in range(8)]
