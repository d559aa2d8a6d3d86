import re
from html import unescape

from contestry.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a>Menu</a></ul></nav><div class="ad">Buy</div><article><header><h1>Title &amp; more</h1></header>
<p><b>Bold one.<br>two&nbsp;three<p>Second <i>it</i>alic &lt;b&gt;.</p><ul><li>one<li>two</ul><div class="comments"><p>Nice!</p></div>
<form><input value=x>Send</form><pre>a
  b</pre><aside>side</aside><p>Last &copy; x &#228;<!-- no --></p></article><div id="cookie-notice">ok?</div><footer>Foot</footer>"""


def texts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "2 AS blocks")
    return {r.page_id: (r.text, r.n_chars) for r in pages.main_text(frame).collect()}


def test_main_part_of_a_page(spark):
    want = "Title & more Bold one. two three Second italic <b>. one two a b Last © x ä"
    found = texts(spark, [(1, "http://a.example/x", PAGE), (2, None, PAGE), (3, "u", None), (4, "http://a.example", ""), (5, "", "<p>only <div>text"), (6, "http://a.example/x", PAGE)])
    assert found == {1: (want, len(want)), 2: (want, len(want)), 3: ("", 0), 4: ("", 0), 5: ("only text", 9), 6: (want, len(want))}


def test_template_of_a_site_is_removed_and_its_content_stays(spark):
    def page(k):
        return f"<body><div class='x7'>Same words on all pages</div><div class='story'><p>Story {k} tells of {k * k}.</p><p>More {k}</p></div><div class='y'>All rights</div></body>"

    rows = [(k, f"https://site.example/{k}", page(k)) for k in range(12)]
    rows += [(100 + k, "https://site.example/copy", page(3)) for k in range(30)]  # copies do not make a story a template
    rows += [(200 + k, f"https://small.example/{k}", page(k)) for k in range(2)]  # too few pages to tell
    found = texts(spark, rows)
    assert all(found[k][0] == f"Story {k} tells of {k * k}. More {k}" for k in range(12))
    assert all(found[100 + k][0] == found[3][0] for k in range(30))
    assert found[200][0] == "Same words on all pages Story 0 tells of 0. More 0 All rights"


def test_given_pages(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in pages.main_text(given).collect()}
    assert len(found) == given.count()
    for row in given.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", row.html, re.S)[1]
        assert found[row.page_id].split() == unescape(re.sub(r"<[^>]+>", " ", body)).split()


def test_empty_table(spark):
    assert texts(spark, []) == {}


def test_names_drop_neither_an_article_nor_what_holds_it(spark):
    body = "<h1>Head</h1><p>Long story</p>"
    made = [f"<div class='wrap no-sidebar'><article>{body}</article></div>", f"<article class='post has-sidebar'>{body}</article>", f"<main class='search-results'>{body}</main>"]
    made += [f"<div class='content sidebar'>x<article class='sidebar'>{body}</article></div>", f"<main id='search'><div class='widget'><article>{body}</article></div></main>"]
    made += [f"<article><div class='article-header'><h1>Head</h1></div><section id='legal-framework'>Long</section><h2 id='related-work'>story</h2><div class='share'>x</div></article>"]
    made += [f"<main>{body}<div id='comments'><article class='comment'>Nice!</article></div></main>", f"<div class='related'><article>{body}</article></div>", "<div class='ad'>Buy</div>"]
    found = texts(spark, [(k, f"http://h{k}.example/", html) for k, html in enumerate(made)])
    assert [found[k][0] for k in range(len(made))] == ["Head Long story"] * 8 + [""]


def test_a_node_with_text_and_children_has_one_place_in_the_tree(spark):
    page = "<body><article><p class='lead'>Unique {k} <a>x</a></p><div class='box'><section><p class='in'>Own {k}<b>y</b></p></section></div></article>"
    for html in (page, page.replace("article", "div")):
        blocks, nodes = pages.blocks_of(html)
        over = {path: named[-2] if len(named) > 1 else "" for path, named, _ in blocks}
        assert set(over.items()) <= {(path, above) for path, above, _ in nodes}
    found = texts(spark, [(k, f"http://lead.example/{k}", page.replace("{k}", str(k))) for k in range(8)])
    assert all(found[k][0] == f"Unique {k} x Own {k}y" for k in range(8))


def test_unnamed_template_text_inside_an_article_is_removed(spark):
    def page(k):
        return f"<body><div><article><h1>Title {k}</h1><p>Story {k} tells.</p><p>Subscribe to us</p><p>More {k}</p><div><p>Same box</p><p>Same end</p></div>By us</article></div>"

    rows = [(k, f"https://site.example/{k}", page(k)) for k in range(12)]
    rows += [(100 + k, "https://copy.example/", page(3)) for k in range(30)]  # copies of one page are no template
    rows += [(200 + k, f"https://small.example/{k}", page(k)) for k in range(2)]
    rows += [(300, "https://one.example/", "<article>" + "".join(f"<p>Item {k % 3}</p>" for k in range(40)) + "</article>")]
    found = texts(spark, rows)
    assert all(found[k][0] == f"Title {k} Story {k} tells. More {k}" for k in range(12))
    whole = "Title {k} Story {k} tells. Subscribe to us More {k} Same box Same end By us"
    assert all(found[100 + k][0] == whole.format(k=3) for k in range(30))
    assert all(found[200 + k][0] == whole.format(k=k) for k in range(2))
    assert found[300][0].count("Item") == 40
