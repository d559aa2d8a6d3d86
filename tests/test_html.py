import datetime as dt

from contestry.sources import html

PAGE = """<nav><ul><li><a href="/x/1">Event 1</a></li><li><a href="http://w/2"> Two (c)</a></li><li><a href="/3"> </a></li>
<li>unlinked</li><li><a href="/4">Four</a></li></ul></nav>"""


def test_items_and_pairs(spark):
    pages = spark.createDataFrame([(1, "http://w.example/p?q", PAGE), (2, "u", None), (3, None, "<p>none</p>")], "page_id long, url string, html string")
    found = [tuple(r) for r in html.extract_schedule(pages).orderBy("position").collect()]
    assert found == [(1, 0, "Event 1", "http://w.example/x/1"), (1, 1, "Two", "http://w/2"), (1, 2, "Four", "http://w.example/4")]
    assert [tuple(r) for r in html.extract_cards(pages).collect()] == [(1, 0, "Event 1", "Two", True)]


SCHEDULE = """<table id="Past_events"><tr><td><a href="/wiki/Old">Old</a></td><td>May 1, 2020</td></tr></table>
<!-- <table id="Scheduled_events"><tr><td><a href="/x">no</a></td><td>May 1, 2020</td></tr></table> -->
<TABLE class="sortable" id='Scheduled_events'><tr><th>Event</th><th>Date</th></tr>
<tr><td><i><a href="/wiki/A" title="Night A (2026)"> Night&nbsp;A </a></i></td><td><span data-sort-value="7">Jul 05, 2026</span> late</td></tr>
<tr><td>Unlinked</td><td>Jul 5, 2026</td></tr><tr><td><a>Nowhere</a></td><td>Jul 5, 2026</td></tr>
<tr><td><a href="/wiki/B">B</a></td><td>TBD</td></tr><tr><td><a href="/wiki/B">B</a></td></tr>
<tr><td><a href="/wiki/B">B</a></td><td>February 30, 2026</td></tr><tr><td><a href="/wiki/B">B</a></td><td>May 3, 20261</td></tr>
<TR><TD><a href='/wiki/C'>C &amp;lt; D*&#x1F600;/~</a><table><tr><td>in</td><td>ner</td></tr></table><TD>August  9, 2026
<tr><td><a href="/wiki/D">D</a></td><td><table></table>May 3, 2026</td></tr></table>
<table><tr><td><a href="/wiki/Z">Z</a></td><td>May 3, 2026</td></tr></table>"""

CARD = """<table><tr><td>Before</td><td>a</td><td>vs</td><td>b</td></tr></table><div><h2 class="x" id="Fight_card">Fight card</h2></div>
<p>text</p><table><thead><tr><th>Class</th><th></th><th>vs.</th><th></th></tr></thead><tr><td colspan="8">Main card</td></tr>
<tr><td>Light<br>weight </td><td><a href="/a">Jos\u00e9&#32;A&#39;a</a> (c)</td><td> VS. </td><td>B &#xZZ; &unknown; &</td><td>KO</td></tr>
<tr><td>Heavy</td><td>A</td><td>def.</td><td>B</td></tr><tr><td>Heavy</td><td>(c)</td><td>vs.</td><td>B</td></tr>
<tr><td>Heavy</td><td>A</td><td>vs.</td></tr><tr><td></td><td>C<script>var x = "</td>";</script></td><td>vs.</td><td>D (c) </td></tr>
<tr><td>Open</td><td>E (C)</td><td>versus</td><td>F</td></tr><tr><td>Open</td><td>E (C)</td><td>vs</td><td>F"""


def _pages(spark, page):
    rows = [(1, "https://w.example/list?x", page), (2, None, None), (3, "u", ""), (4, "u", "<p>Scheduled_events Fight_card</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rows_of_a_schedule(spark):
    found = [tuple(r)[1:] for r in html.scheduled_events(_pages(spark, SCHEDULE)).orderBy("page_id", "position").collect()]
    title = "C &lt; D*\U0001F600/~"
    assert found == [
        (0, "Night\u00a0A", "Night A (2026)", dt.date(2026, 7, 5), "https://w.example/wiki/Night_A_%282026%29"),
        (1, "D", "D", dt.date(2026, 5, 3), "https://w.example/wiki/D"),
    ]
    closed = SCHEDULE.replace("<table><tr><td>in</td><td>ner</td></tr></table>", "")
    found = html.scheduled_events(_pages(spark, closed)).where("event_name like 'C%'").first()
    assert tuple(found)[1:] == (1, title, title, dt.date(2026, 8, 9), "https://w.example/wiki/C_%26lt%3B_D%2A%F0%9F%98%80/~")


def test_rows_of_a_card(spark):
    found = [tuple(r)[1:] for r in html.card_bouts(_pages(spark, CARD)).orderBy("page_id", "position").collect()]
    assert found == [
        (0, "Jos\u00e9 A'a", "B &#xZZ; &unknown; &", "Lightweight", True, True),
        (1, "C", "D", "", True, False),
        (2, "E (C)", "F", "Open", False, False),
    ]


def test_long_pages_take_time_in_proportion(spark):
    row = "<tr><td>Open</td><td>A &amp; {}</td><td>vs</td><td>B<table><tr><td>x</td></tr></table></td></tr>"
    page = '<h2 id="Fight_card">x</h2>' + " " * 300_000 + "<table>" + "".join(row.format(k) for k in range(20_000))
    found = html.card_bouts(_pages(spark, page))
    assert found.count() == 20_000
    assert found.where("position = 19999").first().competitor_a_name == "A & 19999"
