"""Schedules and cards out of web pages, as column expressions.

A schedule is a page's linked list items, or the rows of its table of events
(``scheduled_events``); a card is its list items taken two by two, or the rows of the
table behind its heading (``card_bouts``).  Rows and cells are cut out of the tags in
page order, on the JVM, in time that grows with the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = r'<li><a href="[^"]*">[^<]*</a></li>'
_HREF = r'href="([^"]*)"'
_TITLE = r">([^<>]*)</a>"


def _title(item: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(item, _TITLE, 1), r"\s*\(c\)\s*$", ""))


def _items(html: Column) -> Column:
    """The page's linked list items in order; those without a title are skipped."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_ITEM), F.lit(0))
    return F.filter(found, lambda item: _title(item) != "")


def extract_schedule(pages: DataFrame) -> DataFrame:
    """(page_id, position, event_name, page_url) per linked list item; links are resolved against the page's site."""
    site = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://[^/?#]+", 0)
    rows = pages.select("page_id", site.alias("site"), F.posexplode(_items(F.col("html"))).alias("position", "item"))
    href = F.regexp_extract("item", _HREF, 1)
    page_url = F.when(href.startswith("/"), F.concat("site", href)).otherwise(href)
    return rows.select("page_id", "position", _title(F.col("item")).alias("event_name"), page_url.alias("page_url"))


def extract_cards(pages: DataFrame) -> DataFrame:
    """(page_id, position, competitor_a_name, competitor_b_name, main_event) per pair of list items; an odd last one is skipped."""
    items = pages.select("page_id", _items(F.col("html")).alias("items"))
    pairs = F.transform(
        F.slice("items", 1, F.floor(F.size("items") / 2).cast("int") * 2),
        lambda item, k: F.when(k % 2 == 0, F.struct(_title(item).alias("a"), _title(F.get("items", k + 1)).alias("b"))),
    )
    rows = items.select("page_id", F.posexplode(F.filter(pairs, lambda p: p.isNotNull())).alias("position", "pair"))
    return rows.select(
        "page_id", "position", F.col("pair.a").alias("competitor_a_name"), F.col("pair.b").alias("competitor_b_name"),
        (F.col("position") == 0).alias("main_event"),
    )


# --- tables of pages ------------------------------------------------------------------------

# The commonest named character references.
_NAMED = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "mdash": "\u2014", "nbsp": "\u00a0", "ndash": "\u2013", "quot": '"'}
# How a schedule spells its dates.
_DATE_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy")
_BLANKS = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_LINK = r"(?is)<a(?=[\s>])([^>]*)>(.*?)(?:</a\b|\z)"
_SPAN = r"(?is)<span(?=[\s>])[^>]*>(.*?)(?:</span\b|\z)"
_CHAMPION = "(c)"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _decoded(text: Column) -> Column:
    """Character references as characters, each once; one that names no character stays as it is."""
    named = F.create_map(*[F.lit(x) for name, char in _NAMED.items() for x in (f"&{name};", char)])

    def plain(token: Column) -> Column:
        decimal = F.regexp_extract(token, r"^&#([0-9]{1,7});$", 1).try_cast("int")
        code = F.coalesce(decimal, F.conv(F.regexp_extract(token, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1), 16, 10).try_cast("int"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        known = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), char)
        return F.when(token.startswith("&"), F.coalesce(known, F.try_element_at(named, token), token)).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit(r"&#?[0-9A-Za-z]{1,8};|[^&]+|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(tokens, plain), "")).otherwise(text)


def _text(fragment: Column) -> Column:
    """The fragment's texts between tags, each trimmed, without anything between them."""
    texts = F.transform(F.split(fragment, "<[^>]*>"), lambda piece: _strip(_decoded(piece)))
    return F.array_join(texts, "")


def _attribute(attributes: Column, name: str) -> Column:
    """The quoted value of an attribute; empty if there is none."""
    return _decoded(F.regexp_extract(attributes, rf"(?is)\s{name}\s*=\s*([\"'])(.*?)\1", 2))


def _marked(name: str) -> str:
    return rf"\sid\s*=\s*[\"']?{name}(?=[\"'\s>])[^>]*>"


def _up_to_close(inside: Column) -> Column:
    """What stands in an open table before its end, the tables within it included."""
    pieces = F.split(inside, r"(?i)(?=</?table\b)")
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.rlike(r"(?i)^<table\b"), 1).when(piece.rlike(r"(?i)^</table\b"), -1).otherwise(0)
        inner = F.struct(depth.alias("depth"), (state["n"] + (depth > 0).cast("int")).alias("n"))
        return F.when(state["depth"] > 0, inner).otherwise(state)

    return F.array_join(F.slice(pieces, F.lit(1), F.aggregate(pieces, start, step)["n"]), "")


def _rows(table: Column) -> Column:
    """Each row's data cells as markup; a row ends at its closing tag or the next row, a cell likewise."""

    def behind_first(parts: Column) -> Column:
        return F.slice(parts, F.lit(2), F.size(parts))

    def cells(row: Column) -> Column:
        own = F.get(F.split(row, r"(?i)</tr\b", 2), F.lit(0))
        parts = behind_first(F.split(own, r"(?i)<td(?=[\s>/])[^>]*>"))
        return F.transform(parts, lambda cell: F.get(F.split(cell, r"(?i)</td\b|<th\b", 2), F.lit(0)))

    return F.transform(behind_first(F.split(table, r"(?i)<tr(?=[\s>/])")), cells)


def _table_rows(html: Column, opening: str) -> Column:
    """Rows of the table that ``opening`` finds; none without it."""
    shown = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), _HIDDEN, "")
    return _rows(_up_to_close(F.regexp_extract(shown, f"(?is){opening}(.*)", 1)))


def _day(text: Column) -> Column:
    spelt = F.regexp_replace(text, r"\s+", " ")
    tries = F.coalesce(*[F.try_to_timestamp(spelt, F.lit(f)) for f in _DATE_FORMATS])
    return F.when(spelt.rlike(r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$"), tries.cast("date"))


def _encoded(title: Column) -> Column:
    """A page's title as the end of its address."""
    address = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for had, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        address = F.replace(address, F.lit(had), F.lit(wanted))
    return address


def scheduled_events(pages: DataFrame, table_id: str = "Scheduled_events", folder: str = "/wiki/") -> DataFrame:
    """(page_id, position, event_name, wiki_title, date, page_url) per row of the table with that id, in page order.

    The first cell's first link names the event, its title (else its text) the event's page
    on the same site; the second cell's first span, or its whole text, is the date.  Rows
    with fewer than two data cells, without a link that leads anywhere or with a date that
    can't be read are skipped.  A null page and one without the table give no rows.
    """
    rows = F.filter(_table_rows(F.col("html"), r"<table\b[^>]*?" + _marked(table_id)), lambda row: F.size(row) >= 2)

    def event(row: Column) -> Column:
        name, when = F.get(row, F.lit(0)), F.get(row, F.lit(1))
        attributes = F.regexp_extract(name, _LINK, 1)
        span = F.when(when.rlike(_SPAN), F.regexp_extract(when, _SPAN, 1)).otherwise(when)
        return F.struct(
            _text(F.regexp_extract(name, _LINK, 2)).alias("event_name"), _attribute(attributes, "href").alias("href"),
            _attribute(attributes, "title").alias("title"), _day(_text(span)).alias("date"),
        )

    kept = F.filter(F.transform(rows, event), lambda e: (e["href"] != "") & e["date"].isNotNull())
    site = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://[^/?#]+", 0)
    found = pages.select("page_id", site.alias("site"), F.posexplode(kept).alias("position", "event"))
    title = F.coalesce(F.nullif(F.col("event.title"), F.lit("")), "event.event_name")
    return found.select(
        "page_id", "position", "event.event_name", title.alias("wiki_title"), "event.date",
        F.concat("site", F.lit(folder), _encoded(title)).alias("page_url"),
    )


def card_bouts(pages: DataFrame, heading_id: str = "Fight_card") -> DataFrame:
    """(page_id, position, competitor_a_name, competitor_b_name, weight_class, title_fight, main_event) per bout.

    Bouts are the rows of the first table behind the element with that id that have at
    least four data cells: class, name, "vs", name.  A champion's mark at the end of a
    name goes and makes the bout a title fight.  Other rows and those without both names
    are skipped; the first bout left is the main event.  A null page and one without the
    heading or a table behind it give no rows.
    """
    rows = _table_rows(F.col("html"), r"<[a-z][^>]*?" + _marked(heading_id) + r".*?<table\b[^>]*>")
    texts = F.transform(F.filter(rows, lambda row: F.size(row) >= 4), lambda row: F.transform(F.slice(row, 1, 4), _text))

    def name(text: Column) -> Column:
        bare = F.left(text, F.char_length(text) - len(_CHAMPION))
        return F.when(text.endswith(_CHAMPION), _strip(bare)).otherwise(text)

    def bout(row: Column) -> Column:
        a, b = F.get(row, F.lit(1)), F.get(row, F.lit(3))
        return F.struct(
            name(a).alias("competitor_a_name"), name(b).alias("competitor_b_name"), F.get(row, F.lit(0)).alias("weight_class"),
            (a.endswith(_CHAMPION) | b.endswith(_CHAMPION)).alias("title_fight"),
        )

    against = F.filter(texts, lambda row: F.lower(F.get(row, F.lit(2))).contains("vs"))
    kept = F.filter(F.transform(against, bout), lambda x: (x["competitor_a_name"] != "") & (x["competitor_b_name"] != ""))
    found = pages.select("page_id", F.posexplode(kept).alias("position", "bout"))
    return found.select("page_id", "position", "bout.*", (F.col("position") == 0).alias("main_event"))
