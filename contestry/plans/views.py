"""The contest tables, derived from the order tables at hand.

Orders are paired inside (week, block of order keys) in date order: an odd row
is side a, the next row side b.  A block spans 2^20 unique order keys, so no
window ever holds more rows than that, whatever the date skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.operators import dataset

KEY_BLOCK = 1 << 20
CARD_SIZE = 12

# Division texts assigned to contests in turn.
DIVISIONS = (
    "Women's Strawweight Bout",
    "Light Heavyweight Title Bout",
    "Heavyweight Bout",
    "lightweight bout",
    "Catchweight Bout",
    "Middleweight Bout",
    "Bantamweight Title Bout",
    "Open Weight Bout",
    "--",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_id(key: Column) -> Column:
    return F.lower(F.lpad(F.hex(key), 16, "0"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired orders: the a_ and b_ columns of the two orders, week and card."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("priority"),
    )
    week = F.date_sub("day", F.weekday("day")).alias("week")
    block = F.floor(F.col("order") / KEY_BLOCK).alias("block")
    w = Window.partitionBy("week", "block").orderBy("day", "order")
    return (
        orders.select("*", week, block)
        .select(
            "week",
            "block",
            "priority",
            F.row_number().over(w).alias("rn"),
            *[F.col(c).alias(f"a_{c}") for c in ("order", "cust", "status", "price", "day")],
            *[F.lead(c).over(w).alias(f"b_{c}") for c in ("order", "cust", "status", "price", "day")],
        )
        .filter(
            (F.col("rn") % 2 == 1) & F.col("b_order").isNotNull() & (F.col("a_cust") != F.col("b_cust"))
        )
        .withColumn("bout", F.floor((F.col("rn") - 1) / 2))
        .withColumn("card", F.floor(F.col("bout") / CARD_SIZE))
    )


def raw_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests in raw spelling: text dates, division text, winner id, last-round clock."""
    p = pairs(spark, sf_dir)
    a, b = F.col("a_order"), F.col("b_order")
    tied = F.col("a_status") == F.col("b_status")
    planned = F.when(a % 7 == 0, 5).otherwise(3)
    level = F.substring("priority", 1, 1)
    method = (
        F.when(tied & (F.col("a_status") == "P"), "Overturned")
        .when(level == "1", "KO/TKO")
        .when(level == "2", "Submission")
        .when(level == "3", "Decision - Split")
        .when(level == "4", "Decision - Unanimous")
        .otherwise("DQ")
    )
    winner = F.when(F.col("a_price") > F.col("b_price"), F.col("a_cust")).otherwise(F.col("b_cust"))
    day = F.col("b_day")
    return p.select(
        hex_id(a).alias("contest_id"),
        F.when(a % 2 == 0, F.date_format(day, "yyyy/MM/dd"))
        .otherwise(F.date_format(day, "MMM d, yyyy"))
        .alias("date"),
        hex_id(F.col("a_cust")).alias("r_id"),
        hex_id(F.col("b_cust")).alias("b_id"),
        F.when(tied & F.col("a_status").isin("P", "O"), None)
        .otherwise(F.concat(F.lit(" "), hex_id(winner)))
        .alias("winner_id"),
        method.alias("method"),
        (a % planned + 1).cast("string").alias("finish_round"),
        F.when(a % 31 == 0, "unknown").otherwise(planned.cast("string")).alias("total_rounds"),
        F.element_at(F.array(*[F.lit(d) for d in DIVISIONS]), (a % 9 + 1).cast("int")).alias("division"),
        F.when(a % 13 != 0, (a % 7 == 0).cast("int").cast("string")).alias("title_fight"),
        (b % 300).cast("string").alias("match_time_sec"),
        "a_order",
        "b_order",
        "week",
        "block",
        "card",
        "bout",
    )


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.build_contests(raw_contests(spark, sf_dir))


def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line totals per order, all whole numbers held as doubles."""
    q, n = F.sum("l_quantity"), F.count("*")
    stats = {
        "kd": F.count_if(F.col("l_quantity") > 45),
        "sig_landed": q,
        "sig_attempted": q + F.sum("l_linenumber"),
        "total_landed": q + n,
        "total_attempted": q + n + F.sum("l_linenumber"),
        "td_landed": F.count_if(F.col("l_returnflag") == "R"),
        "td_attempted": n,
        "sub_att": F.count_if(F.col("l_linestatus") == "F"),
        "ctrl_sec": F.sum(F.round(F.col("l_discount") * 100).cast("int")) * 10,
    }
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order"))
        .agg(*[agg.cast("double").alias(name) for name, agg in stats.items()])
    )


def _side_orders(raw: DataFrame, *keep: str) -> DataFrame:
    def one(letter: str, prefix: str) -> Column:
        return F.struct(
            F.col(f"{prefix}id").alias("competitor_id"),
            F.lit(letter).alias("side"),
            F.col(f"{letter}_order").alias("order"),
        )

    return raw.select("contest_id", *keep, F.inline(F.array(one("a", "r_"), one("b", "b_"))))


def side_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per contest; all null for a side whose order has no lines."""
    side_orders = _side_orders(raw_contests(spark, sf_dir))
    return side_orders.join(order_stats(spark, sf_dir), "order", "left").drop("order")


def raw_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw contest table with both sides' statistics in r_ and b_ columns."""
    raw, stats = raw_contests(spark, sf_dir), order_stats(spark, sf_dir)

    def side(prefix: str, letter: str) -> DataFrame:
        renamed = [
            F.col(out).cast("string").alias(prefix + raw_name)
            for out, raw_name in dataset.STAT_SUFFIXES.items()
        ]
        return stats.select(F.col("order").alias(f"{letter}_order"), *renamed)

    return raw.join(side("r_", "a"), "a_order", "left").join(side("b_", "b"), "b_order", "left")


def raw_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw competitor rows: text numbers, padded names, gaps."""
    key = F.col("c_custkey")
    name = (
        F.when(key % 17 == 0, None)
        .when(key % 13 == 0, F.concat(F.lit("Gemel "), F.floor(key / 26).cast("string")))
        .when(key % 5 == 0, F.concat(F.lit("José "), F.col("c_name")))
        .otherwise(F.concat(F.lit("  "), F.col("c_name")))
    )
    born = F.date_add(F.lit("1960-01-01").cast("date"), (key % 14000).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.concat(hex_id(key), F.lit(" ")).alias("id"),
        name.alias("name"),
        F.when(key % 19 == 0, "n/a").otherwise((150 + key % 60).cast("string")).alias("height"),
        F.when(key % 7 == 0, None).otherwise((150 + key * 37 % 60).cast("string")).alias("reach"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Southpaw")
        .when(F.col("c_mktsegment") != "FURNITURE", "Orthodox")
        .alias("stance"),
        F.when(key % 11 == 0, "--").otherwise(F.date_format(born, "MMM d, yyyy")).alias("dob"),
    )


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.build_competitors(raw_competitors(spark, sf_dir))


def listed_name(key: Column) -> Column:
    """A competitor's name as an outside list spells it: accents dropped, case changed."""
    plain = F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))
    return (
        F.when(key % 17 == 0, F.concat(F.lit("Unknown "), plain))
        .when(key % 13 == 0, F.concat(F.lit("Gemel "), F.floor(key / 26).cast("string")))
        .when(key % 5 == 0, F.concat(F.lit("Jose "), plain))
        .when(key % 7 == 3, F.upper(plain))
        .otherwise(plain)
    )


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (contest, line number): a book's prices for the two listed sides.

    The first listed side is b for every third contest; every fifth contest and
    the first book carry no competitor links, only names.
    """
    p = pairs(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("book")
    ).agg((F.lit(1.1) + 40 * F.max("l_discount")).alias("odds"))

    def one(letter: str) -> Column:
        return F.struct(F.lit(letter).alias("side"), F.col(f"{letter}_order").alias("order"))

    by_side = p.select("a_order", "a_cust", "b_cust", F.inline(F.array(one("a"), one("b"))))
    odds = (
        by_side.join(lines, "order")
        .groupBy("a_order", "a_cust", "b_cust", "book")
        .agg(
            F.max(F.when(F.col("side") == "a", F.col("odds"))).alias("odds_a"),
            F.max(F.when(F.col("side") == "b", F.col("odds"))).alias("odds_b"),
        )
    )
    flipped = F.col("a_order") % 3 == 0
    linked = (F.col("a_order") % 5 != 0) & (F.col("book") != 1)

    def listed(when_flipped: str, otherwise: str) -> Column:
        return F.when(flipped, F.col(when_flipped)).otherwise(F.col(otherwise))

    first, second = listed("b_cust", "a_cust"), listed("a_cust", "b_cust")
    url = F.lit("http://stats.example.org/competitor/")
    return odds.select(
        F.concat(F.lit("http://stats.example.org/contest/"), hex_id(F.col("a_order")), F.lit("/")).alias(
            "contest_url"
        ),
        F.col("book").alias("load_order"),
        listed_name(first).alias("competitor_1"),
        listed_name(second).alias("competitor_2"),
        F.when(linked, F.concat(url, hex_id(first))).alias("competitor_1_url"),
        F.when(linked, F.concat(url, hex_id(second))).alias("competitor_2_url"),
        listed("odds_b", "odds_a").alias("odds_1"),
        listed("odds_a", "odds_b").alias("odds_2"),
    )


def event_name(week: Column, block: Column, card: Column) -> Column:
    return F.concat(
        F.lit("Open Night: "), week.cast("string"), F.lit(" / "),
        block.cast("string"), F.lit("."), card.cast("string"),
    )


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upcoming cards: every pairing listed on a card of at most twelve bouts."""
    p = pairs(spark, sf_dir)
    shift = (F.col("card") + F.weekofyear("week")) % 7
    a, b = F.col("a_cust"), F.col("b_cust")
    flipped = F.col("a_order") % 3 == 0
    return p.select(
        event_name(F.col("week"), F.col("block"), F.col("card")).alias("event_name"),
        F.date_add("week", shift.cast("int")).alias("event_date"),
        (F.col("bout") % CARD_SIZE).cast("int").alias("position"),
        hex_id(F.col("a_order")).alias("contest_id"),
        "a_order",
        listed_name(F.when(flipped, b).otherwise(a)).alias("competitor_a_name"),
        listed_name(F.when(flipped, a).otherwise(b)).alias("competitor_b_name"),
        F.when(F.col("a_order") % 9 != 8, F.lit("Lightweight")).alias("weight_class"),
        (F.col("a_order") % 7 == 0).alias("title_fight"),
        (F.col("bout") % CARD_SIZE == 0).alias("main_event"),
        "week",
        "block",
        "card",
    )


def _markup(text: Column) -> Column:
    """Text as a page's source spells it."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("#"), F.lit("&#35;"))


def _joined(rows: Column, *order: str) -> Column:
    """The group's rows in order as one text; a card or a schedule is bounded (twelve bouts, one block's events of a week)."""
    placed = F.array_sort(F.collect_list(F.struct(*order, rows.alias("row"))))
    return F.array_join(F.transform(placed, lambda r: r["row"]), "\n")


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html) per event: its card behind a heading, among other tables.

    A title fight has the champion's mark at one of its names; every eleventh bout is
    listed as settled and not as "vs"; some rows have capital tags that never close,
    some a table in their last cell.
    """
    order, champion = F.col("a_order"), F.lit(" <small>(c)</small>")

    def name(column: str, rest: int) -> Column:
        link = F.concat(F.lit('<a href="/wiki/x">'), _markup(F.col(column)), F.lit("</a>"))
        return F.when(F.col("title_fight") & (order % 2 == rest), F.concat(link, champion)).otherwise(link)

    against = F.when(order % 11 == 3, "def.").when(order % 3 == 0, "VS").otherwise(" vs. ")
    cells = (F.coalesce("weight_class", F.lit("")), name("competitor_a_name", 0), against, name("competitor_b_name", 1))
    notes = F.when(order % 4 == 0, "<table><tr><td>note</td><td>1</td></tr></table>").otherwise("")
    closed = F.concat(F.lit("<tr><td>"), F.concat_ws("</td>\n<td>", *cells, notes), F.lit("</td></tr>"))
    opened = F.concat(F.lit("<TR><TD align=left>"), F.concat_ws("<TD>", *cells))
    rows = F.when(order % 5 == 1, opened).otherwise(closed)
    head = (
        '<!DOCTYPE html><html><body><table class="infobox"><tr><td>No</td><td>a</td><td>vs.</td><td>b</td></tr></table>'
        '<div class="heading"><h2 id="Fight_card">Fight card</h2></div><!-- <table><tr><td>No</td></tr></table> -->'
        '<table class="card"><tr><th>Class</th><th></th><th>vs.</th><th></th></tr><tr><th colspan="8">Main card</th></tr>'
    )
    tail = "</table><table><tr><td>No</td><td>a</td><td>vs.</td><td>b</td></tr></table></body></html>"
    pages = bouts(spark, sf_dir).groupBy("event_name").agg(_joined(rows, "position", "a_order").alias("rows"))
    return pages.select(
        F.col("event_name").alias("page_id"), F.lit("https://wiki.example.org/wiki/x").alias("url"),
        F.concat(F.lit(head), "rows", F.lit(tail)).alias("html"),
    )


def schedule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html) per week and block: a table of its events.

    Events on days divisible by five have no link and those whose day leaves three of
    seven no date; month names are long on even days, link titles absent on days
    divisible by three.
    """
    day, date = F.day("event_date"), F.col("event_date")
    title = F.when(day % 3 == 0, "").otherwise(F.concat(F.lit(' title="'), _markup(F.col("event_name")), F.lit('"')))
    link = F.concat(F.lit('<i><a href="/wiki/x"'), title, F.lit(">"), _markup(F.col("event_name")), F.lit("</a></i>"))
    name = F.when(day % 5 == 0, _markup(F.col("event_name"))).otherwise(link)
    spelt = F.when(day % 2 == 0, F.date_format(date, "MMMM d, yyyy")).otherwise(F.date_format(date, "MMM dd, yyyy"))
    when = F.when(day % 7 == 3, "TBD").when(day % 3 == 1, spelt).otherwise(F.concat(F.lit("<span>"), spelt, F.lit("</span> (local)")))
    rows = F.concat(F.lit("<tr><td>"), name, F.lit("</td><td>"), when, F.lit("</td><td>Hall</td></tr>"))
    events = bouts(spark, sf_dir).select("week", "block", "card", "event_name", "event_date").distinct()
    pages = events.groupBy("week", "block").agg(_joined(rows, "event_date", "card").alias("rows"))
    head = '<html><body><table id="Past_events"><tr><td><a href="/wiki/o">Old</a></td><td>May 1, 1990</td></tr></table>'
    table = '<table class="sortable" id="Scheduled_events"><tr><th>Event</th><th>Date</th></tr>'
    return pages.select(
        F.concat_ws("/", F.col("week").cast("string"), F.col("block").cast("string")).alias("page_id"),
        F.lit("https://wiki.example.org/wiki/List?x=1").alias("url"),
        F.concat(F.lit(head), F.lit(table), "rows", F.lit("</table></body></html>")).alias("html"),
    )
