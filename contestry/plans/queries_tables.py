"""Registered queries: sources, cleaning, checks, ratings, history, features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.functions import labels, names, odds, parsing, probability, rating
from contestry.operators import dataset, features, history, learn, predictions, ratings
from contestry.operators.careers import STAT_NAMES
from contestry.plans import sql_more, views  # noqa: F401  (sql_more adds SQL blocks)
from contestry.plans.oracle import r6 as q6
from contestry.plans.registry import (
    TEST_START, TODAY, TRAIN_END, VAL, Tables, r6, register, rounded,
)
from contestry.session import scratch_path
from contestry.sources import documents, event_files, html, tables

_DAY = "CAST(date AS VARCHAR)"
_CONTEST_SQL = f"""
SELECT contest_id, {_DAY} AS date, a_id AS competitor_a_id, b_id AS competitor_b_id, winner, method, method_raw,
       decision_subtype, CAST(finish_round AS BIGINT) AS finish_round,
       CAST(scheduled_rounds AS BIGINT) AS scheduled_rounds, weight_class, title_fight, duration_sec FROM contests"""
_STATS_SQL = "SELECT * FROM side_stats"


def _train(df):
    return learn.split(df, "train", train_end=TRAIN_END)


# --- sources ---------------------------------------------------------------------------


@register("clean_contests", _CONTEST_SQL)
def _(t: Tables):
    return rounded(views.contests(t.spark, t.sf_dir))


@register("csv_contests", _CONTEST_SQL)
def _(t: Tables):
    path = scratch_path(t.spark, "raw-contests")
    raw = views.raw_wide(t.spark, t.sf_dir)
    tables.write_csv(raw.select(*[f.name for f in tables.RAW_CONTESTS.fields]), path)
    return rounded(dataset.build_contests(tables.read_csv(t.spark, path, tables.RAW_CONTESTS)))


@register("wide_to_side_stats", _STATS_SQL)
def _(t: Tables):
    return dataset.build_side_stats(views.raw_wide(t.spark, t.sf_dir))


@register("side_stats", _STATS_SQL)
def _(t: Tables):
    return views.side_stats(t.spark, t.sf_dir)


@register(
    "csv_competitors",
    "SELECT competitor_id, name, height_cm, reach_cm, stance, CAST(dob AS VARCHAR) AS dob FROM competitors",
)
def _(t: Tables):
    path = scratch_path(t.spark, "raw-competitors")
    tables.write_csv(views.raw_competitors(t.spark, t.sf_dir), path)
    return rounded(dataset.build_competitors(tables.read_csv(t.spark, path, tables.RAW_COMPETITORS)))


@register(
    "csv_quotes",
    f"""SELECT contest_id, f1_id, f2_id, CAST(load_order AS BIGINT) AS load_order, competitor_1, competitor_2,
        {q6('odds_1')} AS odds_1, {q6('odds_2')} AS odds_2 FROM raw_quotes""",
)
def _(t: Tables):
    from contestry.operators import market

    path = scratch_path(t.spark, "raw-quotes")
    tables.write_csv(t.quotes, path)
    quotes = market.with_ids(tables.typed_quotes(tables.read_csv(t.spark, path, tables.RAW_QUOTES)))
    return rounded(
        quotes.select("contest_id", "f1_id", "f2_id", "load_order", "competitor_1", "competitor_2", "odds_1", "odds_2")
    )


@register(
    "parquet_tables",
    "SELECT year(date) AS year, winner, count(*) AS n, count(method) AS n_method FROM contests GROUP BY ALL",
)
def _(t: Tables):
    path = scratch_path(t.spark, "contests")
    tables.write_table(t.contests, path, order_by=tables.ORDER["contests"])
    stored = tables.read_table(t.spark, path, t.contests.schema)
    return stored.groupBy(F.year("date").cast("bigint").alias("year"), "winner").agg(
        F.count("*").alias("n"), F.count("method").alias("n_method")
    )


_LOG_COLUMNS = """event_name, CAST(event_date AS VARCHAR) AS event_date, CAST(position AS BIGINT) AS position,
  name_a AS competitor_a_name, name_b AS competitor_b_name, weight_class, skipped, reason, a_id AS competitor_a_id,
  b_id AS competitor_b_id, match_tier, title_fight, CAST(scheduled_rounds AS BIGINT) AS scheduled_rounds,
  {p} AS p_a_wins, {a} AS elo_a, {b} AS elo_b, predicted_at_utc, model_version""".format(
    p=q6("p_a_wins"), a=q6("elo_a"), b=q6("elo_b")
)
LOG_FIELDS = (
    "event_name event_date position competitor_a_name competitor_b_name weight_class skipped reason "
    "competitor_a_id competitor_b_id match_tier title_fight scheduled_rounds p_a_wins elo_a elo_b "
    "predicted_at_utc model_version"
).split()


@register("json_log", f"SELECT {_LOG_COLUMNS} FROM log")
def _(t: Tables):
    path = scratch_path(t.spark, "log-documents")
    documents.write_log(t.log, path)
    return rounded(documents.read_log(t.spark, path).select(*LOG_FIELDS))


_SHARES_SQL = ", ".join(
    f"CASE WHEN NOT skipped THEN {p} END AS {name}"
    for name, p in {
        "p_ko_tko": "0.3::DOUBLE", "p_submission": "0.2::DOUBLE", "p_decision": "0.5::DOUBLE",
        "p_round_1": "CASE WHEN scheduled_rounds <= 3 THEN 0.5 ELSE 0.4 END::DOUBLE",
        "p_round_2": "CASE WHEN scheduled_rounds <= 3 THEN 0.3 ELSE 0.24 END::DOUBLE",
        "p_round_3": "CASE WHEN scheduled_rounds <= 3 THEN 0.2 ELSE 0.16 END::DOUBLE",
        "p_round_45": "CASE WHEN scheduled_rounds <= 3 THEN 0.0 ELSE 0.2 END::DOUBLE",
    }.items()
)
_SLUG_SQL = "'EVENT_' || trim(regexp_replace(event_name, '[^A-Za-z0-9]+', '_', 'g'), '_') || '_' || event_date || '.json'"


@register(
    "event_files",
    f"""SELECT {_SLUG_SQL} AS file_name,
               {_LOG_COLUMNS.replace("match_tier", "CASE WHEN day(event_date) % 2 = 0 THEN match_tier END AS match_tier").replace("model_version", "CASE WHEN day(event_date) % 5 = 0 THEN 'next' ELSE model_version END AS model_version")},
               {_SHARES_SQL}, CASE WHEN day(event_date) % 5 = 0 THEN '"' || position || ' of the card"' END AS place
        FROM log""",
)
def _(t: Tables):
    """Events written one file each, some rewritten by a later writer, all read back.

    The first writer does not know ``match_tier`` on odd days; the later one adds a field.
    """
    folder, day = scratch_path(t.spark, "event-files"), F.dayofmonth("event_date")
    first = t.log.withColumn("match_tier", F.when(day % 2 == 0, F.col("match_tier")))
    event_files.write_event_files(first, folder)
    later = documents.log_documents(first.filter(day % 5 == 0).withColumn("model_version", F.lit("next")))
    fights = F.transform("fights", lambda f: f.withField("place", F.concat(f["position"].cast("string"), F.lit(" of the card"))))
    rows = later.withColumn("fights", fights)
    fields = [c for c in rows.columns if c != "file_name"]
    rows.select("file_name", F.to_json(F.struct(*fields)).alias("document")).write.format(event_files.FORMAT).mode("append").save(folder)
    read = documents.flatten_documents(event_files.read_event_files(t.spark, folder))
    shares = {f"p_{c}": F.col("method_probs")[c] for c in labels.METHODS} | {f"p_round_{c}": F.col("round_probs")[c] for c in labels.ROUND_CLASSES}
    return rounded(read.select("file_name", *LOG_FIELDS, *[v.alias(k) for k, v in shares.items()], F.col("more")["place"].alias("place")))


@register(
    "log_documents",
    """SELECT 'EVENT_' || trim(regexp_replace(event_name, '[^A-Za-z0-9]+', '_', 'g'), '_') || '_' || event_date || '.json'
              AS file_name, event_name, CAST(event_date AS VARCHAR) AS event_date, count(*) AS n_fights,
              min(predicted_at_utc) AS predicted_at_utc, min(model_version) AS model_version,
              string_agg(name_a, '|' ORDER BY position) AS listed
       FROM log GROUP BY event_name, event_date""",
)
def _(t: Tables):
    return documents.log_documents(t.log).select(
        "file_name",
        "event_name",
        "event_date",
        F.size("fights").cast("bigint").alias("n_fights"),
        "predicted_at_utc",
        "model_version",
        F.array_join(F.transform("fights", lambda f: f["competitor_a_name"]), "|").alias("listed"),
    )


@register(
    "metric_document",
    """SELECT '{"model":"' || model || '","n":' || n || ',"hits":' || hits || '}' AS document FROM (
         SELECT 'coin_flip' AS model, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits FROM scored
         UNION ALL SELECT 'elo', count(*), count(*) FILTER ((p >= 0.5) = (y = 1)) FROM scored)""",
)
def _(t: Tables):
    scored = _scored(t)
    models = F.array(
        F.struct(F.lit("coin_flip").alias("model"), F.lit(0.5).alias("q")),
        F.struct(F.lit("elo").alias("model"), F.col("p").alias("q")),
    )
    counted = scored.select("y", F.inline(models)).groupBy("model").agg(
        F.count("*").alias("n"), F.sum(probability.hit(F.col("y"), F.col("q"))).cast("bigint").alias("hits")
    )
    return documents.metric_document(counted)


_ITEMS_SQL = """
page_items AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^[A-Za-z]+://[^/?#]+') AS site,
         list_filter(regexp_extract_all(coalesce(html, ''), '<li><a href="[^"]*">[^<]*</a></li>'),
                     lambda x: regexp_matches(x, '>\\s*[^<>\\s][^<>]*</a>')) AS found
  FROM pages),
item_places AS (SELECT page_id, site, found, unnest(range(len(found))) AS position FROM page_items),
titled AS (
  SELECT page_id, site, position, len(found) AS n, regexp_extract(found[position + 1], 'href="([^"]*)"', 1) AS href,
         trim(regexp_replace(regexp_extract(found[position + 1], '>([^<>]*)</a>', 1), '\\s*\\(c\\)\\s*$', '')) AS title
  FROM item_places)
"""


@register(
    "schedule_pages",
    f"""WITH {_ITEMS_SQL} SELECT page_id, CAST(position AS INTEGER) AS position, title AS event_name,
               CASE WHEN href LIKE '/%' THEN site || href ELSE href END AS page_url FROM titled""",
)
def _(t: Tables):
    return rounded(html.extract_schedule(t.table("pages")))


@register(
    "card_pages",
    f"""WITH {_ITEMS_SQL} SELECT page_id, CAST(a.position // 2 AS INTEGER) AS position, a.title AS competitor_a_name,
               b.title AS competitor_b_name, a.position = 0 AS main_event
        FROM titled a JOIN titled b USING (page_id) WHERE a.position % 2 = 0 AND b.position = a.position + 1""",
)
def _(t: Tables):
    return rounded(html.extract_cards(t.table("pages")))


_SCHEDULE_SQL = """
SELECT week || '/' || block AS page_id, CAST(row_number() OVER (PARTITION BY week, block ORDER BY event_date, card) - 1 AS BIGINT) AS position,
       event_name, event_name AS wiki_title, event_date AS day,
       'https://wiki.example.org/wiki/' || replace(replace(event_name, ' ', '_'), ':', '%3A') AS page_url
FROM (SELECT DISTINCT week, block, card, event_name, event_date FROM bouts)
WHERE day(event_date) % 5 <> 0 AND day(event_date) % 7 <> 3"""


@register("schedule_tables", f"SELECT * EXCLUDE (day), CAST(day AS VARCHAR) AS date FROM ({_SCHEDULE_SQL})")
def _(t: Tables):
    return rounded(html.scheduled_events(views.schedule_pages(t.spark, t.sf_dir)))


@register(
    "upcoming_from_pages",
    f"""SELECT event_name, CAST(day AS VARCHAR) AS date, page_url FROM ({_SCHEDULE_SQL})
        WHERE day BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 30""",
)
def _(t: Tables):
    events = html.scheduled_events(views.schedule_pages(t.spark, t.sf_dir)).select("event_name", "date", "page_url")
    return rounded(predictions.upcoming(events, F.lit(TODAY).cast("date"), 30))


@register(
    "card_tables",
    """SELECT event_name AS page_id, row_number() OVER w - 1 AS position, name_a AS competitor_a_name, name_b AS competitor_b_name,
              coalesce(weight_class, '') AS weight_class, title_fight, row_number() OVER w = 1 AS main_event
       FROM bouts WHERE a_order % 11 <> 3 WINDOW w AS (PARTITION BY event_name ORDER BY position)""",
)
def _(t: Tables):
    return rounded(html.card_bouts(views.card_pages(t.spark, t.sf_dir)))


@register(
    "schema_report",
    """SELECT 'customer' AS source, p AS position, c AS "column", ty AS type, n AS n_rows, v AS n_values, lo AS smallest,
              hi AS largest FROM (
         SELECT 0::BIGINT AS p, 'c_custkey' AS c, 'bigint' AS ty, count(*) AS n, count(c_custkey) AS v,
                CAST(min(c_custkey) AS VARCHAR) AS lo, CAST(max(c_custkey) AS VARCHAR) AS hi FROM customer
         UNION ALL SELECT 1, 'c_name', 'string', count(*), count(c_name), min(c_name), max(c_name) FROM customer
         UNION ALL SELECT 2, 'c_nationkey', 'int', count(*), count(c_nationkey), CAST(min(c_nationkey) AS VARCHAR),
                CAST(max(c_nationkey) AS VARCHAR) FROM customer
         UNION ALL SELECT 3, 'c_acctbal', 'double', count(*), count(c_acctbal), CAST(min(c_acctbal) AS VARCHAR),
                CAST(max(c_acctbal) AS VARCHAR) FROM customer
         UNION ALL SELECT 4, 'c_mktsegment', 'string', count(*), count(c_mktsegment), min(c_mktsegment),
                max(c_mktsegment) FROM customer)""",
)
def _(t: Tables):
    return rounded(tables.schema_report(t.table("customer"), "customer"))


# The tables given.
GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _profile_sql(name: str) -> str:
    """Counts and ends per column; the ends of whole numbers and short texts only, which both engines spell alike."""

    def long_form(what: str, alias: str) -> str:
        return f"""SELECT * FROM (SELECT {what} FROM {name}) UNPIVOT INCLUDE NULLS ({alias} FOR "column" IN (COLUMNS(*)))"""

    kinds = f"(SELECT column_name AS \"column\", column_type AS kind FROM (DESCRIBE {name}))"
    return f"""
SELECT '{name}' AS source, "column", (SELECT count(*) FROM {name}) AS n_rows, n_values,
       CASE WHEN kind IN ('BIGINT', 'INTEGER', 'VARCHAR') THEN smallest END AS smallest,
       CASE WHEN kind IN ('BIGINT', 'INTEGER', 'VARCHAR') THEN largest END AS largest
FROM ({long_form(r"count(COLUMNS('(.*)')) AS '\1'", "n_values")})
JOIN ({long_form(r"CAST(min(COLUMNS('(.*)')) AS VARCHAR) AS '\1'", "smallest")}) USING ("column")
JOIN ({long_form(r"CAST(max(COLUMNS('(.*)')) AS VARCHAR) AS '\1'", "largest")}) USING ("column")
JOIN {kinds} USING ("column")"""


@register("table_profiles", " UNION ALL ".join(_profile_sql(name) for name in GIVEN))
def _(t: Tables):
    found = reduce(DataFrame.unionByName, [tables.profile(t.table(name), name) for name in GIVEN])
    alike = F.col("type").isin("bigint", "int", "string")
    ends = {end: F.when(alike, F.col(end)) for end in ("smallest", "largest")}
    return found.withColumns(ends).drop("position", "type", "n_different")


# --- column expressions --------------------------------------------------------------------

@register(
    "parse_raw",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CASE WHEN v < 5 THEN CAST(l_quantity AS INTEGER) END AS landed,
              CASE WHEN v < 5 THEN CAST(l_partkey AS INTEGER) END AS attempted,
              CASE WHEN v < 5 THEN l_linenumber * 60 + CAST(l_suppkey % 60 AS INTEGER) END AS clock_sec,
              CASE WHEN v < 5 THEN CAST(l_linenumber * 12 + l_suppkey % 12 AS DOUBLE) END AS height,
              CASE WHEN v < 6 THEN CAST(l_partkey % 90 AS DOUBLE) + CASE WHEN v < 3 THEN 0.5 ELSE 0 END END AS reach,
              CASE WHEN v <> 5 THEN round(l_discount * 100) / 100.0 END AS pct,
              CASE WHEN v NOT IN (5, 6) THEN 'value' END AS cleaned,
              CASE WHEN v < 5 THEN l_tax END AS number
       FROM (SELECT *, l_orderkey % 7 AS v FROM lineitem)""",
)
def _(t: Tables):
    v = F.col("l_orderkey") % 7

    def text(*parts):
        return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])

    q, part, supp, line = (F.col(c) for c in ("l_quantity", "l_partkey", "l_suppkey", "l_linenumber"))
    strikes = F.when(v < 5, text(" ", q.cast("int"), " of  ", part)).when(v == 5, " -- ").otherwise(text(part, " off 3"))
    clock = (
        F.when(v < 5, text(line, ":", F.lpad((supp % 60).cast("string"), 2, "0")))
        .when(v == 5, "N/A")
        .otherwise(text(line, ":7"))
    )
    height = F.when(v < 5, text(line, "' ", supp % 12, '"')).when(v == 5, "nan").otherwise(text(line, "'"))
    reach = (
        F.when(v < 3, text(part % 90, ".5"))
        .when(v < 6, text(part % 90, '"'))
        .otherwise(text(part % 90, " in"))
    )
    pct = F.round(F.col("l_discount") * 100).cast("int")
    percent = F.when(v == 5, "---").when(v < 3, text(pct, "%")).otherwise(text(pct))
    cleaned = F.when(v == 5, " NaN ").when(v == 6, "").otherwise(" value ")
    number = F.when(v < 5, F.col("l_tax").cast("string")).when(v == 5, "NaN").otherwise("abc")
    pair = parsing.landed_attempted(strikes)
    return t.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        pair["landed"].alias("landed"),
        pair["attempted"].alias("attempted"),
        parsing.clock_seconds(clock).alias("clock_sec"),
        parsing.height_inches(height).alias("height"),
        parsing.reach_inches(reach).alias("reach"),
        parsing.percent(percent).alias("pct"),
        parsing.clean_text(cleaned).alias("cleaned"),
        parsing.number(number).alias("number"),
    )


@register(
    "label_maps",
    """SELECT a_order, CASE a_order % 8 WHEN 0 THEN 'ko_tko' WHEN 1 THEN 'ko_tko' WHEN 2 THEN 'ko_tko'
                 WHEN 3 THEN 'submission' WHEN 4 THEN 'decision' WHEN 5 THEN 'decision' END AS method,
              CASE a_order % 8 WHEN 5 THEN 'majority' END AS subtype,
              CASE WHEN a_order % 3 = 0 THEN planned END AS scheduled,
              CASE a_order % 9 WHEN 0 THEN 'Women''s Strawweight' WHEN 1 THEN 'Light Heavyweight' WHEN 2 THEN 'Heavyweight'
                   WHEN 3 THEN 'Lightweight' WHEN 4 THEN 'Catch Weight' WHEN 5 THEN 'Middleweight'
                   WHEN 6 THEN 'Bantamweight' WHEN 7 THEN 'Open Weight' END AS weight_class,
              a_order % 9 IN (1, 6) AS title
       FROM raw_contests""",
)
def _(t: Tables):
    spellings = (
        "KO/TKO", "TKO - Cut", "Stopped by DOCTOR", "Technical Submission", "Technical Decision",
        "Decision - Majority", "Overturned", " -- ",
    )
    raw = views.raw_contests(t.spark, t.sf_dir)
    a = F.col("a_order")
    spelled = F.element_at(F.array(*[F.lit(s) for s in spellings]), (a % 8 + 1).cast("int"))
    planned = F.when(a % 7 == 0, "5").otherwise("3")
    fmt = F.when(a % 3 == 0, F.concat(planned, F.lit(" Rnd (5-5-5)"))).when(a % 3 == 1, "No Time Limit")
    return raw.select(
        "a_order",
        labels.method(spelled).alias("method"),
        labels.decision_subtype(spelled).alias("subtype"),
        labels.scheduled_rounds(fmt).alias("scheduled"),
        labels.weight_class(F.col("division")).alias("weight_class"),
        labels.is_title(F.col("division")).alias("title"),
    )


@register(
    "mixed_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day
       FROM orders""",
)
def _(t: Tables):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(k % 6 == 0, F.date_format(d, "yyyy/MM/dd"))
        .when(k % 6 == 1, F.date_format(d, "MMM d, yyyy"))
        .when(k % 6 == 2, F.date_format(d, "MMMM d, yyyy"))
        .when(k % 6 == 3, F.date_format(d, " yyyy-MM-dd "))
        .when(k % 6 == 4, "TBA")
    )
    return t.table("orders").select("o_orderkey", F.date_format(parsing.mixed_date(text), "yyyy-MM-dd").alias("day"))


@register(
    "style_shares",
    f"SELECT contest_id, {q6('share')} AS share FROM shares",
)
def _(t: Tables):
    totals = dataset.contest_totals(t.stats)
    share = rating.striking_share(*[F.col(c) for c in ("sig_landed", "td_landed", "sub_att", "ctrl_sec")])
    return totals.select("contest_id", r6(share).alias("share"))


@register("contest_totals", "SELECT contest_id, sig AS sig_landed, td AS td_landed, sub AS sub_att, ctrl AS ctrl_sec FROM totals")
def _(t: Tables):
    return dataset.contest_totals(t.stats)


@register(
    "side_swap",
    """SELECT contest_id, swapped, CASE WHEN swapped THEN b_id ELSE a_id END AS first_id,
              CASE WHEN swapped THEN a_id ELSE b_id END AS second_id,
              CAST(winner = CASE WHEN swapped THEN 'b' ELSE 'a' END AS BIGINT) AS y
       FROM (SELECT *, md5(contest_id)[32] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS swapped FROM decisive)""",
)
def _(t: Tables):
    a, b = F.col("competitor_a_id"), F.col("competitor_b_id")
    swapped = features.swap_side(F.col("contest_id"))
    won = F.when(swapped, F.col("winner") == "b").otherwise(F.col("winner") == "a")
    return dataset.decisive(t.contests).select(
        "contest_id",
        swapped.alias("swapped"),
        F.when(swapped, b).otherwise(a).alias("first_id"),
        F.when(swapped, a).otherwise(b).alias("second_id"),
        won.cast("bigint").alias("y"),
    )


@register(
    "implied_odds",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {q6('p_us')} AS p_us, {q6('p_dec')} AS p_dec,
               {q6('p_us / (p_us + p_dec)')} AS fair_us, {q6('p_dec / (p_us + p_dec)')} AS fair_dec
        FROM (SELECT *, CASE WHEN us > 0 THEN 100.0 / (us + 100.0) ELSE -us / (-us + 100.0) END AS p_us,
                     1.0 / (1.1 + 40 * l_discount) AS p_dec
              FROM (SELECT *, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 100 + l_quantity * 5
                                        ELSE -100 - l_quantity * 5 END AS DOUBLE) AS us FROM lineitem))""",
)
def _(t: Tables):
    q = F.col("l_quantity")
    american = F.when(F.col("l_linenumber") % 2 == 0, 100 + q * 5).otherwise(-100 - q * 5)
    p_us, p_dec = odds.american_implied(american), odds.decimal_implied(1.1 + 40 * F.col("l_discount"))
    fair_us, fair_dec = odds.devig(p_us, p_dec)
    return t.table("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        r6(p_us).alias("p_us"), r6(p_dec).alias("p_dec"), r6(fair_us).alias("fair_us"), r6(fair_dec).alias("fair_dec"),
    )


@register(
    "name_forms",
    """SELECT DISTINCT token, lower(replace(nfc_normalize(token), 'ß', 'ss')) AS normal,
              lower(strip_accents(replace(token, 'ß', 'ss'))) AS folded
       FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS token FROM documents) WHERE token <> ''""",
)
def _(t: Tables):
    tokens = t.table("documents").select(F.explode(F.split("text", r"\s+")).alias("token")).filter("token <> ''").distinct()
    return tokens.select(
        "token", names.normal_name(F.col("token")).alias("normal"), names.folded_name(F.col("token")).alias("folded")
    )


@register(
    "event_slugs",
    """SELECT DISTINCT event_name, CAST(event_date AS VARCHAR) AS event_date,
              'EVENT_' || trim(regexp_replace(event_name, '[^A-Za-z0-9]+', '_', 'g'), '_') || '_' || event_date || '.json' AS slug
       FROM bouts""",
)
def _(t: Tables):
    day = F.date_format("event_date", "yyyy-MM-dd")
    return t.bouts.select(
        "event_name", day.alias("event_date"), names.event_slug(F.col("event_name"), day).alias("slug")
    ).distinct()


# --- checks --------------------------------------------------------------------------------


@register(
    "key_violations",
    """SELECT 'duplicate' AS violation, l_orderkey AS key, count(*) AS n_rows FROM lineitem
       GROUP BY l_orderkey HAVING count(*) > 1""",
)
def _(t: Tables):
    return dataset.key_violations(t.table("lineitem"), "l_orderkey")


@register(
    "side_violations",
    """SELECT 'same_competitor' AS violation, o_orderkey AS contest_id FROM orders WHERE o_custkey = o_orderkey % 1500""",
)
def _(t: Tables):
    listed = t.table("orders").select(
        F.col("o_orderkey").alias("contest_id"),
        F.col("o_custkey").alias("competitor_a_id"),
        (F.col("o_orderkey") % 1500).alias("competitor_b_id"),
    )
    return dataset.side_violations(listed)


@register(
    "integrity_report",
    f"""SELECT *, n_bad_dates = 0 AS dates_ok, n_stats = 2 * n_contests AS stats_ok,
               n_orphans < 0.02 * n_participants AS orphans_ok, method_coverage > 0.95 AS method_ok,
               class_coverage > 0.95 AS class_ok
        FROM (SELECT count(*) AS n_contests, count(*) FILTER (date IS NULL) AS n_bad_dates,
                     {q6('count(method) / count(*)')} AS method_coverage,
                     {q6('count(weight_class) / count(*)')} AS class_coverage FROM contests),
             (SELECT count(*) AS n_stats FROM side_stats),
             (SELECT count(*) AS n_participants, count(*) FILTER (k.competitor_id IS NULL) AS n_orphans
              FROM (SELECT a_id AS id FROM contests UNION SELECT b_id FROM contests) i
              LEFT JOIN competitors k ON k.competitor_id = i.id)""",
)
def _(t: Tables):
    return rounded(dataset.integrity_report(t.contests, t.stats, t.competitors))


@register(
    "orphan_participants",
    """SELECT id AS competitor_id FROM (SELECT a_id AS id FROM contests UNION SELECT b_id FROM contests)
       WHERE id NOT IN (SELECT competitor_id FROM competitors WHERE name IS NOT NULL)""",
)
def _(t: Tables):
    return dataset.orphans(t.contests, t.competitors.filter("name IS NOT NULL"))


@register(
    "rating_checks",
    """SELECT n_rows, n_expected, 0::BIGINT AS n_broken_chains, n_out_of_range FROM
         (SELECT count(*) AS n_rows, count(*) FILTER (post_overall NOT BETWEEN 1000 AND 2200) AS n_out_of_range FROM ratings),
         (SELECT 2 * count(*) AS n_expected FROM rated)""",
)
def _(t: Tables):
    return ratings.rating_checks(t.ratings, t.contests)


@register(
    "feature_checks",
    f"""SELECT count(*) AS n_features, {q6('avg(y_winner)')} AS target_mean,
               (SELECT count(*) FROM decisive) AS n_decisive FROM features""",
)
def _(t: Tables):
    built = features.build_features(t.contests, t.competitors, t.ratings, t.history)
    return rounded(features.feature_checks(built, t.contests))


@register(
    "truncation_check",
    f"SELECT count(*) AS n_compared, 0::BIGINT AS n_differences FROM features WHERE date < DATE '{TEST_START}'",
)
def _(t: Tables):
    cutoff = F.lit(TEST_START).cast("timestamp_ntz")
    old = t.contests.filter(F.col("date") < cutoff)
    old_ratings = ratings.run_elo(old, t.stats)
    old_history = history.build_history(old, t.stats, old_ratings)
    truncated = rounded(features.build_features(old, t.competitors, old_ratings, old_history))
    full = rounded(features.build_features(t.contests, t.competitors, t.ratings, t.history))
    differing = features.truncation_differences(full, truncated, TEST_START)
    return dataset.one_row(
        full.filter(F.col("date") < TEST_START).agg(F.count("*").alias("n_compared")),
        differing.agg(F.count("*").alias("n_differences")),
    )


@register(
    "value_distribution",
    "SELECT method AS value, count(*) AS n_rows FROM contests GROUP BY method",
)
def _(t: Tables):
    return dataset.value_distribution(t.contests, "method")


@register("rows_per_year", "SELECT year(date) AS year, count(*) AS n_rows FROM contests GROUP BY 1")
def _(t: Tables):
    return rounded(dataset.rows_per_year(t.contests))


@register(
    "time_splits",
    f"""SELECT part, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day FROM (
          SELECT date, CASE WHEN date < DATE '{TRAIN_END}' THEN 'train'
                            WHEN date BETWEEN DATE '{VAL[0]}' AND DATE '{VAL[1]}' THEN 'val'
                            WHEN date >= DATE '{TEST_START}' THEN 'test' END AS part FROM decisive)
        GROUP BY part""",
)
def _(t: Tables):
    rows = dataset.decisive(t.contests)
    options = {"train_end": TRAIN_END, "val": VAL, "test_start": TEST_START}
    out = None
    for part in ("train", "val", "test"):
        one = learn.split(rows, part, **options).select(F.lit(part).alias("part"), "date")
        out = one if out is None else out.unionByName(one)
    return rounded(
        out.groupBy("part").agg(
            F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
        )
    )


@register(
    "known_labels",
    """SELECT y_method, y_finish_round, count(*) AS n FROM features
       WHERE y_method IS NOT NULL OR y_finish_round IS NOT NULL GROUP BY ALL""",
)
def _(t: Tables):
    method = F.col("method")
    rows = dataset.decisive(t.contests).select(
        method.alias("y_method"), labels.round_bucket(F.col("finish_round")).alias("y_finish_round")
    )
    known = rows.filter("y_method IS NOT NULL OR y_finish_round IS NOT NULL")
    return known.groupBy("y_method", "y_finish_round").agg(F.count("*").alias("n"))


@register(
    "upcoming_events",
    f"""SELECT DISTINCT event_name, CAST(event_date AS VARCHAR) AS date FROM bouts
        WHERE event_date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 30""",
)
def _(t: Tables):
    events = t.bouts.select("event_name", F.col("event_date").alias("date")).distinct()
    return rounded(predictions.upcoming(events, F.lit(TODAY).cast("date"), 30))


@register(
    "empty_cards",
    """SELECT DISTINCT event_name FROM bouts WHERE event_name NOT IN
         (SELECT event_name FROM bouts WHERE title_fight)""",
)
def _(t: Tables):
    events = t.bouts.select("event_name").distinct()
    return predictions.empty_cards(events, t.bouts.filter("title_fight"))


# --- ratings ----------------------------------------------------------------------------------

_RATED_SQL = ", ".join(
    f"{q6(c)} AS {c}"
    for c in ("pre_overall", "pre_striking", "pre_grappling", "post_overall", "post_striking", "post_grappling")
)


@register(
    "ratings",
    f"""SELECT contest_id, {_DAY} AS date, competitor_id, side, pre_fights, {_RATED_SQL} FROM ratings""",
)
def _(t: Tables):
    return rounded(t.ratings)


@register(
    "rating_grid",
    f"""SELECT pid AS grid_index, {q6('log_loss')} AS log_loss, k_early, k_late, early AS early_contests,
               bonus AS finish_bonus FROM grid JOIN grid_loss USING (pid)""",
)
def _(t: Tables):
    return rounded(t.grid_losses)


@register(
    "prediction_pairs",
    f"""SELECT contest_id, {_DAY} AS date, winner, {q6('pre_overall_a')} AS pre_overall_a,
               {q6('pre_overall_b')} AS pre_overall_b, {q6('p_a')} AS p_a, y FROM predictions""",
)
def _(t: Tables):
    return rounded(t.predictions)


@register(
    "rating_peaks",
    """SELECT competitor_id, coalesce(name, competitor_id) AS name, round(peak, 1) AS peak FROM (
         SELECT competitor_id, max(post_overall) AS peak FROM ratings GROUP BY competitor_id
         ORDER BY peak DESC, competitor_id LIMIT 10) JOIN competitors USING (competitor_id)""",
)
def _(t: Tables):
    return ratings.peaks(t.ratings, t.competitors)


@register(
    "last_ratings",
    f"""SELECT competitor_id, {q6('elo_overall')} AS elo_overall, {q6('elo_striking')} AS elo_striking,
               {q6('elo_grappling')} AS elo_grappling FROM last_ratings""",
)
def _(t: Tables):
    return rounded(history.last_ratings(t.ratings))


@register(
    "rating_trajectory",
    f"SELECT {_DAY} AS date, competitor_id, {q6('avg(post_overall)')} AS post_overall FROM ratings GROUP BY date, competitor_id",
)
def _(t: Tables):
    return rounded(ratings.trajectory(t.ratings))


@register(
    "trajectory_pivot",
    f"""SELECT {_DAY} AS date, {q6("avg(post_overall) FILTER (competitor_id = printf('%016x', 1))")} AS c1,
               {q6("avg(post_overall) FILTER (competitor_id = printf('%016x', 2))")} AS c2
        FROM ratings WHERE competitor_id IN (printf('%016x', 1), printf('%016x', 2)) GROUP BY date""",
)
def _(t: Tables):
    first, second = f"{1:016x}", f"{2:016x}"
    wide = ratings.trajectory_pivot(t.ratings, [first, second])
    return rounded(wide.withColumnsRenamed({first: "c1", second: "c2"}))


# --- history -------------------------------------------------------------------------------------

_INTS = ("career_fights", "streak", "days_since_last")
_STATS_OUT = ", ".join(c if c in _INTS else f"{q6(c)} AS {c}" for c in STAT_NAMES if c != "last5_avg_opp_elo")


def career_history(t: Tables):
    """Career statistics before every rated contest, from the raw tables alone."""
    return rounded(history.build_history(t.contests, t.stats).drop("last5_avg_opp_elo"))


register(
    "career_history",
    f"SELECT contest_id, {_DAY} AS date, side, competitor_id, {_STATS_OUT} FROM careers_before",
)(career_history)


@register(
    "rated_history",
    f"""SELECT contest_id, {_DAY} AS date, side, competitor_id, {_STATS_OUT},
               {q6('last5_avg_opp_elo')} AS last5_avg_opp_elo FROM full_history""",
)
def _(t: Tables):
    return rounded(t.history)


@register(
    "career_ordinals",
    "SELECT contest_id, side, competitor_id, ordinal FROM ordinals",
)
def _(t: Tables):
    from contestry.operators import careers

    rows = dataset.sides(dataset.rated(t.contests), "date").select("contest_id", "date", "side", "competitor_id")
    return rounded(careers.career_links(rows).select("contest_id", "side", "competitor_id", "ordinal"))


@register(
    "snapshots",
    f"""SELECT competitor_id, {_STATS_OUT.replace('days_since_last, ', '')}, CAST(last_date AS VARCHAR) AS last_date,
               {q6('last5_avg_opp_elo')} AS last5_avg_opp_elo, {q6('elo_overall')} AS elo_overall,
               {q6('elo_striking')} AS elo_striking, {q6('elo_grappling')} AS elo_grappling FROM snapshots""",
)
def _(t: Tables):
    return rounded(t.snapshots)


@register(
    "named_snapshots",
    f"""SELECT competitor_id, name, career_fights, {q6('elo_overall')} AS elo_overall FROM snapshots
        JOIN competitors USING (competitor_id) WHERE name IS NOT NULL""",
)
def _(t: Tables):
    named = t.competitors.filter("name IS NOT NULL").select("competitor_id", "name")
    joined = t.snapshots.join(named, "competitor_id")
    return rounded(joined.select("competitor_id", "name", "career_fights", "elo_overall"))


# --- features ------------------------------------------------------------------------------------


_BOOLS = ("title_fight", "swapped", "debut_matchup", "stance_mismatch") + tuple(
    f"{n}_{s}" for s in "ab" for n in ("reach_missing", "dob_missing", "southpaw", "debut")
)
_DIFF_NAMES = [f"{stem}_diff" for stem in features.DIFF_STEMS.values()]
_FEATURE_SQL = f"""contest_id, {_DAY} AS date, swapped, y_winner, y_method, y_finish_round, weight_class, title_fight,
  CAST(scheduled_rounds AS BIGINT) AS scheduled_rounds, {', '.join(f'{q6(c)} AS {c}' for c in _DIFF_NAMES)},
  {q6('age_a')} AS age_a, {q6('age_b')} AS age_b, career_fights_a, career_fights_b,
  {', '.join(b for b in _BOOLS if b not in ('title_fight', 'swapped'))}"""


@register("features", f"SELECT {_FEATURE_SQL} FROM features")
def _(t: Tables):
    return rounded(features.build_features(t.contests, t.competitors, t.ratings, t.history))


def _scored(t: Tables):
    """Decisive contests with the rating probability in feature orientation."""
    swapped = features.swap_side(F.col("contest_id"))
    p, y = F.col("p_a"), F.col("y")
    chosen = dataset.decisive(t.contests).select(
        "contest_id",
        "weight_class",
        F.col("method").alias("y_method"),
        labels.round_bucket(F.col("finish_round")).alias("y_finish_round"),
        "scheduled_rounds",
    )
    oriented = t.predictions.select(
        "contest_id",
        "date",
        swapped.alias("swapped"),
        F.when(swapped, 1.0 - y).otherwise(y).alias("y"),
        F.when(swapped, rating.expected_score(F.col("pre_overall_b"), F.col("pre_overall_a"))).otherwise(p).alias("p"),
    )
    return oriented.join(chosen, "contest_id")


scored_table = _scored
train_rows = _train
