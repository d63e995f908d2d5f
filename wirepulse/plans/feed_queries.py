"""Queries over documents: feeds built from headlines, scorer responses, pages.

The feed documents and responses are spelled by Spark from every headline row,
so the expected result of parsing them is the headlines table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wirepulse.functions import text as tx, times as tm
from wirepulse.operators import verdicts as vd
from wirepulse.plans import inputs as I, oracle_views as V
from wirepulse.plans.inputs import ntz
from wirepulse.plans.registered import query
from wirepulse.sources import feeds

T = f"TIMESTAMP '{I.NOW_ITEMS}'"

# ---------------------------------------------------------------- pages


@query(f"SELECT page_id, {V.strip_html('html')} AS text FROM pages")
def strip_html(spark, d):
    pages = I.table(spark, d, "pages")
    return pages.select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query(f"SELECT page_id, {V.article('html')} AS text FROM pages")
def article_text(spark, d):
    pages = I.table(spark, d, "pages")
    return pages.select("page_id", tx.article_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {V.article('html', None)} AS text FROM pages")
def article_text_whole(spark, d):
    """As ``article_text``, without its cut at 4,000 characters."""
    pages = I.table(spark, d, "pages")
    return pages.select("page_id", tx.article_text(F.col("html"), None).alias("text"))


@query(V.query(V.HEADLINES, select="""
SELECT item_id, title || ' ' || chr(CAST(161 + k % 5000 AS INT)) || chr(CAST(128512 + k % 60 AS INT)) || ' & £ € &unknown; &#163; ' || '—' AS text FROM headlines"""))
def decode_entities(spark, d):
    raw = F.expr("concat(title, ' &#', 161 + k % 5000, ';&#x', hex(128512 + k % 60), '; &amp; &pound; &Euro; &unknown; &amp;#163; &#99999999;&mdash;')")
    return I.headlines(spark, d).select("item_id", tx.decode_entities(raw).alias("text"))


# ---------------------------------------------------------------- feeds


def _escaped(col: str) -> str:
    return f"replace(replace({col}, '&', '&amp;'), '<', '&lt;')"


def _rss_docs(spark, d):
    """One RSS document per 20 headlines; every fifth one is cut off inside its last item."""
    item = f"""concat('<item><title>', case when k % 2 = 0 then concat('<![CDATA[<b>', title, '</b>]]>') else {_escaped('title')} end, '</title>',
      case when k % 11 <> 0 then concat('<link>', {_escaped('link')}, '</link>') else '' end,
      '<description>&lt;p&gt;', summary, '&lt;/p&gt;</description>',
      case when k % 3 = 0 then concat('<content:encoded><![CDATA[<script>x()</script>Full: <p>', summary, '</p>]]></content:encoded>') else '' end,
      case when published_at is null then '' when k % 2 = 0 then concat('<pubDate>', date_format(published_at, 'E, dd MMM yyyy HH:mm:ss'), ' GMT</pubDate>')
           else concat('<dc:date>', date_format(published_at, "yyyy-MM-dd'T'HH:mm:ss"), 'Z</dc:date>') end,
      '<guid isPermaLink="false">urn:', k, '</guid><category>Fintech </category><category domain="x">', source_id, '</category></item>')"""
    return _documents(
        spark, d, item,
        '<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Wire</title>',
        "</channel></rss>",
    )


def _atom_docs(spark, d):
    item = f"""concat('<entry><title type="html">', {_escaped("concat(" + I.pick(I.FORMS, "k % 6") + ", ' - ', title)")}, '</title>',
      case when k % 11 <> 0 then concat('<link rel="self" href="https://self.example.com/"/><link rel="alternate" href="', {_escaped('link')}, '"/>') else '' end,
      '<summary>', summary, '</summary>', case when k % 3 = 0 then concat('<content type="html">Full: ', summary, '</content>') else '' end,
      case when published_at is null then '' else concat('<updated>', date_format(timestampadd(HOUR, -4, published_at), "yyyy-MM-dd'T'HH:mm:ss"), '-04:00</updated>') end,
      '<id>urn:', k, '</id>', case when k % 4 <> 0 then concat('<category scheme="s" label="form type" term="', {I.pick(I.FORMS, "k % 6")}, '"/>') else '' end, '</entry>')"""
    return _documents(spark, d, item, '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">', "</feed>")


def _documents(spark, d, item: str, head: str, tail: str):
    rows = I.headlines(spark, d).selectExpr("floor(k / 20) as check_id", "k", f"{item} as item")
    # A document holds twenty items by construction.
    bodies = rows.groupBy("check_id").agg(F.sort_array(F.collect_list(F.struct("k", "item"))).alias("_i"))
    whole = F.concat(F.lit(head), F.array_join(F.transform("_i", lambda s: s["item"]), ""), F.lit(tail))
    return bodies.select(
        F.concat(F.lit("src"), (F.col("check_id") % 10).cast("string")).alias("source_id"), "check_id",
        F.expr("timestamp '2002-01-01 00:00:00'").alias("ts"),
        F.when(F.col("check_id") % 5 == 0, F.left(whole, F.length(whole) - 40)).otherwise(whole).alias("body"),
    )


def _feed_sources(docs):
    return docs.select("source_id").distinct().withColumn("type", F.when(F.col("source_id") < "src5", "sec").otherwise("atom"))


_PUBLISHED = f"CASE WHEN published_at <= {T} + INTERVAL 1 HOUR THEN published_at END"
_COLUMNS = ["source_id", "check_id", "position", "title", "link", "summary", "published_at", "guid", "categories", "sec_form_type"]


def _items(docs):
    items, _ = feeds.parse_feeds(docs, _feed_sources(docs), I.NOW_ITEMS)
    return ntz(items.withColumn("categories", F.array_join("categories", ",")).select(*_COLUMNS))


@query(V.query(V.HEADLINES, select=f"""
SELECT 'src' || (k // 20 % 10) AS source_id, k // 20 AS check_id, CAST(k % 20 AS INT) AS position, title, link,
  CASE WHEN k % 3 = 0 THEN 'Full: ' ELSE '' END || summary AS summary, {_PUBLISHED} AS published_at, 'urn:' || k AS guid,
  'fintech,' || source_id AS categories, CAST(NULL AS VARCHAR) AS sec_form_type
FROM (SELECT *, max(k) OVER (PARTITION BY k // 20) AS max_k FROM headlines) WHERE k % 11 <> 0 AND (k // 20 % 5 <> 0 OR k < max_k)"""))
def feed_rss_items(spark, d):
    return _items(_rss_docs(spark, d))


@query(V.query(V.HEADLINES, select=f"""
SELECT 'src' || (k // 20 % 10) AS source_id, k // 20 AS check_id, CAST(k % 20 AS INT) AS position, form || ' - ' || title AS title, link,
  CASE WHEN k % 3 = 0 THEN 'Full: ' ELSE '' END || summary AS summary, {_PUBLISHED} AS published_at, 'urn:' || k AS guid,
  CASE WHEN k % 4 <> 0 THEN lower(form) ELSE '' END AS categories, CASE WHEN k // 20 % 10 < 5 THEN form END AS sec_form_type
FROM (SELECT *, {V.pick(I.FORMS, "k % 6")} AS form, max(k) OVER (PARTITION BY k // 20) AS max_k FROM headlines) WHERE k % 11 <> 0 AND (k // 20 % 5 <> 0 OR k < max_k)"""))
def feed_atom_items(spark, d):
    return _items(_atom_docs(spark, d))


def _messy_docs(spark, d):
    """One RSS document per four headlines, each spoiled in one of four ways."""
    rows = I.headlines(spark, d).selectExpr("floor(k / 4) as check_id", "k", f"""concat('<item><title>', case when floor(k / 4) % 4 = 1 then 'M&nbsp;' else '' end, {_escaped('title')},
      '</title><link>https://messy.example.com/', k, case when floor(k / 4) % 4 = 0 then '?a=1&b=2' else '' end, '</link><description>', summary, '</description></item>') as item""")
    bodies = rows.groupBy("check_id").agg(F.sort_array(F.collect_list(F.struct("k", "item"))).alias("_i"))  # four items
    whole = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel>'), F.array_join(F.transform("_i", lambda s: s["item"]), ""), F.lit("</channel></rss>"))
    case = F.col("check_id") % 4
    return bodies.select(
        F.concat(F.lit("src"), (F.col("check_id") % 10).cast("string")).alias("source_id"), "check_id", F.expr("timestamp '2002-01-01 00:00:00'").alias("ts"),
        F.when(case == 2, F.concat(F.lit("\n "), whole)).when(case == 3, F.left(whole, F.length(whole) - 30)).otherwise(whole).alias("body"),
    )


@query(V.query(V.HEADLINES, select="""
SELECT k // 4 AS check_id, CAST(k % 4 AS INT) - CAST(min(k % 4) OVER (PARTITION BY k // 4) AS INT) AS position, CASE WHEN k // 4 % 4 = 1 THEN 'M ' ELSE '' END || title AS title,
  'https://messy.example.com/' || k || CASE WHEN k // 4 % 4 = 0 THEN '?a=1&b=2' ELSE '' END AS link, summary
FROM (SELECT *, max(k) OVER (PARTITION BY k // 4) AS max_k FROM headlines) WHERE k // 4 % 4 <> 3 OR k < max_k"""))
def feed_messy_items(spark, d):
    items, _ = feeds.parse_feeds(_messy_docs(spark, d), _feed_sources(_messy_docs(spark, d)), I.NOW_ITEMS)
    return items.select("check_id", "position", "title", "link", "summary")


@query(V.query(V.HEADLINES, select="SELECT DISTINCT k // 4 AS check_id FROM headlines WHERE k // 4 % 4 = 3"))
def feed_messy_errors(spark, d):
    _, errors = feeds.parse_feeds(_messy_docs(spark, d), _feed_sources(_messy_docs(spark, d)), I.NOW_ITEMS)
    return errors.select("check_id")


@query(V.query(V.HEADLINES, select="""
SELECT DISTINCT k // 20 AS check_id, 'src' || (k // 20 % 10) AS source_id, 'parse failed: not a well-formed feed document' AS reason FROM headlines WHERE k // 20 % 5 = 0"""))
def feed_parse_errors(spark, d):
    docs = _rss_docs(spark, d)
    _, errors = feeds.parse_feeds(docs, _feed_sources(docs), I.NOW_ITEMS)
    return errors.select("check_id", "source_id", "reason")


@query(V.query(V.HEADLINES, select="SELECT item_id, CASE WHEN k % 14 = 13 THEN date_trunc('day', published_at) WHEN k % 14 <> 6 THEN published_at END AS at FROM headlines"))
def feed_dates(spark, d):
    t, ahead = "published_at", "timestampadd(HOUR, 2, published_at)"
    text = f"""case k % 14 when 0 then concat(date_format({t}, 'E, d MMM yyyy HH:mm:ss'), ' GMT') when 1 then concat(date_format({ahead}, 'E, dd MMM yyyy HH:mm:ss'), ' +0200')
      when 2 then concat(date_format({t}, "yyyy-MM-dd'T'HH:mm:ss"), 'Z') when 3 then concat(date_format({ahead}, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00')
      when 4 then concat(date_format({t}, 'dd MMM yyyy HH:mm'), ' UTC') when 5 then concat(date_format({t}, "yyyy-MM-dd'T'HH:mm:ss"), '.000Z') when 7 then concat(date_format({t}, 'd MMM yy HH:mm:ss'), ' +0000')
      when 8 then concat(date_format({t}, 'd MMMM yyyy HH:mm:ss'), ' +0000') when 9 then concat(date_format({t}, 'E, d MMM yyyy HH:mm:ss'), ' +0000 (UTC)')
      when 10 then concat(date_format({t}, 'E, d MMM yyyy HH:mm:ss'), ' +00:00') when 11 then concat(replace(date_format({t}, 'd MMM yyyy HH:mm:ss'), 'Sep', 'Sept'), ' GMT')
      when 12 then concat(date_format({t}, 'd MMM yyyy H:mm:ss'), ' GMT') when 13 then date_format({t}, 'MMM d, yyyy') else 'last Tuesday' end"""
    return ntz(I.headlines(spark, d).select("item_id", tm.parse_feed_date(F.expr(text)).alias("at")))


# ---------------------------------------------------------------- scorer responses


def _responses(spark, d):
    """Response text per five headlines, in the shapes scorers return."""
    entry = """concat('{"id":"i', k % 5, '","relevant":', k % 10 <> 3, ',"event":"', case k % 4 when 0 then 'funding' when 1 then 'null' when 2 then ' launch ' else 'ipo' end,
      '","is_fintech":true,"region":"', case when k % 13 = 0 then 'Mars' else 'US' end, '","company":"', company, ' {x} \\\\"q\\\\"","amount":"', case k % 3 when 0 then 'N/A' when 1 then '  ' else '$5M' end, '",',
      case k % 4 when 0 then '"lead_investors":"A, B ,,C"' when 1 then '"lead_investors":["A",null," ",7,"B"]' when 2 then '"lead_investors":null' else '"other_investors":5' end,
      ',"one_line_summary":"s","confidence":', case k % 6 when 0 then '85' when 1 then '"0.8"' when 2 then '"90"' when 3 then '-1' when 4 then '""' else '0.5' end, '}')"""
    rows = I.headlines(spark, d).selectExpr("floor(k / 5) as request_id", "k", f"{entry} as entry")
    packed = rows.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("k", "entry"))).alias("_e"))  # five each
    listed = packed.withColumn("list", F.concat(F.lit("["), F.array_join(F.transform("_e", lambda s: s["entry"]), ","), F.lit("]")))
    return listed.withColumn("env", F.expr("""concat('{"verdicts":', list, '}')""")).selectExpr(
        "request_id",
        """case request_id % 8 when 0 then env when 1 then concat('```json\\n', env, '\\n```') when 2 then concat('Sure: ', env, ' hope } that helps')
          when 3 then list when 4 then substring(env, 1, 100) when 5 then 'no answer today' when 6 then '{"items": []}' else concat('Here [it is] ', env) end as body""",
    )


@query(V.query(V.HEADLINES, select="""
SELECT DISTINCT k // 5 AS request_id, k // 5 % 8 NOT IN (4, 5, 7) AS parsed, CASE k // 5 % 8 WHEN 4 THEN 'its JSON breaks off before it is closed'
  WHEN 5 THEN 'nothing in it looks like JSON' WHEN 7 THEN 'its JSON cannot be read' END AS json_error FROM headlines"""))
def extract_json(spark, d):
    found = vd.extract_json(_responses(spark, d))
    return found.select("request_id", F.col("json").isNotNull().alias("parsed"), "json_error")


@query(V.query(V.HEADLINES, select="""
SELECT k // 5 AS request_id, k // 5 % 8 IN (0, 1, 2, 3) AS usable, CASE WHEN k // 5 % 8 IN (0, 1, 2, 3) THEN count(*) ELSE 1 END AS n FROM headlines GROUP BY 1, 2"""))
def verdict_envelope(spark, d):
    entries, errors = vd.verdict_entries(vd.extract_json(_responses(spark, d)), "request_id")
    good = entries.groupBy("request_id").agg(F.count("*").alias("n")).withColumn("usable", F.lit(True))
    return good.unionByName(errors.groupBy("request_id").agg(F.count("*").alias("n")).withColumn("usable", F.lit(False)))


_PROBLEMS = """concat_ws('; ', CASE WHEN k % 4 = 3 THEN 'event: not a known event' END, CASE WHEN k % 13 = 0 THEN 'region: not a known region' END,
  CASE WHEN k % 6 = 3 THEN 'confidence: expected a number from 0 to 1' END)"""


@query(V.query(V.HEADLINES, select=f"""
SELECT k // 5 AS request_id, CAST(k % 5 AS INT) AS position, CASE WHEN {_PROBLEMS} = '' THEN {_PROBLEMS} ELSE {_PROBLEMS} END AS problems,
  CASE WHEN {_PROBLEMS} = '' THEN CASE k % 4 WHEN 0 THEN 'funding' WHEN 2 THEN 'launch' END END AS event,
  CASE WHEN {_PROBLEMS} = '' THEN CASE WHEN k % 3 = 2 THEN '$5M' END END AS amount,
  CASE WHEN {_PROBLEMS} = '' THEN CASE k % 4 WHEN 0 THEN 'A|B|C' WHEN 1 THEN 'A|B' ELSE '' END END AS leads,
  CASE WHEN {_PROBLEMS} = '' THEN CAST(CASE k % 6 WHEN 0 THEN 0.85 WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 4 THEN 0 ELSE 0.5 END AS DOUBLE) END AS confidence,
  CASE WHEN {_PROBLEMS} = '' THEN company || ' {{x}} "q"' END AS company
FROM headlines WHERE k // 5 % 8 IN (0, 1, 2, 3)"""))
def verdict_validate(spark, d):
    entries, _ = vd.verdict_entries(vd.extract_json(_responses(spark, d)), "request_id")
    good, bad = vd.validate_verdicts(entries)
    none = F.lit(None).cast("string")
    accepted = good.select(
        "request_id", "position", F.lit("").alias("problems"), "event", "amount", F.array_join("lead_investors", "|").alias("leads"), "confidence", "company"
    )
    rejected = bad.select(
        "request_id", "position", "problems", none.alias("event"), none.alias("amount"), none.alias("leads"), none.cast("double").alias("confidence"), none.alias("company")
    )
    return accepted.unionByName(rejected)


# ---------------------------------------------------------------- lenient values

_MESSY = "case k % 7 when 0 then ' Null ' when 1 then 'N/A' when 2 then '' when 3 then concat('  ', company, ' ') when 4 then 'n/a.' when 5 then null else phrase end"


@query(V.query(V.HEADLINES, select="""
SELECT item_id, CASE k % 7 WHEN 3 THEN company WHEN 4 THEN 'n/a.' WHEN 6 THEN phrase END AS value FROM headlines"""))
def null_text(spark, d):
    return I.headlines(spark, d).select("item_id", tx.null_text(F.expr(_MESSY)).alias("value"))


@query(V.query(V.HEADLINES, select="""
SELECT item_id, CASE k % 3 WHEN 0 THEN company || '|' || phrase WHEN 1 THEN phrase ELSE '' END AS value FROM headlines"""))
def string_array(spark, d):
    raw = F.expr("case k % 3 when 0 then concat(' ', company, ' ,, ', phrase) when 1 then phrase else ' , ' end")
    return I.headlines(spark, d).select("item_id", F.array_join(tx.comma_list(raw), "|").alias("value"))


@query(V.query(V.HEADLINES, select="""
SELECT item_id, CASE k % 5 WHEN 0 THEN (k % 100) / 100.0 WHEN 1 THEN CASE WHEN k % 100 > 1 THEN (k % 100) / 100.0 ELSE CAST(k % 100 AS DOUBLE) END WHEN 2 THEN 0.0 ELSE NULL END AS value,
  CASE WHEN k % 200 > 1 AND k % 200 <= 100 THEN (k % 200) / 100.0 ELSE CAST(k % 200 AS DOUBLE) END AS number FROM headlines"""))
def confidence_norm(spark, d):
    raw = F.expr("case k % 5 when 0 then cast((k % 100) / 100.0D as string) when 1 then concat(' ', k % 100) when 2 then ' ' when 3 then 'high' else null end")
    return I.headlines(spark, d).select(
        "item_id", tx.confidence_from_text(raw).alias("value"),
        tx.confidence_from_number(F.expr("cast(k % 200 as double)")).alias("number"),
    )
