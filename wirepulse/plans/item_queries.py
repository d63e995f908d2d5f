"""Queries over items: keys, keyword classification, dedupe and the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse import config
from wirepulse.functions import text as tx, times as tm
from wirepulse.operators import dedupe, prefilter as pf, queue, reports
from wirepulse.plans import inputs as I, oracle_views as V
from wirepulse.plans.inputs import ntz
from wirepulse.plans.registered import query
from wirepulse.session import written
from wirepulse.sources import registry, sinks

T = f"TIMESTAMP '{I.NOW_ITEMS}'"

# ---------------------------------------------------------------- keyword classification


@query(V.query(V.HEADLINES, V.OUTCOME, select="SELECT item_id, family AS hit, in_title FROM outcome"))
def prefilter_family(spark: SparkSession, d: str) -> DataFrame:
    return pf.keyword_match(I.headlines(spark, d), pf.enabled_families()).select("item_id", "hit", "in_title")


# Document texts with a deal sentence before, across or after the character where the search ends.
_SENTENCES = (" Firm raises $5M.", " Firm acquires a rival.", " Firm launches a card.", " The market is projected to grow at a high cagr. It raises $5M.", "")
_SPOT = "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 700 WHEN 1 THEN 1495 ELSE 1600 END"
_DOCUMENT_ITEMS = f"""documents_items AS (SELECT doc_id AS item_id, 'Document ' || doc_id AS title,
  substr(text, 1, {_SPOT}) || {V.pick(_SENTENCES, 'doc_id % 5')} || substr(text, 1 + {_SPOT}) AS summary FROM documents)"""


def _document_items(spark, d):
    docs = I.table(spark, d, "documents").selectExpr("doc_id", "text", _SPOT + " as spot", I.pick(_SENTENCES, "doc_id % 5") + " as said")
    return docs.selectExpr("doc_id as item_id", "concat('Document ', doc_id) as title", "concat(substr(text, 1, spot), said, substr(text, 1 + spot)) as summary")


@query(f"""WITH {_DOCUMENT_ITEMS}, hay AS (SELECT *, chr(10) || title || chr(10) || substr(summary, 1, 1500) AS haystack FROM documents_items)
SELECT item_id, split_part({V.family_case('haystack')}, '#', 1) AS hit FROM hay""")
def prefilter_documents(spark, d):
    """The reference's limit: only the first 1,500 characters are searched. ``prefilter_documents_whole`` reads whole texts."""
    return pf.keyword_match(_document_items(spark, d), pf.enabled_families()).select("item_id", "hit")


@query(f"""WITH {_DOCUMENT_ITEMS}, hay AS (SELECT *, chr(10) || title || chr(10) || summary AS haystack FROM documents_items)
SELECT item_id, split_part({V.family_case('haystack')}, '#', 1) AS hit FROM hay""")
def prefilter_documents_whole(spark, d):
    return pf.keyword_match(_document_items(spark, d), pf.enabled_families(), body_chars=None).select("item_id", "hit")


@query(V.query(V.HEADLINES, V.OUTCOME, select="SELECT item_id, reason FROM outcome WHERE reason LIKE 'vetoed by%'"))
def prefilter_veto(spark, d):
    return pf.prefilter(I.headlines(spark, d)).where(F.col("reason").startswith("vetoed by")).select("item_id", "reason")


@query(V.query(V.HEADLINES, V.OUTCOME, select="SELECT item_id, hit FROM outcome WHERE strong"))
def prefilter_strong(spark, d):
    return pf.prefilter(I.headlines(spark, d)).where("strong").select("item_id", "hit")


@query(V.query(V.HEADLINES, V.OUTCOME, select="SELECT item_id, pass, hit, reason, strong FROM outcome"))
def prefilter_full(spark, d):
    return pf.prefilter(I.headlines(spark, d)).select("item_id", "pass", "hit", "reason", "strong")


_HAY = "title || chr(10) || summary"
_REST = f"regexp_replace({_HAY}, '(?i){config.ITEM_101_CAPTION}', ' ', 'g')"


def _filings(spark, d):
    items = I.filings(spark, d)
    return items.withColumn("sec_form_type", tx.sec_form_type(F.col("category_structs"), F.col("title")))


@query(V.query(V.HEADLINES, V.FILINGS, select="SELECT item_id, form AS sec_form_type FROM filings"))
def sec_form_type(spark, d):
    return _filings(spark, d).select("item_id", "sec_form_type")


@query(V.query(V.HEADLINES, V.FILINGS, select="SELECT item_id, filer FROM filings"))
def sec_filer_name(spark, d):
    return I.filings(spark, d).select("item_id", tx.sec_filer_name(F.col("title")).alias("filer"))


@query(V.query(V.HEADLINES, V.FILINGS, select=f"""
SELECT item_id, hit IS NOT NULL AS pass, hit, reason FROM (
  SELECT item_id, CASE WHEN i2 OR (i1 AND deal IS NOT NULL) THEN 'sec-8k' END AS hit,
    CASE WHEN i2 THEN '8-K item 2.01 (completed acquisition)' WHEN NOT i1 THEN '8-K without item 1.01 or 2.01'
         WHEN deal IS NOT NULL THEN '8-K item 1.01 + ' || deal
         ELSE '8-K item 1.01 with no acquisition or merger language beyond the standard caption' END AS reason
  FROM (SELECT item_id, regexp_matches({_HAY}, '(?i){config.ITEM_101}') AS i1, regexp_matches({_HAY}, '(?i){config.ITEM_201}') AS i2,
          {V.first_of(_REST, config.ACQUISITION)} AS deal FROM filings WHERE form = '8-K'))"""))
def prefilter_sec_8k(spark, d):
    filings = _filings(spark, d).where(F.col("sec_form_type") == "8-K")
    return pf.prefilter(filings).select("item_id", "pass", "hit", "reason")


@query(V.query(V.HEADLINES, V.FILINGS, select=f"""
SELECT item_id, hit IS NOT NULL AS pass, hit, reason FROM (
  SELECT item_id, CASE WHEN form IN ('D', 'D/A') AND vehicle IS NULL AND hint IS NOT NULL THEN 'sec-form-d' END AS hit,
    CASE WHEN form NOT IN ('D', 'D/A') THEN 'SEC form ' || form || ' is not tracked'
         WHEN vehicle IS NOT NULL THEN 'Form D from an investment vehicle (' || vehicle || ')'
         WHEN hint IS NULL THEN 'Form D with no fintech signal in the name' ELSE 'Form D, name matches ' || hint END AS reason
  FROM (SELECT item_id, form, {V.first_of('filer', config.FILER_VEHICLE)} AS vehicle, {V.first_of('filer', config.FILER_HINT)} AS hint
        FROM filings WHERE form <> '8-K'))"""))
def prefilter_form_d(spark, d):
    filings = _filings(spark, d).where(F.col("sec_form_type") != "8-K")
    return pf.prefilter(filings).select("item_id", "pass", "hit", "reason")


@query(V.query(V.HEADLINES, V.OUTCOME, select="""
SELECT count(*) AS n, CAST(count_if(pass AND e) AS BIGINT) AS tp, CAST(count_if(pass AND NOT e) AS BIGINT) AS fp, CAST(count_if(NOT pass AND e) AS BIGINT) AS fn,
  CAST(count_if(NOT pass AND NOT e) AS BIGINT) AS tn, count_if(pass AND e) / CAST(count_if(pass) AS DOUBLE) AS precision,
  count_if(pass AND e) / CAST(count_if(e) AS DOUBLE) AS recall
FROM (SELECT pass, k % 16 NOT IN (10, 11, 14, 15) AS e FROM outcome)"""))
def prefilter_eval(spark, d):
    items = I.headlines(spark, d)
    predicted = pf.prefilter(items).select("item_id", F.col("pass").alias("predicted"))
    truth = items.selectExpr("item_id", "k % 16 not in (10, 11, 14, 15) as expected")
    return pf.evaluate(predicted, truth, "item_id")


@query("""SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR CAST(substr(source, 4) AS INT) % 3 <> 0 OR lang IN ('en', 'fr')""")
def category_filter(spark, d):
    docs = I.table(spark, d, "documents").selectExpr(
        "doc_id", "source as source_id", "case when doc_id % 7 = 0 then array() else array(lang, source) end as categories"
    )
    sources = docs.select("source_id").distinct().selectExpr(
        "source_id", "case when cast(substring(source_id, 4) as int) % 3 = 0 then array('en', 'fr') end as category_filter"
    )
    return pf.category_filter(docs, sources).select("doc_id")


# ---------------------------------------------------------------- keys


@query(f"SELECT page_id, {V.canonical('url')} AS canonical FROM pages")
def canonical_url(spark, d):
    return I.table(spark, d, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical"))


@query(V.query(V.HEADLINES, V.KEYED, select="SELECT item_id, url_key FROM keyed"))
def url_key(spark, d):
    return I.headlines(spark, d).select("item_id", tx.url_key(F.col("link")).alias("url_key"))


@query(V.query(V.HEADLINES, V.KEYED, select="SELECT item_id, ntitle AS normalized FROM keyed"))
def normalize_title(spark, d):
    return I.headlines(spark, d).select("item_id", tx.normalize_title(F.col("title")).alias("normalized"))


_SHORT = "CASE WHEN k % 8 = 0 THEN left(title, 14) ELSE title END"


@query(V.query(V.HEADLINES, select=f"""
SELECT item_id, CASE WHEN length(t) >= 12 THEN {V.short_hash('t')} END AS title_key
FROM (SELECT item_id, {V.norm_title(_SHORT)} AS t FROM headlines)"""))
def title_key(spark, d):
    return I.headlines(spark, d).select("item_id", tx.title_key(F.expr(_SHORT)).alias("title_key"))


@query(V.query(V.HEADLINES, V.VERDICTS, V.REPORTS, select="SELECT report_id, deal_key FROM reports"))
def deal_key(spark, d):
    return I.reports(spark, d).select("report_id", "deal_key")


@query("SELECT CASE WHEN h = '' THEN url ELSE lower(h) END AS host, count(*) AS n "
       "FROM (SELECT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages) GROUP BY 1")
def fetches_by_host(spark, d):
    return reports.fetches_by_host(I.table(spark, d, "pages"), "url")


# ---------------------------------------------------------------- dedupe

_RANK = "ORDER BY fetched_at, source_id, item_id"


def _keyed(spark, d):
    return dedupe.with_keys(I.headlines(spark, d))


@query(V.query(V.HEADLINES, V.KEYED, select=f"""
SELECT item_id, source_id, fetched_at FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, url_key {_RANK}) AS rn FROM keyed) WHERE rn = 1"""))
def dedupe_payload(spark, d):
    return ntz(dedupe.first_per_key(_keyed(spark, d), ["source_id", "url_key"], I.ORDER).select("item_id", "source_id", "fetched_at"))


@query(V.query(V.HEADLINES, V.KEYED, select=f"""
SELECT item_id, url_key FROM (SELECT *, row_number() OVER (PARTITION BY url_key {_RANK}) AS rn FROM keyed) WHERE rn = 1"""))
def dedupe_url(spark, d):
    return dedupe.dedupe_url(_keyed(spark, d), I.ORDER).select("item_id", "url_key")


_GREEDY = """ranked AS (SELECT item_id, source_id, fetched_at, url_key AS u, title_key AS t, row_number() OVER (ORDER BY fetched_at, source_id, item_id) AS rk FROM keyed),
steps(item_id, u, t, rk, state) AS (
  SELECT item_id, u, t, rk, 0 FROM ranked
  UNION ALL
  SELECT item_id, u, t, rk, CASE WHEN a THEN 1 ELSE 0 END FROM (
    SELECT *, bool_or(a) OVER (PARTITION BY u) AS bu, bool_or(a) OVER (PARTITION BY t) AS bt FROM (
      SELECT *, rk = min(rk) OVER (PARTITION BY u) AND rk = min(rk) OVER (PARTITION BY t) AS a FROM steps WHERE state = 0))
  WHERE a OR NOT (bu OR bt))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(V.query(V.HEADLINES, V.KEYED, _GREEDY, select="SELECT item_id FROM steps WHERE state = 1")))
def dedupe_two_key(spark, d):
    return dedupe.dedupe_two_key(_keyed(spark, d), I.ORDER).select("item_id")


@query(_recursive(V.query(V.HEADLINES, V.KEYED, _GREEDY, select="""
SELECT day, source_id, n_items, COALESCE(n_kept, 0) AS n_kept, n_items - COALESCE(n_kept, 0) AS duplicates
FROM (SELECT source_id, strftime(fetched_at, '%Y-%m') AS day, count(DISTINCT url_key) AS n_items FROM keyed GROUP BY ALL)
LEFT JOIN (SELECT r.source_id, strftime(r.fetched_at, '%Y-%m') AS day, count(*) AS n_kept
           FROM steps s JOIN ranked r USING (item_id) WHERE s.state = 1 GROUP BY ALL) USING (source_id, day)""")))
def duplicate_counts(spark, d):
    items = _keyed(spark, d).withColumn("day", F.date_format("fetched_at", "yyyy-MM"))
    kept = dedupe.dedupe_two_key(items, I.ORDER)
    return dedupe.duplicate_counts(items, kept, ["source_id", "day"])


@query(V.query(V.HEADLINES, select="SELECT item_id FROM headlines WHERE k % 3 <> 0 OR k = (SELECT min(k) FROM headlines WHERE k % 3 = 0)"))
def dedupe_hot_key(spark, d):
    """A third of the rows share an address."""
    items = I.headlines(spark, d).selectExpr("item_id", "case when k % 3 = 0 then 'hot' else concat('u', k) end as url_key", "concat('t', k) as title_key")
    return dedupe.dedupe_two_key(items, ["item_id"]).select("item_id")


@query(V.query(V.HEADLINES, select="SELECT item_id FROM headlines WHERE (k - (SELECT min(k) FROM headlines)) % 2 = 0"))
def dedupe_chain(spark, d):
    """All rows in one chain: each shares its address with one neighbour and its title with the other."""
    items = I.headlines(spark, d).selectExpr("item_id", "concat('c', floor((k + 1) / 2)) as url_key", "concat('d', floor(k / 2)) as title_key")
    return dedupe.dedupe_two_key(items, ["item_id"]).select("item_id")


_EARLY = "TIMESTAMP '1996-06-01 00:00:00'"


@query(V.query(V.HEADLINES, V.KEYED, select=f"""
SELECT item_id FROM keyed WHERE fetched_at >= {_EARLY}
  AND url_key NOT IN (SELECT url_key FROM keyed WHERE fetched_at < {_EARLY})
  AND title_key NOT IN (SELECT title_key FROM keyed WHERE fetched_at < {_EARLY})"""))
def anti_seen(spark, d):
    items = _keyed(spark, d)
    early = F.expr("timestamp '1996-06-01 00:00:00'")
    return dedupe.anti_seen(items.where(F.col("fetched_at") >= early), items.where(F.col("fetched_at") < early)).select("item_id")


@query(_recursive(V.query(V.HEADLINES, V.KEYED, _GREEDY, select="""
SELECT item_id FROM steps JOIN ranked r USING (item_id) WHERE steps.state = 1
  AND r.fetched_at > (SELECT min(fetched_at) FROM ranked f WHERE f.source_id = r.source_id)""")))
def bootstrap_gate(spark, d):
    items = _keyed(spark, d)
    kept = dedupe.dedupe_two_key(items, I.ORDER)
    return dedupe.bootstrap_gate(items, kept).select("item_id")


@query(V.query(V.HEADLINES, V.KEYED, select=f"""
, old AS (SELECT url_key AS id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY url_key {_RANK}) AS rn FROM keyed WHERE fetched_at < {_EARLY}) WHERE rn = 1),
new AS (SELECT url_key AS id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY url_key {_RANK}) AS rn FROM keyed WHERE fetched_at >= {_EARLY}) WHERE rn = 1)
SELECT id, item_id FROM old UNION ALL SELECT id, item_id FROM new WHERE id NOT IN (SELECT id FROM old)""").replace("\n\n, old", ", old"))
def insert_if_absent(spark, d):
    items = _keyed(spark, d).withColumn("id", F.col("url_key"))
    early = F.expr("timestamp '1996-06-01 00:00:00'")
    old = dedupe.first_per_key(items.where(F.col("fetched_at") < early), ["id"], I.ORDER)
    merged = sinks.upsert(old, items.where(F.col("fetched_at") >= early), "id", I.ORDER)
    return merged.select("id", "item_id")


@query(V.query(V.HEADLINES, V.KEYED, select=f"""
SELECT url_key AS id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY fetched_at DESC, source_id DESC, item_id DESC) AS rn FROM keyed) WHERE rn = 1"""))
def upsert_latest(spark, d):
    items = _keyed(spark, d).withColumn("id", F.col("url_key"))
    early = F.expr("timestamp '1996-06-01 00:00:00'")
    old = dedupe.first_per_key(items.where(F.col("fetched_at") < early), ["id"], I.ORDER)
    merged = sinks.upsert(old.limit(0), items, "id", I.ORDER, replace=True)
    return merged.select("id", "item_id")


@query(V.query(V.HEADLINES, select=f"SELECT item_id, CASE WHEN published_at <= {T} + INTERVAL 1 HOUR THEN published_at END AS published_at FROM headlines"))
def future_date_clamp(spark, d):
    return ntz(I.headlines(spark, d).select("item_id", tm.no_future(F.col("published_at"), I.NOW_ITEMS).alias("published_at")))


@query(V.query(V.HEADLINES, select=f"SELECT item_id FROM headlines WHERE fetched_at > {T} - INTERVAL 30 DAY"))
def retention(spark, d):
    return sinks.apply_retention(I.headlines(spark, d), "fetched_at", 30, I.NOW_ITEMS).select("item_id")


_UNIQUE = """SELECT o.* FROM steps s JOIN outcome o USING (item_id) WHERE s.state = 1"""


@query(_recursive(V.query(V.HEADLINES, V.KEYED, _GREEDY, V.OUTCOME, select=f"""
, uni AS ({_UNIQUE}), counts AS (
  SELECT 'fetched' AS stage, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM headlines UNION ALL SELECT 'unique', NULL, count(*) FROM uni
  UNION ALL SELECT 'passed', NULL, count(*) FROM uni WHERE pass UNION ALL SELECT 'rejected', NULL, count(*) FROM uni WHERE NOT pass
  UNION ALL SELECT 'rejected', reason, count(*) FROM uni WHERE NOT pass GROUP BY reason)
SELECT stage, reason, n, round(100.0 * n / (SELECT n FROM counts WHERE stage = CASE WHEN c.stage IN ('fetched', 'unique') THEN 'fetched' ELSE 'unique' END), 1) AS percent
FROM counts c""")))
def funnel(spark, d):
    items = _keyed(spark, d)
    unique = dedupe.dedupe_two_key(items, I.ORDER)
    # One narrow row for each unique item, written once: it gives both counts.
    outcomes = written(pf.prefilter(unique).select("pass", "reason"))
    return reports.funnel(items, outcomes, outcomes)


# ---------------------------------------------------------------- registry


@query("""WITH s AS (SELECT 'src' || (s_suppkey % 90) AS source_id, CASE WHEN s_suppkey % 10 = 0 THEN 'http' ELSE 'https' END || '://feeds.example.com/' || (s_suppkey % 95) AS url,
   30 + 10 * (s_suppkey % 8) AS i, s_suppkey % 7 <> 0 AS enabled FROM supplier),
 r AS (SELECT 'https://feeds.example.com/' || n_nationkey AS url FROM nation)
SELECT 'id is not unique' AS rule, source_id FROM s WHERE source_id IN (SELECT source_id FROM s GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'url is not unique', source_id FROM s WHERE url IN (SELECT url FROM s GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'url is not https', source_id FROM s WHERE url NOT LIKE 'https://%'
UNION ALL SELECT 'polled more than once a minute', source_id FROM s WHERE i < 60
UNION ALL SELECT 'enabled and rejected', source_id FROM s WHERE enabled AND url IN (SELECT url FROM r)""")
def registry_violations(spark, d):
    sources = I.table(spark, d, "supplier").selectExpr(
        "concat('src', s_suppkey % 90) as source_id",
        "concat(case when s_suppkey % 10 = 0 then 'http' else 'https' end, '://feeds.example.com/', s_suppkey % 95) as url",
        "30 + 10 * (s_suppkey % 8) as min_interval_seconds", "s_suppkey % 7 <> 0 as enabled",
    )
    rejected = I.table(spark, d, "nation").selectExpr("concat('https://feeds.example.com/', n_nationkey) as url")
    return registry.check_registry(sources, rejected)


# ---------------------------------------------------------------- queue

_CANDS = V.query(V.HEADLINES, V.CANDIDATES, select="")
_STATE = "id, status, status_at, attempts"


@query(_CANDS + f"""SELECT id, CASE WHEN x THEN 'rejected' ELSE status END AS status, CASE WHEN x THEN {T} ELSE status_at END AS status_at,
  CASE WHEN x THEN 'stale: older than 6h before it could be classified' END AS rejected_reason, CASE WHEN x THEN {T} + INTERVAL 30 DAY END AS expires_at
FROM (SELECT *, status = 'pending' AND COALESCE(published_at, fetched_at) < {T} - INTERVAL 6 HOUR AS x FROM candidates)""")
def expire_stale(spark, d):
    done = queue.expire_stale(I.candidates(spark, d), I.NOW_ITEMS)
    return ntz(done.select("id", "status", "status_at", "rejected_reason", "expires_at"))


@query(_CANDS + f"""SELECT id, attempts + 1 AS attempts, {T} AS status_at, fetched_at FROM candidates
WHERE status = 'pending' AND attempts < 5 AND (attempts = 0 OR status_at <= {T} - INTERVAL 5 MINUTE) ORDER BY fetched_at DESC, id LIMIT 15""")
def claim_batch(spark, d):
    return ntz(queue.claim_batch(I.candidates(spark, d), I.NOW_ITEMS).select("id", "attempts", "status_at", "fetched_at"))


@query(_CANDS + "SELECT status, count(*) AS n FROM candidates GROUP BY status")
def queue_depth(spark, d):
    return queue.queue_depth(I.candidates(spark, d))


@query(_CANDS + """SELECT id, status, attempts FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM (
    SELECT id % 500 AS id, id AS seq, status, attempts FROM candidates)) WHERE rn = 1""")
def candidate_latest(spark, d):
    log = I.candidates(spark, d).selectExpr("id % 500 as id", "id as seq", "status", "attempts")
    return queue.latest_state(log, ["status", "attempts"])


@query(_CANDS + f"""SELECT id, CASE WHEN x THEN 'pending' ELSE status END AS status, CASE WHEN x THEN {T} - INTERVAL 5 MINUTE ELSE status_at END AS status_at, attempts
FROM (SELECT *, status = 'classified' AND attempts < 5 AND status_at <= {T} - INTERVAL 5 MINUTE AS x FROM candidates)""")
def recover_stuck(spark, d):
    return ntz(queue.recover_stuck(I.candidates(spark, d), I.NOW_ITEMS).selectExpr(*_STATE.split(", ")))


@query(_CANDS + f"""SELECT id, status, CASE WHEN x THEN {T} - INTERVAL 301 SECOND ELSE status_at END AS status_at, CASE WHEN x THEN 0 ELSE attempts END AS attempts
FROM (SELECT *, status = 'pending' AND attempts >= 5 AS x FROM candidates)""")
def reset_exhausted(spark, d):
    return ntz(queue.reset_exhausted(I.candidates(spark, d), I.NOW_ITEMS).selectExpr(*_STATE.split(", ")))


@query(_CANDS + f"""SELECT id, CASE WHEN x THEN 'pending' ELSE status END AS status, CASE WHEN x THEN {T} - INTERVAL 301 SECOND ELSE status_at END AS status_at,
  CASE WHEN x AND id % 3 = 0 THEN attempts - 1 ELSE attempts END AS attempts
FROM (SELECT *, status = 'classified' AND id % 8 = 1 AS x FROM candidates)""")
def return_to_pending(spark, d):
    failed = (F.col("status") == "classified") & (F.col("id") % 8 == 1)
    done = queue.return_to_pending(I.candidates(spark, d), I.NOW_ITEMS, failed, F.col("id") % 3 == 0)
    return ntz(done.selectExpr(*_STATE.split(", ")))


_PACKED = f"""packed AS (SELECT *, (rn - 1) // 15 AS batch_id, 'i' || ((rn - 1) % 15) AS item_no
  FROM (SELECT *, row_number() OVER (ORDER BY fetched_at, id) AS rn FROM candidates WHERE status = 'pending'))"""


def _packed(spark, d):
    return queue.pack_batches(I.candidates(spark, d).where("status = 'pending'"))


@query(V.query(V.HEADLINES, V.CANDIDATES, _PACKED, select="SELECT id, batch_id, item_no FROM packed"))
def batch_packing(spark, d):
    return _packed(spark, d).select("id", "batch_id", "item_no")


@query(V.query(V.HEADLINES, V.CANDIDATES, _PACKED, select="""
SELECT id, batch_id, thin AND sum(CAST(thin AS INT)) OVER (PARTITION BY batch_id ORDER BY fetched_at, id) <= 5 AS fetch_article
FROM (SELECT *, length(summary) < 400 AND COALESCE(CAST(substr(source_id, 4) AS INT) % 4 <> 0, TRUE) AS thin FROM packed)"""))
def enrichment_plan(spark, d):
    permits = I.headlines(spark, d).select("source_id").distinct().selectExpr(
        "source_id", "cast(substring(source_id, 4) as int) % 4 <> 0 as fetch_article"
    )
    return queue.needs_enrichment(_packed(spark, d), permits).select("id", "batch_id", "fetch_article")


_REQUEST = """
SELECT batch_id, count(*) AS n_items, 'Classify each of the following ' || count(*) || ' news item(s).' || chr(10) || chr(10) ||
  string_agg('--- ITEM id=' || item_no || ' ---' || chr(10) || 'Source: ' || source_id || chr(10) || 'Published: ' ||
    COALESCE(strftime(published_at, '%Y-%m-%dT%H:%M:%S.%gZ'), 'unknown') || chr(10) || 'Title: ' || title || chr(10) || 'Body: ' || {body},
    chr(10) || chr(10) ORDER BY rn) AS request
FROM packed GROUP BY batch_id"""


@query(V.query(V.HEADLINES, V.CANDIDATES, _PACKED, select=_REQUEST.replace("{body}", "substr(summary, 1, 1500)")))
def render_request(spark, d):
    return queue.render_requests(_packed(spark, d).withColumn("body", F.col("summary")))


@query(V.query(V.HEADLINES, V.CANDIDATES, _PACKED, "texts AS (SELECT doc_id, text FROM documents)", select=_REQUEST.replace("{body}", "COALESCE(text, summary)")
    .replace("FROM packed", "FROM packed LEFT JOIN texts ON doc_id = id")))
def render_request_whole(spark, d):
    """As ``render_request``, over whole document texts where a candidate has one."""
    texts = I.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    packed = _packed(spark, d).join(texts, "id", "left").withColumn("body", F.coalesce("text", "summary")).drop("text")
    return queue.render_requests(packed, None)


_BODY = """WITH a AS (SELECT page_id, {link} AS link, {article} AS article FROM pages),
one AS (SELECT link, article FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id) AS rn FROM a) WHERE rn = 1)
SELECT page_id, {cut}(CASE WHEN length(one.article) > length(text) THEN one.article ELSE text END{to}) AS body
FROM a JOIN documents ON doc_id = page_id LEFT JOIN one USING (link)"""


def _bodies(spark, d, article_chars, body_chars):
    pages = I.table(spark, d, "pages").withColumn("link", tx.canonical_url(F.col("url")))
    articles = dedupe.first_per_key(
        pages.select("link", "page_id", tx.article_text(F.col("html"), article_chars).alias("article")), ["link"], ["page_id"]
    )
    docs = I.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("summary"))
    cands = pages.select("page_id", "link").join(docs, "page_id")
    return queue.choose_body(cands, articles, body_chars).select("page_id", "body")


@query(_BODY.format(link=V.canonical("url"), article=V.article("html"), cut="substr", to=", 1, 1500"))
def choose_body(spark, d):
    return _bodies(spark, d, config.SUMMARY_CHARS, config.BODY_CHARS)


@query(_BODY.format(link=V.canonical("url"), article=V.article("html", None), cut="", to=""))
def choose_body_whole(spark, d):
    """As ``choose_body``, with whole articles and whole texts."""
    return _bodies(spark, d, None, None)
