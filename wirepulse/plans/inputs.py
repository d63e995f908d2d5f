"""Working tables derived from the given parquet tables.

``orders`` carries no news, so ``headlines`` spells one item per order out of
its keys; filings, reports, candidates and logs are views over that or over
``events``. All are lazy, whole-table and deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirepulse import config
from wirepulse.functions import times as tm
from wirepulse.session import use_utc

NOW_ITEMS = "1998-06-01 00:00:00"
NOW_EVENTS = "2024-01-28 12:00:00"

PHRASES = (
    "raises $25M Series B", "secures $40 million credit facility", "acquires a rival processor in $300M deal",
    "to acquire a lender", "launches a card", "unveils a billing dashboard", "expands to Canada", "opens new office",
    "rebrands", "partners with a bank", "names three board members", "reports earnings",
    "appoints new CFO to lead funding strategy", "launches a card and raises $20M", "runs a background check",
    "shares news",
)
EVENT_OF_PHRASE = (
    "funding", "funding", "acquisition", "acquisition", "launch", "launch", "expansion", "expansion", "rebrand",
    "partnership", None, None, "funding", "funding", None, None,
)
SUMMARIES = (
    "The market is projected to grow at a high cagr.", "A quarterly dividend was declared.",
    "The round was led by a fund.", "It will merge two units.", "Nothing else was said.", "Nothing else was said.",
)
LINK_TAILS = ("?utm_source=rss&b=2&a=1", "/", "#top", "?a=1&b=2", "")
FORMS = ("8-K", "D", "8-K", "D/A", "10-Q", "8-K")
FILERS = (
    "Payments Inc", "Capital Fund II", "Robotics", "Bank", "Partners LP", "Mortgage Corp", "Opportunities",
    "Metals Corp.", "Realty",
)
FILING_TEXTS = (
    "Item 2.01 Completion of Acquisition or Disposition of Assets", "Item 1.01 Entry into a Material Definitive Agreement",
    "Item 1.01 Entry into a Material Definitive Agreement. The parties signed a merger plan.",
    "Item 5.02 Departure of Directors", "",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: str):
    """SQL: the element of a fixed list at a (remainder) index."""
    quoted = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"element_at(array({quoted}), cast({index} as int) + 1)"


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    base = orders.selectExpr("o_orderkey as k", "o_custkey as c", "cast(o_orderdate as timestamp) as d")
    named = base.selectExpr(
        "*",
        "concat('Customer ', c, " + pick((" Inc.", " Corporation", "", " Ltd"), "k % 4") + ") as company",
        pick(PHRASES, "k % 16") + " as phrase",
    )
    return named.selectExpr(
        "k as item_id", "k", "c",
        "concat('src', c % 20) as source_id", "company", "phrase",
        "concat(" + pick(("Exclusive: ", "UPDATE: ", "", "", ""), "k % 5") + ", company, ' ', phrase) as title",
        pick(SUMMARIES, "k % 6") + " as summary",
        "case when k % 17 = 0 then null else timestampadd(MINUTE, k % 1440, d) end as published_at",
        "timestampadd(MINUTE, k % 1440 + c % 900, d) as fetched_at",
        "concat(case c % 2 when 0 then 'http://www.' else 'https://' end, 'wire', c % 7, '.example.com/', c, '/', k % 12, "
        + pick(LINK_TAILS, "k % 5") + ") as link",
    )


ORDER = ["fetched_at", "source_id", "item_id"]


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headlines(spark, sf_dir).selectExpr(
        "item_id",
        "concat(" + pick(FORMS, "k % 6") + ", ' - Filer ', c, ' ', " + pick(FILERS, "k % 9")
        + ", ' (', lpad(cast(k as string), 10, '0'), ') (Filer)') as title",
        pick(FILING_TEXTS, "k % 5") + " as summary",
        "case when k % 4 = 0 then array() else array(named_struct('term', 'x', 'label', 'other'), named_struct('term', "
        + pick(FORMS, "k % 6") + ", 'label', 'form type')) end as category_structs",
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored verdict per headline."""
    return headlines(spark, sf_dir).selectExpr(
        "item_id", "k", "c", "source_id", "title", "link", "summary", "published_at", "fetched_at",
        "concat('Merchant ', c % 40, " + pick((" Inc.", " Corporation", "", " Ltd"), "k % 4") + ") as company",
        pick(EVENT_OF_PHRASE, "k % 16") + " as event",
        pick(config.REGIONS, "c % 5") + " as region",
        "k % 10 <> 3 as relevant", "k % 9 <> 4 as is_fintech", "(k % 100) / 100.0D as confidence",
        "case k % 3 when 0 then 'Series B' when 1 then '' end as round",
        "case when k % 4 = 1 then '$25M & more' end as amount",
        "case when k % 4 = 2 then '$300M' end as deal_value",
        "case k % 5 when 0 then array('Alpha <Fund>', 'Beta') when 1 then array('') else array() end as lead_investors",
        "case k % 7 when 0 then array('Gamma', '', 'Delta', 'Eps', 'Zeta') when 1 then array('One') else array() end as other_investors",
        "case when k % 2 = 0 then \"Buyer's Bank\" end as acquirer",
        "case when k % 3 <> 1 then 'Target & Co' end as target",
        "k % 11 = 0 as unverified",
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deal reports: the verdicts that name an event."""
    from wirepulse.functions.text import deal_key

    named = verdicts(spark, sf_dir).where("event is not null")
    return named.withColumn("deal_key", deal_key(F.col("company"), F.col("event"))).withColumn(
        "report_id", F.col("item_id")
    ).withColumn("reported_at", F.col("fetched_at"))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored deals: every report as if it had been alerted."""
    return reports(spark, sf_dir).selectExpr(
        "item_id", "cast(item_id as string) as deal_key", "company", "event", "region", "round", "amount", "deal_value",
        "published_at", "k % 1000 as n_sources", "unverified",
        "case when k % 13 = 0 then 'alerting' else 'sent' end as alert_state",
        "case when k % 19 = 0 then timestampadd(MINUTE, -30, published_at) else timestampadd(SECOND, k % 7200, fetched_at) end as alerted_at",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = pick(("pending", "classified", "alerted", "rejected"), "k % 4")
    return headlines(spark, sf_dir).selectExpr(
        "item_id as id", "source_id", "title", "link", "summary", "published_at", "fetched_at",
        status + " as status",
        "timestampadd(SECOND, k % 900, timestampadd(MINUTE, -14, timestamp '" + NOW_ITEMS + "')) as status_at",
        "cast(k % 7 as int) as attempts", "cast(null as string) as rejected_reason", "cast(null as timestamp) as expires_at",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def fetch_log(spark: SparkSession, sf_dir: str, healthy: str = "event_type <> 'error'") -> DataFrame:
    """``events`` read as source checks: errors are failures, the rest successes."""
    return event_log(spark, sf_dir).selectExpr(
        "concat('src', user_id % 30) as source_id", "event_id as check_id", "ts",
        f"{healthy} as ok",
        "case event_type when 'error' then 'error' when 'view' then 'not-modified' else 'ok' end as status",
        "case when event_id % 3 = 0 then concat('e', cast(value as bigint)) end as etag",
        "case when event_id % 5 = 0 then concat('m', event_id) end as last_modified",
        "case when event_type not in ('error', 'view') then props end as body_hash",
        "case when event_type not in ('error', 'view') then props end as body",
        f"case when not ({healthy}) then concat('HTTP ', 500 + event_id % 5) end as error",
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with one source per supplier remainder seen in the log, and more."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('src', s_suppkey) as source_id", "s_name as name",
        "cast(60 + 600 * (s_suppkey % 5) as int) as min_interval_seconds", "s_suppkey % 7 <> 0 as enabled",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as scorer calls of two models."""
    return event_log(spark, sf_dir).selectExpr(
        "concat('model-', user_id % 2, '.5') as model", "event_id as call_id", "ts", "event_type <> 'error' as ok",
        "case event_type when 'error' then cast(element_at(array(429, 503, 400, 500, null), cast(event_id % 5 as int) + 1) as int) else 200 end as status",
    )


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as cycle runs of a few jobs."""
    return event_log(spark, sf_dir).selectExpr(
        "event_type as job", "event_id as cycle_id", "ts", "cast(1 as bigint) as cycles",
        "cast(value * 100 as bigint) as wall_ms", "cast(value as bigint) as cpu_ms",
        "event_id % 12 as items_seen", "event_id % 5 as candidates", "case when event_type = 'purchase' then 1 else 0 end as alerts",
    )


def ntz(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as in the given tables."""
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


now_items = lambda: tm.instant(NOW_ITEMS)
