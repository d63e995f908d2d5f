"""URL filter: host and path rules, and a list of canonical URLs behind a Bloom filter.

A list entry blocks every spelling of its URL. A broadcast blocked Bloom filter passes
possible hits only, and an exact hash join on the canonical URL removes the false
ones, so results do not depend on the filter. Built-in expressions throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wirepulse.llm import bloom
from wirepulse.session import checkpointed

# The rules of the contract as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Query parameters that do not select a page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)=.*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, sorted parameters without tracking ones.

    Null where the url is null or has no ``://``.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(
        F.instr(url, "://") > 0,
        F.concat(
            F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""),
            F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")),
        ),
    )


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (``host`` + ``path``) that fits, as a struct of rule and verdict; else null.

    A rule fits its host and all subdomains where the path starts with its own.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(ordered):
        at_host = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(at_host & F.startswith(path, F.lit(rule_path)), value).otherwise(fits)
    return fits


def listed_urls(pages: DataFrame, url_col: str = "url", html_col: str = "html", marks: int = 20) -> DataFrame:
    """A block list from page contents: canonical URLs of pages with at least ``marks`` runs of symbols."""
    runs = F.regexp_count(F.col(html_col), F.lit(r"[*#$%&]{3}"))
    return pages.where(runs >= marks).select(canonical(F.col(url_col)).alias("canonical"))


def filter_urls(
    pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES, blocks: int | None = None,
) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, canonical, listed``.

    ``listed`` has a column ``canonical``; repeats and nulls in it are harmless. The
    verdict is that of the longest fitting rule, else ``block`` for a listed URL, else
    ``allow``; a null url, or one without ``://``, has an empty host and path, no
    canonical form, and is allowed. Repeated rows repeat; null ids are carried along;
    other columns of the pages are not read. Only possible hits are shuffled, and a
    URL that fills a third of them is split by the planner's skew handling, as the
    listed side has one row a URL. The list is evaluated once; ``blocks`` of the filter
    follow its length unless given, and beyond ``bloom.SENT`` of them the filter is
    partitioned instead of sent. A url of any length is one row's work.
    """
    narrow = pages.select(F.col(id_col).alias("row_id"), F.col(url_col).alias("row_url"))
    urls = listed.select(F.col("canonical").alias("listed_url")).where(F.col("listed_url").isNotNull())
    listing = checkpointed(urls.distinct())
    blocks = blocks or bloom.sized(listing.count())
    keyed = narrow.withColumn("canonical", canonical(F.col("row_url")))
    probed = bloom.probe(keyed, F.col("canonical"), bloom.build(listing, F.col("listed_url"), blocks), "possible", blocks)
    exact = (
        probed.where("possible")
        .join(listing.hint("shuffle_hash"), F.col("canonical") == F.col("listed_url"), "left")
        .withColumn("listed", F.col("listed_url").isNotNull())
    )
    columns = ["row_id", "row_url", "canonical", "listed"]
    judged = probed.where(~F.col("possible")).withColumn("listed", F.lit(False)).select(columns).unionAll(exact.select(columns))
    parts = judged.withColumn("host", host_of(F.col("row_url"))).withColumn("path", path_of(F.col("row_url")))
    ruled = parts.withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select(
        F.col("row_id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), by_list).alias("verdict"), "canonical", "listed",
    )


#: The same in SQL, over the whole table and without a filter in front.
ORACLE = r"""
WITH parts AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS kept,
    url
  FROM pages
), keyed AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
      regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM parts
), listing AS (
  SELECT DISTINCT canonical AS c FROM keyed
  WHERE len(regexp_extract_all(html, '[*#$%&]{3}')) >= 20 AND canonical IS NOT NULL
), judged AS (
  SELECT k.*, l.c IS NOT NULL AS listed,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM keyed k LEFT JOIN listing l ON k.canonical = l.c
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
  canonical, listed
FROM judged
"""
