"""DuckDB counterparts of the working tables, as common table expressions."""

from __future__ import annotations

from wirepulse import config
from wirepulse.plans import inputs as I


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def pick(values, index: str) -> str:
    return f"(list_value({', '.join(q(v) for v in values)}))[CAST({index} AS INT) + 1]"


def canonical(col: str) -> str:
    """Canonical address of a well-formed http(s) address."""
    tracking = ", ".join(q(p) for p in config.TRACKING_PARAMS)
    host = f"regexp_replace(lower(regexp_extract({col}, '^https?://([^/?#]+)', 1)), '^www\\.', '')"
    path = f"regexp_extract({col}, '^https?://[^/?#]+([^?#]*)', 1)"
    query = f"regexp_extract({col}, '\\?([^#]*)', 1)"
    kept = f"list_filter(string_split({query}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({tracking}))"
    params = f"array_to_string(list_sort({kept}), '&')"
    full = (
        f"'https://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN {params} = '' THEN '' ELSE '?' || {params} END"
    )
    return f"CASE WHEN ({full}) LIKE '%/' AND {path} NOT IN ('', '/') THEN left({full}, length({full}) - 1) ELSE {full} END"


def short_hash(expr: str) -> str:
    return f"substr(sha256({expr}), 1, 32)"


def norm_title(col: str) -> str:
    prefixes = "|".join(config.TITLE_PREFIXES).replace("'", "''")
    prefix = f"^(?:{prefixes})\\s*[:\\-–—]\\s*"
    text = f"trim(lower({col}))"
    for _ in range(2):
        text = f"regexp_replace({text}, '{prefix}', '')"
    return f"trim(regexp_replace({text}, '[^a-z0-9$%+]+', ' ', 'g'))"


def deal_key(company: str, event: str) -> str:
    suffixes = "|".join(config.COMPANY_SUFFIXES)
    name = f"regexp_replace({norm_title(company)}, '\\b({suffixes})\\b', '', 'g')"
    return short_hash(f"trim(regexp_replace({name}, ' +', ' ', 'g')) || '::' || {event}")


def first_of(col: str, patterns, result=None) -> str:
    """CASE over patterns in order: the result for the first that occurs."""
    result = result or (lambda p: q(p))
    arms = " ".join(f"WHEN regexp_matches({col}, {q('(?i)' + p)}) THEN {result(p)}" for p in patterns)
    return f"CASE {arms} END"


def family_case(col: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({col}, {q('(?i)' + p)}) THEN {q(name + '#' + p)}"
        for name, terms in config.FAMILIES.items() for p in terms
    )
    return f"CASE {arms} END"


HEADLINES = f"""headlines AS (
  SELECT k AS item_id, k, c, 'src' || (c % 20) AS source_id, company, phrase,
    {pick(("Exclusive: ", "UPDATE: ", "", "", ""), "k % 5")} || company || ' ' || phrase AS title,
    {pick(I.SUMMARIES, "k % 6")} AS summary,
    CASE WHEN k % 17 = 0 THEN NULL ELSE d + to_minutes(CAST(k % 1440 AS INT)) END AS published_at,
    d + to_minutes(CAST(k % 1440 + c % 900 AS INT)) AS fetched_at,
    CASE c % 2 WHEN 0 THEN 'http://www.' ELSE 'https://' END || 'wire' || (c % 7) || '.example.com/' || c || '/' || (k % 12)
      || {pick(I.LINK_TAILS, "k % 5")} AS link
  FROM (SELECT *, 'Customer ' || c || {pick((" Inc.", " Corporation", "", " Ltd"), "k % 4")} AS company,
          {pick(I.PHRASES, "k % 16")} AS phrase
        FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d FROM orders)))"""

KEYED = f"""keyed AS (
  SELECT *, {short_hash('curl')} AS url_key,
    CASE WHEN length(ntitle) >= 12 THEN {short_hash('ntitle')} ELSE {short_hash('curl')} END AS title_key
  FROM (SELECT *, {canonical('link')} AS curl, {norm_title('title')} AS ntitle FROM headlines))"""

OUTCOME = f"""matched AS (
  SELECT *, {family_case('title')} AS tm, {family_case('haystack')} AS bm, {first_of('haystack', config.VETO)} AS veto
  FROM (SELECT *, title || chr(10) || substr(summary, 1, 1500) AS haystack FROM headlines)),
outcome AS (
  SELECT item_id, title, source_id, fetched_at, published_at, link, summary, k, c,
    m IS NOT NULL AND veto IS NULL AS pass,
    CASE WHEN m IS NOT NULL AND veto IS NULL THEN split_part(m, '#', 1) END AS hit,
    CASE WHEN m IS NULL THEN 'no tracked event language' WHEN veto IS NOT NULL THEN 'vetoed by ' || veto
         ELSE 'matched ' || substr(m, strpos(m, '#') + 1) END AS reason,
    COALESCE(m IS NOT NULL AND veto IS NULL AND split_part(tm, '#', 1) IN ('funding', 'acquisition')
      AND regexp_matches(title, {q('(?i)' + config.MONEY)}), FALSE) AS strong,
    split_part(m, '#', 1) AS family, tm IS NOT NULL AS in_title
  FROM (SELECT *, COALESCE(tm, bm) AS m FROM matched))"""

FILINGS = f"""filings AS (
  SELECT item_id, k, {pick(I.FORMS, "k % 6")} AS form,
    {pick(I.FORMS, "k % 6")} || ' - Filer ' || c || ' ' || {pick(I.FILERS, "k % 9")} || ' (' || lpad(CAST(k AS VARCHAR), 10, '0') || ') (Filer)' AS title,
    'Filer ' || c || ' ' || {pick(I.FILERS, "k % 9")} AS filer,
    {pick(I.FILING_TEXTS, "k % 5")} AS summary
  FROM headlines)"""

VERDICTS = f"""verdicts AS (
  SELECT item_id, k, c, source_id, title, link, summary, published_at, fetched_at,
    'Merchant ' || (c % 40) || {pick((" Inc.", " Corporation", "", " Ltd"), "k % 4")} AS company,
    {pick(I.EVENT_OF_PHRASE, "k % 16")} AS event, {pick(config.REGIONS, "c % 5")} AS region,
    k % 10 <> 3 AS relevant, k % 9 <> 4 AS is_fintech, (k % 100) / 100.0 AS confidence,
    CASE k % 3 WHEN 0 THEN 'Series B' WHEN 1 THEN '' END AS round,
    CASE WHEN k % 4 = 1 THEN '$25M & more' END AS amount, CASE WHEN k % 4 = 2 THEN '$300M' END AS deal_value,
    CASE k % 5 WHEN 0 THEN ['Alpha <Fund>', 'Beta'] WHEN 1 THEN [''] ELSE CAST([] AS VARCHAR[]) END AS lead_investors,
    CASE k % 7 WHEN 0 THEN ['Gamma', '', 'Delta', 'Eps', 'Zeta'] WHEN 1 THEN ['One'] ELSE CAST([] AS VARCHAR[]) END AS other_investors,
    CASE WHEN k % 2 = 0 THEN 'Buyer''s Bank' END AS acquirer, CASE WHEN k % 3 <> 1 THEN 'Target & Co' END AS target,
    k % 11 = 0 AS unverified
  FROM headlines),
events_cfg(event, icon, label, min_confidence, window_hours) AS (VALUES
  {', '.join(f"({q(e.id)}, {q(e.icon)}, {q(e.label)}, {e.min_confidence}, {e.window_hours})" for e in config.EVENTS)})"""

REPORTS = f"""reports AS (
  SELECT *, {deal_key('company', 'event')} AS deal_key, item_id AS report_id, fetched_at AS reported_at
  FROM verdicts WHERE event IS NOT NULL)"""

DEALS = """deals AS (
  SELECT item_id, CAST(item_id AS VARCHAR) AS deal_key, company, event, region, round, amount, deal_value, published_at,
    k % 1000 AS n_sources, unverified, CASE WHEN k % 13 = 0 THEN 'alerting' ELSE 'sent' END AS alert_state,
    CASE WHEN k % 19 = 0 THEN published_at - INTERVAL 30 MINUTE ELSE fetched_at + to_seconds(CAST(k % 7200 AS INT)) END AS alerted_at
  FROM reports)"""

CANDIDATES = f"""candidates AS (
  SELECT item_id AS id, source_id, title, link, summary, published_at, fetched_at,
    {pick(("pending", "classified", "alerted", "rejected"), "k % 4")} AS status,
    TIMESTAMP '{I.NOW_ITEMS}' - INTERVAL 14 MINUTE + to_seconds(CAST(k % 900 AS INT)) AS status_at,
    CAST(k % 7 AS INT) AS attempts, CAST(NULL AS VARCHAR) AS rejected_reason, CAST(NULL AS TIMESTAMP) AS expires_at
  FROM headlines)"""

FETCH_LOG = """fetch_log AS (
  SELECT 'src' || (user_id % 30) AS source_id, event_id AS check_id, ts, event_type <> 'error' AS ok,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'not-modified' ELSE 'ok' END AS status,
    CASE WHEN event_id % 3 = 0 THEN 'e' || CAST(trunc(value) AS BIGINT) END AS etag,
    CASE WHEN event_id % 5 = 0 THEN 'm' || event_id END AS last_modified,
    CASE WHEN event_type NOT IN ('error', 'view') THEN props END AS body,
    CASE WHEN event_type = 'error' THEN 'HTTP ' || (500 + event_id % 5) END AS error
  FROM events)"""

REGISTRY = """registry AS (
  SELECT 'src' || s_suppkey AS source_id, s_name AS name, CAST(60 + 600 * (s_suppkey % 5) AS INT) AS min_interval_seconds,
    s_suppkey % 7 <> 0 AS enabled FROM supplier)"""

CALLS = """calls AS (
  SELECT 'model-' || (user_id % 2) || '.5' AS model, event_id AS call_id, ts, event_type <> 'error' AS ok,
    CASE event_type WHEN 'error' THEN [429, 503, 400, 500, NULL][CAST(event_id % 5 AS INT) + 1] ELSE 200 END AS status
  FROM events)"""

CYCLES = """cycles AS (
  SELECT event_type AS job, event_id AS cycle_id, ts, 1 AS cycles, CAST(trunc(value * 100) AS BIGINT) AS wall_ms,
    CAST(trunc(value) AS BIGINT) AS cpu_ms, event_id % 12 AS items_seen, event_id % 5 AS candidates,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS alerts FROM events)"""

STATE = f"""seen_log AS (SELECT * FROM fetch_log WHERE ts <= TIMESTAMP '{I.NOW_EVENTS}'),
good AS (SELECT source_id, max(ts) AS last_checked_at, max(ts) FILTER (ok) AS last_success_at FROM seen_log GROUP BY source_id),
state AS (
  SELECT g.source_id, g.last_checked_at, g.last_success_at, count(l.ts) AS error_count, arg_max(l.error, l.ts) AS last_error
  FROM good g LEFT JOIN seen_log l ON l.source_id = g.source_id AND NOT l.ok AND (g.last_success_at IS NULL OR l.ts > g.last_success_at)
  GROUP BY ALL)"""


def duration(ms: str) -> str:
    s = f"CAST(floor({ms} / 1000.0 + 0.5) AS BIGINT)"
    return (
        f"CASE WHEN {ms} < 0 THEN '0s' WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN ({s} // 60) || 'm ' || ({s} % 60) || 's' "
        f"ELSE ({s} // 3600) || 'h ' || (({s} // 60) % 60) || 'm' END"
    )


def ms_between(start: str, end: str) -> str:
    return f"(epoch_us({end}) // 1000 - epoch_us({start}) // 1000)"


def to_fixed(x: str, digits: int) -> str:
    """printf rounds exact ties to even; nudge those up."""
    steps = {1: 4, 2: 8}[digits]
    return f"printf('%.{digits}f', CASE WHEN {x} * {steps} = floor({x} * {steps}) THEN nextafter({x}, CAST('inf' AS DOUBLE)) ELSE {x} END)"


def ago(ts: str, now: str) -> str:
    return f"CASE WHEN {ts} IS NULL THEN 'never' ELSE ({duration(ms_between(ts, now))}) || ' ago' END"


def escape(expr: str) -> str:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        expr = f"replace({expr}, '{char}', '{ref}')"
    return expr


def query(*views: str, select: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + select


def strip_html(expr: str) -> str:
    for tag in ("script", "style"):
        expr = f"regexp_replace({expr}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
    expr = f"regexp_replace({expr}, '<[^>]+>', ' ', 'g')"
    # "amp" last, so that no reference is decoded twice.
    for name, char in sorted(config.NAMED_ENTITIES.items(), key=lambda e: e[0] == "amp"):
        expr = f"regexp_replace({expr}, '(?i)&{name};', {q(char)}, 'g')"
    return f"trim(regexp_replace({expr}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def article(html: str, chars: int | None = 4000) -> str:
    a, b = "(?is)<article[^>]*>(.*?)</article>", "(?is)<body[^>]*>(.*?)</body>"
    main = (
        f"CASE WHEN regexp_matches({html}, '{a}') THEN regexp_extract({html}, '{a}', 1) "
        f"WHEN regexp_matches({html}, '{b}') THEN regexp_extract({html}, '{b}', 1) ELSE {html} END"
    )
    for tag in ("nav", "header", "footer", "aside"):
        main = f"regexp_replace({main}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
    text = strip_html(main)
    return f"CASE WHEN length({text}) > 200 THEN {text if chars is None else f'substr({text}, 1, {chars})'} END"
