"""Column layouts of the tables the operators exchange."""

FETCH_LOG = (
    "source_id string, check_id bigint, ts timestamp, status string, via string, http_status int, bytes bigint, "
    "duration_ms bigint, reason string, etag string, last_modified string, body string"
)
SOURCES = (
    "source_id string, name string, url string, type string, region_hint string, min_interval_seconds int, "
    "conditional_get string, enabled boolean, category_filter array<string>, timeout_ms int, fetch_article boolean"
)
REJECTED_SOURCES = "name string, url string, reason string"
ITEMS = (
    "source_id string, position int, title string, link string, summary string, published_at timestamp, guid string, "
    "categories array<string>, sec_form_type string, fetched_at timestamp"
)
SEEN = "url_key string, title_key string, source_id string, link string, title string, first_seen_at timestamp"
CANDIDATES = (
    "id string, source_id string, title string, link string, summary string, published_at timestamp, "
    "fetched_at timestamp, status string, status_at timestamp, attempts int, rejected_reason string, "
    "expires_at timestamp, sec_form_type string"
)
OUTBOX = "deal_key string, emit_ts timestamp, channel string, alert_html string"
