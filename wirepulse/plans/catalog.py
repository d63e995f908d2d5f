"""All registered queries."""

from wirepulse.plans import deal_queries, feed_queries, health_queries, item_queries, store_queries, stream_queries  # noqa: F401
from wirepulse.plans.registered import ORACLES, QUERIES  # noqa: F401
