"""Scoring: one pass, unanswered candidates, repeated answers, the payload rule."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wirepulse.operators import dedupe, gate, verdicts as vd
from wirepulse.plans import flow

START = datetime(2026, 1, 1)
ITEM = "id bigint, source_id string, title string, link string, summary string, published_at timestamp, fetched_at timestamp, hit string, strong boolean"


def candidates(spark, n=6):
    rows = [
        (k, "a", f"Firm{k} Payments raises ${k + 1} million", f"https://x/{k}", "A lender.", START, START + timedelta(minutes=k), "funding", True)
        for k in range(n)
    ]
    return spark.createDataFrame(rows, ITEM)


def test_each_item_is_scored_once_and_the_rest_stays_pending(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer(items):
        def run(batches):
            for batch in batches:
                calls.add(len(batch))
                yield batch

        same = items.mapInPandas(run, items.schema)
        answered = vd.keyword_scorer(same.where("item_no in ('i0', 'i1')"))
        return answered.unionByName(answered.where("id = 'i1'").withColumn("company", F.lit("Later")).withColumn("confidence", F.lit(0.1)))

    answers = lambda items: scorer(items).withColumn("position", F.when(F.col("company") == "Later", 2).otherwise(1))
    sources = spark.createDataFrame([("a", "Wire A")], "source_id string, name string")
    result = flow.alerts_from(candidates(spark), gate.event_table(spark), answers, sources=sources)
    assert sorted(r.id for r in result.pending.collect()) == [2, 3, 4, 5]
    assert result.verdicts.count() == 2
    rejected = result.rejected.collect()
    assert [r.company for r in rejected] == ["Later"]
    assert result.outbox.count() == 1 and "Wire A" in result.outbox.first().alert_html
    # The union reads its one branch twice; nothing after the answers reads it again.
    assert calls.value == 2 * 6


def test_payload_rule_comes_before_the_two_keys(spark):
    rows = [("s", 1, 0, START, "u1", "taken", None), ("s", 1, 1, START, "u1", "free", None)]
    items = spark.createDataFrame(rows, "source_id string, check_id bigint, position int, fetched_at timestamp, url_key string, title_key string, x string")
    seen = spark.createDataFrame([("u0", "taken")], "url_key string, title_key string")
    assert dedupe.dedupe_two_key(items, flow.ORDER, seen=seen).count() == 1
    assert dedupe.dedupe_two_key(flow.payload_firsts(items), flow.ORDER, seen=seen).count() == 0
