"""From a scorer's raw response text to validated verdict rows.

Fields are read out of VARIANT values with built-in expressions. Python sees
only responses that are neither clean JSON nor a fenced block of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from wirepulse import config
from wirepulse.functions import text as tx
from wirepulse.session import checkpointed

FENCE = r"(?i)```(?:json)?\s*([\s\S]*?)```"
OPTIONAL_TEXT = ("fintech_subsector", "amount", "currency", "round", "acquirer", "target", "deal_value")
REQUIRED_TEXT = ("id", "company", "one_line_summary")


#: What can change the nesting: whole strings count as one token, escaped characters as none.
TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|\\.|["{}\[\]]', re.DOTALL)
LEVELS = {"{": {"{": 1, "}": -1}, "[": {"[": 1, "]": -1}}


def first_value(text: str) -> str | None:
    """The first object or array of a text, up to the bracket that closes it."""
    begin = re.search(r"[{\[]", text)
    if begin is None:
        return None
    level, counts = 0, LEVELS[begin[0]]
    for token in TOKENS.finditer(text, begin.start()):
        level += counts.get(token[0], 0)
        if token[0] == '"':  # a string that never ends hides the rest
            return None
        if level == 0:
            return text[begin.start() : token.end()]
    return None


@F.pandas_udf(StringType())
def balanced_json(texts: pd.Series) -> pd.Series:
    return texts.map(first_value, na_action="ignore")


def extract_json(responses: DataFrame, body: str = "body") -> DataFrame:
    """Add ``json`` (VARIANT) and ``json_error``."""
    text = tx.strip(F.col(body))
    read = responses.withColumn("_whole", F.try_parse_json(text)).withColumn(
        "_fenced", F.when(F.col("_whole").isNull(), F.try_parse_json(F.trim(F.regexp_extract(text, FENCE, 1))))
    )
    messy = F.col("_whole").isNull() & F.col("_fenced").isNull()
    read = read.withColumn("_slice", balanced_json(F.when(messy, text)))
    found = F.coalesce("_whole", "_fenced", F.try_parse_json("_slice"))
    error = (
        F.when(found.isNotNull(), F.lit(None).cast("string"))
        .when(~F.coalesce(text, F.lit("")).rlike(r"[\[{]"), "nothing in it looks like JSON")
        .when(F.col("_slice").isNull(), "its JSON breaks off before it is closed")
        .otherwise("its JSON cannot be read")
    )
    return read.select(*responses.columns, found.alias("json"), error.alias("json_error"))


def _entries(json: Column) -> Column:
    """The verdict list: the value itself, or its ``verdicts`` member."""
    member = F.try_variant_get(json, "$.verdicts", "variant")
    # Only arrays cast; anything else gives null.
    return F.coalesce(json.try_cast("array<variant>"), member.try_cast("array<variant>"))


def verdict_entries(extracted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(entries, errors): one row per verdict; unusable responses go to errors."""
    # Both outputs come from one pass over the responses.
    listed = checkpointed(extracted.select(key, "json_error", _entries(F.col("json")).alias("_list")))
    error = F.coalesce(
        "json_error",
        F.when(F.col("_list").isNull(), "its JSON holds no list of verdicts"),
    )
    entries = listed.where("_list is not null").select(key, F.posexplode("_list").alias("position", "entry"))
    errors = listed.where("_list is null").select(key, error.alias("error"))
    return entries, errors


FIELDS = (
    *REQUIRED_TEXT, *OPTIONAL_TEXT, "event", "region", "relevant", "is_fintech", "confidence",
    "lead_investors", "other_investors",
)


def _strings(value: Column, kind: Column) -> Column:
    """Non-blank strings of an array, parts of a comma-joined string, else none."""
    texts = F.filter(value.try_cast("array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    texts = F.filter(F.transform(texts, lambda v: v.try_cast("string")), lambda s: tx.strip(s) != "")
    none = F.array().cast("array<string>")
    return (
        F.when(kind.startswith("ARRAY"), texts)
        .when(kind == "STRING", tx.comma_list(value.try_cast("string"))).otherwise(none)
    )


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def parse_entries(entries: DataFrame) -> DataFrame:
    """Add the verdict fields and ``problems`` (null when the entry is valid).

    Each field is fetched once together with its type; the rest are conditions
    on those two columns.
    """
    fetched = entries.withColumns({f"_v_{n}": F.try_variant_get("entry", f"$.{n}", "variant") for n in FIELDS})
    fetched = fetched.withColumns({f"_k_{n}": F.coalesce(F.schema_of_variant(f"_v_{n}"), F.lit("missing")) for n in FIELDS})
    value = {n: F.col(f"_v_{n}") for n in FIELDS}
    kind = {n: F.col(f"_k_{n}") for n in FIELDS}
    text = {n: F.when(kind[n] == "STRING", value[n].try_cast("string")) for n in FIELDS}

    fields: dict[str, Column] = {n: text[n] for n in (*REQUIRED_TEXT, "region")}
    fields |= {n: tx.null_text(text[n]) for n in (*OPTIONAL_TEXT, "event")}
    fields |= {n: F.when(kind[n] == "BOOLEAN", value[n].try_cast("boolean")) for n in ("relevant", "is_fintech")}
    fields["confidence"] = F.when(kind["confidence"] == "STRING", tx.confidence_from_text(text["confidence"])).when(
        _is_number(kind["confidence"]), tx.confidence_from_number(value["confidence"].try_cast("double"))
    )
    fields |= {n: _strings(value[n], kind[n]) for n in ("lead_investors", "other_investors")}
    parsed = fetched.withColumns(fields)

    def wrong(condition: Column, name: str, message: str) -> Column:
        return F.when(condition, f"{name}: {message}")

    optional = {n: kind[n].isin("STRING", "VOID", "missing") for n in (*OPTIONAL_TEXT, "event")}
    known = F.coalesce(F.col("event").isin([t.id for t in config.EVENTS]), F.lit(True))
    checks = [wrong(kind[n] != "STRING", n, "expected string") for n in REQUIRED_TEXT]
    checks += [wrong(kind[n] != "BOOLEAN", n, "expected boolean") for n in ("relevant", "is_fintech")]
    checks += [wrong(~optional[n], n, "expected string or null") for n in OPTIONAL_TEXT]
    checks.append(wrong(~optional["event"] | ~known, "event", "not a known event"))
    checks.append(wrong(~F.coalesce(F.col("region").isin(*config.REGIONS), F.lit(False)), "region", "not a known region"))
    in_range = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    checks.append(wrong(~in_range, "confidence", "expected a number from 0 to 1"))
    problems = F.nullif(F.concat_ws("; ", *checks), F.lit(""))
    # A generator, so that filtering on problems does not repeat the parsing.
    return parsed.select(*entries.columns, *fields, F.inline(F.array(F.struct(problems.alias("problems")))))


def validate_verdicts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, quarantine): a bad entry never takes its neighbours along."""
    parsed = checkpointed(parse_entries(entries))
    good = parsed.where("problems is null").drop("entry", "problems")
    bad = parsed.where("problems is not null").select(
        *[c for c in entries.columns if c != "entry"], F.to_json("entry").alias("raw"), "problems"
    )
    return good, bad


# ---------------------------------------------------------------- scoring

VERDICT_SCHEMA = (
    "batch_id long, id string, relevant boolean, event string, is_fintech boolean, region string, company string, "
    "fintech_subsector string, amount string, currency string, round string, lead_investors array<string>, "
    "other_investors array<string>, acquirer string, target string, deal_value string, one_line_summary string, "
    "confidence double"
)


def score(items: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Run a user-supplied scorer over item batches; it yields verdict rows."""
    return items.mapInPandas(scorer, VERDICT_SCHEMA)


def keyword_scorer(items: DataFrame) -> DataFrame:
    """Deterministic default scorer: verdicts from the prefilter outcome alone.

    Needs batch_id, item_no, title, summary, hit and strong.
    """
    text = F.concat_ws("\n", "title", "summary")
    amount = F.nullif(F.regexp_extract("title", r"(?i)(\$\s?\d[\d.,]*\s*(?:m|bn|b|million|billion)?)(?![A-Za-z])", 1), F.lit(""))
    verb = r"(?i)^(.*?)\s+(?:raises?|raised|closes|closed|secures|secured|to acquire|acquires|acquired|completes|launches|launched|unveils|expands|partners|rebrands|announces|opens)(?![A-Za-z])"
    company = F.coalesce(F.nullif(F.regexp_extract("title", verb, 1), F.lit("")), F.col("title"))
    fintech = text.rlike("(?i)" + r"(?:payments?|bank|lend|credit|fintech|wealth|invest|insur|crypto|stablecoin|mortgage|card|processor|accounting)")
    abroad = text.rlike(r"(?i)(?:united kingdom|\buk\b|london)")
    canada = text.rlike(r"(?i)(?:canad|toronto|montreal)")
    region = F.when(abroad & ~canada, "other").when(canada, "CA").otherwise("US")
    none = F.lit(None).cast("string")
    event = F.when(F.col("hit").isin(*[t.id for t in config.EVENTS]), F.col("hit"))
    return items.select(
        "batch_id", F.col("item_no").alias("id"), (fintech & event.isNotNull() & (region != "other")).alias("relevant"),
        event.alias("event"), fintech.alias("is_fintech"), region.alias("region"), tx.squeeze(company).alias("company"),
        none.alias("fintech_subsector"), F.when(event == "funding", amount).alias("amount"), none.alias("currency"),
        none.alias("round"), F.array().cast("array<string>").alias("lead_investors"),
        F.array().cast("array<string>").alias("other_investors"), none.alias("acquirer"), none.alias("target"),
        F.when(event == "acquisition", amount).alias("deal_value"), F.col("title").alias("one_line_summary"),
        F.when(F.col("strong"), 0.95).otherwise(0.8).alias("confidence"),
    )
