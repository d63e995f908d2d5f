"""Keyword classification of items: families, vetoes and filing rules."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from wirepulse import config
from wirepulse.functions import text as tx
from wirepulse.functions.patterns import contains_any, first_pattern, padded


class Vocabulary(NamedTuple):
    """The pattern lists of the keyword stage; families in priority order."""

    families: Mapping[str, Sequence[str]]
    veto: Sequence[str] = tuple(config.VETO)
    deal: Sequence[str] = tuple(config.ACQUISITION)
    vehicle: Sequence[str] = tuple(config.FILER_VEHICLE)
    hint: Sequence[str] = tuple(config.FILER_HINT)


def read_vocabulary(table: DataFrame) -> Vocabulary:
    """A vocabulary from rows ``(list, priority, position, pattern)``.

    ``veto``, ``deal``, ``vehicle`` and ``hint`` name the lists of that kind, any other
    name a family; families come by priority. The table is a configuration of
    some hundred rows. A kind that has no row keeps its default.
    """
    rows = table.select("list", "priority", "position", "pattern").orderBy("priority", "list", "position").collect()
    lists: dict[str, list[str]] = {}
    for row in rows:
        lists.setdefault(row["list"], []).append(row["pattern"])
    kinds = {name: lists.pop(name) for name in ("veto", "deal", "vehicle", "hint") if name in lists}
    return Vocabulary(families=lists or enabled_families(), **kinds)


def enabled_families(
    families: Mapping[str, Sequence[str]] = config.FAMILIES,
    disabled: Collection[str] = (),
) -> dict[str, Sequence[str]]:
    """Families of the enabled events, in priority order."""
    off = set(disabled) | {e.id for e in config.EVENTS if not e.enabled}
    return {name: terms for name, terms in families.items() if name not in off}


def _family_of(text: Column, families: Mapping[str, Sequence[str]]) -> Column:
    found = F.lit(None).cast("string")
    for name, terms in reversed(families.items()):
        found = F.when(contains_any(text, terms), name).otherwise(found)
    return found


def _pattern_of(lists: Mapping[str, Sequence[str]]) -> Column:
    """Name the first pattern of list ``_list`` that occurs in ``_text``."""
    found = F.lit(None).cast("string")
    for name, terms in lists.items():
        found = F.when(F.col("_list") == name, first_pattern(F.col("_text"), terms)).otherwise(found)
    return found


def keyword_match(
    items: DataFrame, families: Mapping[str, Sequence[str]], body_chars: int | None = config.BODY_CHARS,
) -> DataFrame:
    """Add ``haystack``, ``hit``, ``in_title`` and ``scope`` (the text that hit).

    A family found in the title outranks any found in the body. One alternation
    of every pattern dismisses most rows; the rest take one per family. Naming
    the pattern is left to the rows that need it. ``haystack`` and ``scope`` are
    padded. Of the body ``body_chars`` characters are searched (None: all).
    """
    body = F.coalesce("summary", F.lit(""))
    body = body if body_chars is None else F.substring(body, 1, body_chars)
    every = [p for terms in families.values() for p in terms]
    none = F.lit(None).cast("string")
    return (
        items.withColumn("haystack", F.concat(F.lit("\n"), F.col("title"), F.lit("\n"), body))
        .withColumn("_title", padded(F.col("title")))
        .withColumn("_any", contains_any(F.col("haystack"), every))
        .withColumn("_title_family", F.when(F.col("_any"), _family_of(F.col("_title"), families)).otherwise(none))
        .withColumn("in_title", F.col("_title_family").isNotNull())
        .withColumn(
            "hit",
            F.when(F.col("in_title"), F.col("_title_family"))
            .when(F.col("_any"), _family_of(F.col("haystack"), families)).otherwise(none),
        )
        .withColumn("scope", F.when(F.col("in_title"), F.col("_title")).otherwise(F.col("haystack")))
        .drop("_any", "_title", "_title_family")
    )


def _outcome(
    hit: Column | None, reason: Column | str, named: str | Column | None = None, text: Column | None = None,
    strong: Column | None = None, after: str = "",
) -> Column:
    """Outcome struct. ``named`` is the list whose pattern completes the reason."""
    none = F.lit(None).cast("string")

    def column(value) -> Column:
        return none if value is None else F.lit(value) if isinstance(value, str) else value

    return F.struct(
        F.lit(hit is not None).alias("pass"), column(hit).alias("hit"),
        (F.lit(False) if strong is None else strong).alias("strong"),
        column(reason).alias("_before"), column(named).alias("_list"), column(text).alias("_text"), F.lit(after).alias("_after"),
    )


def _news(words: Vocabulary) -> Column:
    """Outcome for news items; expects the ``keyword_match`` columns."""
    hit, haystack = F.col("hit"), F.col("haystack")
    money = contains_any(padded(F.col("title")), (config.MONEY,))
    return (
        F.when(hit.isNull(), _outcome(None, "no tracked event language"))
        .when(contains_any(haystack, words.veto), _outcome(None, "vetoed by ", "veto", haystack))
        .otherwise(
            _outcome(
                hit, "matched ", hit, F.col("scope"),
                F.col("in_title") & hit.isin("funding", "acquisition") & money,
            )
        )
    )


def _current_report(words: Vocabulary) -> Column:
    """8-K: item 2.01 passes; 1.01 needs deal words beyond its own caption."""
    haystack = F.col("haystack")
    rest = F.regexp_replace(haystack, "(?i)" + config.ITEM_101_CAPTION, " ")
    passed = F.lit("sec-8k")
    return (
        F.when(
            ~contains_any(haystack, (config.ITEM_101, config.ITEM_201)), _outcome(None, "8-K without item 1.01 or 2.01")
        )
        .when(contains_any(haystack, (config.ITEM_201,)), _outcome(passed, "8-K item 2.01 (completed acquisition)"))
        .when(contains_any(rest, words.deal), _outcome(passed, "8-K item 1.01 + ", "deal", rest))
        .otherwise(
            _outcome(None, "8-K item 1.01 with no acquisition or merger language beyond the standard caption")
        )
    )


def _offering_notice(words: Vocabulary) -> Column:
    """Form D: investment vehicles are vetoed, then the name must hint at finance."""
    name = padded(tx.sec_filer_name(F.col("title")))
    return (
        F.when(
            contains_any(name, words.vehicle),
            _outcome(None, "Form D from an investment vehicle (", "vehicle", name, after=")"),
        )
        .when(
            contains_any(name, words.hint),
            _outcome(F.lit("sec-form-d"), "Form D, name matches ", "hint", name),
        )
        .otherwise(_outcome(None, "Form D with no fintech signal in the name"))
    )


def prefilter(
    items: DataFrame,
    families: Mapping[str, Sequence[str]] | None = None,
    vocabulary: Vocabulary | None = None,
    body_chars: int | None = config.BODY_CHARS,
) -> DataFrame:
    """Add ``pass``, ``hit``, ``reason`` and ``strong`` to items.

    Needs ``title`` and ``summary``; filings also carry ``sec_form_type``. Every
    rejected row has a reason. ``vocabulary`` replaces all lists, ``families`` those
    of the events only; ``body_chars`` of the summary are searched (None: all).
    """
    words = vocabulary or Vocabulary(enabled_families())
    if families is not None:
        words = words._replace(families=dict(families))
    families = words.families
    matched = keyword_match(items, families, body_chars)
    lists = {"veto": words.veto, **families}
    decision = _news(words)
    if "sec_form_type" in items.columns:
        lists |= {"deal": words.deal, "vehicle": words.vehicle, "hint": words.hint}
        form = F.upper(F.nullif("sec_form_type", F.lit("")))
        decision = (
            F.when(form.isNull(), decision)
            .when(form == "8-K", _current_report(words))
            .when(form.isin("D", "D/A"), _offering_notice(words))
            .otherwise(_outcome(None, F.concat(F.lit("SEC form "), form, F.lit(" is not tracked"))))
        )
    # A generator is a barrier: a filter on the outcome runs right above it, before
    # reasons are spelled out, and is not copied - patterns and all - below it.
    decided = matched.select(*items.columns, F.inline(F.array(decision)))
    named = F.coalesce(_pattern_of(lists), F.lit(""))
    return decided.select(
        *items.columns, "pass", "hit", F.concat("_before", named, "_after").alias("reason"), "strong"
    )


def category_filter(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Keep items whose categories meet their source's allow-list.

    Sources without a list, and items without categories, pass. The registry is
    a small dimension table; the optimizer broadcasts it by its measured size.
    """
    lists = sources.select("source_id", "category_filter")
    allowed = F.col("category_filter")
    keep = (
        F.coalesce(F.size(allowed) <= 0, F.lit(True))
        | F.coalesce(F.size("categories") <= 0, F.lit(True))
        | F.coalesce(F.arrays_overlap("categories", allowed), F.lit(False))
    )
    return items.join(lists, "source_id", "left").where(keep).select(*items.columns)


def evaluate(predicted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Compare ``predicted`` flags with ``expected`` ones: one row of counts.

    ``predicted`` has (key, predicted BOOLEAN), ``truth`` (key, expected BOOLEAN).
    """
    p, e = F.col("predicted"), F.col("expected")
    counts = predicted.join(truth, key).agg(
        F.count("*").alias("n"),
        F.count_if(p & e).alias("tp"),
        F.count_if(p & ~e).alias("fp"),
        F.count_if(~p & e).alias("fn"),
        F.count_if(~p & ~e).alias("tn"),
    )
    return counts.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn(
        "recall", F.try_divide("tp", F.col("tp") + F.col("fn"))
    )
