"""Feed documents to items: RSS 2.0, Atom and regulatory Atom feeds.

Documents are parsed by Spark's own XML expression; nothing is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wirepulse import config, schemas
from wirepulse.functions import text as tx, times as tm
from wirepulse.session import checkpointed

RSS_ITEM = (
    "title: string, link: array<string>, description: string, `content:encoded`: string, pubDate: string, "
    "`dc:date`: string, guid: string, category: array<string>"
)
ATOM_ENTRY = (
    "title: string, link: array<struct<_rel: string, _href: string>>, content: string, summary: string, "
    "updated: string, published: string, id: string, category: array<struct<_term: string, _label: string, _VALUE: string>>"
)
RSS = f"channel struct<item: array<struct<{RSS_ITEM}>>>, _corrupt string"
ATOM = f"entry array<struct<{ATOM_ENTRY}>>, _corrupt string"
# What both dialects come down to before texts are cleaned.
RAW = "array<struct<title:string,link:string,body:string,date:string,guid:string,categories:array<string>,terms:array<struct<term:string,label:string>>,broken:boolean>>"
BROKEN = "parse failed: not a well-formed feed document"
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def read_fetch_log(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """Archived fetches, as a table or as a stream of newly landed files."""
    if streaming:
        return (
            spark.readStream.schema(schemas.FETCH_LOG).format(fmt).option("maxFilesPerTrigger", max_files).load(path)
        )
    return spark.read.schema(schemas.FETCH_LOG).format(fmt).load(path)


def _once(*columns: Column) -> list[Column]:
    """Columns computed by a generator, so that filters on them do not repeat them."""
    return [F.inline(F.array(F.struct(*columns)))]


def _or_else(*texts: Column) -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def _categories(names: Column) -> Column:
    cleaned = F.transform(names, lambda n: tx.strip(F.lower(n)))
    none = F.array().cast("array<string>")
    return F.coalesce(F.filter(cleaned, lambda n: F.coalesce(n, F.lit("")) != ""), none)


def _from_rss(it: Column, broken: Column) -> Column:
    none = F.lit(None).cast("array<struct<term:string,label:string>>")
    return F.struct(
        it["title"].alias("title"), F.try_element_at(it["link"], F.lit(1)).alias("link"),
        _or_else(it["content:encoded"], it["description"]).alias("body"), _or_else(it["pubDate"], it["dc:date"]).alias("date"),
        _or_else(it["guid"]).alias("guid"), it["category"].alias("categories"), none.alias("terms"), broken.alias("broken"),
    )


def _from_atom(it: Column, broken: Column) -> Column:
    alternate = F.filter(it["link"], lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.try_element_at(alternate, F.lit(1)), F.try_element_at(it["link"], F.lit(1)))["_href"]
    return F.struct(
        it["title"].alias("title"), link.alias("link"), _or_else(it["content"], it["summary"]).alias("body"),
        _or_else(it["updated"], it["published"]).alias("date"), _or_else(it["id"]).alias("guid"),
        F.transform(it["category"], lambda c: _or_else(c["_VALUE"], c["_term"])).alias("categories"),
        F.coalesce(
            F.transform(it["category"], lambda c: F.struct(c["_term"].alias("term"), c["_label"].alias("label"))),
            F.array().cast("array<struct<term:string,label:string>>"),
        ).alias("terms"),
        broken.alias("broken"),
    )


def _pieces(body: Column, is_atom: Column) -> Column:
    """Items of a document that is no XML as a whole: each complete block is read by itself.

    Ampersands that start no XML reference are escaped first, so that named HTML
    references reach the text cleaning as they were written.
    """
    repaired = F.regexp_replace(body, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")

    def read(name: str, fields: str, convert) -> Column:
        blocks = F.regexp_extract_all(repaired, F.lit(rf"(?s)(<{name}(?:\s[^>]*)?>.*?</{name}\s*>)"), 1)
        parsed = F.transform(blocks, lambda b: F.from_xml(b, f"struct<{fields}, _corrupt: string>", OPTIONS))
        return F.transform(parsed, lambda it: convert(it, it.isNull() | it["_corrupt"].isNotNull()))

    return F.when(is_atom, read("entry", ATOM_ENTRY, _from_atom)).otherwise(read("item", RSS_ITEM, _from_rss))


def parse_feeds(
    docs: DataFrame, sources: DataFrame, now, summary_chars: int | None = config.SUMMARY_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of fetched documents.

    ``docs`` needs source_id, check_id, ts and body. Items without a title or a
    link are skipped. A document that is no XML as a whole is cut into its item
    blocks, and each complete block still gives its item; it also leaves an error
    row if its end is missing or a block cannot be read. ``summary_chars`` cuts
    summaries (None: whole). The dialect is told by the root element; each document
    is read once, and both outputs come from the checkpointed result.
    """
    typed = docs.select("source_id", "check_id", "ts", "body").join(
        sources.select("source_id", F.col("type").alias("_type")), "source_id", "left"
    )
    body = F.regexp_replace(F.col("body"), r"^[\s\uFEFF]+", "")
    opening = r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<(?:\w+:)?"
    read = typed.select("source_id", "check_id", "ts", "_type", *_once(body.alias("body"), body.rlike(opening + r"feed[\s>]").alias("is_atom"))).select(
        "*",
        F.when(~F.col("is_atom"), F.from_xml("body", RSS, OPTIONS)).alias("rss"),
        F.when(F.col("is_atom"), F.from_xml("body", ATOM, OPTIONS)).alias("atom"),
    )
    broken = F.coalesce("rss._corrupt", "atom._corrupt").isNotNull() | (F.col("rss").isNull() & F.col("atom").isNull())
    whole = F.lit(False)
    items = F.when(broken, _pieces(F.col("body"), F.col("is_atom"))).when(
        F.col("is_atom"), F.transform("atom.entry", lambda it: _from_atom(it, whole))
    ).otherwise(F.transform("rss.channel.item", lambda it: _from_rss(it, whole)))
    complete = F.col("body").rlike(opening + r"(?:rss|feed|RDF)[\s>]") & F.col("body").rlike(r"</(?:\w+:)?(?:rss|feed|RDF)\s*>\s*$")
    parsed = checkpointed(
        read.select("source_id", "check_id", "ts", "_type", *_once(items.cast(RAW).alias("raw"), broken.alias("broken"), F.coalesce(complete, F.lit(False)).alias("complete")))
    )
    lost = F.col("broken") & (~F.col("complete") | F.exists(F.coalesce("raw", F.array().cast(RAW)), lambda it: it["broken"]))
    errors = parsed.where(lost).select("source_id", "check_id", "ts", F.lit(BROKEN).alias("reason"))

    r = lambda name: F.col("it")[name]
    title = tx.strip_html(r("title"))
    found = parsed.select("source_id", "check_id", "ts", "_type", F.posexplode("raw").alias("position", "it")).where(~F.col("it.broken"))
    listed = found.select(
        "source_id", "check_id", "position", *_once(
        title.alias("title"),
        F.replace(tx.strip(r("link")), F.lit("&amp;"), F.lit("&")).alias("link"),
        _summary(r("body"), summary_chars),
        _date(r("date"), now),
        r("guid").alias("guid"),
        _categories(r("categories")).alias("categories"),
        F.when((F.col("_type") == "sec") & r("terms").isNotNull(), tx.sec_form_type(r("terms"), title)).alias("sec_form_type"),
        F.col("ts").alias("fetched_at"),
    ))
    return listed.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != "")), errors


def _summary(body: Column, chars: int | None) -> Column:
    plain = tx.strip_html(body) if chars is None else F.substring(tx.strip_html(body), 1, chars)
    return F.coalesce(plain, F.lit("")).alias("summary")


def _date(text: Column, now) -> Column:
    return tm.no_future(tm.parse_feed_date(text), now).alias("published_at")
