"""String functions on columns: keys, canonical forms, HTML and rendering.

Everything here is a built-in expression, so it stays inside code generation.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from wirepulse import config
from wirepulse.functions.patterns import SPACE


# The characters other text tools trim; plain ``trim`` only knows the space.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used in several places is otherwise computed in each of them, and
    inside conditions the optimizer cannot share it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space (of any kind) to one space, ends trimmed."""
    # The full class is several times slower, and most text does not need it.
    return let(
        text,
        lambda t: F.trim(
            F.when(is_ascii(t), F.regexp_replace(t, r"\s+", " ")).otherwise(F.regexp_replace(t, f"[{SPACE}]+", " "))
        ),
    )


def strip(text: Column) -> Column:
    """Trim white space of any kind from both ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


# ---------------------------------------------------------------- URLs


def canonical_url(raw: Column) -> Column:
    """One spelling per article address.

    https, lower-case host without ``www.``, no fragment, no default port, no dot
    segments, no tracking parameters, the remaining parameters in key order and
    one escaping, no closing slash except on a bare origin. User info and
    bracketed addresses stay. Anything else is only trimmed and lowered.
    """
    mark = "\u0001"
    address = r"^(?i:https?)://((?:[^/?#@]*@)?)(\[[^\]/?#]*\]|[^/?#:@]+)(:\d*)?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"

    def rebuilt(parts: Column) -> Column:
        host = F.regexp_replace(F.lower(F.get(parts, F.lit(1))), r"^www\.", "")
        user, port, written, query = (F.get(parts, F.lit(i)) for i in (0, 2, 3, 4))
        path = F.when(written.rlike(r"/\.{1,2}(?:/|$)"), _without_dots(written)).otherwise(written)
        origin = F.concat(F.lit("https://"), user, host, F.when(port.isin("", ":", ":80", ":443"), "").otherwise(port))
        params = F.when(query == "", "").otherwise(_kept_params(query))
        # The slash goes only when it ends the whole address and is not the root.
        bare = F.when((params == "") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
        return F.concat(
            origin, F.when(path.isin("", "/"), "/").otherwise(bare),
            F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)),
        )

    def spelled(text: Column) -> Column:
        parts = F.split(F.regexp_replace(text, address, f"$1{mark}$2{mark}$3{mark}$4{mark}$5"), mark)
        return let(parts, lambda p: F.when(F.size(p) == 5, rebuilt(p)).otherwise(F.lower(text)))

    return let(strip(raw), spelled)


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
            .when(part == ".", done).otherwise(F.concat(done, F.array(part)))
        )

    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(closed, "/")


def _kept_params(query: Column) -> Column:
    """Query parameters without the tracking ones, in key order, spelled one way."""
    tracking = F.array(*[F.lit(p) for p in config.TRACKING_PARAMS])

    def key(pair: Column) -> Column:
        return F.substring_index(pair, "=", 1)

    def spelled(part: Column) -> Column:
        plain = part.rlike(r"^[A-Za-z0-9*._+-]*$")
        return F.when(plain, part).otherwise(F.url_encode(F.coalesce(F.try_url_decode(part), part)))

    kept = F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(tracking, F.lower(key(p)))
    )
    # Sorting whole structs (key, position, pair) keeps equal keys in order.
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p"))))
    # A parameter without "=" is written back with an empty value.
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat(spelled(s["k"]), F.lit("="), spelled(F.substr(s["p"], F.length(s["k"]) + 2))),
        ),
        "&",
    )


def url_key(raw: Column) -> Column:
    return short_hash(canonical_url(raw))


def host_of(url: Column) -> Column:
    """Host of an address, or the address itself when it has none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(host != "", F.lower(host)).otherwise(url)


# ---------------------------------------------------------------- titles


@lru_cache(maxsize=1)
def _compatibility_forms() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII.

    Derived from the Unicode tables of the running Python: (from, to) for the
    one-to-one cases, and a map for those that expand to several characters.
    Characters that decompose to non-ASCII only are left alone, because titles
    turn every one of them into a space anyway.
    """
    single, multi = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0x300 <= code <= 0x36F or 0xD800 <= code <= 0xDFFF:
            continue
        form = unicodedata.normalize("NFKD", chr(code))
        form = "".join(c for c in form if not 0x300 <= ord(c) <= 0x36F)
        if form == chr(code) or not any(ord(c) < 0x80 for c in form):
            continue
        if len(form) == 1 and code < 0x10000:
            single[chr(code)] = form
        else:
            multi[chr(code)] = form
    return "".join(single), "".join(single.values()), multi


def fold_accents(text: Column) -> Column:
    """Compatibility-decompose letters and drop combining marks U+0300-036F."""
    source, target, multi = _compatibility_forms()
    expanding = "[" + "".join(multi) + "]"
    lookup = F.from_json(F.lit(json.dumps(multi)), "map<string,string>")

    def expanded(folded: Column) -> Column:
        letters = F.transform(F.split(folded, ""), lambda c: F.coalesce(F.element_at(lookup, c), c))
        return F.when(folded.rlike(expanding), F.array_join(letters, "")).otherwise(folded)

    folded = F.translate(F.regexp_replace(text, r"[\x{300}-\x{36F}]", ""), source, target)
    return F.when(is_ascii(text), text).otherwise(let(folded, expanded))


def normalize_title(raw: Column) -> Column:
    """Headline in a form that syndicated copies share."""
    prefix = f"^(?:{'|'.join(config.TITLE_PREFIXES)})[{SPACE}]*[:\\-–—][{SPACE}]*"

    def bare(text: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(text, prefix, ""), prefix, "")
        return F.trim(F.regexp_replace(F.translate(text, "‘’“”", ""), "[^a-z0-9$%+]+", " "))

    return bare(strip(F.lower(let(raw, fold_accents))))


def title_key(raw: Column) -> Column:
    """Hash of the normalized headline; null when too short to identify one."""
    return let(
        normalize_title(raw), lambda title: F.when(F.length(title) >= config.MIN_TITLE_KEY_CHARS, short_hash(title))
    )


def deal_key(company: Column, event: Column) -> Column:
    """Hash of company (without corporate suffixes) and event."""
    word = f"(?<![A-Za-z0-9_])(?:{'|'.join(config.COMPANY_SUFFIXES)})(?![A-Za-z0-9_])"
    name = F.trim(F.regexp_replace(F.regexp_replace(normalize_title(company), word, ""), " +", " "))
    return short_hash(F.concat(name, F.lit("::"), event))


# ---------------------------------------------------------------- HTML


def _splice(text: Column, pattern: str, group: int, decode) -> Column:
    """Replace each match of ``pattern`` by ``decode(match)``, in one pass."""

    def spliced(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), decode)
        pieces = F.zip_with(F.split(t, pattern, -1), found, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(pieces, "")).otherwise(t)

    return let(text, spliced)


def _character(code: Column) -> Column:
    """Character of a code point, "" when out of range."""
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.between(0, 0x10FFFF), wide).otherwise(F.lit(""))


def _from_hex(digits: Column) -> Column:
    digits = F.regexp_replace(digits, "^0+", "")
    return F.when(F.length(digits) <= 8, F.conv(digits, 16, 10).cast("bigint"))


def decode_entities(text: Column) -> Column:
    """Decimal, then hexadecimal, then named references; unknown names stay."""
    return let(text, lambda t: F.when(t.contains("&"), _decoded(t)).otherwise(t))


def _decoded(text: Column) -> Column:
    decimal = _splice(text, r"&#(\d+);", 1, lambda d: _character(d.try_cast("bigint")))
    hexa = _splice(decimal, r"&#[xX]([0-9a-fA-F]+);", 1, lambda h: _character(_from_hex(h)))
    names = F.create_map(*[F.lit(x) for pair in config.NAMED_ENTITIES.items() for x in pair])
    return _splice(
        hexa, r"&([A-Za-z]+);", 0,
        lambda m: F.coalesce(F.element_at(names, F.lower(F.regexp_extract(m, "[A-Za-z]+", 0))), m),
    )


def strip_html(text: Column) -> Column:
    """Plain text of a fragment: no scripts, styles, tags or references."""

    def untagged(t: Column) -> Column:
        bare = F.regexp_replace(t, r"(?i)<script[\s\S]*?</script>", " ")
        bare = F.regexp_replace(bare, r"(?i)<style[\s\S]*?</style>", " ")
        return F.when(t.contains("<"), F.regexp_replace(bare, "<[^>]+>", " ")).otherwise(t)

    return squeeze(decode_entities(let(text, untagged)))


def article_text(html: Column, chars: int | None = config.SUMMARY_CHARS) -> Column:
    """Main text of a page, at most ``chars`` of it (None: all), or null when there are not more than 200 characters."""

    def first_block(tag: str, otherwise: Column) -> Column:
        block = rf"(?i)<{tag}[^>]*>([\s\S]*?)</{tag}>"
        whole = F.regexp_extract(html, block, 0)
        return let(whole, lambda w: F.when(w == "", otherwise).otherwise(F.regexp_extract(w, block, 1)))

    main = first_block("article", first_block("body", html))
    for tag in ("nav", "header", "footer", "aside"):
        main = F.regexp_replace(main, rf"(?i)<{tag}[\s\S]*?</{tag}>", " ")
    return let(
        strip_html(main),
        lambda text: F.when(F.length(text) > config.MIN_ARTICLE_CHARS, text if chars is None else F.substring(text, 1, chars)),
    )


def escape_html(text: Column) -> Column:
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text


def plain_text(html: Column) -> Column:
    """A rendered alert without its markup; links become "text address"."""
    text = F.regexp_replace(html, r'<a href="([^"]*)">([^<]*)</a>', "$2 $1")
    text = F.regexp_replace(text, "</?[bi]>", "")
    for reference, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


# ---------------------------------------------------------------- filings


def sec_filer_name(title: Column) -> Column:
    """Filer name without form prefix, registry number and role."""
    name = F.regexp_replace(title, f"^[A-Z0-9/-]+[{SPACE}]+-[{SPACE}]+", "")
    name = F.regexp_replace(name, f"[{SPACE}]*\\(\\d{{7,10}}\\)[{SPACE}]*", " ")
    name = F.regexp_replace(name, f"(?i)[{SPACE}]*\\((?:Filer|Subject|Reporting)\\)[{SPACE}]*", " ")
    return squeeze(name)


def sec_form_type(categories: Column, title: Column) -> Column:
    """Form type from the category labelled so, else the title's first token.

    ``categories`` is an array of structs with ``term`` and ``label``.
    """
    terms = F.filter(categories, lambda c: (c["label"] == "form type") & (F.coalesce(c["term"], F.lit("")) != ""))
    leading = F.regexp_extract(title, f"^([A-Z0-9/-]+)[{SPACE}]+-[{SPACE}]+", 1)
    return F.coalesce(F.try_element_at(terms, F.lit(1))["term"], F.nullif(leading, F.lit("")))


# ---------------------------------------------------------------- lenient values


def null_text(text: Column) -> Column:
    """Trimmed text, or null when blank, "null" or "n/a"."""
    trimmed = strip(text)
    return F.when(~F.lower(trimmed).isin("", "null", "n/a"), trimmed)


def comma_list(text: Column) -> Column:
    """Non-blank trimmed parts of a comma-joined string."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda s: s != "")


def confidence_from_text(text: Column) -> Column:
    """Number from text on a 0-1 or 0-100 scale; a blank text counts as 0."""
    trimmed = strip(text)
    number = F.when(trimmed == "", F.lit(0.0)).otherwise(
        F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))
    )
    return F.when(number > 1, number / 100).otherwise(number)


def confidence_from_number(number: Column) -> Column:
    return F.when((number > 1) & (number <= 100), number / 100).otherwise(number)


# ---------------------------------------------------------------- small formats


def to_fixed(number: Column, digits: int) -> Column:
    """A non-negative number with one or two (or no) decimals.

    Rounds half up on the exact binary value: 1.15 is a little less than it looks
    and gives 1.1, where ``format_string`` rounds its decimal spelling to 1.2.
    """
    scale = 10**digits
    whole = F.floor(number)
    binary = ((number - whole) * float(2**55)).cast("bigint")
    part = F.shiftright(binary * scale + 2**54, 55)
    total = whole * scale + part
    left = F.floor(total / scale).cast("string") if digits else total.cast("string")
    return F.concat(left, F.lit("."), F.lpad((total % scale).cast("string"), digits, "0")) if digits else left


def region_flag(region: Column) -> Column:
    return (
        F.when(region == "US", "🇺🇸").when(region == "CA", "🇨🇦")
        .when(region == "US+CA", "🇺🇸🇨🇦").otherwise("🌐")
    )
