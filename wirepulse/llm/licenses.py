"""License scan: ordered signature rules behind a keyword prefilter.

Each rule is a regular expression over the normalised words of a text, with a
keyword that must occur before the expression is tried, a priority and a label.
Overlapping detections are resolved by suppressing every detection whose interval
lies inside one of at least its own priority. All work on a text is one task's; rows
are independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame, functions as F, types as T

from wirepulse.llm.rows import text_map

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# The phrases of the base contract and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Published license names. Label, name as words, versions as words, short forms.
FAMILIES = (
    ("gpl", "gnu general public license", "1|2|3", "gpl|gnu gpl"),
    ("lgpl", "gnu lesser general public license", "2 1|3", "lgpl|gnu lgpl"),
    ("lgpl", "gnu library general public license", "2", "lgpl"),
    ("agpl", "gnu affero general public license", "1|3", "agpl|gnu agpl"),
    ("gfdl", "gnu free documentation license", "1 1|1 2|1 3", "gfdl|gnu fdl"),
    ("apache", "apache license", "1 0|1 1|2 0", "asl|apache"),
    ("apache", "apache software license", "1 1|2 0", "asl"),
    ("mpl", "mozilla public license", "1 0|1 1|2 0", "mpl"),
    ("epl", "eclipse public license", "1 0|2 0", "epl"),
    ("edl", "eclipse distribution license", "1 0", "edl"),
    ("cddl", "common development and distribution license", "1 0|1 1", "cddl"),
    ("cpl", "common public license", "1 0", "cpl"),
    ("cpal", "common public attribution license", "1 0", "cpal"),
    ("eupl", "european union public license", "1 0|1 1|1 2", "eupl"),
    ("osl", "open software license", "1 0|1 1|2 0|2 1|3 0", "osl"),
    ("afl", "academic free license", "1 1|1 2|2 0|2 1|3 0", "afl"),
    ("artistic", "artistic license", "1 0|2 0", "artistic"),
    ("bsl", "boost software license", "1 0", "bsl"),
    ("busl", "business source license", "1 0|1 1", "busl"),
    ("psf", "python software foundation license", "2|2 0", "psfl"),
    ("ms-pl", "microsoft public license", "", "ms pl"),
    ("ms-rl", "microsoft reciprocal license", "", "ms rl"),
    ("lppl", "latex project public license", "1 0|1 1|1 2|1 3|1 3a|1 3c", "lppl"),
    ("ofl", "sil open font license", "1 0|1 1", "ofl"),
    ("qpl", "q public license", "1 0", "qpl"),
    ("php", "php license", "3 0|3 01", ""),
    ("zpl", "zope public license", "1 1|2 0|2 1", "zpl"),
    ("ncsa", "university of illinois ncsa open source license", "", "ncsa license"),
    ("ipl", "ibm public license", "1 0", ""),
    ("apsl", "apple public source license", "1 0|1 1|1 2|2 0", "apsl"),
    ("spl", "sun public license", "1 0", ""),
    ("odbl", "open database license", "1 0", "odbl"),
    ("odc-by", "open data commons attribution license", "1 0", "odc by"),
    ("pddl", "public domain dedication and license", "1 0", "pddl"),
    ("cecill", "cecill free software license agreement", "1 0|1 1|2 0|2 1", "cecill"),
    ("blueoak", "blue oak model license", "1 0 0", "blueoak"),
    ("upl", "universal permissive license", "1 0", "upl"),
    ("ecl", "educational community license", "1 0|2 0", "ecl"),
    ("mulan", "mulan permissive software license", "1|2", "mulanpsl"),
    ("sspl", "server side public license", "1", "sspl"),
    ("elastic", "elastic license", "1 0|2 0", ""),
    ("cc0", "cc0 universal", "1 0", "cc0"),
    ("isc", "isc license", "", ""),
    ("mit", "mit license", "", ""),
    ("x11", "x11 license", "", ""),
    ("zlib", "zlib license", "", ""),
    ("unlicense", "unlicense", "", ""),
    ("wtfpl", "do what the fuck you want to public license", "1|2", "wtfpl"),
    ("postgresql", "postgresql license", "", ""),
    ("ruby", "ruby license", "", ""),
    ("vim", "vim license", "", ""),
    ("curl", "curl license", "", ""),
    ("openssl", "openssl license", "", ""),
    ("beerware", "beer ware license", "", "beerware"),
)
# The Creative Commons terms and their versions.
CC_TERMS = (
    ("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"),
    ("by nc", "attribution noncommercial"), ("by nc sa", "attribution noncommercial sharealike"),
    ("by nc nd", "attribution noncommercial noderivatives"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Opening words of well-known license texts. Label, keyword, expression.
TEXTS = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause", "neither the name", "neither the name(?: \\w+){1,12}? may be used to endorse or promote products"),
    ("bsd-2-clause", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "this software is provided", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:released into|dedicated to|placed in|in) the public domain"),
    ("proprietary", "all rights reserved", "copyright(?: \\w+){1,12}? all rights reserved"),
    ("warranty-disclaimer", "without warranty", "(?:without warranty of any kind|without any warranty)"),
    ("wtfpl", "everyone is permitted", "everyone is permitted to copy and distribute verbatim or modified copies"),
    ("cc0", "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("bsl", "boost software license", "boost software license version 1 0 august 17th 2003"),
    ("beerware", "beer ware license", "the beer ware license revision 42"),
)
BSD_CLAUSES = (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four"))
# Exceptions of the SPDX list that may follow WITH, as words.
EXCEPTIONS = (
    "389 exception", "autoconf exception 2 0", "autoconf exception 3 0", "bison exception 2 2", "bootloader exception",
    "classpath exception 2 0", "font exception 2 0", "gcc exception 2 0", "gcc exception 3 1", "libtool exception",
    "linux syscall note", "llvm exception", "ocaml lgpl linking exception", "openjdk assembly exception 1 0",
    "swift exception", "universal foss exception 1 0", "wxwindows exception 3 1",
)
# Short forms that are written with their version in one word, also without a v.
GLUED = ("gpl", "lgpl", "agpl", "mpl", "epl")
# Names whose grants and adjectives need no word "license".
BARE = ("mit", "isc", "zlib", "x11", "unlicense")
# A plus sign that closes a version; the word before it takes it in, so that words keep their numbers.
PLUS = re.compile(r"(?<=[0-9])\+(?=[\x00-\x20)\],;\"'*]|$)")
GRANT = r"(?:licensed|distributed|released|available|published|redistributed|covered|provided|use|modify it) (?:by \w+ )?under (?:the )?(?:terms of )?(?:the )?(?:conditions of the )?"
LATER = (
    r"(?:plus|(?: of the license)?(?: (?![0-9])\w+)?(?: at your option)?(?: or)?(?: at your option)? any later(?: version)?"
    r"|(?: of the license)? (?:or|and)(?: at your option)?(?: any)? (?:later|newer|higher|above|up|upwards?)(?: versions?)?)"
)


class Rule(NamedTuple):
    """``scope``: an expression whose first group bounds where the pattern is tried; empty: everywhere."""

    name: str
    label: str
    priority: int
    keyword: str
    pattern: str
    scope: str = ""


def _version(version: str, listed: list[str]) -> str:
    """The words of a version; a closing ``0`` may be missing or added where no other version begins alike."""
    first, _, rest = version.partition(" ")
    alone = sum(v.split(" ")[0] == first for v in listed) == 1
    return f"{first}(?: 0)?" if alone and rest in ("", "0") else version


def _identifiers() -> tuple[list[tuple[str, str]], str]:
    """``(label, pattern)`` per identifier that an SPDX expression may hold, and one pattern of any of them."""
    own, heads = [], {}
    for family, _, versions, shorts in FAMILIES:
        listed = [v for v in versions.split("|") if v]
        for head in dict.fromkeys([*(s for s in shorts.split("|") if s and not s.startswith("gnu ")), family.replace("-", " ")]):
            own.append((family, head))
            heads.setdefault(head, set()).update(_version(v, listed) for v in listed)
            for version in listed:
                numbered = f"{head} {_version(version, listed)}"
                own.append((f"{family}-{version}", f"{numbered}(?: only)?"))
                own.append((f"{family}-{version}-or-later", f"{numbered}(?:plus| or later)"))
    for term, _ in CC_TERMS:
        head, label = f"cc {term}", f"cc-{term.replace(' ', '-')}"
        own += [(label, head), *((f"{label}-{v}", f"{head} {v}") for v in CC_VERSIONS)]
        heads[head] = set(CC_VERSIONS)
    others = [(f"bsd-{digit}-clause", f"bsd {digit} clause") for digit, _ in BSD_CLAUSES] + [("bsd-0-clause", "0bsd"), ("mit-0", "mit 0")]
    others += [(re.sub(r"(?<=\d) (?=\d)", ".", words).replace(" ", "-"), words) for words in EXCEPTIONS]
    ways = [(words, "") for _, words in others]
    for head, versions in heads.items():
        numbers = "|".join(sorted(versions, key=lambda v: ("?" in v, -len(v), v)))  # 2 1 before 2
        ways.append((head, f"(?: (?:{numbers})(?:plus| or later| only)?)?" if numbers else ""))
    ways.sort(key=lambda w: (-len(w[0]), w))
    unlisted = r"licenseref(?:(?: (?!(?:and|or|with) )\w+){1,8}(?= (?:and|or|with) )| \w+)"
    return own + others, "|".join([*(f"{head}{tail}(?= )" for head, tail in ways), f"{unlisted}(?= )"])


@lru_cache(maxsize=1)
def default_rules() -> tuple[Rule, ...]:
    """The rule set, highest priority first: identifiers, grants, versions, texts, names, short forms."""
    rules: list[Rule] = []

    def add(name: str, label: str, priority: int, keyword: str, pattern: str, scope: str = "") -> None:
        rules.append(Rule(name, label.replace(" ", "."), priority, keyword, rf"(?<= )(?:{pattern})(?= )", scope))

    for family, name, versions, shorts in FAMILIES:
        key, listed = f"{family}:{name}", [v for v in versions.split("|") if v]
        add(f"{key}:grant", family, 70, name, f"{GRANT}{name}")
        add(f"{key}:name", family, 50, name, name)
        for version in listed:
            label, number = f"{family}-{version}", f"(?:(?: version| v)? |(?: version)? v){_version(version, listed)}"
            with_version = f"{name}(?: \\w+)?(?: as published by the free software foundation)?(?: either)?{number}"
            add(f"{key}:{version}:later", f"{label}-or-later", 95, name, f"(?:{GRANT})?{with_version}{LATER}")
            add(f"{key}:{version}:grant", label, 90, name, f"{GRANT}{with_version}")
            add(f"{key}:{version}", label, 80, name, with_version)
        for short in filter(None, shorts.split("|")):
            for version in listed:
                label, words = f"{family}-{version}", _version(version, listed)
                spaced = f"(?:{GRANT})?{short}(?: license)?(?:(?: version| v)? |(?: version)? v){words}"
                add(f"{key}:{short}:{version}", label, 60, f" {short} ", f"{spaced}(?: only)?")
                add(f"{key}:{short}:{version}:later", f"{label}-or-later", 65, f" {short} ", spaced + LATER)
                if not short.startswith("gnu "):
                    joint = f"(?:{GRANT})?{short}v" + ("?" if short in GLUED else "")
                    keyword = f" {short}" if short in GLUED else f" {short}v"
                    add(f"{key}:{short}:{version}:joint", label, 60, keyword, f"{joint}{words}(?: only)?")
                    add(f"{key}:{short}:{version}:joint:later", f"{label}-or-later", 65, keyword, f"{joint}{words}{LATER}")
            add(f"{key}:{short}:license", family, 55, f" {short} ", f"(?:{GRANT}{short}|{short} licen[sc]ed?)")
    identifiers, any_identifier = _identifiers()
    scope = f"(?<= )spdx license identifier ((?:{any_identifier})(?: (?:and|or|with) (?:{any_identifier}))*)"
    for label, pattern in identifiers:
        add(f"spdx:{label}:{pattern}", label, 100, "spdx license identifier", pattern, scope)
    for term, words in CC_TERMS:
        add(f"cc:{term}", f"cc-{term.replace(' ', '-')}", 50, " cc by", f"cc {term}")
        add(f"cc:{term}:grant", f"cc-{term.replace(' ', '-')}", 70, " cc by", f"{GRANT}cc {term}")
        add(f"cc:{term}:words", f"cc-{term.replace(' ', '-')}", 70, "creative commons", f"creative commons {words}")
        for version in CC_VERSIONS:
            label = f"cc-{term.replace(' ', '-')}-{version}"
            add(f"cc:{term}:{version}", label, 80, " cc by", f"(?:{GRANT})?cc {term} {version}")
            add(f"cc:{term}:{version}:words", label, 85, "creative commons", f"creative commons {words} {version}(?: international| unported| generic)?")
            add(f"cc:{term}:{version}:url", label, 90, "creativecommons org", f"creativecommons org licenses {term} {version}")
    for digit, word in BSD_CLAUSES:
        add(f"bsd:{digit}", f"bsd-{digit}-clause", 80, "clause", f"(?:bsd (?:{digit}|{word}) clause|(?:{digit}|{word}) clause bsd)(?: license)?")
    add("bsd:grant", "bsd", 70, " bsd ", f"(?:{GRANT}(?:a )?bsd|bsd (?:style )?license)")
    for name in BARE:
        add(f"{name}:bare", name, 70, f" {name} ", f"(?:{GRANT}{name}|{name} licen[sc]ed)")
    for label, keyword, pattern in TEXTS:
        add(f"text:{label}:{keyword}", label, 75, keyword, pattern)
    return tuple(sorted(rules, key=lambda r: (-r.priority, r.name)))


def suppress(found: list[tuple[int, int, int, str, str]]) -> list[tuple[int, int, int, str, str]]:
    """Detections ``(start, end, priority, label, rule)`` not contained in another of at least their priority.

    Of equal intervals the higher priority stays, then the smaller label and rule.
    One pass over the sorted detections with the furthest end per priority; a
    container that is itself suppressed has a container of its own that also fits.
    """
    furthest: dict[int, int] = {}
    kept = []
    for one in sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3], d[4])):
        if not any(p >= one[2] and e >= one[1] for p, e in furthest.items()):
            kept.append(one)
        furthest[one[2]] = max(one[1], furthest.get(one[2], 0))
    return kept


def scanner(rules: tuple[Rule, ...]):
    """The function that scans one text; compiled once per task."""
    by_keyword: dict[str, list[Rule]] = {}
    for rule in rules:
        by_keyword.setdefault(rule.keyword, []).append(rule)
    automaton = ahocorasick.Automaton()
    for keyword in by_keyword:
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    compiled: dict[str, re.Pattern] = {}

    def scan(text: str) -> tuple:
        lowered = text.translate(LOWER)
        words = WORD.findall(PLUS.sub("plus", lowered) if "+" in lowered else lowered)
        joined = f" {' '.join(words)} "
        regions = {"": [(0, len(joined))]}
        base = []
        for phrase, label in BASE:
            sought, at, count, counted = f" {phrase} ", joined.find(f" {phrase} "), 0, 0
            while at >= 0:
                count, counted = count + joined.count(" ", counted, at), at
                base.append((count, label))
                at = joined.find(sought, at + 1)
        found = []
        for keyword in {hit for _, hit in automaton.iter(joined)}:
            for rule in by_keyword[keyword]:
                pattern = compiled.get(rule.name)
                if pattern is None:
                    pattern = compiled[rule.name] = re.compile(rule.pattern)
                if rule.scope not in regions:
                    regions[rule.scope] = [(m.start(1), m.end(1) + 1) for m in re.finditer(rule.scope, joined)]
                for start, end in regions[rule.scope]:
                    found += [(m.start(), m.end(), rule.priority, rule.label, rule.name) for m in pattern.finditer(joined, start, end)]
        detections, count, counted = [], 0, 0
        for start, end, priority, label, name in suppress(found):
            count, counted = count + joined.count(" ", counted, start), start
            first = count - 1
            detections.append({
                "label": label, "rule": name, "priority": priority, "first": first, "last": first + joined.count(" ", start, end),
            })
        return len(words), [{"label": label, "word": at} for at, label in sorted(base)], detections

    return scan


BASE_TYPE = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))
FOUND_TYPE = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("priority", T.IntegerType()),
    T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
]))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per input row: ``id, n_words, base, detections``.

    ``base`` holds the places of the four base phrases (label, first word), and
    ``detections`` what the rules leave after suppression, with word positions from 0
    (``last`` inclusive). Null and empty texts give no words and empty arrays; a null
    id is carried along; repeated rows give repeated rows; an empty table an empty
    result. Other columns of the input are not read. A text is scanned whole by one
    task, however long, in memory of a few times its size. Of an SPDX expression every
    listed license and exception is detected by itself; what is not listed ends the
    expression, but for a ``LicenseRef``. Line ends are not seen.
    """
    chosen = rules or default_rules()
    fields = [("n_words", T.LongType()), ("base", BASE_TYPE), ("detections", FOUND_TYPE)]
    return text_map(df, id_col, text_col, fields, lambda: scanner(chosen))


def license_report(df: DataFrame) -> DataFrame:
    """The digest of :func:`scan_licenses` per document.

    ``score`` is the confidence of the strongest evidence, from 0 (none) to 1 (an
    identifier): a detection counts its priority in hundredths, a base phrase a half.
    """
    found = scan_licenses(df)
    words, base = F.col("base.word"), F.col("base.label")
    strongest = F.coalesce(F.array_max(F.col("detections.priority")), F.lit(0)) / F.lit(100.0)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, F.col("detections.label")))), ",").alias("labels"),
        F.greatest(strongest, F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
