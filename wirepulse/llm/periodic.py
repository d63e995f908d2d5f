"""Periodic runs of words: found online along sparse diagonals, and collapsed to one period.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
equal) that is at least ``least`` words and ``times`` periods long and that no neighbouring
word extends. It is a diagonal of the table "word ``i`` equals word ``i - q``".

Words are read from the left. Every active diagonal whose earlier word equals the new one
grows by one; the others end, and a diagonal that is long enough emits its run there and
then. Comparing each word with all its earlier occurrences would be quadratic for frequent
words, so diagonals start only where a run can be: at the scale of ``c`` = 16, 32, 64, ...
words, where the ``c`` words that end here occurred before, and only at the lag of their
nearest earlier occurrence, if that lag fits the scale (``c / 2 < lag <= c``, at the first
scale ``lag <= c``). This loses nothing: inside a run of smallest period ``q <= c`` the
window of ``c`` words cannot recur at a smaller lag (the run would have a smaller
period by the theorem of Fine and Wilf), and a run matches over ``2 * q > c`` words. For the same
reason a diagonal that gets long enough has its smallest period as lag. Windows are named
exactly, by doubling, and not by hashes. A text takes ``n log n`` steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Words of the first scale.
FIRST = 16
#: Texts taken from a batch at a time.
SLICE = 256

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
FIELDS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def split_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _numbers(words: list[bytes]) -> np.ndarray:
    known = dict.fromkeys(words)
    for number, word in enumerate(known):
        known[word] = number
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _recurs(numbers: np.ndarray, size: int) -> bool:
    """Whether some window of ``size`` (a power of two) words may occur twice; never wrong when it says no."""
    hashes, step = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while step < size:
        mixed = hashes[:-step] * np.uint64(0xD6E8FEB86659FD93) + hashes[step:]
        hashes, step = mixed ^ (mixed >> np.uint64(29)), 2 * step
    hashes.sort()
    return bool((hashes[1:] == hashes[:-1]).any())


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of the windows of ``2 * size`` words from those of ``size`` words."""
    return np.unique((names[:-size] << 32) | names[size:], return_inverse=True)[1].astype(np.int64)


def _lags(names: np.ndarray) -> np.ndarray:
    """Distance of every window to its nearest earlier occurrence; 0 where there is none."""
    order = np.argsort(names, kind="stable")
    again = names[order[1:]] == names[order[:-1]]
    lags = np.zeros(len(names), np.int64)
    lags[order[1:][again]] = (order[1:] - order[:-1])[again]
    return lags


def _births(numbers: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Where diagonals start: by the place of a window's last word, its lag and its number of matched words."""
    count, names, size = len(numbers), numbers, 1
    births: dict[int, list[tuple[int, int]]] = {}
    while 2 * size <= count:
        names, size = _doubled(names, size), 2 * size
        if size < FIRST:
            continue
        lags = _lags(names)
        if not lags.any():
            break
        fits = (lags > 0) & (lags <= size) & ((lags > size // 2) | (size == FIRST))
        opens = fits & (np.concatenate([[0], lags[:-1]]) != lags)
        for start in np.flatnonzero(opens).tolist():
            births.setdefault(start + size - 1, []).append((int(lags[start]), size))
    return births


def find_runs(words: list[bytes], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period.

    ``least`` has to be 24 or more and ``times`` 3 or more, else runs could be shorter than the first scale.
    """
    if least < 24 or times < 3:
        raise ValueError("runs take 24 words and 3 periods or more")
    count = len(words)
    if count < least:
        return []
    numbers = _numbers(words)
    if not _recurs(numbers, FIRST):
        return []
    births = _births(numbers)
    places, at = sorted(births), 0
    word = numbers.tolist()
    active: dict[int, int] = {}  # lag -> words matched so far
    found: list[tuple[int, int, int]] = []

    def end(place: int, lag: int) -> None:
        length = active.pop(lag) + lag
        if length >= least and length >= times * lag:
            found.append((place - length, length, lag))

    i = places[0] if places else count
    while i < count:
        for lag in [q for q in active if word[i] != word[i - q]]:
            end(i, lag)
        for lag in active:
            active[lag] += 1
        for lag, matched in births.get(i, ()):
            active.setdefault(lag, matched)
        while at < len(places) and places[at] <= i:
            at += 1
        i = i + 1 if active else places[at] if at < len(places) else count
    for lag in list(active):
        end(count, lag)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    kept, free = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[free:max(free, start)]
        free = max(free, end)
    return kept + words[free:]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, rewrite: Rewrite | None = None,
) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of every row: its runs and its text without their repeats.

    ``rewrite`` maps the id and the words of a text to other words, before anything else.
    Narrow: rows stay where they are and nothing is shuffled. A null text is empty and has no
    runs; a null id stays null; repeated rows give repeated rows; an empty table gives
    none; other columns are not read. A text is held whole by its task: about 100 bytes a
    word, and time in proportion to ``n log n`` words whatever their frequencies.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                counts, spans, texts = [], [], []
                for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                    words = split_words(text or "")
                    if rewrite is not None:
                        words = rewrite(name, words)
                    runs = find_runs(words, least, times)
                    counts.append(len(words))
                    spans.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass"))
                if schema is None:
                    item = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
                    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(item)), ("collapsed", pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(v, f.type) for v, f in zip((counts, spans, texts), list(schema)[1:]))], schema=schema
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id long, {FIELDS}")


def planted_period(name: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all ids (by the crc32 of the decimal id) repeat a period from some word on; others and null ids stay."""
    if name is None or not words:
        return words
    code, count = zlib.crc32(str(name).encode()), len(words)
    if code % 10:
        return words
    given = code // 10
    begin = given % count
    period = 1 + (count - begin) // (3 + given % 8)
    whole, rest = divmod(count - begin, period)
    piece = words[begin : begin + period]
    return words[:begin] + piece * whole + piece[:rest]


def _strongest(runs: Column) -> Column:
    """The run with the greatest exact exponent; the earliest of equal ones."""
    def better(best: Column, r: Column) -> Column:
        more = best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
        return F.when(more, r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def run_digest(runs: DataFrame) -> DataFrame:
    """Number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = runs.withColumn("best", _strongest(F.col("runs")))
    return best.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
