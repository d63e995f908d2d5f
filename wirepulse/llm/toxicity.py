"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is the log-odds of toxic against other labelled documents under an
informative Dirichlet prior (its share of all labelled tokens). Tokens are lower-cased
words; a word too rare to be judged backs off to its stem (its first letters), so that
inflected forms count together. A linear scan finds every maximal scoring segment of
a text. Under the extreme-value law of such segments, one of score s is expected
``K m exp(-lambda s)`` times in m ordinary tokens; lambda follows from the scores of
ordinary tokens, K from the segments of ordinary documents. A text's evidence is the
sum of its segments' ``-log`` expectations, and its score a logistic curve over that.
"""

from __future__ import annotations

import math
import re
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wirepulse.llm.rows import text_map
from wirepulse.session import checkpointed

#: Most labelled documents of either class that the model is fitted on (lowest hash of the id first).
FIT_DOCUMENTS = 20_000
#: Occurrences among labelled documents from which a token is judged by itself.
MIN_COUNT = 8
#: Weight of the Dirichlet prior, in documents; drift taken from every token; letters of a stem.
PRIOR, DRIFT, STEM = 5.0, 0.35, 4
#: Largest log-odds a single token can carry either way.
CLIP = 5.0
#: Tokens that chance may pass for toxic, expected among all tested ones; sets the deviance asked for.
BY_CHANCE = 0.05
#: A segment is reported when fewer than this many are expected by chance in its text.
SIGNIFICANT = 0.05
WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    """Scores of words and stems, and the constants of the extreme-value law."""

    words: dict[str, float]
    stems: dict[str, float]
    rate: float
    scale: float
    weight: float
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> DataFrame:
    """Texts to learn from: ``(doc_id, text, toxic)`` of at most ``limit`` rows per class, none held out.

    A document with several labels is toxic if one of them says so; null ids and null
    labels teach nothing. The chosen ids are at most twice ``limit`` longs, so they are
    broadcast and the texts are not shuffled.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marks = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [marks.where(F.col("toxic") == kind).orderBy(*order).limit(limit) for kind in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    return docs.select("doc_id", "text").join(ids, "doc_id")


def _counts(text: str) -> tuple:
    words = WORD.findall(text.lower())
    return (words + [w[:STEM] + "*" for w in words if len(w) > STEM],)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn the token scores and the extreme-value constants.

    Counts and score histograms are aggregated by Spark; the driver receives the tokens
    that ``MIN_COUNT`` of the bounded sample of labelled rows hold, a histogram of fixed size, and the
    rows' classes as sums. Without labelled rows of both classes every
    document scores the same: near 0 or 1 by the class there is, and a half without any.
    """
    known = labelled(docs, labels)
    tokens = text_map(
        known.select(F.struct("doc_id", "toxic").alias("key"), "text"), "key", "text", [("tokens", T.ArrayType(T.StringType()))], lambda: _counts,
    )
    # A token counts once a document: a text that repeats itself is one witness.
    each = tokens.select(F.col("key.toxic").alias("toxic"), F.explode(F.array_distinct("tokens")).alias("token"))
    counts = each.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    docs_toxic, docs_other = sizes.get(1, 0), sizes.get(0, 0)
    if not docs_toxic or not docs_other:
        return Model({}, {}, 1.0, 1.0, 0.0, 0.0 if not sizes else (9.0 if docs_toxic else -9.0))
    n_toxic, n_other, n_all = float(docs_toxic), float(docs_other), float(docs_toxic + docs_other)
    # The prior adds PRIOR documents to each side that hold the token at its overall share.
    share = F.col("n") / F.lit(n_all)
    toxic, other = F.col("toxic") + share * PRIOR, F.col("n") - F.col("toxic") + share * PRIOR
    odds = F.log(toxic / (n_toxic + PRIOR - toxic + 0.5)) - F.log(other / (n_other + PRIOR - other + 0.5))
    # Deviance of the token's split between the classes from the split of all documents.
    clean, expected = F.col("n") - F.col("toxic"), F.col("n") * F.lit(n_toxic / n_all)
    deviance = 2 * (
        F.when(F.col("toxic") > 0, F.col("toxic") * F.log(F.col("toxic") / expected)).otherwise(0.0)
        + F.when(clean > 0, clean * F.log(clean / (F.col("n") - expected))).otherwise(0.0)
    )
    scored = counts.select("token", "n", odds.alias("odds"), deviance.alias("deviance"))
    # Positive scores need a significant difference; the rest is background and only drifts.
    # All tokens come from the bounded sample of labelled documents, so their number is bounded, too.
    tested = checkpointed(scored)
    sure = _surely(tested.count())
    chosen = tested.where((F.col("deviance") > sure) & (F.col("odds") > 1.0)).collect()
    words, stems = {}, {}
    for row in chosen:
        (stems if row.token.endswith("*") else words)[row.token.removesuffix("*")] = min(row.odds, CLIP)
    common = tested.where(~F.col("token").endswith("*")).select("token").collect()
    words = {r.token: 0.0 for r in common} | words
    return calibrate(Model(words, stems, 1.0, 1.0, 0.0, 0.0), known)


def calibrate(model: Model, known: DataFrame) -> Model:
    """Constants of the extreme-value law, and of the score, from the labelled texts.

    ``rate`` solves ``sum p(s) exp(rate s) = 1`` over the scores of ordinary tokens (in
    hundredths: a histogram of fixed size). ``scale`` makes the law meet the share of
    ordinary documents that have any segment, at those segments' mean score. The
    score is a logistic curve over the evidence of all segments of a text, fitted on a
    histogram of fixed size.
    """
    keyed = known.select(F.struct("doc_id", "toxic").alias("key"), "text")
    fields = [("n", T.LongType()), ("histogram", T.MapType(T.IntegerType(), T.LongType())), ("best", T.DoubleType())]
    scored = text_map(keyed, "key", "text", fields, lambda: _sampler(model)).where("key.toxic = 0")
    bars = scored.select(F.explode("histogram").alias("score", "n")).groupBy("score").agg(F.sum("n").alias("n")).collect()
    total = sum(b.n for b in bars) or 1
    shares = [(b.score / 100, b.n / total) for b in bars]
    low, high = 1e-6, 10.0
    if any(s > 0 for s, _ in shares):
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(p * math.exp(middle * s) for s, p in shares) < 1 else (low, middle)
        rate = low
    else:
        rate = 1.0
    hit = F.col("best") > 0
    law = scored.where("n > 0").agg(
        F.avg(hit.cast("double")).alias("share"), F.avg(F.when(hit, F.col("best"))).alias("score"), F.avg("n").alias("length"),
    ).first()
    share = min(max(law.share or 0.0, 1e-4), 0.999)
    scale = -math.log(1 - share) / max(law.length or 1.0, 1.0) * math.exp(min(rate * (law.score or CLIP - DRIFT), 50.0))
    known_law = model._replace(rate=rate, scale=scale)
    evidence = text_map(keyed, "key", "text", [("evidence", T.DoubleType())], lambda: lambda text: (_evidence(known_law, text)[0],))
    bins = evidence.groupBy(F.col("key.toxic").alias("toxic"), F.round(F.least("evidence", F.lit(50.0)), 1).alias("x")).count().collect()
    weight, bias = _logistic([(b.x, b.toxic, b["count"]) for b in bins])
    return known_law._replace(weight=weight, bias=bias)


def _surely(tested: int) -> float:
    """Deviance that chance exceeds for ``BY_CHANCE`` of ``tested`` tokens: a quantile of the chi-squared law with one degree of freedom."""
    tail = BY_CHANCE / max(tested, 1)
    return NormalDist().inv_cdf(1 - tail / 2) ** 2


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Weight and bias of a logistic curve through counted ``(x, class)``, by Newton steps with a slight ridge."""
    x, y, n = (np.array([b[k] for b in bins], float) for k in range(3))
    rows = np.stack([x, np.ones_like(x)], axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ theta, -30, 30)))
        slope = rows.T @ (n * (y - p)) - 0.01 * theta
        curve = (rows * (n * p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def token_scores(model: Model, text: str) -> np.ndarray:
    """Score of each word of a text, drift taken off."""
    words, stems = model.words, model.stems
    values = []
    for word in WORD.findall(text.lower()):
        value = words.get(word)
        if value is None:  # too rare to be judged by itself
            value = stems.get(word[:STEM], 0.0) if len(word) > STEM else 0.0
        values.append(value)
    return np.asarray(values, dtype=np.float64) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment ``(start, end, score)``, end exclusive, in order.

    Runs of rising totals are candidates; each new one is merged to the left as long as
    an earlier candidate starts lower and ends no higher. A candidate is pushed and
    popped once and the search for the earlier one skips along links, so a text
    takes time in proportion to its length.
    """
    if not len(scores):
        return []
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # start, end, total before, total after, index of the nearest candidate that starts lower
    for at in np.flatnonzero(scores > 0).tolist():
        one = [at, at + 1, float(totals[at]), float(totals[at + 1]), -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= one[2]:
                j = stack[j][4]
            one[4] = j
            if j < 0 or stack[j][3] >= one[3]:
                stack.append(one)
                break
            one = [stack[j][0], one[1], stack[j][2], one[3], -1]
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


def _sampler(model: Model):
    def sample(text: str) -> tuple:
        scores = token_scores(model, text)
        values, counts = np.unique(np.round(scores * 100).astype(np.int64), return_counts=True)
        best = max((s[2] for s in segments(scores)), default=0.0)
        return len(scores), list(zip(values.tolist(), counts.tolist(), strict=True)), float(best)

    return sample


def _evidence(model: Model, text: str) -> tuple[float, list[dict]]:
    """How far all segments of a text together exceed chance, and the significant ones."""
    scores = token_scores(model, text)
    found, evidence = [], 0.0
    for start, end, score in segments(scores):
        expected = model.scale * len(scores) * math.exp(-min(model.rate * score, 500.0))
        if expected < SIGNIFICANT:
            found.append({"first": start, "last": end - 1, "score": round(score, 6), "expected": expected})
        if expected < 1:
            evidence -= math.log(max(expected, 1e-200))
    return evidence, found


def _judge(model: Model):
    def judge(text: str) -> tuple:
        evidence, found = _evidence(model, text)
        value = model.weight * min(evidence, 50.0) + model.bias
        return round(1 / (1 + math.exp(-max(min(value, 500.0), -500.0))), 9), found

    return judge


FOUND_TYPE = T.ArrayType(T.StructType([
    T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("expected", T.DoubleType()),
]))


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, score, passages`` (word positions of significant segments).

    Null, empty and wordless texts score as texts without evidence and have no passages; null ids are carried
    along, repeated rows repeat, an empty table gives an empty result, and other columns
    are not read.
    """
    return text_map(df, id_col, text_col, [("score", T.DoubleType()), ("passages", FOUND_TYPE)], lambda: _judge(model))


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Fit on the labelled rows that are not held out, and score every document."""
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"),
    )
