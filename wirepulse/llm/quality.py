"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed to a fixed number of buckets. Two
multinomials over the buckets are counted, one over trusted documents and one over the
whole corpus; a document's ratio is the mean of ``log(p_trusted / p_corpus)`` over its
n-grams, and every document is kept or rejected by one threshold. Built-in expressions
throughout: one narrow pass to count, one to judge, and no shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirepulse.functions.text import let

#: Buckets of the hashed n-grams: fixes the size of the model.
BUCKETS = 1 << 16
#: Most trusted documents the target multinomial is fitted on (lowest hash of the id first).
TRUSTED = 20_000
#: Pseudo-count of each bucket in the corpus; the target's has the same share of its size.
SMOOTHING = 20.0
#: Mean log-likelihood ratio from which a document is kept.
THRESHOLD = -0.08
WHITE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Runs of anything but space and the controls 9 to 13; none for null."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+", -1))


def _hashes(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``q_words`` and ``q_hashes``; each is computed once a row."""
    return df.withColumn("q_words", words_of(text)).withColumn("q_hashes", F.transform("q_words", lambda w: F.xxhash64(w)))


def _buckets(hashes: Column, buckets: int) -> Column:
    """Bucket of every word and of every pair of neighbours."""
    singles = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = F.when(
        F.size(hashes) > 1,
        F.transform(
            F.sequence(F.lit(0), F.size(hashes) - 2),
            lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(buckets)).cast("int"),
        ),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(singles, pairs)


def _repeated_words(hashes: Column) -> Column:
    """Words inside a three-word window that the text holds at least twice.

    Windows are sorted by hash with their position; those equal to a neighbour repeat,
    and the words they cover are counted from the gaps between their positions. Texts
    without any repeat skip the sort.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)),
    )

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    def repeats(ordered: Column) -> Column:
        same = F.filter(
            ordered,
            lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(values: Column) -> Column:
        pairs = F.transform(values, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(values)) == F.size(values), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), repeats))

    return F.when(F.size(hashes) >= 3, let(windows, count)).otherwise(F.lit(0).cast("long"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, trusted: int = TRUSTED) -> str:
    """The log-ratio of each bucket as a JSON array of ``buckets`` numbers.

    The corpus multinomial counts every document. The target multinomial counts
    documents labelled ``quality = 1``: at most ``trusted`` of them, by lowest hash of
    the id, so that their ids (one long each) are broadcast and no text is shuffled.
    Without trusted documents all ratios are zero and only the base rules decide.
    """
    spark = docs.sparkSession
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good_id")).distinct()
    chosen = good.orderBy(F.xxhash64("good_id"), "good_id").limit(trusted).withColumn("good", F.lit(1))
    narrow = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text"))
    marked = narrow.join(F.broadcast(chosen), F.col("row_id") == F.col("good_id"), "left")
    hashed = _hashes(marked.select(F.coalesce("good", F.lit(0)).alias("good"), "row_text"), F.col("row_text"))
    each = hashed.select("good", F.explode(_buckets(F.col("q_hashes"), buckets)).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("corpus"), F.sum("good").alias("target"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    filled = every.select("bucket", F.coalesce("corpus", F.lit(0)).alias("corpus"), F.coalesce("target", F.lit(0)).alias("target"))
    # ``buckets`` rows in all: gathering them in one is of fixed size.
    gathered = filled.agg(F.array_sort(F.collect_list(F.struct("bucket", "corpus", "target"))).alias("rows"), F.sum("corpus").alias("n"), F.sum("target").alias("m"))

    def ratio(r: Column) -> Column:
        # An n-gram is judged by the other n-grams of the corpus, without itself; one
        # that occurs nowhere else then says nothing.
        share = F.col("m") / F.col("n")
        target = F.log(r["target"] + F.lit(SMOOTHING) * share) - F.log(F.col("m") + F.lit(SMOOTHING * buckets) * share)
        corpus = F.log(F.greatest(r["corpus"] - 1, F.lit(0)) + SMOOTHING) - F.log(F.col("n") + SMOOTHING * buckets)
        return F.when(F.col("m") > 0, target - corpus).otherwise(F.lit(0.0))

    return gathered.select(F.to_json(F.transform("rows", ratio))).first()[0]


def judge(
    df: DataFrame, ratios: str, text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS,
) -> DataFrame:
    """``row`` (the input row as a struct) with its counts, its ratio and the verdict ``kept``.

    Null, empty and wordless texts have no words, a null ratio, and fail the base
    rules; a text of one word is scored by that word. Repeated rows and null ids are
    judged like any other row; extra columns stay inside ``row`` and cannot clash; an
    empty table gives an empty result.
    """
    text = F.col("q_text")
    # The model is a subquery's value: as a literal, every rendering of the plan would hold all of its numbers.
    given = df.sparkSession.createDataFrame([(ratios,)], "ratios string")
    model = given.select(F.from_json("ratios", "array<double>")).scalar()
    narrow = df.select(F.struct("*").alias("row"), F.col(text_col).alias("q_text"))
    hashed = _hashes(narrow, text)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    ratio = F.when(
        F.size("q_grams") > 0,
        F.aggregate("q_grams", F.lit(0.0), lambda total, b: total + F.get(F.col("q_model"), b)) / F.size("q_grams"),
    )
    # The counts come out of a generator, so a filter on the verdict is not copied below it.
    each = F.struct(
        F.size("q_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("q_hashes")).alias("n_repeat_words"),
        _buckets(F.col("q_hashes"), buckets).alias("q_grams"),
    )
    counted = hashed.select("row", F.explode(F.array(each)).alias("counted")).select("row", "counted.*")
    counted = counted.withColumn("q_model", model).withColumn("log_ratio", ratio).drop("q_grams", "q_model")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("log_ratio", F.lit(0.0)) >= threshold),
    )


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, ratio and verdict per document."""
    judged = judge(docs, fit(docs, labels))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio",
    )
