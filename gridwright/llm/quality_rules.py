"""Quality rules in DataFrame functions alone: base rules, then a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets are
counted, one on trusted texts and one on the whole corpus, both smoothed. A text's verdict is the mean,
over its n-grams, of ``log p_trusted - log p_corpus``, held against a fixed threshold. Counting shuffles
only bucket counts, scoring shuffles nothing; the table of weights has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import spare, text_of

BUCKETS = 10_000
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Mean log ratio from which a text is kept.
THRESHOLD = -0.15
#: Base rules: fewer words, or a larger percentage of words in repeated three-word windows, fail a text.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Up to so many trusted ids are sent to all tasks; more are joined by a shuffle of the texts.
BROADCAST_IDS = 200_000

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def gram_buckets(words: Column, buckets: int) -> Column:
    """The bucket of each word and of each pair of neighbours, as ints."""
    n = F.size(words)
    pairs = F.slice(words, 1, F.greatest(n - 1, F.lit(0)))
    return F.concat(
        F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")),
        F.transform(pairs, lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int")),
    )


def _windows(words: Column) -> Column:
    """The three-word windows as 64-bit hash and start, in hash order: equal ones are neighbours."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.sort_array(
        F.transform(
            starts, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
        )
    )


def _repeats(windows: Column) -> Column:
    """Sorted starts of the windows with an equal neighbour in hash order."""
    n = F.greatest(F.size(windows) - 1, F.lit(0))
    pairs = F.filter(
        F.arrays_zip(F.slice(windows, 1, n).alias("a"), F.slice(windows, 2, n).alias("b")),
        lambda p: p["a"]["h"] == p["b"]["h"],
    )
    return F.sort_array(
        F.array_distinct(
            F.flatten(F.transform(pairs, lambda p: F.array(p["a"]["i"], p["b"]["i"])))
        )
    )


def _covered(starts: Column) -> Column:
    """Words covered by windows of three at the sorted ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def base_columns(df: DataFrame, text: str = "text", words: str = "words_") -> DataFrame:
    """``df`` with the base counts, ``base_failed`` (see ``rules`` for their meaning) and the list of ``words``."""
    t, s, r = (spare(df, n) for n in ("t_", "s_", "r_"))
    w = words
    lines = F.filter(F.split(F.col(t), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    worded = df.withColumn(t, text_of(text)).withColumn(w, words_of(F.col(t)))
    # Each sorted list is a column of its own, so that no lambda computes it anew for each element.
    listed = worded.withColumn(s, _windows(F.col(w))).withColumn(r, _repeats(F.col(s)))
    n, repeats = F.size(w).cast("long"), _covered(F.col(r))
    return (
        listed.withColumns(
            {
                "n_words": n,
                "word_chars": F.length(F.regexp_replace(F.col(t), GAP, "")).cast("long"),
                "n_symbols": (F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, ""))).cast("long"),
                "n_dup_lines": F.aggregate(
                    F.array(lines), F.lit(0).cast("long"), lambda acc, x: acc + F.size(x) - F.size(F.array_distinct(x))
                ),
                "n_repeat_words": repeats,
            }
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        )
        .drop(t, s, r)
    )


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """How often each bucket occurs in the column ``t`` of ``texts``, in all and in the ``trusted`` ones, in one pass."""
    grams = texts.select("trusted", words_of(F.col("t")).alias("w")).select(
        "trusted", F.explode(gram_buckets(F.col("w"), buckets)).alias("b")
    )
    return grams.groupBy("b").agg(F.count_if("trusted").alias("n_trusted"), F.count(F.lit(1)).alias("n_all"))


def log_ratios(trusted: DataFrame, corpus: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """The ratios of two separate tables of texts (column ``t``); see ``log_ratios_within``."""
    sides = trusted.select("t", F.lit(True).alias("trusted")).unionAll(corpus.select("t", F.lit(False).alias("trusted")))
    found = bucket_counts(sides, buckets).withColumn("n_corpus", F.col("n_all") - F.col("n_trusted"))
    return _ratios(found, buckets, smoothing)


def log_ratios_within(texts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row, one column ``ratios``: the log ratio of each bucket, in order.

    ``texts`` has a column ``t`` and a boolean ``trusted``; the corpus is all of them. No trusted text, or none at
    all: that side counts as evenly spread.
    """
    return _ratios(bucket_counts(texts, buckets).withColumnRenamed("n_all", "n_corpus"), buckets, smoothing)


def _ratios(found: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    counted = (
        found.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(found, "b", "left")
        .fillna(0, ["n_trusted", "n_corpus"])
    )
    sums = counted.agg(
        F.sum("n_trusted").alias("a"), F.sum("n_corpus").alias("c"),
        F.sort_array(F.collect_list(F.struct("b", "n_trusted", "n_corpus"))).alias("rows"),
    )
    extra = F.lit(smoothing * buckets)
    shift = F.log(F.col("c") + extra) - F.log(F.col("a") + extra)
    return sums.select(
        F.transform(
            "rows", lambda r: F.log(r["n_trusted"] + smoothing) - F.log(r["n_corpus"] + smoothing) + shift
        ).alias("ratios")
    )


def marked_texts(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts (column ``t``); ``trusted`` are those whose key is in the first column of ``trusted_ids``.

    Few ids are sent to the tasks, so no text is shuffled; the number is counted first.
    """
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("k")).dropna().distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    known = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).join(ids.withColumn("y", F.lit(True)), "k", "left")
    return known.select("t", F.coalesce("y", F.lit(False)).alias("trusted"))


def trusted_texts(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The trusted ones of ``marked_texts``."""
    return marked_texts(docs, trusted_ids, key, text).where("trusted").select("t")


def rules(
    df: DataFrame, ratios: DataFrame, text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD
) -> DataFrame:
    """``df`` with base counts, ``log_ratio`` and ``kept``; ``ratios`` comes from ``log_ratios``.

    ``word_chars`` counts the characters of words, ``n_symbols`` the symbols, ``n_dup_lines`` the lines with
    a word that equal an earlier line, ``n_repeat_words`` the words in three-word windows found twice or
    more. A null text counts as empty: no words, so the base rules fail it. Columns of these names are
    replaced, all others stay. The verdict of one text depends on no other row of ``df``.
    """
    words = spare(df, "words_")
    based = base_columns(df, text, words)
    # A list of fixed length; as text it becomes one constant when the plan is optimised.
    listed = ratios.select(F.transform("ratios", lambda x: F.round(x, 6).cast("string")).alias("r")).first().r
    weight = F.split(F.lit(",".join(listed)), ",").cast("array<double>")
    grams = gram_buckets(F.col(words), buckets)
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(weight, b))
    mean = F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(F.lit(0.0))
    return (
        based.withColumn("log_ratio", mean)
        .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
        .drop(words)
    )
