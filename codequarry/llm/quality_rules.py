"""Operator 2: quality rules, and hashed n-gram importance of each document.

The verdict compares two multinomials over hashed word n-grams, each word and each two words in a row
of the whole text: that of a trusted target and that of the raw corpus. A document is kept when
the mean of log(target / corpus) over its n-grams reaches a fixed threshold. A bucket holds many n-grams, and the
target is smoothed by the corpus: words that the target lacks then count for little by themselves, and many of them for much.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import SPACE_CHARS, table, text_or_empty, words

#: Hash buckets of n-grams: what is gathered of the corpus, at most 2 counts each.
BUCKETS = 1 << 14
#: Weight of the corpus in the target's smoothing, in n-grams: 16 for each bucket.
PRIOR = 1 << 18
#: Trusted documents that were left out of the target lie above it, but for 2 % at sf0.01 and none at sf0.1.
THRESHOLD = -0.05
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def _pairs(a: Column, gap: Column, drop: int, then=lambda h: h) -> Column:
    """Hashes of each item with the one ``gap`` later; ``drop``: by how many the result is shorter than the words; ``then``: what is made of each."""
    n = F.greatest(F.size("__q_words") - drop, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, gap + 1, n), lambda x, y: then(F.xxhash64(x, y)))


def _hashes(docs: DataFrame) -> DataFrame:
    """Add __q_text and __q_words, and hashes of each word (__q_h1) and of each two in a row (__q_h2)."""
    out = docs.withColumn("__q_text", text_or_empty()).withColumn("__q_words", words(F.col("__q_text")))
    return out.withColumn("__q_h1", F.transform("__q_words", lambda w: F.xxhash64(w))).withColumn("__q_h2", _pairs(F.col("__q_words"), F.lit(1), 1))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def base_measures(hashed: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Windows of 8 words are named by hashing pairs of pairs of pairs. Only in texts where
    a window comes twice are the windows sorted; there a repeated window adds the words
    that the one before it does not cover yet.
    """
    long = lambda c: c.cast("long")
    out = hashed.withColumn("__q_h4", _pairs(F.col("__q_h2"), F.lit(2), 3))
    out = out.withColumn("__q_h8", _pairs(F.col("__q_h4"), F.lit(4), 7))
    twice = F.size(F.array_distinct("__q_h8")) < F.size("__q_h8")
    listed = F.when(twice, F.array_sort(F.transform("__q_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("__q_sorted", listed)
    s = F.col("__q_sorted")
    again = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("__q_at", F.array_sort(F.transform(again, lambda x: x["i"])))
    cover = F.aggregate(
        "__q_at",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["total"] + WINDOW - F.greatest(F.lit(0), acc["end"] - p)).alias("total"), (p + WINDOW).alias("end")),
        lambda acc: acc["total"],
    )
    lines = F.filter(F.split("__q_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    out = out.withColumn("__q_lines", lines)
    return (
        out.withColumn("n_words", long(F.size("__q_words")))
        .withColumn("word_chars", long(F.length(F.array_join("__q_words", ""))))
        .withColumn("n_symbols", long(F.length("__q_text") - F.length(F.regexp_replace("__q_text", SYMBOLS, ""))))
        .withColumn("n_dup_lines", long(F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))))
        .withColumn("n_repeat_words", long(F.coalesce(cover, F.lit(0))))
        .drop("__q_h4", "__q_h8", "__q_sorted", "__q_at", "__q_lines")
    )


def ngram_counts(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams in all of ``docs``, and in those whose doc_id is in ``trusted``."""
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("__q_t")).distinct()
    # The hint: one way at every size, for the trusted documents grow with the corpus. What is shuffled is two bytes for each n-gram.
    small = lambda h: _bucket(h).cast("smallint")
    grams = F.concat(F.transform("__q_words", lambda w: small(F.xxhash64(w))), _pairs(F.col("__q_words"), F.lit(1), 1, small))
    listed = docs.select("doc_id", words(text_or_empty()).alias("__q_words"))
    rows = listed.select("doc_id", grams.alias("__q_b")).join(ids.hint("merge"), F.col("doc_id") == F.col("__q_t"), "left")
    grams = rows.select(F.col("__q_t").isNotNull().alias("t"), F.explode("__q_b").alias("b"))
    counts = np.zeros((2, BUCKETS))
    for t, b, n in grams.groupBy("t", "b").count().collect():  # 2 * BUCKETS rows at most
        counts[int(t), b] = n
    return counts.sum(0), counts[1]


def log_ratios(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / corpus) for each bucket. The target is smoothed by the corpus, so that a bucket
    of which it has too little to tell anything has a ratio near 1."""
    raw = (corpus + 1) / (corpus.sum() + len(corpus))
    return np.log((target + PRIOR * raw) / (target.sum() + PRIOR) / raw)


def _ratio_sum(ratios: np.ndarray, hashes: str) -> Column:
    """The sum of the ratios of some hashes' buckets; the list of ratios is one constant of fixed size."""
    listed = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    return F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.get(listed, _bucket(h)))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated windows of 8.
    llr: mean log ratio of the text's words and pairs of words, 0 without any. kept: not base_failed and
    llr >= threshold. Null texts have no words and fail; without trusted documents each
    ratio is 1. Rows are judged one by one, so order, ties and repeated rows don't matter.
    """
    ratios = log_ratios(*ngram_counts(docs, trusted))
    out = base_measures(_hashes(docs))
    n = F.size("__q_h1") + F.size("__q_h2")
    out = out.withColumn("llr", F.when(n > 0, (_ratio_sum(ratios, "__q_h1") + _ratio_sum(ratios, "__q_h2")) / n).otherwise(0.0))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return out.drop("__q_text", "__q_words", "__q_h1", "__q_h2")


def accepted(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they came with, whatever their names.

    Null and empty texts have under 20 words and go; ties and repeated rows are judged alike; an empty table
    stays empty; a very long text is judged whole, in one task. A generator drops the others. The optimizer
    would push a filter down through all the projections of judge(), and copy each of their expressions wherever it is used.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__q_row"))
    out = judge(rows, trusted, threshold).withColumn("__q_stay", F.explode(F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))))
    return out.select(*[F.col("__q_row")[c].alias(c) for c in docs.columns])


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


QUERIES = {"op2_quality_rules": op2_quality_rules}
