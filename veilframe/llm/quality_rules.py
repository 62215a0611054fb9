"""Quality rules: per-document measures, then the frequency of lines across the documents of a host.

Only DataFrame expressions. Lines are normalised (white space collapsed, trimmed, lower case) and hashed; for every host the
number of distinct texts that hold a line is counted (exact copies of a text count once); lines in more than ``max_share`` of the
host's distinct texts, and in more than ``max_texts_per_host``, are removed, and a document that loses more than ``max_lost`` of the words of its distinct lines is rejected as depleted.

Edge cases: a null text has no words and fails the base rules; a null source is a host of its own; repeated rows are all
returned and judged alike; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import GAP, WORD, materialize, small, text_key, words


@dataclass(frozen=True)
class QualityLimits:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_texts_per_host: int = 20
    max_share: float = 0.01
    max_lost: float = 0.7


def line_array(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def measure(docs: DataFrame) -> DataFrame:
    """Adds the counts of a text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Words become 64-bit hashes at once, so the arrays that follow are small and flat.
    step = docs.withColumns({"_w": F.transform(words(F.col("text")), lambda x: F.xxhash64(x)), "_l": line_array(F.col("text")), "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"), "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    step = step.withColumns({"n_words": F.size("_w").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")})
    step = step.withColumn("_t", F.expr("if(size(_w) < 3, array(), transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"))
    # A window found twice stands beside its twin once sorted; most texts have none and skip the sort.
    step = step.withColumn("_s", F.expr("if(size(_t) = size(array_distinct(_t)), null, sort_array(transform(_t, (h, i) -> struct(h, i))))"))
    step = step.withColumn("_p", F.expr("if(_s is null, null, sort_array(transform(filter(_s, (x, k) -> (k > 0 and _s[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(_s) and _s[least(k + 1, size(_s) - 1)].h = x.h)), x -> x.i)))"))
    covered = F.expr("if(_p is null, 0L, aggregate(transform(_p, (p, k) -> if(k + 1 < size(_p), least(3, _p[least(k + 1, size(_p) - 1)] - p), 3)), 0L, (a, x) -> a + x))")
    return step.withColumn("n_repeat_words", covered).drop("_w", "_t", "_s", "_p", "_l")


def normalised_lines(text: Column) -> Column:
    """Distinct (hash, words) of the lines of a text."""
    tidy = lambda x: F.lower(F.btrim(F.regexp_replace(x, GAP, " ")))
    return F.array_distinct(F.transform(F.transform(line_array(text), tidy), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w"))))


def line_losses(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Per (source, text): how many words stand in its distinct lines, and how many of them in lines above the limit."""
    # One row per line, text and host: the copies of a text say nothing about boilerplate.
    texts = docs.select("source", text_key(F.col("text")).alias("_k"), F.explode(normalised_lines(F.col("text"))).alias("_x"))
    # Kept, for the counts and the losses both read it, and the texts should be taken apart once.
    lines = materialize(texts.select("source", "_k", "_x.h", "_x.w").groupBy("source", "_k", "h").agg(F.first("w").alias("w")))
    texts = lines.select("source", "_k").distinct().groupBy(F.col("source").alias("_of")).agg(F.count(F.lit(1)).alias("_texts"))
    common = lines.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limits.max_texts_per_host).join(texts, F.col("source").eqNullSafe(F.col("_of")))
    # A host has no more such lines than a hundred times the lines of its average text: counted, and beyond the limit joined by shuffle.
    common = materialize(common.where(F.col("n") > limits.max_share * F.col("_texts")).select(F.col("source").alias("_src"), F.col("h").alias("_h"), F.lit(True).alias("_common")))
    seen = lines.join(small(common), F.col("source").eqNullSafe(F.col("_src")) & (F.col("h") == F.col("_h")), "left")
    return seen.groupBy("source", "_k").agg(F.sum("w").alias("all_words"), F.sum(F.when(F.col("_common"), F.col("w")).otherwise(0)).alias("lost_words"))


def judge(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """doc_id, the measures, base_failed, lost_words, kept."""
    docs = docs.select("doc_id", "text", "source")
    lost = line_losses(docs, limits).select(F.col("source").alias("_src"), F.col("_k").alias("_kk"), "all_words", "lost_words")
    rows = measure(docs).withColumn("_k", text_key(F.col("text"))).drop("text")
    rows = rows.join(lost, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_k") == F.col("_kk")), "left")
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    lost_words = F.coalesce(F.col("lost_words"), F.lit(0))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~(lost_words > limits.max_lost * F.coalesce(F.col("all_words"), F.lit(0)))).alias("kept"), lost_words.cast("long").alias("lost_words"))
