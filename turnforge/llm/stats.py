"""Statistics of whole texts as built-in Spark expressions, and a bounded labelled sample of them.

Words are `[^\\x20\\x09-\\x0D]+`.  Five-word windows are told apart by their 64-bit
xxhash64, within one text.  ``vocabulary`` is ln(1 + distinct words) / ln(1 + words), which depends on
the length far less than the share of distinct words does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most.
LABELLED_ROWS = 20_000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "vocabulary", "upper_share", "mark_share", "words_a_line"]


def with_stats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns, BASE counts and RATIOS of each row; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text.alias("__text"), F.array_remove(F.split(text, "[ \\t-\\r]+"), "").alias("__words"))
    window = ", ".join(f"__words[i + {k}]" for k in range(5))
    grams = split.withColumn("__grams", F.expr(f"if(size(__words) >= 5, transform(sequence(0, size(__words) - 5), i -> xxhash64({window})), cast(array() as array<bigint>))"))
    twice = F.size(F.array_distinct("__grams")) < F.size("__grams")
    placed = grams.withColumn("__placed", F.when(twice, F.expr("array_sort(transform(__grams, (g, i) -> struct(g, i)))")))
    again = placed.withColumn("__again", F.expr("array_sort(transform(filter(__placed, (x, i) -> x.g <=> get(__placed, i - 1).g or x.g <=> get(__placed, i + 1).g), x -> x.i))"))
    covered = F.coalesce(F.expr("aggregate(transform(__again, (p, i) -> least(5, coalesce(get(__again, i + 1) - p, 5))), 0, (a, x) -> a + x)"), F.lit(0))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    counted = (again.withColumn("__lines", lines)
               .select("doc_id", *keep, F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
                       F.length(F.regexp_replace("__text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                       (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
                       F.size(F.array_distinct("__words")).alias("__distinct"), F.size("__lines").alias("__n_lines"),
                       F.length(F.regexp_replace("__text", "[^A-Z]+", "")).alias("__upper"), F.length(F.regexp_replace("__text", "[^!?]+", "")).alias("__marks")))
    words, chars, of_lines = (F.greatest(c, F.lit(1)).cast("double") for c in ("n_words", "word_chars", "__n_lines"))
    return counted.select("doc_id", *keep, *BASE, (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / chars).alias("symbol_share"),
                          (F.col("n_dup_lines") / of_lines).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"), (F.log1p("__distinct") / F.greatest(F.log1p("n_words"), F.lit(0.5))).alias("vocabulary"),
                          (F.col("__upper") / chars).alias("upper_share"), (F.col("__marks") / chars).alias("mark_share"), (F.col("n_words") / of_lines).alias("words_a_line"))


def labelled(stats: DataFrame, labels: DataFrame, features: list[str], rows: int = LABELLED_ROWS) -> list:
    """(y, features...) of about nine tenths of ``rows`` labelled documents at most; null labels and ids are left out.

    With more labels than that, rows are taken by a hash of their id; the driver gets
    ``rows`` rows at most, in hashed order.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    both = stats.join(known, "doc_id").select(F.xxhash64("doc_id").alias("at"), "doc_id", F.col("y").cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    n = both.count()
    span = 1 << 40
    if n > 0.9 * rows:
        both = both.where(F.pmod("at", F.lit(span)) < int(span * 0.9 * rows / n))
    return sorted(both.limit(rows).collect())
