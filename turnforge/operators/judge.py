"""Judge output: parsing, statistics, agreement, sampling, grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnforge.constants import ISSUE_KEYS, RATING_KEY
from turnforge.functions.text import strip_fences
from turnforge.schemas import judgement_schema

JUDGE_KEYS = ISSUE_KEYS + [RATING_KEY]


def parse_judgements(df: DataFrame, raw: str = "raw", keys: Sequence[str] = JUDGE_KEYS) -> DataFrame:
    """Q6: judge JSON to long form ``(…, issue, label, is_valid)``.

    Strict typing: a label given as text makes the record corrupt.  Fences
    are stripped first.  A record that does not parse gives NULL labels; an
    absent key is *missing* (NULL, not 0); an out-of-range label is kept but
    marked invalid.
    """
    p = F.from_json(strip_fences(F.col(raw)), judgement_schema(keys),
                    {"columnNameOfCorruptRecord": "_corrupt_record"})
    staged = df.withColumn("_p", p).withColumn(
        "_ok", F.col("_p").isNotNull() & F.col("_p._corrupt_record").isNull())
    items = F.array(*[F.struct(F.lit(k).alias("issue"), F.col("_p")[k]["label"].alias("label")) for k in keys])
    long = staged.select(*[c for c in df.columns if c != raw], "_ok", F.explode(items).alias("_it"))
    label = F.when(F.col("_ok"), F.col("_it.label")).cast("bigint")
    in_range = F.when(F.col("_it.issue") == RATING_KEY, label.between(1, 5)).otherwise(label.isin(0, 1))
    return long.select(*[c for c in df.columns if c != raw], F.col("_it.issue").alias("issue"),
                       label.alias("label"), F.coalesce(F.col("_ok") & in_range, F.lit(False)).alias("is_valid"))


def issue_rates(parsed: DataFrame, by: Sequence[str] = ("evaluator", "lang", "model"), total_label: str = "ALL") -> DataFrame:
    """Rate (mean label) and count of valid labels per issue and group, with a
    total row per issue (its group columns are ``total_label``)."""
    by = list(by)
    v = parsed.where(F.col("is_valid"))
    g = v.groupingSets([["issue", *by], ["issue"]], "issue", *by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"),
        F.grouping(by[0]).alias("_g"))
    return g.select(*[F.when(F.col("_g") == 1, F.lit(total_label)).otherwise(F.col(c)).alias(c) for c in by],
                    "issue", "n", "rate")


def agreement(df: DataFrame, judge: str, truth: str, pred: str) -> DataFrame:
    """Per judge, accuracy and Cohen's kappa against reference 0/1 labels.

    One conditional aggregate; kappa in closed form from the confusion counts.
    """
    t, p = F.col(truth) == 1, F.col(pred) == 1
    g = df.groupBy(judge).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    n = F.col("n").cast("double")
    po = (F.col("tp") + F.col("tn")) / n
    pe = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn"))
          + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (n * n)
    kappa = F.when(pe < 1.0, (po - pe) / (F.lit(1.0) - pe))
    return g.select(judge, F.col("n").cast("bigint").alias("n"), F.round(po, 6).alias("accuracy"),
                    F.round(kappa, 6).alias("kappa"))


def stratified_sample(df: DataFrame, by: str, id_col: str, n: int) -> DataFrame:
    """``n`` rows per group in a stable pseudo-random order (md5 of the id, then id).

    The limit is the feature.  ``row_number() <= n`` is planned as a
    per-partition group limit before the shuffle, so a huge group ships at
    most ``n`` rows per map task.
    """
    w = Window.partitionBy(by).orderBy(F.md5(F.col(id_col).cast("string")), F.col(id_col))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def grid(spark: SparkSession, **dims: Sequence[str]) -> DataFrame:
    """The full grid of literal dimensions, generated (not joined) from one row."""
    out = spark.range(1).select(*[F.explode(F.array(*[F.lit(v) for v in vals])).alias(name)
                                  for name, vals in list(dims.items())[:1]])
    for name, vals in list(dims.items())[1:]:
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vals])))
    return out


def flip_when(label: Column, cond: Column) -> Column:
    return F.when(cond, F.lit(1) - label).otherwise(label)
