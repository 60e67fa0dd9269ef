"""Verdicts, score aggregation, summaries and evaluation over scored items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon
from ..functions.text import ratio
from .text_signals import verdict_columns


def add_verdict(scored: DataFrame, score: str = "ai_score") -> DataFrame:
    return scored.withColumns(verdict_columns(F.col(score)))


def aggregate_detectors(scores: DataFrame, keys: Sequence[str], modality: Column | str = "text") -> DataFrame:
    """Weighted mean of each item's detector scores. scores: keys, detector, score (long form).

    The weight table is a handful of literals, so it is a map lookup, not a join; unknown detectors weigh 1. Items whose
    scores are all null get 0.5.
    """
    kind = F.lit(modality) if isinstance(modality, str) else modality
    table = F.create_map(*[F.lit(x) for m, ws in lexicon.DETECTOR_WEIGHTS.items() for d, w in ws.items() for x in (f"{m}/{d}", w)])
    weight = F.coalesce(F.try_element_at(table, F.concat(kind, F.lit("/"), F.col("detector"))), F.lit(1.0))
    used = F.when(F.col("score").isNotNull(), weight)
    combined = F.coalesce(F.try_divide(F.sum(F.col("score") * weight), F.sum(used)), F.lit(0.5))
    return scores.groupBy(*keys).agg(combined.alias("ai_score"), F.sort_array(F.collect_set(F.when(F.col("score").isNotNull(), F.col("detector")))).alias("detectors"))


def detector_mean(scores: Sequence[tuple[str, Column]], modality: str = "text") -> Column:
    """The same for detectors in columns: (detector, score or null)."""
    weights = lexicon.DETECTOR_WEIGHTS[modality]
    total, whole = F.lit(0.0), F.lit(0.0)
    for name, score in scores:
        weight = F.when(score.isNotNull(), F.lit(weights.get(name, 1.0))).otherwise(F.lit(0.0))
        total, whole = total + F.coalesce(score, F.lit(0.0)) * weight, whole + weight
    return F.when(whole == 0, F.lit(0.5)).otherwise(F.try_divide(total, whole))


def batch_summary(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items in all, by verdict, and the mean score."""
    return verdicts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("human").alias("human_items"), F.count_if(~F.col("human")).alias("ai_items"), F.avg("ai_score").alias("mean_score")
    )


def histogram(values: DataFrame, column: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets (le, n): how many values are at most each bound; the last bucket has them all."""
    counts = values.groupBy(*by).agg(*[F.count_if(F.col(column) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count(column).alias("_all"))
    buckets = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n"))]
    return counts.select(*by, F.inline(F.array(*buckets)))


def confusion(predictions: DataFrame, expected: str = "expected", predicted: str = "predicted", by: Sequence[str] = (), positive: str = "ai") -> DataFrame:
    """tp, tn, fp, fn and the metrics in per cent; 0 where a ratio has nothing to divide by."""
    is_positive, said = F.col(expected) == positive, F.col(predicted) == positive
    counts = predictions.groupBy(*by).agg(
        F.count_if(is_positive & said).alias("tp"), F.count_if(~is_positive & ~said).alias("tn"), F.count_if(~is_positive & said).alias("fp"), F.count_if(is_positive & ~said).alias("fn")
    )
    return with_metrics(counts)


def with_metrics(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn) * 100).withColumn("precision", ratio(tp, tp + fp) * 100).withColumn("recall", ratio(tp, tp + fn) * 100)
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("precision") * F.col("recall") * 2, both)))


def confusion_rollup(predictions: DataFrame, by: str, expected: str = "expected", predicted: str = "predicted", positive: str = "ai") -> DataFrame:
    """confusion() by a column, with one row more for all (null), from one pass."""
    is_positive, said = F.col(expected) == positive, F.col(predicted) == positive
    counts = predictions.rollup(by).agg(
        F.count_if(is_positive & said).alias("tp"), F.count_if(~is_positive & ~said).alias("tn"), F.count_if(~is_positive & said).alias("fp"), F.count_if(is_positive & ~said).alias("fn"),
        F.grouping(by).cast("int").alias("is_total"),
    )
    return with_metrics(counts)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """One row per content type with two decimals, as a report has it."""
    columns = [F.format_string("%.2f", F.col(c)).alias(c) if c in ("accuracy", "precision", "recall", "f1") else F.col(c) for c in summary.columns]
    summary.select(*columns).write.mode("overwrite").option("header", True).csv(path)
