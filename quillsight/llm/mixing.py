"""Mixing sources to target weights: hash-random keys, distributed prefix sums, exact budgets, repeated epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize
from .ranking import numbered

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """source, source_size, target: one row per source, with its target. sizes: source, source_size.

    Sources take the weights in code-point order (null last), in turn. A target stops at most_epochs times its
    source's size; what it leaves is shared by weight among the rest. That is a water level, (all - caps filled) / weights left: each round fills the
    caps below the level, which lifts it, until no more are below. A round is one aggregation; no task sees all sources, and only sums reach the driver.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    rows = (
        numbered(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "place")
        .withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    total, all_weights = rows.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level, filled, below = 0.0, 0.0, 0.0
    while total and below < all_weights:
        level = (total - filled) / (all_weights - below)
        more = rows.where(F.col("ratio") < level).agg(F.sum("cap"), F.sum("weight")).first()
        if (more[0] or 0.0, more[1] or 0.0) == (filled, below):
            break
        filled, below = more[0] or 0.0, more[1] or 0.0
    return rows.select("source", "source_size", F.least("cap", F.lit(float(level)) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3, key_digits: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source).

    A document's key is the md5 of its id, so the order within a source is random and the same in every run. The key
    space is cut into 16**key_digits ranges; the ranges' sums, then the rows within each range, give every
    row's prefix sum, so no task holds a whole source. A source's budget is floor(target) words: whole epochs first, then
    documents in key order, the last one cut at the budget.

    A null text has size 0 and is taken 0 times; a null source is a source of its own; rows that share a doc_id are
    ordered by size and equal ones are interchangeable; no rows give no rows. Other columns are ignored.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
        ),
        "mix-sizes",
    ).withColumn("range", F.substring("key", 1, key_digits))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("skip", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    targets = source_targets(materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes"), weights, most_epochs)
    budgets = targets.select(
        F.col("source").alias("t_source"),
        "source_size",
        "target",
        F.floor(F.coalesce("target", F.lit(0.0))).cast("long").alias("budget"),
    )
    plan = (
        ranges.join(budgets, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .select(
            F.col("source").alias("p_source"), F.col("range").alias("p_range"), "skip", "source_size",
            F.coalesce("target", F.lit(0.0)).alias("target"), "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("left"),
        )
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range"))).withColumn(
        "before", F.col("skip") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sources),
weighed AS (
  SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM placed),
levels AS (
  SELECT *, (total - filled) / open AS level FROM (
    SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
           sum(cap) OVER w - cap AS filled, sum(weight) OVER () - (sum(weight) OVER w - weight) AS open
    FROM weighed WINDOW w AS (ORDER BY cap / weight, place))),
targets AS (
  SELECT source, source_size,
         coalesce(least(cap, (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, place LIMIT 1) * weight), 0.0::DOUBLE) AS target
  FROM levels),
epochs AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS full_epochs
  FROM targets),
ordered AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s)
SELECT o.doc_id, o.size, e.source_size, e.target,
       CAST(full_epochs * o.size + least(o.size, greatest(0, budget - full_epochs * source_size - before)) AS BIGINT) AS taken
FROM ordered o JOIN epochs e ON o.source IS NOT DISTINCT FROM e.source
"""
