"""Line deduplication by distinct-site spread, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import fresh, materialize

_NO_SITE = "\u0000"


def line_spread(docs: DataFrame) -> DataFrame:
    """key, site, doc_id, doc_key, pos: one row per line that isn't blank. key: the line's md5, doc_key: the text's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit(_NO_SITE)).alias("site"),
        F.unhex(F.md5(text.cast("binary"))).alias("doc_key"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    )
    return rows.where(F.col("line").rlike(r"\S")).select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"), "site", "doc_id", "doc_key", "pos")


def widespread_lines(lines: DataFrame, min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """key, first: the lines on min_sites sites or more, and the first place (doc_id, doc_key, pos) of each.

    Each line's sites are gathered in a HyperLogLog sketch, merged by partial and final aggregation. Estimates within four standard
    errors of the threshold (and never less than one site) are replaced by exact distinct counts; the others decide at once.
    """
    sketches = materialize(
        lines.groupBy("key").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate"),
            F.min(F.struct("doc_id", "doc_key", "pos")).alias("first"),
        ).where(F.col("estimate") > 1),
        "line-spread",
    )
    margin = max(1.0, 4 * 1.04 / (1 << lg_k) ** 0.5 * min_sites)
    sure = sketches.where(F.col("estimate") > min_sites + margin).select("key", "first")
    near = sketches.where(F.col("estimate").between(min_sites - margin, min_sites + margin)).select("key", "first")
    counted = (
        lines.join(near.select("key"), "key", "left_semi").groupBy("key", "site").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("key")
    )
    return materialize(sure.unionAll(near.join(counted, "key", "left_semi")), "widespread-lines")


def line_dedup(docs: DataFrame, min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """docs with text, n_lines and n_removed: lines found on min_sites sites (sources) or more go, but for their first place.

    A line is what stands between \\n; it counts whole and unchanged. Blank lines never go. The first place is the
    smallest (doc_id, text's md5, position), so that content which copies share stays once in the corpus. A null text
    stays null and has one line; a null source is a site of its own; rows with the same id and text are treated
    alike; no rows give no rows. The result has the columns of docs, then n_lines and n_removed; where docs has columns of these names they stay
    as they are, and the new ones begin with an underscore (see common.fresh).
    """
    n_lines, n_removed = fresh(docs, "n_lines", "n_removed")
    g_id, g_key, g_pos, d_key = fresh(docs, "g_id", "g_key", "g_pos", "d_key")
    lines = materialize(line_spread(docs), "lines")
    wide = widespread_lines(lines, min_sites, lg_k)
    gone = (
        lines.join(wide, "key")
        .where(F.struct("doc_id", "doc_key", "pos") != F.col("first"))
        .groupBy(F.col("doc_id").alias(g_id), F.col("doc_key").alias(g_key)).agg(F.collect_set("pos").alias(g_pos))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    mine = docs.withColumn(d_key, F.unhex(F.md5(text.cast("binary"))))
    joined = mine.join(gone, F.col("doc_id").eqNullSafe(F.col(g_id)) & (F.col(d_key) == F.col(g_key)), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(g_pos, i))
    cleaned = F.when(F.col(g_pos).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[cleaned.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size(F.split(text, "\n", -1)).cast("long").alias(n_lines),
        F.coalesce(F.size(g_pos), F.lit(0)).cast("long").alias(n_removed),
    )


LINE_SQL = """
WITH lines AS (
  SELECT doc_id, md5(coalesce(text, '')) AS doc_key, coalesce(source, chr(0)) AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
wide AS (
  SELECT line, min(row(doc_id, doc_key, pos)) AS first FROM lines WHERE regexp_matches(line, '[^\\t\\n\\x0B\\f\\r ]')
  GROUP BY line HAVING count(DISTINCT site) >= 10),
gone AS (
  SELECT doc_id, doc_key, list(DISTINCT pos) AS places FROM lines JOIN wide USING (line)
  WHERE row(doc_id, doc_key, pos) <> first GROUP BY doc_id, doc_key)
SELECT d.doc_id,
       CASE WHEN places IS NULL THEN text
            ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(places, i)), chr(10)) END AS text,
       CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines,
       CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id AND md5(coalesce(d.text, '')) = g.doc_key
"""
